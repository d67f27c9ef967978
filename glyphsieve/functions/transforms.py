"""Text transforms as column expressions.

Each transform maps single characters, so any sequence of them is one table. Where that maps characters to one or none, it is a
built-in expression; texts with a character that may become several go through an Arrow UDF, the others never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphsieve import tables
from glyphsieve.flags import ProcessType
from glyphsieve.tables import Own, Table


#: Bytes of texts that are mapped at once: what a task holds besides a batch and its result follows these.
PIECE = 1 << 21
#: Up to so many mapped characters in a piece are replaced one after another.
FEW = 12


def _occurring(texts: list[str | None]) -> list[int]:
    """The distinct codepoints of texts."""
    seen = np.zeros(0x110000, bool)
    text = "".join(filter(None, texts))
    for k in range(0, len(text), PIECE):
        seen[np.frombuffer(text[k : k + PIECE].encode("utf-32-le"), "<u4")] = True
    return np.flatnonzero(seen).tolist()


def _mapped_piece(texts: pa.Array, table: Table) -> pa.Array:
    strings = texts.to_pylist()
    codes = _occurring(strings)
    put = {chr(c): table[c] or "" for c in codes if c in table}
    if len(put) <= FEW and not any(c in s for s in put.values() for c in put):  # none makes another's character
        for c, s in put.items():
            texts = pc.replace_substring(texts, c, s)
        return texts
    every = {c: table.get(c, c) for c in codes}  # an entry for each, as a missing one costs translate an exception
    return pa.array([t and t.translate(every) for t in strings], texts.type)


def mapped_pieces(texts: pa.Array, table: Table) -> Iterator[pa.Array]:
    """Each text by table, in order. A batch is taken by pieces, so that no more of it than a piece, or one long text, is held as Python strings."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PIECE, "right")))
        yield _mapped_piece(texts.slice(at, to - at), table)
        at = to


def mapped(texts: pa.Array, table: Table) -> pa.Array:
    """mapped_pieces as one array."""
    return pa.concat_arrays([texts.slice(0, 0), *mapped_pieces(texts, table)])


class Mapping:
    """A table as an expression. Its UDF holds the table in its closure: executors derive none."""

    def __init__(self, table: Table):
        single = {c: s for c, s in table.items() if s and len(s) == 1}
        gone = [c for c, s in table.items() if not s]
        self.matching, self.replace = "".join(map(chr, [*single, *gone])), "".join(single.values())
        several = sorted(c for c, s in table.items() if s and len(s) > 1)
        self.span = f"[\\x{{{several[0]:x}}}-\\x{{{several[-1]:x}}}]" if several else ""

        @F.arrow_udf("string")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:  # a result goes to the JVM piece by piece: a task holds a batch, but not its result, which may be some times as long
                yield from mapped_pieces(texts, table)

        self.run = run

    def __call__(self, text: Column) -> Column:
        plain = F.translate(text, self.matching, self.replace) if self.matching else text
        if not self.span:
            return plain
        # one range, not the characters themselves: a class of some thousand is slow and nests too deep, and taking them out of a text to see
        # whether it had any costs more than mapping a text that has none
        needs = text.rlike(self.span)
        return F.when(needs, self.run(F.when(needs, text))).otherwise(plain)


@cache
def _derived(steps: tuple[int, ...]) -> Mapping:
    return Mapping(tables.composed(steps))


def steps_of(pt: int) -> list[ProcessType]:
    """Single transforms of pt in their order; 0, no transform at all, leaves a text as it is."""
    return ProcessType.checked(pt).normalized().steps() if pt else []


def prefixes(text: Column, pt: int, own: Own = None) -> list[Column]:
    """The text after each step, in order; without steps nothing. Each is read off the text itself, not off the one before."""
    steps = tuple(map(int, steps_of(pt)))
    parts = [steps[: k + 1] for k in range(len(steps))]
    return [(Mapping(tables.composed(s, own)) if own else _derived(s))(text) for s in parts]


def text_process(pt: int, text: Column, own: Own = None) -> Column:
    """The text after all transforms of pt. own replaces derived tables, by transform bit (see sources.read_table)."""
    steps = tuple(map(int, steps_of(pt)))
    if not steps:
        return text
    return (Mapping(tables.composed(steps, own)) if own else _derived(steps))(text)


def reduce_text_process(pt: int, text: Column, own: Own = None) -> Column:
    """Array of the text and of each transform's result that differs from the one before."""
    every = F.array(text, *prefixes(text, pt, own))
    return F.transform(F.array(every), lambda a: F.filter(a, lambda v, i: (i == 0) | ~v.eqNullSafe(F.get(a, i - 1))))[0]


def reduce_text_process_emit(pt: int, text: Column, own: Own = None) -> Column:
    """As reduce_text_process, but a changed result takes the place of the last entry, except that Delete's adds one."""
    out, last = F.array(text), text
    for step, now in zip(steps_of(pt), prefixes(text, pt, own), strict=True):
        kept = out if step == ProcessType.DELETE else F.slice(out, 1, F.size(out) - 1)
        out = F.when(now.eqNullSafe(last), out).otherwise(F.concat(kept, F.array(now)))
        last = now
    return out


def variants(pt: int, text: Column, own: Own = None) -> list[Column]:
    """The forms of a text in which a rule of type pt is looked for: the result of each step, and the text itself if
    there is no step or the first is Delete."""
    first = steps_of(pt)[:1]
    return ([text] if not first or first[0] == ProcessType.DELETE else []) + prefixes(text, pt, own)
