"""Rules to small relations. Pure Python; no session is needed unless a rule asks for a transform whose table comes from ICU."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache, cached_property

from glyphsieve import tables
from glyphsieve.flags import EmptyPatterns, ProcessType, RuleError
from glyphsieve.tables import Own

BOUNDARY = "\\b"
_OPERATORS = re.compile(r"[&~|\\]")


@dataclass(frozen=True)
class Alternative:
    """A pattern as it is looked for, and whether a word must start or end with it."""

    pattern: str
    left: bool
    right: bool


@dataclass(frozen=True)
class Segment:
    """Alternatives whose hits are counted together; negative segments veto once a variant has quota hits, others need as many."""

    number: int
    negative: bool
    quota: int
    alternatives: tuple[Alternative, ...]


@dataclass(frozen=True)
class Rule:
    process_type: ProcessType
    word_id: int
    word: str
    segments: tuple[Segment, ...]

    @property
    def needed(self) -> tuple[Segment, ...]:
        return tuple(s for s in self.segments if not s.negative)


@dataclass
class Compiled:
    """Rules in order of type and id. Those of one literal, as most of a large table are, are kept as their pattern alone."""

    rows: list[tuple[int, int, str]]  # process_type, word_id, word
    literals: list[str | None]  # the pattern of a rule that is one literal
    parsed: dict[int, Rule]  # the others, by number
    own: Own = None  # tables that take the place of derived ones

    @cached_property
    def rules(self) -> list[Rule]:
        single = lambda p: (Segment(0, False, 1, (Alternative(p, False, False),) if p else ()),)
        types = {pt: ProcessType(pt) for pt in {r[0] for r in self.rows}}
        return [self.parsed[k] if p is None else Rule(types[pt], word_id, word, single(p)) for k, ((pt, word_id, word), p) in enumerate(zip(self.rows, self.literals, strict=True))]

    @cached_property
    def patterns(self) -> list[str]:
        return sorted({e[1] for e in self.entries()})

    def types(self) -> list[int]:
        return sorted({r[0] for r in self.rows})

    def entries(self) -> Iterable[tuple[int, str, bool, bool, int, int]]:
        """process_type, pattern, left, right, rule number, segment number"""
        for k, p in enumerate(self.literals):
            if p:
                yield self.rows[k][0], p, False, False, k, 0
            elif p is None:
                for s in self.parsed[k].segments:
                    for a in s.alternatives:
                        yield self.rows[k][0], a.pattern, a.left, a.right, k, s.number


@cache
def _pattern_steps(pt: ProcessType) -> tuple[ProcessType, ...]:
    return tuple(step for step in pt.steps() if step != ProcessType.DELETE)


def emitted(pt: ProcessType, pattern: str, own: Own = None) -> str:
    """A pattern under all transforms of pt but Delete, which concerns texts alone."""
    for step in _pattern_steps(pt):
        pattern = tables.translate(step, pattern, own)
    return pattern


def _alternatives(pt: ProcessType, segment: str, own: Own) -> tuple[Alternative, ...]:
    out: dict[Alternative, None] = {}
    for part in segment.split("|"):
        left = part.startswith(BOUNDARY)
        part = part[2:] if left else part
        right = part.endswith(BOUNDARY)
        part = part[:-2] if right else part
        if part and (pattern := emitted(pt, part, own)):
            out[Alternative(pattern, left, right)] = None
    return tuple(out)


def parse(pt: ProcessType, word_id: int, word: str, own: Own = None) -> Rule | None:
    """A rule, or None if it asks for no segment. & and ~ begin a needed and a vetoing segment; | parts alternatives. A segment
    written k times has quota k; segments are told apart by their text."""
    needed: dict[str, int] = {}
    vetoing: dict[str, int] = {}
    kind = needed
    for token in re.findall(r"[&~]|[^&~]+", word):
        if token in "&~":
            kind = needed if token == "&" else vetoing
        else:
            kind[token] = kind.get(token, 0) + 1
    if not needed:
        return None
    segments = [(False, *x) for x in needed.items()] + [(True, *x) for x in vetoing.items()]
    return Rule(pt, word_id, word, tuple(Segment(k, neg, quota, _alternatives(pt, text, own)) for k, (neg, text, quota) in enumerate(segments)))


def compile_rules(rows: Iterable[tuple[int, int, str]], own: Own = None) -> Compiled:
    """Rows are (process_type, word_id, word). Of rows with one normalized type and id the last stays.

    Raises InvalidProcessType for a type outside 1..127, RuleError for other bad rows, and EmptyPatterns if nothing is left to look for.
    """
    last: dict[tuple[int, int], str] = {}
    types: dict[int, int] = {}
    for pt, word_id, word in rows:
        if word.__class__ is not str or word_id.__class__ is not int:
            raise RuleError(f"not a rule: {(pt, word_id, word)!r}")
        kind = types.get(pt) if pt.__class__ is int else None
        if kind is None:
            kind = types[int(pt)] = int(ProcessType.checked(pt).normalized())
        last[kind, word_id] = word
    made = Compiled([], [], {}, own)
    plain = {pt: None if _pattern_steps(ProcessType(pt)) else True for pt in set(types.values())}  # types under which a pattern is looked for as written
    for (pt, word_id), word in sorted(last.items()):
        if word and not _OPERATORS.search(word):
            made.literals.append(word if plain[pt] else emitted(ProcessType(pt), word, own))
        elif rule := parse(ProcessType(pt), word_id, word, own):
            made.parsed[len(made.rows)] = rule
            made.literals.append(None)
        else:
            continue
        made.rows.append((pt, word_id, word))
    if next(iter(made.entries()), None) is None:
        raise EmptyPatterns("no rule has a pattern")
    return made
