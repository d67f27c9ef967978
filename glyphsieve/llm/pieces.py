"""SentencePiece encoding and decoding by one pass of an Aho-Corasick automaton over the pieces."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphsieve.llm.common import texts_of, tidy

SPACE = "▁"
UNIGRAM, BPE = 1, 2
_CODECS: dict[str, "PieceCodec"] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a serialised protocol buffer."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            at += n
            yield key >> 3, data[at - n : at]
        else:
            n = 4 if key & 7 == 5 else 8
            at += n
            yield key >> 3, data[at - n : at]


class PieceCodec:
    """Encodes and decodes with the pieces of a model file.

    Spaces become SPACE, one is put in front, and the text is cut where no piece can reach across. In each cut, the
    automaton gives the pieces that end at each position, following output links from the longest to the shorter
    ones, and each relaxes its end from the best segmentation up to its start.
    For unigram models that is the best sum of scores. For BPE models a segmentation is what merging yields exactly if
    every two neighbours are what merging their joint text yields, so a piece relaxes its end if it can follow
    the last piece of its start, and there is one such piece at most. Characters in no piece become byte pieces. A
    SPACE in the text itself becomes byte pieces too, so decoding gives the text back exactly.
    """

    def __init__(self, path: str, entries: int = 300_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            spec = dict(x for k, v in _fields(f.read()) if k == 2 for x in _fields(v))
        self.kind = spec.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("neither a unigram nor a BPE model")
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.scores = [model.get_score(i) for i in range(n)]
        self.bytes = {int(self.pieces[i][3:-1], 16): i for i in range(n) if model.is_byte(i)}
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if len(self.bytes) < 256 or any(re.search(f"[^{SPACE}]{SPACE}", self.pieces[i]) for i in normal):
            raise ValueError("needs byte pieces, and pieces that hold spaces only in front")
        self.ids = {self.pieces[i]: i for i in normal}
        self.chars = set("".join(self.ids))
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (len(p), i))
        if self.kind == BPE:  # merging starts from characters, pieces or not
            for c in self.chars - self.ids.keys():
                self.automaton.add_word(c, (1, -ord(c)))
        self.automaton.make_automaton()
        self.unknown = min(self.scores[i] for i in normal) - 10
        bare = "".join(re.escape(c) for c in "\n\t\r" if c not in self.chars)
        self.cuts = re.compile(f"{SPACE}*[^{SPACE}{bare}]+|{SPACE}+" + (f"|[{bare}]" if bare else ""))
        self.entries, self.units, self.old, self.follows = entries, {}, {}, {}
        self.byte_of = {i: bytes([b]) for b, i in self.bytes.items()}
        known = set(normal)
        self.raw = [self.byte_of[i] if i in self.byte_of else p.replace(SPACE, " ").encode("utf-8", "surrogatepass") if i in known else b"" for i, p in enumerate(self.pieces)]

    def _merge(self, text: str) -> list[str]:
        """What merging yields: the neighbours whose joint piece scores best are joined, from the left, until none can be."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _string(self, i: int) -> str:
        return self.pieces[i] if i >= 0 else chr(-i)

    def _can_follow(self, a: int | None, b: int) -> bool:
        key = (a, b)
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > 1_000_000:
                self.follows.clear()
            pair = [self._string(x) for x in (a, b) if x is not None]
            known = self.follows[key] = self._merge("".join(pair)) == pair
        return known

    def _spell(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")]

    def _segment(self, text: str) -> list[int]:
        """ids of a cut of characters that pieces hold."""
        n = len(text)
        last: list[int | None] = [None] * (n + 1)
        size = [0] * (n + 1)
        if self.kind == BPE:
            follows = self.follows
            for end, (length, i) in self.automaton.iter(text):
                end += 1
                start = end - length
                if size[end] or (start and not size[start]):
                    continue
                ok = follows.get((last[start], i))
                if ok or (ok is None and self._can_follow(last[start], i)):
                    last[end], size[end] = i, length
        else:
            best = [0.0] + [-np.inf] * n
            ended = 0
            for end, (length, i) in [*self.automaton.iter(text), (n, (0, -1))]:
                for k in range(ended + 1, end + 1):  # ends that the pieces before have settled
                    if best[k - 1] + self.unknown > best[k] and not size[k]:
                        best[k], last[k], size[k] = best[k - 1] + self.unknown, -ord(text[k - 1]), 1
                    ended = k
                if length and best[end + 1 - length] + self.scores[i] > best[end + 1]:
                    best[end + 1], last[end + 1], size[end + 1] = best[end + 1 - length] + self.scores[i], i, length
        out, at = [], n
        while at:
            out.append(last[at])
            at -= size[at]
        return [x for i in reversed(out) for x in ([i] if i >= 0 else self._spell(chr(-i)))]

    def _unit(self, unit: str) -> bytes:
        ids: list[int] = []
        at = 0
        for k, c in enumerate(unit):
            if c not in self.chars:
                if k > at:
                    ids += self._segment(unit[at:k])
                ids += self._spell(c)
                at = k + 1
        if at < len(unit):
            ids += self._segment(unit[at:])
        return np.array(ids, "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        """ids of a text in which SPACE stands for spaces alone."""
        units = self.cuts.findall(text)
        if len(self.units) > self.entries:
            self.old, self.units = self.units, {}
        known = self.units
        for u in set(units).difference(known):
            known[u] = self.old.get(u) or self._unit(u)
        return b"".join(map(known.__getitem__, units))

    def encode(self, text: str) -> bytes:
        """ids of a whole text, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        mark = np.array(self._spell(SPACE), "<u4").tobytes()
        first, *rest = text.split(SPACE)
        return mark.join([self._plain(SPACE + first.replace(" ", SPACE)), *[self._plain(x.replace(" ", SPACE)) for x in rest]])

    def decode(self, ids: bytes) -> str:
        """The text of ids, without the space put in front; control pieces are nothing, bytes that are no UTF-8 are marked."""
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        try:
            text = raw.decode("utf-8", "surrogatepass")
        except UnicodeDecodeError:
            text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def codec(path: str) -> PieceCodec:
    """One codec for each worker process and file; its caches outlive tasks."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


CODED = "doc_id long, ids binary, n_tokens long, ids_crc32 long, decoded string"


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), n_tokens, ids_crc32, decoded of every row of docs (doc_id, text).

    decoded is what the ids alone give back. Nulls: a null text is empty and has no ids; a null doc_id stays. Repeated
    rows are encoded each, texts of any length whole, in one worker. An empty table gives no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                some = b.slice(at, 1000)
                ids = [own.encode(t) for t in texts_of(some.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([own.decode(x) for x in ids], pa.string())],
                    [c.split()[0] for c in CODED.split(", ")],
                )
            tidy()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, CODED)


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, n_chars and decoded_sha256 of the text decoded from the ids of every row of docs."""
    coded = encode(docs, model)
    return coded.select("doc_id", "n_tokens", "ids_crc32", F.length("decoded").cast("long").alias("n_chars"), F.sha2("decoded", 256).alias("decoded_sha256"))
