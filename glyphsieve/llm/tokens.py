"""Exact, cached encoding of whole texts with a public tokenizer file."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ENCODERS: dict[tuple[str, int], "ChunkEncoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Texts of these characters, none of which composes with a neighbour or has more than one lower-case character, are cut
#: into pieces here; others are cut at white space only and left to the library.
_PLAIN = "^[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]*$"
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u017e"
_ODD = f"([0-9]|[^\t-\r 0-9{_LETTERS}]+)"
_PIECE = f"('s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\t-\r 0-9{_LETTERS}]+)"


class _TwoAges:
    """A dictionary that forgets: once young is full, it starts anew, and what is missing is looked up in what it was before."""

    def __init__(self, entries: int):
        self.entries, self.young, self.old = entries, {}, {}

    def turn(self) -> None:
        if len(self.young) > self.entries:
            self.old, self.young = self.young, {}

    def missing(self, keys: Iterable) -> list:
        """The keys that neither age has; those of the old age are taken over."""
        out, old, young = [], self.old, self.young
        for k in keys:
            v = old.get(k)
            if v is None:
                out.append(k)
            else:
                young[k] = v
        return out


class ChunkEncoder:
    """ids of a text, as little-endian unsigned 32-bit integers.

    For tokenizers whose pieces never hold white space (their pre-tokenizer drops it), the ids of a text are those of
    its chunks between ASCII white space, one after another. If the tokenizer also lower-cases and cuts at letters,
    digits and the rest, the same holds for these pieces. So texts are cut by columnar string functions, equal pieces
    of a batch are found by dictionary encoding, their ids kept in a bounded cache, and the library encodes only
    pieces that the cache lacks. Both properties are probed when the file is loaded; a tokenizer without
    the first encodes whole texts.
    """

    def __init__(self, path: str, entries: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunks, self.pieces = _TwoAges(entries), _TwoAges(entries)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        probe = "Ab c.\n\n d,\te'south 12x \u00c9a's ##..' A\u0110z-_9 x'll'"
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        whole = ids(probe)
        self.by_chunk = whole == [i for c in probe.split() for i in ids(c)]
        self.by_piece = self.by_chunk and whole == [i for p in re.findall(_PIECE, probe.lower()) for i in ids(p)]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _lines(self, chunks: list[str]) -> list[bytes]:
        """Chunks are encoded as lines of some hundred; a token belongs to the chunk in which its characters start."""
        out: list[bytes] = []
        for at in range(0, len(chunks), 400):
            some = chunks[at : at + 400]
            ends = np.cumsum([len(c) + 1 for c in some])
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            starts = np.fromiter((s for s, _ in e.offsets), np.int64, len(e.ids))
            ids = np.array(e.ids, "<u4").tobytes()
            cuts = [0, *(np.searchsorted(starts, ends) * 4).tolist()]
            out += [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def _known(self, cache: _TwoAges, keys: list[str]) -> list[bytes]:
        """ids of each of keys, which differ from each other."""
        cache.turn()
        young = cache.young
        fresh = cache.missing([k for k in keys if k not in young])
        young.update(zip(fresh, self._lines(fresh), strict=True))
        return list(map(young.__getitem__, keys))

    def _join(self, cut: pa.ListArray, cache: _TwoAges) -> list[bytes]:
        """ids of the strings of each list, one after another."""
        words = cut.flatten().dictionary_encode()
        own = self._known(cache, words.dictionary.to_pylist())
        length = np.array([len(x) for x in own], np.int32) // 4
        start = np.cumsum(length, dtype=np.int32) - length
        flat = np.frombuffer(b"".join(own), "<u4")
        which = words.indices.to_numpy()
        n = length[which]
        ends = np.cumsum(n, dtype=np.int32)
        ids = flat[np.repeat(start[which] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)].tobytes()
        lists = cut.offsets.to_numpy()
        bounds = (np.concatenate(([0], ends)).astype(np.int64)[lists - lists[0]] * 4).tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _pieces(self, texts: list[str]) -> list[bytes]:
        low = pc.utf8_lower(pa.array(texts, pa.large_string()))
        quoted = pc.match_substring(low, "'")
        spaced = pc.if_else(quoted, pc.replace_substring_regex(pc.if_else(quoted, low, ""), _PIECE, "\\1 "), pc.replace_substring_regex(pc.if_else(quoted, "", low), _ODD, " \\1 "))
        spaced = pc.ascii_trim_whitespace(spaced).cast(pa.string())
        full = pc.not_equal(spaced, "")
        own = iter(self._join(pc.ascii_split_whitespace(spaced.filter(full)), self.pieces))
        return [next(own) if f else b"" for f in full.to_pylist()]

    def _chunks(self, texts: list[str]) -> list[bytes]:
        split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        each = sorted(set().union(*split))
        ids = dict(zip(each, self._known(self.chunks, [c.decode("utf-8", "surrogatepass") for c in each]), strict=True))
        return [b"".join(map(ids.__getitem__, words)) for words in split]

    def encode(self, texts: Iterable[str], batch_chars: int = 2 << 20) -> list[bytes]:
        texts = list(texts)
        if not self.by_chunk:
            return self._whole(texts)
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and chars <= batch_chars:
                chars += len(texts[to])
                to += 1
            some, at = texts[at:to], to
            if self.by_piece:
                array = pa.array(some, pa.large_string())
                plain = pc.and_not(pc.match_substring_regex(array, _PLAIN), pc.match_substring(array, "<|")).to_pylist()
            else:
                plain = [False] * len(some)
            easy = iter(self._pieces([t for t, p in zip(some, plain, strict=True) if p]) if any(plain) else ())
            hard = iter(self._chunks([t for t, p in zip(some, plain, strict=True) if not p]) if not all(plain) else ())
            out += [next(easy) if p else next(hard) for p in plain]
        return out


def encoder(path: str, entries: int = 150_000) -> ChunkEncoder:
    """One encoder for each worker process and file; its cache outlives tasks."""
    if (path, entries) not in _ENCODERS:
        _ENCODERS[path, entries] = ChunkEncoder(path, entries)
    return _ENCODERS[path, entries]
