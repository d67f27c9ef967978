"""Token ids of a corpus as wavelet matrices: one compressed, searchable file for each shard."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsieve.llm.common import scratch_path, shuffle_partitions, small_batches, texts_of, tidy
from glyphsieve.llm.tokens import encoder

MAGIC = b"GWM2"
ROWS, BATCH_CHARS, CACHED = 4096, 8 << 20, 500_000  # of a batch, of what is encoded at once, and pieces whose ids a worker keeps
BLOCK = 64  # bytes of a plane for each entry of its rank directory
PIECE = 1 << 16  # bytes of a plane that are compressed by themselves, so that access unpacks no more
STORE = "part int, seq int, first_token long, n_tokens long, doc_ids binary, id_known binary, lengths binary, payload binary"


class WaveletMatrix:
    """Sequence of n ids below 2**width. Plane l holds bit width-1-l of each id, in the order left by the planes above:
    stably, first ids whose last bit was 0 (zeros[l] of them), then the rest. access, rank, select and count take
    O(width) rank or select steps; decode gives all ids. A plane is kept as its compressed rank directory (ones before each block) and
    its compressed pieces; both are unpacked when first asked for."""

    def __init__(self, n: int, width: int, zeros: list[int], packed: list[list[bytes]]):
        self.n, self.width, self.zeros = n, width, zeros
        self._packed, self._directories, self._pieces = packed, {}, {}

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        squeeze = zstandard.ZstdCompressor(level=1)

        def packed(plane: bytes) -> list[bytes]:
            raw = np.frombuffer(plane + bytes(-len(plane) % BLOCK), np.uint8).reshape(-1, BLOCK)
            ones = np.concatenate(([0], np.cumsum(np.bitwise_count(raw).sum(1, dtype=np.int64))))
            return [squeeze.compress(ones.astype("<u4" if len(ids) < 1 << 32 else "<u8").tobytes()), *(squeeze.compress(plane[i : i + PIECE]) for i in range(0, len(plane), PIECE))]

        values, zeros, planes = ids.astype(np.uint16 if width <= 16 else np.uint32), [], []
        for level in range(width):
            bits = (values & values.dtype.type(1 << (width - 1 - level))) != 0
            planes.append(packed(np.packbits(bits, bitorder="little").tobytes()))
            zeros.append(len(ids) - int(np.count_nonzero(bits)))
            if level + 1 < width:
                parted = np.empty_like(values)
                np.compress(bits, values, out=parted[zeros[-1] :])
                np.compress(np.logical_not(bits, out=bits), values, out=parted[: zeros[-1]])
                values = parted
        return cls(len(ids), width, zeros, planes)

    def to_bytes(self) -> bytes:
        sizes = [len(x) for plane in self._packed for x in plane]
        head = struct.pack("<4sQB", MAGIC, self.n, self.width) + struct.pack(f"<{self.width + len(sizes)}Q", *self.zeros, *sizes)
        return head + b"".join(x for plane in self._packed for x in plane)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, n, width = struct.unpack_from("<4sQB", data)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix")
        at, each = struct.calcsize("<4sQB"), 1 + -(-((n + 7) // 8) // PIECE)
        numbers = struct.unpack_from(f"<{width + width * each}Q", data, at)
        at += 8 * len(numbers)
        ends = np.cumsum([at, *numbers[width:]]).tolist()
        view = memoryview(data)
        parts = [view[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        return cls(n, width, list(numbers[:width]), [parts[k * each : (k + 1) * each] for k in range(width)])

    def _raw(self, level: int) -> np.ndarray:
        """Bytes of a plane."""
        unpack = zstandard.ZstdDecompressor()
        return np.frombuffer(b"".join(unpack.decompress(x) for x in self._packed[level][1:]), np.uint8)

    def _directory(self, level: int) -> np.ndarray:
        """Ones of a plane before each block, and of all of it."""
        if level not in self._directories:
            raw = zstandard.ZstdDecompressor().decompress(self._packed[level][0])
            self._directories[level] = np.frombuffer(raw, "<u4" if self.n < 1 << 32 else "<u8").astype(np.int64)
        return self._directories[level]

    def _piece(self, level: int, k: int) -> np.ndarray:
        if (level, k) not in self._pieces:
            self._pieces[level, k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._packed[level][1 + k]), np.uint8)
        return self._pieces[level, k]

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, rest = divmod(i, 8 * BLOCK)
        count = int(self._directory(level)[block])
        if rest:
            whole, odd = divmod(rest, 8)
            k, at = divmod(block * BLOCK, PIECE)
            raw = self._piece(level, k)
            count += int(np.bitwise_count(raw[at : at + whole]).sum(dtype=np.int64))
            count += (int(raw[at + whole]) & ((1 << odd) - 1)).bit_count() if odd else 0
        return count

    def _find(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of that kind in a plane."""
        directory = self._directory(level)
        lo, hi = 0, self.n
        held = directory if bit else np.arange(len(directory)) * 8 * BLOCK - directory
        block = int(np.searchsorted(held, k, side="right")) - 1
        lo, hi = block * 8 * BLOCK, min(self.n, (block + 1) * 8 * BLOCK)
        while lo < hi:  # the smallest i with more than k such bits among the first i + 1
            mid = (lo + hi) // 2
            ones = self._ones(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.width):
            before = self._ones(level, i)
            bit = self._ones(level, i + 1) - before
            value = value << 1 | bit
            i = self.zeros[level] + before if bit else i - before
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        if token >> self.width:
            return 0, 0
        for level in range(self.width):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.width - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences among the first i ids."""
        lo, hi = self._range(token, min(max(i, 0), self.n))
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence (from 0), or -1."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            return -1
        at = lo + k
        for level in reversed(range(self.width)):
            bit = token >> (self.width - 1 - level) & 1
            at = self._find(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids, from the last plane up: each plane tells how to merge what the one below had parted."""
        values = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for level in reversed(range(self.width)):
            bits = np.unpackbits(self._raw(level), count=self.n, bitorder="little").view(bool)
            merged, high = np.empty_like(values), values[self.zeros[level] :]
            high |= values.dtype.type(1 << (self.width - 1 - level))
            merged[bits] = high
            merged[np.logical_not(bits, out=bits)] = values[: self.zeros[level]]
            values = merged
        return values


def _encoded(docs: DataFrame, tokenizer: str, end_id: int, bounds: list[int]) -> DataFrame:
    cuts = np.array(bounds, np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, end = encoder(tokenizer, CACHED), struct.pack("<I", end_id)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                ids = [x + end for x in codec.encode(texts_of(part.column(1)), BATCH_CHARS)]
                if not codec.wide:
                    ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
                keys = part.column(0)
                where = np.searchsorted(cuts, keys.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), side="left")
                yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.binary()), pa.array(where.astype(np.int32))], ["doc_id", "ids", "part"])
        tidy()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, ids binary, part int")


def write_store(docs: DataFrame, tokenizer: str, end_id: int = 1, shard_tokens: int = 4 << 20, path: str | None = None) -> str:
    """Encode docs (doc_id, text), append end_id to each, and write shards in ascending doc_id order; gives the path.

    A shard is one Parquet file of one row: its documents and the wavelet matrix of their ids; it closes at the first
    document with which it holds shard_tokens ids, so a task holds one shard at a time. Documents are dealt to parts
    by doc_id cuts from a sketch of the doc_id column alone, so texts are encoded once; a part is one task.
    Nulls: a null text is empty (its ids are [end_id]); null doc_ids come first. Rows that repeat a doc_id all stay,
    ordered by their ids. A text of any length is encoded whole, in one worker, and is in one shard. An empty table gives an empty
    store. Other columns are not read.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [k / parts for k in range(1, parts)], 100 * parts).alias("c")).first().c if parts > 1 else []
    wide = encoder(tokenizer).wide

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, first, held, size = 0, 0, 0, [], 0

        def shard() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x[1] for x in held), "<u4" if wide else "<u2")
            lengths = np.array([len(x[1]) // (4 if wide else 2) for x in held], "<i8")
            keys = np.array([x[0] or 0 for x in held], "<i8")
            known = np.array([x[0] is not None for x in held], np.uint8)
            row = [part, seq, first, len(ids), keys.tobytes(), known.tobytes(), lengths.tobytes(), WaveletMatrix.build(ids).to_bytes()]
            names = ["part", "seq", "first_token", "n_tokens", "doc_ids", "id_known", "lengths", "payload"]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for b in batches:
            for key, ids, where in zip(*(c.to_pylist() for c in b.columns), strict=True):
                part = where
                held.append((key, ids))
                size += len(ids) // (4 if wide else 2)
                if size >= shard_tokens:
                    yield shard()
                    seq, first, held, size = seq + 1, first + size, [], 0
        if held:
            yield shard()
        tidy()

    out = path or scratch_path(spark, "wavelet")
    coded = _encoded(docs, tokenizer, end_id, [c for c in cuts or []])
    dealt = coded.repartitionById(parts, "part").sortWithinPartitions("doc_id", "ids")
    with small_batches(spark, ROWS):
        dealt.mapInArrow(pack, STORE).write.option("maxRecordsPerFile", 1).option("compression", "none").parquet(out)
    return out


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORE).parquet(path)


def read_documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of a store: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and if asked their ids."""
    totals = read_shards(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # one small row for each part
    base, so_far = {}, 0
    for r in sorted(totals, key=lambda r: r.part):
        base[r.part] = so_far
        so_far += r.n

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = WaveletMatrix.from_bytes(r["payload"]).decode().astype("<u4")
                lengths, keys = np.frombuffer(r["lengths"], "<i8"), np.frombuffer(r["doc_ids"], "<i8")
                known = np.frombuffer(r["id_known"], np.uint8).astype(bool)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                raw = memoryview(ids.tobytes())
                for at in range(0, len(keys), 1000):
                    some = slice(at, at + 1000)
                    own = [raw[4 * s : 4 * e] for s, e in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
                    columns = [pa.array(keys[some], mask=~known[some]), pa.array(starts[some] + base[r["part"]] + r["first_token"]), pa.array(lengths[some]), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                    columns += [pa.array([bytes(x) for x in own], pa.binary())] if with_ids else []
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
        tidy()

    shards = read_shards(spark, path).select("part", "first_token", "doc_ids", "id_known", "lengths", "payload")
    return shards.mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def lookup(spark: SparkSession, path: str, tokens: list[int], places: bool = False) -> DataFrame:
    """For each shard and token: token, part, first_token of the shard, n (occurrences), and if asked their places in the part."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                wm = WaveletMatrix.from_bytes(r["payload"])
                found = [[r["first_token"] + p for p in wm.occurrences(t)] if places else [] for t in tokens]
                n = [wm.count(t) for t in tokens]
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([r["part"]] * len(n), pa.int32()), pa.array([r["first_token"]] * len(n), pa.int64()), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["token", "part", "first_token", "n", "places"])

    return read_shards(spark, path).select("part", "first_token", "payload").mapInArrow(search, "token long, part int, first_token long, n long, places array<long>")


def token_store(docs: DataFrame, tokenizer: str, end_id: int = 1, shard_tokens: int = 4 << 20) -> DataFrame:
    """Write docs as a store and read it back: doc_id, start, n_tokens (with the end id), ids_crc32; see write_store."""
    spark = docs.sparkSession
    return read_documents(spark, write_store(docs, tokenizer, end_id, shard_tokens), with_ids=False)
