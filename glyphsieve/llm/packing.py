"""Best-fit packing of documents into fixed-length sequences by a distributed grouping genetic algorithm."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphsieve.llm.common import discard, materialize, shuffle_partitions, texts_of, tidy
from glyphsieve.llm.tokens import encoder

PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, encode_chars: int = 2 << 20, cached: int = 150_000) -> DataFrame:
    """The pieces of each document: its ids and the end id, cut after every capacity ids; uid tells rows apart."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codec, end, uid = encoder(tokenizer, cached), struct.pack("<I", end_id), TaskContext.get().partitionId() << 40
        step = 4 * capacity
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                some = b.slice(at, 4096)
                rows = []
                for key, ids in zip(some.column(0).to_pylist(), codec.encode(texts_of(some.column(1)), encode_chars), strict=True):
                    ids += end
                    for k, s in enumerate(range(0, len(ids), step)):
                        own = ids[s : s + step]
                        rows.append((uid, key, k, s // 4, len(own) // 4, zlib.crc32(own)))
                        uid += 1
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["uid", "doc_id", "piece", "start", "length", "ids_crc32"])
                tidy()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by Martello and Toth: no two items over half the capacity share a bin, and for each k the items
    from k up to half can only go beside those of them that leave k or more."""
    s = np.sort(sizes)
    before = np.concatenate(([0], np.cumsum(s)))
    k = np.unique(np.append(s[2 * s <= capacity], 0))
    half = int(np.searchsorted(s, capacity // 2, side="right"))
    high = np.searchsorted(s, capacity - k, side="right")
    beside = (high - half) * capacity - (before[high] - before[half])
    more = np.maximum(before[half] - before[np.searchsorted(s, k)] - beside, 0)
    return max(-(-int(s.sum()) // capacity), int((len(s) - half - (-more // capacity)).max()))


class Packer:
    """One island: a population of packings of the same items. A packing is (bin of each item, fill of each bin)."""

    def __init__(self, sizes: np.ndarray, capacity: int, seed: int):
        self.sizes, self.capacity, self.rng = sizes, capacity, np.random.default_rng(seed)
        self.bound = lower_bound(sizes, capacity)

    def best_fit(self, assign: np.ndarray, fills: list[int], items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put items, in their order, where they leave the least room. Bins are found by room through a bit mask."""
        rooms: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        mask = 0
        for k, f in enumerate(fills):
            room = self.capacity - f
            rooms[room].append(k)
            mask |= 1 << room
        sizes = self.sizes
        for i in items.tolist():
            size = int(sizes[i])
            over = mask >> size
            if over:
                room = size + (over & -over).bit_length() - 1
                k = rooms[room].pop()
                if not rooms[room]:
                    mask &= ~(1 << room)
            else:
                room, k = self.capacity, len(fills)
                fills.append(0)
            assign[i] = k
            fills[k] += size
            rooms[room - size].append(k)
            mask |= 1 << (room - size)
        return assign, np.array(fills, np.int64)

    def fresh(self) -> tuple[np.ndarray, np.ndarray]:
        """A packing of the first population: best fit in an order drawn by lot."""
        return self.best_fit(np.empty(len(self.sizes), np.int32), [], self.rng.permutation(len(self.sizes)))

    def decreasing(self) -> tuple[np.ndarray, np.ndarray]:
        return self.best_fit(np.empty(len(self.sizes), np.int32), [], np.argsort(-self.sizes, kind="stable"))

    def fitness(self, packing: tuple[np.ndarray, np.ndarray]) -> tuple[int, float]:
        """Fewer bins first, then fuller ones."""
        return -len(packing[1]), float(((packing[1] / self.capacity) ** 2).mean()) if len(packing[1]) else 1.0

    def cross(self, host: tuple[np.ndarray, np.ndarray], donor: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Inject whole well-filled bins of donor; drop the host's bins that hold the same items; best-fit what they had besides."""
        assign, fills = host
        good = np.flatnonzero(donor[1] >= np.quantile(donor[1], 0.5))
        taken = np.zeros(len(donor[1]), bool)
        taken[good[self.rng.random(len(good)) < self.rng.uniform(0.2, 0.8)]] = True
        injected = taken[donor[0]]
        doomed = np.zeros(len(fills), bool)
        doomed[assign[injected]] = True
        keep, new = np.flatnonzero(~doomed), np.flatnonzero(taken)
        host_no, donor_no = np.full(len(fills), -1), np.full(len(donor[1]), -1)
        host_no[keep], donor_no[new] = np.arange(len(keep)), len(keep) + np.arange(len(new))
        child = np.where(injected, donor_no[donor[0]], host_no[assign]).astype(np.int32)
        loose = np.flatnonzero(child < 0)
        return self.best_fit(child, [*fills[keep].tolist(), *donor[1][new].tolist()], loose[np.argsort(-self.sizes[loose], kind="stable")])

    def refill(self, packing: tuple[np.ndarray, np.ndarray], roomy: int = 20, share: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
        """Mutation: empty some of the roomiest bins and a share of all, then fill bins one by one: the largest item left and, of the others,
        those that together leave the least room (sums are bits of a number; which items are tried first is drawn by lot)."""
        assign, fills = packing
        sizes, capacity, rng = self.sizes, self.capacity, self.rng
        doomed = np.zeros(len(fills), bool)
        doomed[np.argsort(-((capacity - fills) * rng.uniform(0.5, 1, len(fills))))[:roomy]] = True
        doomed[rng.choice(len(fills), min(len(fills), max(4, int(share * len(fills)))), replace=False)] = True
        keep = np.flatnonzero(~doomed)
        number = np.full(len(fills), -1)
        number[keep] = np.arange(len(keep))
        child, bins = number[assign].astype(np.int32), fills[keep].tolist()
        loose = np.flatnonzero(child < 0)
        rest = loose[np.argsort(-sizes[loose], kind="stable")].tolist()
        while rest:
            first, *rest = rest
            left = capacity - int(sizes[first])
            some = np.array([i for i in rest if sizes[i] <= left], int)
            some = some[np.argsort(-(sizes[some] * rng.uniform(0.7, 1, len(some))))].tolist()
            sums, whole = [1], (1 << (left + 1)) - 1
            for i in some:
                sums.append((sums[-1] | sums[-1] << int(sizes[i])) & whole)
                if sums[-1] >> left:
                    break
            reached, put = sums[-1].bit_length() - 1, {first}
            for k in range(len(sums) - 1, 0, -1):
                if not sums[k - 1] >> reached & 1:
                    put.add(some[k - 1])
                    reached -= int(sizes[some[k - 1]])
            child[list(put)] = len(bins)
            bins.append(int(sizes[list(put)].sum()))
            rest = [i for i in rest if i not in put]
        return child, np.array(bins, np.int64)

    def evolve(self, population: list[tuple[np.ndarray, np.ndarray]], generations: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Best first. Stops once the best needs no more bins than any packing does."""
        population = sorted(population, key=self.fitness, reverse=True)
        for _ in range(generations if len(population) > 1 else 0):
            if len(population[0][1]) <= self.bound:
                break
            a, b = sorted(self.rng.choice(len(population), 2, replace=False).tolist())
            child = self.refill(self.cross(population[a], population[b]))
            population = sorted([*population[:-1], max(population[-1], child, key=self.fitness)], key=self.fitness, reverse=True)
        return population


ISLAND = "chunk long, island int, uids array<long>, sizes array<int>, assign array<int>, bins int, fitness double, immigrant array<int>, bound int"


def _epoch(frame: DataFrame, capacity: int, population: int, generations: int, epoch: int) -> DataFrame:
    """One epoch of every island: from its own best, an immigrant and fresh packings, to its best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {k: b.column(k)[r] for k in ("chunk", "island", "uids", "sizes", "assign", "immigrant")}
                array = lambda k: row[k].values.to_numpy(zero_copy_only=False) if row[k].is_valid else None  # noqa: B023, E731
                sizes = array("sizes").astype(np.int64)
                chunk, island = row["chunk"].as_py(), row["island"].as_py()
                packer = Packer(sizes, capacity, (chunk * 1009 + island) * 31 + epoch)
                first = [(a, np.bincount(a, sizes).astype(np.int64)) for a in (array("assign"), array("immigrant")) if a is not None]
                if epoch:  # new blood where lots alone did not reach the bound
                    first.append(packer.decreasing())
                while len(first) < population and len(sizes):
                    first.append(packer.fresh())
                best = packer.evolve(first, generations)[0]
                bins, full = packer.fitness(best)
                one = pa.array([best[0]], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("chunk").slice(r, 1), b.column("island").slice(r, 1), b.column("uids").slice(r, 1), b.column("sizes").slice(r, 1), one, pa.array([-bins], pa.int32()), pa.array([full]), pa.nulls(1, pa.list_(pa.int32())), pa.array([packer.bound], pa.int32())], [x.split()[0] for x in ISLAND.split(", ")])

    return frame.select("chunk", "island", "uids", "sizes", "assign", "immigrant").mapInArrow(run, ISLAND)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, chunk_items: int = 4096, islands: int = 2, epochs: int = 3, population: int = 6, generations: int = 40, settle: float = 0.995, max_rounds: int = 4, batch_rows: int = 4096, encode_chars: int = 4 << 20, cached: int = 200_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: all docs (doc_id, text) in sequences of at most capacity ids.

    Pieces of exactly capacity ids are sequences of their own. The others are dealt by a hash of their row into chunks
    of about chunk_items; each chunk is packed by several islands, which breed populations that start in orders drawn by lot. A chunk is
    done when an island needs no more bins than any packing does (lower_bound); where none does, every island's best
    packing migrates to its neighbour, up to epochs, and the best wins. Its bins filled to the
    share settle are final; the documents of the others emigrate to the next round, where the few that are left
    of many chunks meet in new ones. The last round keeps all bins. Chunks depend on the row, not on sizes or
    text, so repeated documents spread; islands are dealt to at most as many tasks as there are shuffle partitions. batch_rows,
    encode_chars and cached (pieces whose ids a worker keeps) trade a worker's memory for its time; they change no result.
    Nulls: a null text is empty, hence the one id end_id; a null doc_id stays null. Repeated rows are packed each.
    A text of any length is encoded whole, in one worker. An empty table gives no rows. Other columns are not read.
    """
    held = materialize(pieces(docs, tokenizer, capacity, end_id, encode_chars, cached), "pieces", batch_rows)
    items = held.where(F.col("length") < capacity).select("uid", F.col("length").cast("int").alias("size"))
    placed: list[DataFrame] = []
    left = items.count()
    for turn in range(max_rounds):
        if not left:
            break
        chunks = -(-left // chunk_items)
        key = F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(chunks)).alias("chunk")
        grouped = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("size", "uid"))).alias("held"))
        grouped = grouped.select("chunk", F.col("held.uid").alias("uids"), F.col("held.size").alias("sizes"))
        none = F.lit(None).cast("array<int>")
        state = grouped.select("*", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), none.alias("assign"), none.alias("immigrant"))
        state = state.repartition(min(chunks * islands, shuffle_partitions(docs.sparkSession)), "chunk", "island")
        bred: list[DataFrame] = []
        for epoch in range(epochs):
            # an island's row is a chunk of items, so few rows make a batch
            bred.append(materialize(_epoch(state, capacity, population, generations, epoch), "epoch", 16))
            apart = bred[-1].groupBy("chunk").agg(F.min("bins").alias("least"), F.max("bound").alias("need")).where("least > need").select("chunk")
            if epoch + 1 == epochs or not apart.limit(1).count():
                break
            open_ = bred[-1].join(apart, "chunk", "left_semi")
            elite = open_.select("chunk", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("assign").alias("arrived"))
            state = open_.join(elite, ["chunk", "island"]).withColumn("immigrant", F.col("arrived")).drop("arrived")
        state = reduce(DataFrame.unionByName, bred)
        best = state.groupBy("chunk").agg(F.max_by(F.struct("uids", "sizes", "assign"), F.struct(-F.col("bins"), "fitness", "island")).alias("b"))
        flat = best.select("chunk", F.explode(F.arrays_zip(F.col("b.uids").alias("uids"), F.col("b.sizes").alias("sizes"), F.col("b.assign").alias("assign"))).alias("x"))
        flat = flat.select("chunk", F.col("x.uids").alias("uid"), F.col("x.sizes").alias("size"), F.col("x.assign").alias("bin"))
        bin_ = Window.partitionBy("chunk", "bin")
        before = F.sum("size").over(bin_.orderBy("uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
        number = F.lit(turn << 48) + F.col("chunk") * F.lit(1 << 16) + F.col("bin")
        last = chunks == 1 or turn + 1 == max_rounds
        kept = F.lit(True) if last else F.sum("size").over(bin_) >= int(settle * capacity)
        rows = materialize(flat.select("uid", "size", number.alias("sequence_id"), before.alias("offset"), kept.alias("final")), "bins")
        discard(*bred)
        placed.append(rows.where("final").select("sequence_id", "uid", "offset"))
        items = rows.where("not final").select("uid", "size")
        left = items.count()
    whole = held.where(F.col("length") >= capacity).select((-F.col("uid") - 1).alias("sequence_id"), "uid", F.lit(0).cast("long").alias("offset"))
    spots = whole
    for p in placed:
        spots = spots.unionByName(p)
    return held.join(spots, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
