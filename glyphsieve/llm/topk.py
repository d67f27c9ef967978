"""Exact top-k by integer inner product: histograms of all scores are refined until each query's k-th value is located."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphsieve.llm.blocks import EXACT, finite, integers, matrix, pack, products
from glyphsieve.llm.common import discard, materialize

#: A histogram has two to the power of this many bins; seven of them tell 2^63 scores apart.
BITS = 9
#: Scores held at once by a task.
SCORES = 1 << 22

QUERY = "uid long, id long, dim int, largest double, v binary"


def _queries(blocks: DataFrame) -> DataFrame:
    """The vectors that ask, one a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                which = np.flatnonzero(np.frombuffer(r["asks"], bool))
                uids, ids, named, rows = np.frombuffer(r["uids"], "<i8")[which], np.frombuffer(r["ids"], "<i8")[which], np.frombuffer(r["named"], bool)[which], matrix(r["components"], r["n"])[which]
                n = len(which)
                columns = [pa.array(uids), pa.array(ids, mask=~named), pa.array([r["dim"]] * n, pa.int32()), pa.array([r["largest"]] * n, pa.float64()), pa.array([x.tobytes() for x in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in QUERY.split(", ")])

    return blocks.mapInArrow(run, QUERY)


def _grouped(queries: DataFrame) -> DataFrame:
    """Queries of one group and dimension, with what is known of their k-th values, as one row of matrices."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("uid")
        columns = [pa.array([t.column(c)[0].as_py()], k) for c, k in (("dim", pa.int32()), ("part", pa.int32()))]
        columns += [pa.array([t.column(c).to_numpy().astype("<i8").tobytes()], pa.binary()) for c in ("uid", "low", "shift", "need")]
        columns += [pa.array([b"".join(t.column("v").to_pylist())], pa.binary()), pa.array([max(t.column("largest").to_pylist())], pa.float64())]
        return pa.table(columns, ["dim", "part", "q_uids", "low", "shift", "need", "q_components", "q_largest"])

    return queries.groupBy("dim", "part").applyInArrow(run, "dim int, part int, q_uids binary, low binary, shift binary, need binary, q_components binary, q_largest double")


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each block of vectors and group of queries, some queries at a time: the row, which queries, all scores, and where a query meets itself."""
    for batch in batches:
        for k in range(batch.num_rows):
            r = batch.slice(k, 1).to_pylist()[0]
            for c in ("q_uids", "low", "shift", "need", "uids", "ids"):
                r[c] = np.frombuffer(r[c], "<i8")
            candidates, asked = matrix(r["components"], r["n"]), matrix(r["q_components"], len(r["q_uids"]))
            at = np.minimum(np.searchsorted(r["uids"], r["q_uids"]), r["n"] - 1)
            same = np.where(r["uids"][at] == r["q_uids"], at, -1)
            bound = r["largest"] * r["q_largest"] * (1 + 1e-9)
            if bound < EXACT:
                candidates = candidates.astype(float)  # once for all queries of the group
            step = max(1, SCORES // r["n"])
            for lo in range(0, len(asked), step):
                some = slice(lo, min(lo + step, len(asked)))
                own = np.flatnonzero(same[some] >= 0)
                yield r, some, products(asked[some], candidates, bound), own, same[some][own]


def _histograms(pairs: DataFrame) -> DataFrame:
    """uid, bin, n: of each query and block, the upper bins of its present range down to where the block alone has as many as are sought.

    No bin below can matter: the value sought over all blocks is at least that of any one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, some, scores, own, place in _scored(batches):
            low, shift, need = (r[c][some][:, None] for c in ("low", "shift", "need"))
            bins = (scores - low) >> shift
            bins[own, place] = -1
            inside = (bins >= 0) & (bins < 1 << BITS)
            flat = (bins + (np.arange(len(bins)) << BITS)[:, None])[inside]
            counts = np.bincount(flat, minlength=len(bins) << BITS).reshape(len(bins), -1)
            above = np.cumsum(counts[:, ::-1], 1)[:, ::-1] - counts
            q, b = np.nonzero((counts > 0) & (above < need))
            yield pa.RecordBatch.from_arrays([pa.array(r["q_uids"][some][q]), pa.array(b.astype(np.int32)), pa.array(counts[q, b])], ["uid", "bin", "n"])

    return pairs.mapInArrow(run, "uid long, bin int, n long")


def _selected(pairs: DataFrame, k: int) -> DataFrame:
    """uid, c_uid, vec_id, score of every score at or above its query's limit; of a block's scores for one query no more than its first k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, some, scores, own, place in _scored(batches):
            near = scores >= r["low"][some][:, None]
            near[own, place] = False
            q, c = np.nonzero(near)
            named = np.frombuffer(r["named"], bool)
            score = scores[q, c]
            order = np.lexsort((r["uids"][c], r["ids"][c], ~named[c], -score, q))
            q, c, score = q[order], c[order], score[order]
            first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.empty(0, int)
            rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
            q, c, score = q[rank < k], c[rank < k], score[rank < k]
            yield pa.RecordBatch.from_arrays([pa.array(r["q_uids"][some][q]), pa.array(r["uids"][c]), pa.array(r["ids"][c], mask=~named[c]), pa.array(score)], ["uid", "c_uid", "vec_id", "score"])

    return pairs.mapInArrow(run, "uid long, c_uid long, vec_id long, score long")


def exact_top(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, block_rows: int = 8192, group_queries: int = 1024, wave_bytes: int = 32 << 20, surplus: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors (vec_id, embedding) that is_query holds for, the k best of all other rows by the
    inner product of floor(scale * x), ties to the smaller vec_id; all of them if fewer.

    Every score is counted in a histogram of its query, over all vectors; the bin that holds the k-th value is the range of the next, finer
    histogram, until the bin is one value wide or no more than k + surplus scores lie in it and above. Then scores at or above it are filtered
    and ranked. A task scores a block of at most block_rows vectors against a group of about group_queries; it keeps no score, and reports of
    each query no more bins, and at last rows, than k. Queries are taken in waves of at most wave_bytes (their vectors), which are
    broadcast; vectors are never shuffled. Between the passes only histograms' positions are kept, in the shared folder.
    A query whose k-th value many share gets all above it and of the others the smallest vec_ids, which each block has ranked before.
    Nulls: rows whose vector is null or holds null or non-finite components take no part. A null vec_id asks nothing (is_query is null) and
    comes last in ties. Vectors meet those of their own dimension; empty ones score 0. Rows that repeat a vec_id are rows of their own.
    An empty table gives no rows. Scores that may pass 2^62 are an ArithmeticError. Other columns are not read.
    """
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), is_query.alias("asks"), v.alias("v")).where(finite(F.col("v")))
    blocks = pack(rows.select("id", "asks", integers(F.col("v"), scale).alias("v")), "blocks", block_rows)
    queries = materialize(_queries(blocks), "queries", 4)
    kinds = {r.dim: r for r in queries.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("largest").alias("q")).collect()}  # a row for each dimension
    longest = {r.dim: r.c for r in blocks.groupBy("dim").agg(F.max("largest").alias("c")).collect()}
    total = sum(r.n for r in kinds.values())
    waves = max(1, math.ceil(sum(r.n * (8 * d + 32) for d, r in kinds.items()) / wave_bytes))
    groups = max(1, math.ceil(total / waves / group_queries))
    # ranges start at -2^(p-1) and are 2^p wide, p a multiple of BITS, so that each bin is a full range of the next histogram
    powers = {d: BITS * math.ceil((math.frexp(r.q * longest[d] * (1 + 1e-9) + 1)[1] + 1) / BITS) for d, r in kinds.items()}
    if max(powers.values(), default=0) > 63:
        raise ArithmeticError("inner products of these vectors may not fit in a long")
    of_dim = lambda values: F.coalesce(*[F.when(F.col("dim") == d, F.lit(x)) for d, x in values.items()], F.lit(0))
    dealt = F.pmod(F.xxhash64("uid"), F.lit(waves * groups))
    queries = queries.select("*", (dealt % waves).cast("int").alias("wave"), F.floor(dealt / waves).cast("int").alias("part"))
    spread = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def pairs(asked: DataFrame) -> DataFrame:
        """Each block beside each group of asked queries of its dimension; these take at most about wave_bytes."""
        return spread.join(F.broadcast(_grouped(asked)), ["dim", "part"])

    out = []
    for wave in range(waves):
        asked = queries.where(F.col("wave") == wave)
        # above: how many scores are known to lie above the present range
        low, shift = of_dim({d: -(1 << p - 1) for d, p in powers.items()}), of_dim({d: p - BITS for d, p in powers.items()})
        start = asked.select("uid", low.cast("long").alias("low"), shift.cast("int").alias("shift"), F.lit(0).cast("long").alias("above"), F.lit(False).alias("done"))
        state = materialize(start, "ranges")
        while state.where("not done").limit(1).count():
            left = asked.join(state.where("not done").select("uid", "low", "shift", (k - F.col("above")).alias("need")), "uid")
            counted = materialize(_histograms(pairs(left)), "histograms", 4)
            down = Window.partitionBy("uid").orderBy(F.desc("bin"))
            summed = counted.groupBy("uid", "bin").agg(F.sum("n").alias("n")).withColumn("reached", F.sum("n").over(down))
            # the bin in which k are reached, or the last of all if there are fewer
            located = summed.join(state.select("uid", "low", "shift", "above"), "uid").where((F.col("above") + F.col("reached") - F.col("n")) < k).groupBy("uid").agg(F.max(F.struct("reached", "bin", "n")).alias("at"))
            moved = state.join(located, "uid", "left").select(
                "uid",
                F.when(F.col("done") | F.col("at").isNull(), F.col("low")).otherwise(F.col("low") + F.expr("shiftleft(CAST(at.bin AS BIGINT), shift)")).alias("low"),
                F.when(F.col("done") | (F.col("shift") == 0), F.col("shift")).otherwise(F.col("shift") - BITS).cast("int").alias("shift"),
                F.when(F.col("done") | F.col("at").isNull(), F.col("above")).otherwise(F.col("above") + F.col("at.reached") - F.col("at.n")).alias("above"),
                (F.col("done") | F.col("at").isNull() | (F.col("shift") == 0) | (F.col("above") + F.col("at.reached") <= k + surplus)).alias("done"),
            )
            before, state = state, materialize(moved, "ranges")
            discard(before, counted)
        limits = asked.join(state.select("uid", "low", F.lit(0).alias("shift"), F.lit(k).alias("need")), "uid")
        out.append(materialize(_selected(pairs(limits), k), "selected", 4).join(asked.select("uid", F.col("id").alias("query_id")), "uid"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    best = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "c_uid")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
