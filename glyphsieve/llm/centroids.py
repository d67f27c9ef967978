"""Centroid clustering of integer vectors: distances by matrix products, sums by a tree aggregation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphsieve.llm.blocks import EXACT, MOST, finite, integers, matrix, pack
from glyphsieve.llm.common import materialize

#: Distances held at once by a task.
DISTANCES = 1 << 20


def distances(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Squared distances of the rows of x (int64) from centroids, as |x|^2 - 2 x.c + |c|^2.

    No partial result passes (|x| + |c|)^2: while that is below 2^53 floating-point matrices are exact, up to 2^62 64-bit integers are, and
    beyond Python's integers take their place.
    """
    norm = lambda rows: max((sum(float(v) ** 2 for v in r) for r in rows), default=0.0) ** 0.5
    longest = float(np.sqrt((x.astype(float) ** 2).sum(1).max(initial=0)))
    bound = (longest + norm(centroids)) ** 2 * (1 + 1e-9)
    if bound < EXACT:
        a, c = x.astype(float), np.array(centroids, float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    kind = np.int64 if bound < MOST else object
    a, c = x.astype(kind), np.array(centroids, kind)
    return (a * a).sum(1)[:, None] - 2 * a.dot(c.T) + (c * c).sum(1)


def _parts(r) -> Iterator[np.ndarray]:  # noqa: ANN001
    """The vectors of a packed row, some at a time."""
    x = matrix(bytes(r["components"]), r["n"])
    step = max(1, DISTANCES // x.shape[1])
    for lo in range(0, len(x), step):
        yield x[lo : lo + step]


def _nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    d = distances(x, centroids)
    who = d.argmin(1)  # the first of equals
    return who, d[np.arange(len(x)), who]


Sums = dict[int, tuple[int, int, np.ndarray]]


def _add(total: Sums, who: np.ndarray, away: np.ndarray, x: np.ndarray) -> Sums:
    """Of each cluster: how many vectors, the sum of their distances and of their components, in Python's integers."""
    wide = object if len(x) and float(np.abs(x.astype(float)).max()) * len(x) >= MOST else np.int64
    for c in np.unique(who).tolist():
        own = who == c
        n, d, s = total.get(c, (0, 0, 0))
        total[c] = n + int(own.sum()), d + sum(away[own].tolist()), s + x[own].astype(wide).sum(0).astype(object)
    return total


def _merge(a: Sums, b: Sums) -> Sums:
    for c, (n, d, s) in b.items():
        m, e, t = a.get(c, (0, 0, 0))
        a[c] = n + m, d + e, s + t
    return a


def totals(blocks: DataFrame, centroids: list[list[int]], depth: int = 2) -> Sums:
    """Of each cluster that has vectors: their number, the sum of distances and of components. No more than that reaches a task or the driver
    from any block; partial sums meet in a tree of that depth."""

    def add(total: Sums, r) -> Sums:  # noqa: ANN001
        for x in _parts(r):
            total = _add(total, *_nearest(x, centroids), x)
        return total

    return blocks.select("n", "components").rdd.treeAggregate({}, add, _merge, depth)


OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: str = "1", block_rows: int = 8192) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept row of vectors (vec_id, embedding).

    Kept are vectors of exactly dim components, none null or non-finite; components become floor(scale * x). Centroids start as the k vectors
    of the smallest sha256 of "<seed>:<vec_id>". In each round every vector goes to its nearest centroid (ties: the smaller number) and
    centroids become floor(sum / count) of their vectors; those without any stay. At last vectors are assigned once more.
    Vectors are packed once into blocks in the shared folder, which every pass reads; a pass returns k sums. Nothing is shuffled but those.
    Nulls: null vectors and those of other lengths give no row; a null vec_id stays, with its own row, and hashes last. Rows that repeat a
    vec_id are rows of their own (as seeds the one with the smaller components comes first). Fewer than k kept rows make as many centroids. An
    empty table gives no rows. Components beyond 2^62 are an error, as are sums that no long holds. Other columns are not read.
    """
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    kept = vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where((F.size("v") == dim) & finite(F.col("v")))
    large = F.exists("v", lambda x: F.abs(x) * scale >= float(1 << 62))
    checked = F.when(large, F.raise_error(F.lit("components of these vectors do not fit in a long"))).otherwise(integers(F.col("v"), scale))
    kept = kept.select("id", F.lit(False).alias("asks"), checked.alias("v"))
    blocks = pack(kept, "vectors", block_rows)
    first = kept.select("v", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k)
    centroids = [list(r.v) for r in first.collect()]  # k rows
    if not centroids:
        return spark.createDataFrame([], OUT)
    for _ in range(rounds):
        for c, (n, _, s) in totals(blocks, centroids).items():
            centroids[c] = [int(x) // n for x in s]
    inertia = {c: d for c, (_, d, _) in totals(blocks, centroids).items()}
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = pa.array([inertia.get(c, 0) for c in range(len(centroids))], pa.int64())
        digests = pa.array(hashes)
        for batch in batches:
            for r in batch.to_pylist():
                ids, at = pa.array(np.frombuffer(r["ids"], "<i8"), mask=~np.frombuffer(r["named"], bool)), 0
                for x in _parts(r):
                    who, away = _nearest(x, centroids)
                    n = pa.array(who.astype(np.int32))
                    columns = [ids.slice(at, len(x)), n, pa.array(away.tolist(), pa.int64()), each.take(n), pa.array([sum(inertia.values())] * len(x), pa.int64()), digests.take(n)]
                    at += len(x)
                    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in OUT.split(", ")])

    return materialize(blocks.mapInArrow(assign, OUT), "clusters", 4)
