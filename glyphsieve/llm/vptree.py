"""Nearest neighbours by inner product: a vantage-point tree for each shard, searched by blocks of queries."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphsieve.llm.common import materialize

LEAF = 128


class Tree:
    """Vectors in the order of a balanced vantage-point tree.

    Inner products become distances by one more component: with reach at least every vector's length, x is placed at
    (x, sqrt(reach**2 - |x|**2)) and a query at (q, 0), so the largest product is the least distance. A node covers a range;
    its vantage point parts it at the median distance; of both halves it keeps the least and the largest distance.
    """

    def __init__(self, vectors: np.ndarray, reach: float):
        self.reach, self.order = reach, np.arange(len(vectors))
        self.raw = np.ascontiguousarray(vectors, np.float64)
        lift = np.sqrt(np.maximum(reach**2 - (self.raw**2).sum(1), 0))
        self.placed = np.hstack((self.raw, lift[:, None]))
        self.nodes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self._split(0, len(vectors))
        self.raw, self.placed = self.raw[self.order], self.placed[self.order]

    def parts(self) -> list[bytes]:
        """The built tree: order and vectors, then ranges, vantage points and distances of its nodes. See load."""
        nodes = sorted(self.nodes)
        points, bounds = (np.array([self.nodes[n][k] for n in nodes], np.float64) for k in (0, 1))
        return [x.tobytes() for x in (self.order, self.raw, np.array(nodes, np.int64), points, bounds)]

    @classmethod
    def load(cls, parts: list[bytes], dim: int, reach: float) -> Tree:
        tree = object.__new__(cls)
        order, raw, nodes, points, bounds = (np.frombuffer(x, t) for x, t in zip(parts, (np.int64, np.float64, np.int64, np.float64, np.float64), strict=True))
        tree.reach, tree.order, tree.raw = reach, order, raw.reshape(-1, dim)
        tree.nodes = {(lo, hi): (v, b) for (lo, hi), v, b in zip(nodes.reshape(-1, 2).tolist(), points.reshape(-1, dim + 1), bounds.reshape(-1, 4), strict=True)}
        return tree

    def _split(self, lo: int, hi: int) -> None:
        if hi - lo <= LEAF:
            return
        own = self.order[lo:hi]
        spread = ((self.placed[own] - self.placed[own[0]]) ** 2).sum(1)
        vantage = self.placed[own[int(spread.argmax())]]  # at the rim, where distances differ most
        d = np.sqrt(((self.placed[own] - vantage) ** 2).sum(1))
        sort = np.argsort(d, kind="stable")
        self.order[lo:hi], d = own[sort], d[sort]
        mid = (hi - lo) // 2
        self.nodes[lo, hi] = vantage, np.array([d[0], d[mid - 1], d[mid], d[-1]])
        self._split(lo, lo + mid)
        self._split(lo + mid, hi)

    def search(self, queries: np.ndarray, k: int, factor: float, skip: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, score) of the k best of each query, ties to the smaller of labels (in the order the tree was given).

        A half is passed over if no point in it can be nearer than factor times the k-th distance found so far: by the
        triangle inequality none that matters if factor is one, and the fewer halves the smaller it is.
        skip is the place (as given) that a query must not find, -1 for none.
        """
        self.work = _Search(self, np.ascontiguousarray(queries, np.float64), k, factor, skip, labels[self.order])
        s = self.work
        s.visit(0, len(self.order), np.arange(len(queries)))
        return s.query, self.order[s.place], s.score


class _Search:
    def __init__(self, tree: Tree, queries: np.ndarray, k: int, factor: float, skip: np.ndarray, labels: np.ndarray):
        self.tree, self.queries, self.k, self.factor, self.labels = tree, queries, k, factor, labels
        self.placed = np.hstack((queries, np.zeros((len(queries), 1))))
        self.own = (queries**2).sum(1) + tree.reach**2
        self.tau = np.full(len(queries), np.inf)
        self.worst = np.full(len(queries), -np.inf)
        where = np.empty(len(tree.order), np.int64)
        where[tree.order] = np.arange(len(tree.order))
        self.skip = np.where(skip >= 0, where[np.maximum(skip, 0)], -1)
        self.query, self.place, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def scan(self, lo: int, hi: int, who: np.ndarray) -> None:
        about = self.queries[who] @ self.tree.raw[lo:hi].T
        near = about >= (self.worst[who] - 1e-9 * (1 + np.abs(self.worst[who])))[:, None]
        here = (self.skip[who] >= lo) & (self.skip[who] < hi)
        near[np.flatnonzero(here), self.skip[who[here]] - lo] = False
        row, col = np.nonzero(near)
        if not len(row):
            return
        # products anew, summed from the first component on, so that equal vectors score the same
        exact = np.concatenate([np.add.accumulate(self.queries[who[row[s : s + 65536]]] * self.tree.raw[lo + col[s : s + 65536]], 1)[:, -1] for s in range(0, len(row), 65536)])
        touched = np.zeros(len(self.queries), bool)
        touched[who[row]] = True
        again = touched[self.query]
        query = np.concatenate((self.query[again], who[row]))
        place = np.concatenate((self.place[again], lo + col))
        score = np.concatenate((self.score[again], exact))
        sort = np.lexsort((self.labels[place], -score, query))
        query, place, score = query[sort], place[sort], score[sort]
        first = np.concatenate(([True], query[1:] != query[:-1]))
        rank = np.arange(len(query)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        keep = rank < self.k
        full = rank == self.k - 1
        self.worst[query[full]] = score[full]
        self.tau[query[full]] = np.sqrt(np.maximum(self.own[query[full]] - 2 * score[full], 0))
        self.query, self.place, self.score = (np.concatenate((a[~again], b[keep])) for a, b in ((self.query, query), (self.place, place), (self.score, score)))

    def visit(self, lo: int, hi: int, who: np.ndarray) -> None:
        if not len(who):
            return
        if (lo, hi) not in self.tree.nodes:
            self.scan(lo, hi, who)
            return
        vantage, (a, b, c, d) = self.tree.nodes[lo, hi]
        away = np.sqrt(((self.placed[who] - vantage) ** 2).sum(1))
        inner = np.maximum(np.maximum(a - away, away - b), 0)
        outer = np.maximum(np.maximum(c - away, away - d), 0)
        mid = lo + (hi - lo) // 2
        first = away <= (b + c) / 2
        for group, near, far, bound in ((first, (lo, mid), (mid, hi), outer), (~first, (mid, hi), (lo, mid), inner)):
            some = who[group]
            self.visit(*near, some)
            slack = 1e-7 * (1 + self.tree.reach)  # distances come from differences of squares
            self.visit(*far, some[bound[group] <= self.factor * self.tau[some] + slack])


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


FOUND = "q_uid long, query_id long, vec_id long, c_uid long, score double"


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, factor: float = 1.0, shard_vectors: int = 8192, block_queries: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors (vec_id, embedding) that is_query holds for, its k best of all
    other rows by inner product in double precision, ties to the smaller vec_id; all of them if fewer.

    Rows are dealt by hash into shards of about shard_vectors, all indexed: each shard's tree is built once and written; queries are dealt
    into blocks of about block_queries. A task takes a shard and a block, both bounded; of a query and shard k rows remain. factor
    relaxes the trees' pruning (see Tree.search); at one the result is exact.
    Nulls: rows whose vector is null, zero, empty, or holds null or non-finite components take no part, as query or
    candidate; neither do null vec_ids. Vectors meet only those of their own dimension. Rows that repeat a vec_id are
    rows of their own. An empty table gives no rows. A vector of any length is one value. Other columns are not read.
    """
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), is_query.alias("asks")).where(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "v", F.size("v").alias("dim"), F.coalesce("asks", F.lit(False)).alias("asks")), "vectors")
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asks").cast("long")).alias("q"), F.sqrt(F.max(squares)).alias("reach")).first()
    shards, blocks, reach = max(1, math.ceil(total.n / shard_vectors)), max(1, math.ceil((total.q or 0) / block_queries)), (total.reach or 0.0) * (1 + 1e-12)
    dealt = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def index(t: pa.Table) -> pa.Table:
        t = t.sort_by("uid")
        flat = t.column("v").combine_chunks().flatten().to_numpy().astype("<f8")
        dim = t.column("dim")[0].as_py()
        one = [dim, t.column("shard")[0].as_py(), t.column("uid").to_numpy().tobytes(), t.column("vec_id").to_numpy().tobytes(), Tree(flat.reshape(-1, dim), reach).parts()]
        return pa.table([pa.array([x], kind) for x, kind in zip(one, [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.binary())], strict=True)], ["dim", "shard", "uids", "ids", "tree"])

    shard_rows = rows.select("dim", dealt(shards).alias("shard"), "uid", "vec_id", "v").groupBy("dim", "shard").applyInArrow(index, "dim int, shard int, uids binary, ids binary, tree array<binary>")
    # a shard is a row, so few rows make a batch
    shard_rows = materialize(shard_rows, "shards", 4).withColumn("block", every(blocks))
    asked = rows.where("asks").select("dim", dealt(blocks).alias("block"), "uid", "vec_id", "v").withColumn("shard", every(shards))

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], pa.int64())] * 4 + [pa.array([], pa.float64())], [c.split()[0] for c in FOUND.split(", ")])
        if not left.num_rows or not right.num_rows:
            return empty
        dim = left.column("dim")[0].as_py()
        uids, ids = (np.frombuffer(left.column(c)[0].as_py(), np.int64) for c in ("uids", "ids"))
        tree = Tree.load(left.column("tree")[0].as_py(), dim, reach)
        queries = right.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        q_uid, q_id = right.column("uid").to_numpy(), right.column("vec_id").to_numpy()
        at = np.minimum(np.searchsorted(uids, q_uid), len(uids) - 1)
        skip = np.where(uids[at] == q_uid, at, -1)
        query, place, score = tree.search(queries, k, factor, skip, ids)
        return pa.table([pa.array(x) for x in (q_uid[query], q_id[query], ids[place], uids[place], score)], [c.split()[0] for c in FOUND.split(", ")])

    keys = ["dim", "shard", "block"]
    found = shard_rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(find, FOUND)
    best = Window.partitionBy("q_uid").orderBy(F.desc("score"), "vec_id", "c_uid")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
