"""Helpers shared by the operators: scratch tables, size-checked broadcasts, streaming groups."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LIBC = next((lib for lib in [ctypes.CDLL(None)] if hasattr(lib, "malloc_trim")), None)  # glibc has it

#: A side is broadcast only when its counted rows times its row width stay under this many bytes.
BROADCAST_BYTES = 48 << 20


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of this application: under spark.checkpoint.dir. Where that is unset, a local session gets a temporary one, as in
    tests, and a cluster is refused: its executors would write to disks of their own."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif not re.match(r"local($|\[)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="glyphsieve-")
            sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/glyphsieve-{sc.applicationId}"


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch while a scratch table is written: texts may be long.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Within, jobs hand Python batches of that many rows; the session's own setting comes back after."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def materialize(df: DataFrame, tag: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    with small_batches(spark, batch_rows):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._glyphsieve_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete scratch tables that no later plan reads."""
    for t in tables:
        path = getattr(t, "_glyphsieve_path", None)
        if path:
            spark = t.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def sized(small: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """small with a broadcast hint if its counted size is under limit, else as it is (then AQE's skew-aware shuffle join)."""
    return F.broadcast(small) if small.count() * row_bytes <= limit else small


def tidy() -> None:
    """Give back to the system what Arrow and the C library hold of freed buffers: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    if _LIBC:
        _LIBC.malloc_trim(0)


def texts_of(column: pa.Array) -> list[str]:
    """Strings of an Arrow column; nulls as empty."""
    return [x or "" for x in column.to_pylist()]


def row_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole runs of equal keys, many at a time, from batches sorted by keys. Only the last run of a batch is held over."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(k)[batch.num_rows - 1] for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for k, v in zip(keys, last, strict=True):
            column = batch.column(k)
            change |= np.asarray(pc.not_equal(column, v).fill_null(v.is_valid).to_numpy(zero_copy_only=False), bool) if v.is_valid else np.asarray(pc.is_valid(column).to_numpy(zero_copy_only=False), bool)
        cut = int(np.flatnonzero(change)[-1]) + 1 if change.any() else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif held and any(held[-1].column(k)[held[-1].num_rows - 1] != v for k, v in zip(keys, last, strict=True)):
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def map_runs(df: DataFrame, keys: list[str], fn: Callable[[Iterator[pa.Table]], Iterator[pa.RecordBatch]], schema: str, order: list[str] | None = None) -> DataFrame:
    """Shuffle by keys, sort, and hand fn tables that hold whole groups (several small groups at a time)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(row_groups(batches, keys))

    return df.repartition(*keys).sortWithinPartitions(*keys, *(order or [])).mapInArrow(run, schema)


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of undirected edges; component is the smallest node id.

    Alternating label propagation and pointer jumping, each round written to the shared folder, so no lineage grows
    and nothing but one count reaches the driver. A hub's edges are one key of a plain equi-join, which AQE can split.
    """
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    both = materialize(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels, both.a == labels.node).groupBy(F.col("b").alias("node")).agg(F.min("component").alias("near"))
        stepped = labels.join(near, "node", "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("stepped"))
        stepped = materialize(stepped, "stepped")
        jump = labels.select(F.col("node").alias("stepped"), F.col("component").alias("jumped"))
        nxt = stepped.join(jump, "stepped", "left").select("node", F.least("stepped", F.coalesce("jumped", "stepped")).alias("next"), "component")
        nxt = materialize(nxt, "labels")
        moved = nxt.where("next <> component").limit(1).count()
        discard(labels, stepped)
        labels = nxt.select("node", F.col("next").alias("component"))
        labels._glyphsieve_path = nxt._glyphsieve_path
        if not moved:
            discard(both)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
