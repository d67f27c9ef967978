"""Integer vectors in blocks: a row holds the matrix of many vectors, so that tasks multiply matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphsieve.llm.common import materialize

#: Sums of products below this are exact in float64, whatever the order of the additions.
EXACT = float(1 << 53)
#: Beyond this a long could not hold a score or a distance.
MOST = float(1 << 62)


def finite(v: Column) -> Column:
    """Whether v, an array<double>, and all of its components are neither null nor NaN nor infinite."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False))


def integers(v: Column, scale: int) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))


BLOCK = "dim int, n int, largest double, uids binary, ids binary, named binary, asks binary, components binary"


def _block(dim: int, rows: pa.Table) -> list:
    flat = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<i8")
    squares = (flat.reshape(rows.num_rows, dim).astype(float) ** 2).sum(1)
    ids = rows.column("id").combine_chunks()
    return [
        dim, rows.num_rows, float(np.sqrt(squares.max(initial=0))), rows.column("uid").to_numpy().astype("<i8").tobytes(), ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(),
        ids.is_valid().to_numpy(zero_copy_only=False).tobytes(), rows.column("asks").to_numpy(zero_copy_only=False).astype(bool).tobytes(), flat.tobytes(),
    ]


def pack(rows: DataFrame, tag: str, block_rows: int) -> DataFrame:
    """BLOCK rows, written in the shared folder, of rows (id long, asks boolean, v array<long>): vectors of one dimension that stand near each
    other, at most block_rows. Each vector gets a number of its own (uids), as ids may be null (named is false) or repeated; largest bounds
    the lengths of a block's vectors. Nothing is shuffled."""
    names = [c.split()[0] for c in BLOCK.split(", ")]
    types = [pa.int32(), pa.int32(), pa.float64(), *[pa.binary()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            dims = table.column("dim").to_numpy()
            for dim in np.unique(dims):
                made = _block(int(dim), table.filter(pa.array(dims == dim)))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(made, types, strict=True)], names)

        for batch in batches:
            while batch.num_rows:
                room = block_rows - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) >= block_rows:
                    yield from flush()
                    held = []
        if held:
            yield from flush()

    numbered = rows.select(F.monotonically_increasing_id().alias("uid"), "id", F.coalesce("asks", F.lit(False)).alias("asks"), F.size("v").alias("dim"), "v")
    return materialize(numbered.mapInArrow(run, BLOCK), tag)


def matrix(components: bytes, n: int) -> np.ndarray:
    return np.frombuffer(components, "<i8").reshape(n, -1)


def products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """All inner products of the rows of a and b as int64. bound is at least the product of their largest lengths and so of every partial
    sum: below 2^53 floating-point matrices give them exactly, up to 2^62 integers do, and beyond it is an error."""
    if bound < EXACT:
        return (np.asarray(a, float) @ np.asarray(b, float).T).astype(np.int64)
    if bound < MOST:
        return a @ b.T
    raise ArithmeticError("inner products of these vectors may not fit in a long")
