"""As-of and range joins by key and time bucket: equi-joins and windows, no key whole in one task, no nested loops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(df: DataFrame, time: str) -> Column:
    """A timestamp, with a zone or without, as microseconds."""
    return F.unix_micros(F.col(time).cast("timestamp"))


def _width(df: DataFrame, width: str) -> int:
    return int(df.sparkSession.sql(f"SELECT CAST(INTERVAL {width} AS INTERVAL DAY TO SECOND) AS i").first().i.total_seconds() * 1_000_000)


def _clash(left: DataFrame, names: Sequence[str]) -> None:
    if both := {*left.columns} & {*names}:
        raise ValueError(f"the left side has columns of such names already: {sorted(both)}")


def asof(left: DataFrame, right: DataFrame, by: tuple[str, str], time: tuple[str, str], take: Sequence[str], width: str = "1 day") -> DataFrame:
    """The rows of left with the columns take of the last row of right at or before their time, of the same key; null where there is none.

    by and time name the columns of left and of right. Of right rows of one time the one with the largest columns take counts. Within a bucket
    of width, rows of both sides are put in order by a window; of each bucket the last right row is carried to later buckets by a
    window over buckets. So a key with a third of all rows is spread over its buckets. Null keys and times find nothing; a left row of null
    time stays.
    """
    _clash(left, take)
    micros = _width(left, width)
    keyed = left.select(F.struct("*").alias("row"), F.col(by[0]).alias("k"), _micros(left, time[0]).alias("t"))
    found = right.select(F.struct(*take).alias("hit"), F.col(by[1]).alias("k"), _micros(right, time[1]).alias("t")).where("k is not null and t is not null")
    bucket = F.floor(F.col("t") / F.lit(micros)).alias("bucket")
    empty = F.lit(None).cast(keyed.schema["row"].dataType).alias("row")
    none = F.lit(None).cast(found.schema["hit"].dataType).alias("hit")
    both = keyed.select("k", "t", bucket, "row", none, F.lit(1).alias("side")).unionByName(found.select("k", "t", bucket, empty, "hit", F.lit(0).alias("side")))
    order = Window.partitionBy("k", "bucket").orderBy("t", "side", "hit").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("near", F.last("hit", True).over(order)).where("side = 1").select("k", "t", "bucket", "row", "near")
    # buckets that hold a row of either side, with the last right row of any bucket before
    last = both.where("k is not null and t is not null").groupBy("k", "bucket").agg(F.max(F.when(F.col("side") == 0, F.struct("t", "hit"))).alias("last"))
    before = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(F.col("k").alias("ck"), F.col("bucket").alias("cb"), F.last("last.hit", True).over(before).alias("carried")).where("carried is not null")
    joined = near.join(carried, (F.col("k") == F.col("ck")) & (F.col("bucket") == F.col("cb")), "left")
    hit = F.coalesce("near", "carried")
    return joined.select("row.*", *[F.when(F.col("k").isNotNull() & F.col("t").isNotNull(), hit[c]).alias(c) for c in take])


def within(points: DataFrame, intervals: DataFrame, by: tuple[str, str], time: str, start: str, end: str, take: Sequence[str], width: str = "1 day") -> DataFrame:
    """The rows of points with the columns take of each interval of the same key with start <= time < end (end null: open).

    Intervals are listed once for each bucket of width that they and the points cover, and joined by key and bucket; an inner join. Null keys,
    times and starts find nothing.
    """
    _clash(points, take)
    micros = _width(points, width)
    bucket = lambda t: F.floor(t / F.lit(micros))
    at = points.select("*", F.col(by[0]).alias("__k"), _micros(points, time).alias("__t")).where("__k is not null and __t is not null")
    reach = at.agg(F.min("__t").alias("a"), F.max("__t").alias("b")).first()  # two numbers
    if reach.a is None:
        return points.select("*", *[F.lit(None).cast(intervals.schema[c].dataType).alias(c) for c in take]).where("false")
    spans = intervals.select(F.col(by[1]).alias("__ik"), _micros(intervals, start).alias("__from"), F.coalesce(_micros(intervals, end), F.lit(reach.b + 1)).alias("__to"), *take)
    spans = spans.where((F.col("__ik").isNotNull()) & (F.col("__from") < F.col("__to")) & (F.col("__from") <= reach.b) & (F.col("__to") > reach.a))
    first, last = F.greatest(F.col("__from"), F.lit(reach.a)), F.least(F.col("__to") - 1, F.lit(reach.b))
    spans = spans.withColumn("__ib", F.explode(F.sequence(bucket(first), bucket(last))))
    on = (F.col("__k") == F.col("__ik")) & (bucket(F.col("__t")) == F.col("__ib")) & (F.col("__t") >= F.col("__from")) & (F.col("__t") < F.col("__to"))
    return at.join(spans, on).select(*points.columns, *take)
