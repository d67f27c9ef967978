"""Which rules fire where, as bitmaps that tasks build, groups merge, and counts are read from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphsieve.operators.engine import RuleEngine


def fired_bitmaps(docs: DataFrame, engine: RuleEngine, text: str, *by: str) -> DataFrame:
    """by, bucket, rules: of each group the ids of the rules that fire in any of its rows, as bitmaps; ids are parted by the built-in bucket number.

    Partial bitmaps are built by each task, so a row a group, bucket and task is shuffled. Groups without a hit have no row.
    """
    ids = docs.select(*by, F.explode(engine.process(F.col(text))["word_id"]).alias("__id"))
    return ids.groupBy(*by, F.bitmap_bucket_number("__id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__id")).alias("rules"))


def merged(bitmaps: DataFrame, *by: str) -> DataFrame:
    """Bitmaps of coarser groups: those of their parts, or-ed."""
    return bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("rules").alias("rules"))


def counted(bitmaps: DataFrame, *by: str) -> DataFrame:
    """by, n_rules: how many rules fire in each group."""
    return bitmaps.groupBy(*by).agg(F.sum(F.bitmap_count("rules")).alias("n_rules"))


def fired_together(docs: DataFrame, engine: RuleEngine, text: str, *by: str) -> DataFrame:
    """by, first, second, rows: how many rows of each group two rules fire in together (first < second, by id).

    Rows are counted by the whole set of rules that fire in them first, with partial sums; pairs are listed of each distinct set only.
    """
    sets = docs.select(*by, F.array_sort(F.array_distinct(engine.process(F.col(text))["word_id"])).alias("__ids")).where(F.size("__ids") > 1)
    counts = sets.groupBy(*by, "__ids").agg(F.count(F.lit(1)).alias("__n"))
    first = counts.select(*by, "__n", "__ids", F.posexplode("__ids").alias("__at", "first"))
    pairs = first.select(*by, "__n", "first", F.explode(F.slice(F.col("__ids"), F.col("__at") + 2, F.size("__ids"))).alias("second"))
    return pairs.groupBy(*by, "first", "second").agg(F.sum("__n").alias("rows"))
