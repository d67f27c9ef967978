"""Rule tables that change: a log of changes becomes intervals, and rows meet the rules that were valid at their time."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphsieve.operators.engine import RuleEngine
from glyphsieve.operators.time_joins import within


class RuleVersions:
    """Rules from a log with columns at, process_type, word_id, word: from at on, the rule of that type and id is word, or none if word is null.

    Of changes of one rule at one time the one with the largest order column stays (without one: the largest word, and a deletion goes before
    any word). Rows of null at or word_id are no changes. Every wording that the log ever names is compiled, on the driver: over most of
    them is an error. Those that are no rule (see compile_rules) match nothing.
    """

    def __init__(self, log: DataFrame, order: str | None = None, most: int = 5_000_000):
        kind = F.col("process_type").cast("int")
        kind = F.when(kind.bitwiseAND(126) != 0, kind.bitwiseAND(126)).otherwise(kind)  # none beside another type means nothing
        changes = log.where("at is not null and word_id is not null").select("at", kind.alias("process_type"), F.col("word_id").cast("long").alias("word_id"), "word", F.col(order or "word").alias("__order"))
        last = changes.groupBy("process_type", "word_id", "at").agg(F.max(F.struct(F.col("__order"), F.col("word"))).alias("x")).select("process_type", "word_id", "at", "x.word")
        each = Window.partitionBy("process_type", "word_id").orderBy("at")
        #: process_type, word_id, word, valid_from, valid_to (null: to this day)
        self.intervals = last.select("process_type", "word_id", "word", F.col("at").alias("valid_from"), F.lead("at").over(each).alias("valid_to")).where("word is not null")
        rows = self.intervals.select("process_type", "word").distinct().orderBy("process_type", "word").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} rules")
        self._numbered = [(k, r.process_type, r.word) for k, r in enumerate(rows)]

    def match(self, docs: DataFrame, text: str, time: str, width: str = "1 day") -> DataFrame:
        """docs with process_type, word_id, word and valid_from of each rule that fires in text and was valid at time. A row of null time meets none.

        Each wording is looked for once, however many rules and times it stands in; its intervals are joined by wording and time bucket.
        """
        if not self._numbered:
            return docs.select("*", *[F.lit(None).cast(self.intervals.schema[c].dataType).alias(c) for c in ("process_type", "word_id", "word", "valid_from")]).where("false")
        spark = docs.sparkSession
        engine = RuleEngine([(pt, k, word) for k, pt, word in self._numbered])
        numbers = spark.createDataFrame(self._numbered, "__n long, process_type int, word string")
        spans = self.intervals.join(numbers, ["process_type", "word"])
        hits = docs.select("*", F.explode(engine.process(F.col(text))["word_id"]).alias("__hit"))
        return within(hits, spans, ("__hit", "__n"), time, "valid_from", "valid_to", ["process_type", "word_id", "word", "valid_from"], width).drop("__hit")

    def at(self, time: datetime.datetime) -> RuleEngine:
        """The engine of the rules that were valid at one time."""
        valid = self.intervals.where((F.col("valid_from") <= F.lit(time)) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(time))))
        return RuleEngine([(r.process_type, r.word_id, r.word) for r in valid.collect()])
