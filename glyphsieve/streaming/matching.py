"""Rule matching under Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphsieve.operators.engine import RuleEngine


def match_stream(stream: DataFrame, engine: RuleEngine, text: str, out: str = "matches") -> DataFrame:
    """A stream (or table) with the rules that fire in each row; keeps no state."""
    return engine.match_df(stream, text, out)


def hit_counts(stream: DataFrame, engine: RuleEngine, text: str, time: str, window: str, delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """window_start, word_id, word, hits: rows in which each rule fires by event-time window; late rows count until delay has passed."""
    naive = dict(stream.dtypes)[time] == "timestamp_ntz"  # watermarks need instants
    stream = stream.withColumn(time, F.col(time).cast("timestamp")) if naive else stream
    rows = engine.explode_matches(stream.withWatermark(time, delay) if stream.isStreaming else stream, text)
    span = F.window(time, window, slide) if slide else F.window(time, window)
    counted = rows.groupBy(span.alias("w"), "word_id", "word").agg(F.count(F.lit(1)).alias("hits"))
    start = F.col("w.start").cast("timestamp_ntz") if naive else F.col("w.start")
    return counted.select(start.alias("window_start"), "word_id", "word", "hits")
