"""Rule hits by sessions of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphsieve.operators.engine import RuleEngine


def session_hits(rows: DataFrame, engine: RuleEngine, text: str, time: str, key: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """key, session_start, session_end, events, hits, rules: rows of a key no more than gap apart are a session, which ends gap after the last; hits
    are its rows times the rules that fire in each, rules the ids of those that fired, ascending.

    On a stream (append mode) a session comes out once the watermark, delay behind the latest time seen, has passed its end; a row that is
    so late that a session of its own would have ended is dropped. State is one row a session that is open, and no more ids than rules.
    A null key is a key; rows of null time are in no session.
    """
    naive = dict(rows.dtypes)[time] == "timestamp_ntz"  # watermarks need instants
    fired = rows.select(F.col(key).alias("__key"), F.col(time).cast("timestamp").alias("__time"), engine.process(F.col(text))["word_id"].alias("__ids")).where("__time is not null")
    fired = fired.withWatermark("__time", delay) if rows.isStreaming else fired
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_set("__ids"))))
    out = fired.groupBy("__key", F.session_window("__time", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.sum(F.size("__ids")).cast("long").alias("hits"), ids.alias("rules"))
    instant = lambda c: F.col(c).cast("timestamp_ntz") if naive else F.col(c)
    return out.select(F.col("__key").alias(key), instant("w.start").alias("session_start"), instant("w.end").alias("session_end"), "events", "hits", "rules")
