"""Rules over all rows of a key: segments may be found in different rows, a veto may come later."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glyphsieve.operators.engine import RuleEngine

SUMS = "key string, time timestamp, rules array<int>, segments array<int>, counts array<long>"
CHANGES = "key string, version long, word_id long, word string, fired boolean, closed boolean"


def partial_hits(rows: DataFrame, engine: RuleEngine, text: str, key: str, time: str) -> DataFrame:
    """SUMS: of each Arrow batch and key (as a string) the hits of each segment of each rule, of a row the most of its variants, and the last time.

    So a key with a third of all rows is a row a batch when it is shuffled.
    """
    shared = engine.scanner()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[str | None, dict[tuple[int, int], int]] = {}
            last: dict[str | None, int] = {}
            micros = b.column("time").cast(pa.timestamp("us", "UTC")).cast(pa.int64()).to_pylist()
            for k, t, x in zip(b.column("key").to_pylist(), micros, b.column("text").to_pylist(), strict=True):
                own = sums.setdefault(k, defaultdict(int))
                last[k] = max(last.get(k, t), t)
                for at, n in shared.value.hits(x).items():
                    own[at] += n
            columns = [pa.array(list(sums), pa.string()), pa.array([last[k] for k in sums], pa.int64()).cast(pa.timestamp("us", "UTC"))]
            columns += [pa.array([[at[i] for at in own] for own in sums.values()], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([list(own.values()) for own in sums.values()], pa.list_(pa.int64()))], ["key", "time", "rules", "segments", "counts"])

    named = rows.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("time"), F.col(text).alias("text")).where("time is not null")
    return named.mapInArrow(count, SUMS)


def rules_over_keys(rows: DataFrame, engine: RuleEngine, text: str, key: str, time: str) -> DataFrame:
    """key (as a string), word_id, word of the rules that fire in all rows of a key of a table taken together: hits of a segment are added up
    over the rows, then held against its quota."""
    each = partial_hits(rows, engine, text, key, time).select("key", F.explode(F.arrays_zip("rules", "segments", "counts")).alias("h"))
    sums = each.groupBy("key", F.col("h.rules").alias("rule"), F.col("h.segments").alias("segment")).agg(F.sum("h.counts").alias("n"))
    quotas, names = engine.quotas_df(rows.sparkSession), engine.numbered_df(rows.sparkSession)
    state = sums.join(quotas, ["rule", "segment"]).where("n >= quota").groupBy("key", "rule").agg(F.count_if(~F.col("negative")).alias("have"), F.bool_or("negative").alias("vetoed"))
    return state.join(names, "rule").where("have = needed and not vetoed").select(F.col("key").alias(key), "word_id", "word")


def rule_changes(stream: DataFrame, engine: RuleEngine, text: str, key: str, time: str, idle: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """CHANGES (update mode): a row whenever a rule comes to fire for a key (fired), or no longer does because a vetoing segment has reached its
    quota; versions count a key's changes. The last row of a key and rule tells how it stands: as rules_over_keys of all rows so far.

    Of a key its hits by segment are kept, never its rows. When the watermark, delay behind the latest time seen, is idle past a key's last
    row, its state is dropped with a last row (closed, the rest null), and it starts anew.
    """
    shared = engine.scanner()
    patience = stream.sparkSession.sql(f"SELECT CAST(INTERVAL {idle} AS INTERVAL DAY TO SECOND) AS i").first().i.total_seconds() * 1000

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rules, segments, counts, fired, version, last = state.get if state.exists else ([], [], [], [], 0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "version": [version + 1], "word_id": pd.array([None], "Int64"), "word": [None], "fired": [None], "closed": [True]})
            return
        scanner = shared.value
        sums = defaultdict(int, zip(zip(rules, segments, strict=True), counts, strict=True))
        for frame in frames:
            last = max(last, int(frame["time"].max().timestamp() * 1000))
            for row in zip(frame["rules"], frame["segments"], frame["counts"], strict=True):
                for r, s, n in zip(*row, strict=True):
                    sums[int(r), int(s)] += int(n)
        now, before = set(scanner.settled(sums)), set(fired)
        changed = sorted(now ^ before)
        at = list(sums)
        state.update(([r for r, _ in at], [s for _, s in at], [sums[x] for x in at], sorted(now), version + len(changed), last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + int(patience) + 1)
        if changed:
            names = [scanner.rules[r] for r in changed]
            yield pd.DataFrame({"key": key[0], "version": [version + k + 1 for k in range(len(changed))], "word_id": pd.array([n[0] for n in names], "Int64"), "word": [n[1] for n in names], "fired": [r in now for r in changed], "closed": False})

    kept = "rules array<int>, segments array<int>, counts array<long>, fired array<int>, version long, last long"
    sums = partial_hits(stream, engine, text, key, time).withWatermark("time", delay)
    return sums.groupBy("key").applyInPandasWithState(advance, CHANGES, kept, "update", GroupStateTimeout.EventTimeTimeout)


def last_changes(changes: DataFrame, key: str) -> DataFrame:
    """key, word_id, word of the rules that fire by the last of the changes that a stream has written."""
    last = changes.where("word_id is not null").groupBy("key", "word_id").agg(F.max_by(F.struct("word", "fired"), "version").alias("at"))
    return last.where("at.fired").select(F.col("key").alias(key), "word_id", "at.word")
