"""Rule tables from JSON, dictionaries and DataFrames; texts from lines; codepoint tables from tab-separated files."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsieve.operators.engine import RuleEngine


def from_json(data: bytes, tier: str | None = None) -> RuleEngine:
    """An engine from bytes of ``{"<process type>": {"<id>": "<rule>"}}``. Other types than bytes are a TypeError, anything
    that is not such JSON, or leaves no pattern, a ValueError."""
    if not isinstance(data, (bytes, bytearray)):
        raise TypeError("JSON rules come as bytes")
    try:
        nested = json.loads(data)
        rows = [(int(pt), int(k), word) for pt, words in nested.items() for k, word in words.items()]
    except (UnicodeDecodeError, json.JSONDecodeError, AttributeError, TypeError, ValueError) as e:
        raise ValueError(f"not a rule table: {e}") from e
    return RuleEngine(rows, tier)


def from_dict(nested: Mapping[int, Mapping[int, str]], tier: str | None = None) -> RuleEngine:
    """An engine from {process type: {id: rule}}; wrong types are a TypeError."""
    if not isinstance(nested, Mapping) or not all(isinstance(pt, int) and isinstance(words, Mapping) for pt, words in nested.items()):
        raise TypeError("rules come as {process type: {id: rule}}")
    rows = [(pt, k, word) for pt, words in nested.items() for k, word in words.items()]
    if not all(isinstance(k, int) and isinstance(word, str) for _, k, word in rows):
        raise TypeError("ids are integers and rules are strings")
    return RuleEngine(rows, tier)


def from_dataframe(rules: DataFrame, order: str | None = None, tier: str | None = None, most: int = 5_000_000) -> RuleEngine:
    """An engine from rows (process_type, word_id, word); of those with one type and id the last by order stays, or the
    largest word. The rule table is brought to the driver, as compiling needs all of it: a table of over most rules is an error."""
    chosen = rules.groupBy("process_type", "word_id").agg(F.max_by("word", F.struct(order or "word", "word")).alias("word"))
    rows = chosen.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return RuleEngine([(r.process_type, r.word_id, r.word) for r in rows], tier)


def rules_from_json_column(df: DataFrame, column: Column) -> DataFrame:
    """process_type, word_id, word of the rule tables in a JSON column."""
    nested = F.from_json(column, "map<string, map<string, string>>")
    outer = df.select(F.explode(nested).alias("process_type", "words"))
    return outer.select(F.col("process_type").cast("int").alias("process_type"), F.explode("words").alias("word_id", "word")).select("process_type", F.col("word_id").cast("long").alias("word_id"), "word")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """text: the lines of text files."""
    return spark.read.text(path).withColumnRenamed("value", "text")


def read_table(path: str | Path) -> dict[int, str | None]:
    """A codepoint table from lines "key<TAB>value": # starts a comment line, a line of U+XXXX or one character without value deletes,
    of equal keys the last stays, and a value equal to its key is no entry."""

    def code(key: str) -> int:
        return int(key[2:], 16) if key.upper().startswith("U+") else ord(key)

    out: dict[int, str | None] = {}
    for line in _lines(path):
        key, tab, value = line.partition("\t")
        if key != value:
            out[code(key)] = value or None
    return out


def _lines(path: str | Path) -> Iterable[str]:
    return (x for x in Path(path).read_text(encoding="utf-8").split("\n") if x and not x.startswith("#"))
