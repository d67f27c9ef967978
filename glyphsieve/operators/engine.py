"""The rule engine: compile once, then ask of any string column whether, which and which first of the rules fire."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsieve.flags import ProcessType, RuleError
from glyphsieve.operators.automaton import Scanner
from glyphsieve.operators.table_function import register_table_functions
from glyphsieve.plans import expressions, relational
from glyphsieve.plans.compiler import Compiled, compile_rules
from glyphsieve.plans.expressions import MATCHES
from glyphsieve.tables import Own

#: Up to so many alternatives, rules are expressions; beyond, one automaton scan is cheaper than that many searches.
FEW = 48
#: An automaton that takes more than this, by size_bytes, is not broadcast: match_rows evaluates rule tables of any size.
MOST_BYTES = 128 << 20


class RuleEngine:
    """Evaluates rules over DataFrames. tier is "expressions", "automaton", or None to choose by the number of patterns.

    Null and empty texts fire nothing. Results are ordered by process type and word_id; word is the rule as written. own holds
    tables that take the place of derived ones, by transform bit (see sources.read_table).
    """

    def __init__(self, rows: Iterable[tuple[int, int, str]], tier: str | None = None, own: Own = None):
        self.compiled: Compiled = compile_rules(rows, own)
        if tier not in (None, "expressions", "automaton"):
            raise ValueError(f"no tier {tier!r}")
        self.tier = tier or ("expressions" if sum(1 for _ in self.compiled.entries()) <= FEW else "automaton")

    def __repr__(self) -> str:
        return f"RuleEngine({len(self.compiled.rows)} rules, {len(self.compiled.patterns)} patterns, {self.tier})"

    def __getstate__(self) -> dict:
        return {"compiled": self.compiled, "tier": self.tier}

    @cached_property
    def _scanner(self):  # noqa: ANN202
        if self.size_bytes() > MOST_BYTES:
            raise RuleError(f"rules of about {self.size_bytes()} bytes are too many to broadcast; use match_rows")
        return SparkSession.builder.getOrCreate().sparkContext.broadcast(Scanner(self.compiled))

    def scanner(self):  # noqa: ANN201
        """The broadcast automaton, whatever the tier."""
        return self._scanner

    def is_match(self, text: Column) -> Column:
        """Whether any rule fires."""
        if self.tier == "expressions":
            return expressions.is_match(self.compiled, text)
        shared = self._scanner

        @F.arrow_udf("boolean")
        def run(texts: pa.Array) -> pa.Array:
            return pa.array(shared.value.any_fired(texts.to_pylist()), pa.bool_())

        return run(text)

    def process(self, text: Column) -> Column:
        """array<struct<word_id, word>> of all rules that fire."""
        if self.tier == "expressions":
            return expressions.process(self.compiled, text)
        shared = self._scanner

        @F.arrow_udf(MATCHES)
        def run(texts: pa.Array) -> pa.Array:
            fired = shared.value.fired
            return _results(shared.value, [fired(t) for t in texts.to_pylist()])

        return run(text)

    def process_into(self, existing: Column, text: Column) -> Column:
        """existing with the rules that fire appended."""
        return F.concat(F.coalesce(existing, F.array().cast(MATCHES)), self.process(text))

    def find_match(self, text: Column) -> Column:
        """The first rule that fires, or null. Expressions stop at it, the automaton at the first process type that has one."""
        if self.tier == "expressions":
            return expressions.first(self.compiled, text)
        shared = self._scanner

        @F.arrow_udf(MATCHES)
        def run(texts: pa.Array) -> pa.Array:
            fired = shared.value.fired
            return _results(shared.value, [fired(t, least=True)[:1] for t in texts.to_pylist()])

        return F.get(run(text), 0)

    def explode_matches(self, docs: DataFrame, text: str, limit: int | None = None) -> DataFrame:
        """docs with a row for each rule that fires (at most limit for each text) and its columns word_id, word; where docs has a column
        of such a name, match_word_id or match_word."""
        found = F.filter(F.array(self.find_match(F.col(text))), lambda m: m.isNotNull()) if limit == 1 else self.process(F.col(text))
        found = F.slice(found, 1, limit) if limit else found
        own = [F.col(f"__m.{c}").alias(f"match_{c}" if c in docs.columns else c) for c in ("word_id", "word")]
        return docs.select("*", F.explode(found).alias("__m")).select(*[docs[c] for c in docs.columns], *own)

    def match_df(self, docs: DataFrame, text: str, out: str = "matches") -> DataFrame:
        """docs with a column of all rules that fire, empty where none does. A column of that name is an error."""
        if out in docs.columns:
            raise ValueError(f"docs have a column {out!r} already")
        return docs.withColumn(out, self.process(F.col(text)))

    def semi(self, docs: DataFrame, text: str) -> DataFrame:
        """The rows of docs in which some rule fires. Literals are looked for by the scan where it can."""
        if self.tier == "expressions":
            return docs.where(expressions.predicate(self.compiled, F.col(text)))
        return docs.where(self.is_match(F.col(text)))

    def anti(self, docs: DataFrame, text: str) -> DataFrame:
        """The rows of docs in which no rule fires, null texts among them."""
        return docs.where(~self.is_match(F.col(text)))

    def match_rows(self, docs: DataFrame, text: str, key: str) -> DataFrame:
        """key, process_type, word_id, word of each rule that fires, by joins and aggregates alone; key tells rows apart."""
        return relational.matches(docs, self.compiled, text, key)

    def hit_rows(self, docs: DataFrame, text: str, key: str) -> DataFrame:
        """Hits of single alternatives before any rule is decided."""
        return relational.hit_rows(docs, self.compiled, text, key).withColumnRenamed("__key", key)

    def results_json(self, text: Column) -> Column:
        """All rules that fire as a JSON array of {"word_id", "word"}."""
        return F.to_json(self.process(text))

    def register(self, spark: SparkSession, name: str) -> None:
        """SQL functions: name_is_match(text), and name_process(text) for the ids of the rules that fire. A few rules without transforms
        become SQL functions that are planned with the query they stand in (a contains of a literal reaches the scan); else they are UDFs."""
        told = expressions.sql(self.compiled, "t") if self.tier == "expressions" else None
        if told:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_is_match(t STRING) RETURNS BOOLEAN RETURN coalesce({' OR '.join(told)}, false)")
            ids = ", ".join(f"CASE WHEN {c} THEN {r.word_id}L END" for c, r in zip(told, self.compiled.rules, strict=True))
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_process(t STRING) RETURNS ARRAY<BIGINT> RETURN array_compact(array({ids}))")
            return
        shared = self._scanner

        @F.arrow_udf("boolean")
        def matches(texts: pa.Array) -> pa.Array:
            return pa.array(shared.value.any_fired(texts.to_pylist()), pa.bool_())

        @F.arrow_udf("array<bigint>")
        def ids_of(texts: pa.Array) -> pa.Array:
            scanner = shared.value
            return pa.array([[scanner.rules[r][0] for r in scanner.fired(t)] for t in texts.to_pylist()], pa.list_(pa.int64()))

        spark.udf.register(f"{name}_is_match", matches)
        spark.udf.register(f"{name}_process", ids_of)

    def register_table_functions(self, spark: SparkSession, name: str) -> None:
        """SQL table functions name_hits(text) and name_hits_of(TABLE(t), column); see operators.table_function."""
        register_table_functions(spark, self._scanner, name)

    def quotas_df(self, spark: SparkSession) -> DataFrame:
        """rule, segment, negative, quota: rules by their numbers."""
        return spark.createDataFrame([(k, s.number, s.negative, s.quota) for k, r in enumerate(self.compiled.rules) for s in r.segments], "rule int, segment int, negative boolean, quota int")

    def numbered_df(self, spark: SparkSession) -> DataFrame:
        """rule, process_type, word_id, word, needed (how many segments must reach their quota)."""
        rows = [(k, int(r.process_type), r.word_id, r.word, len(r.needed)) for k, r in enumerate(self.compiled.rules)]
        return spark.createDataFrame(rows, "rule int, process_type int, word_id long, word string, needed int")

    def rules_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.compiled.rows, "process_type int, word_id long, word string")

    def stats(self) -> dict:
        return {"rules": len(self.compiled.rows), "patterns": len(self.compiled.patterns), "process_types": sorted({ProcessType(pt).snake_case() for pt in self.compiled.types()}), "tier": self.tier}

    def size_bytes(self) -> int:
        """Estimate of what a broadcast of the compiled rules takes: an automaton's node for each character of a pattern, and each rule's words."""
        entries = [(p, 72) for _, p, *_ in self.compiled.entries()]
        return sum(16 * len(p) + n for p, n in entries) + sum(2 * len(word) + 72 for _, _, word in self.compiled.rows)

    def to_json(self) -> str:
        out: dict[str, dict[str, str]] = {}
        for pt, word_id, word in self.compiled.rows:
            out.setdefault(str(pt), {})[str(word_id)] = word
        return json.dumps(out, ensure_ascii=False)


def _results(scanner: Scanner, fired: list[list[int]]) -> pa.Array:
    """The rules of each text, taken by their numbers from one array of all."""
    if not hasattr(scanner, "names"):
        ids, words = [r[0] for r in scanner.rules], [r[1] for r in scanner.rules]
        scanner.names = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string())], ["word_id", "word"])
    ends = np.cumsum([0, *map(len, fired)], dtype=np.int32)
    flat = np.fromiter((r for own in fired for r in own), np.int64, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), scanner.names.take(pa.array(flat)))


class RuleEngineBuilder:
    """Collects rules; of those with one type and id the last stays. build() empties the builder, so a second one fails."""

    def __init__(self) -> None:
        self._rows: list[tuple[int, int, str]] = []
        self._built = False

    def add_word(self, process_type: int, word_id: int, word: str) -> RuleEngineBuilder:
        if self._built:
            raise ValueError("already built")
        self._rows.append((process_type, word_id, word))
        return self

    add = add_word

    def to_json(self) -> str:
        nested: Mapping[str, dict[str, str]] = {}
        for pt, word_id, word in self._rows:
            nested.setdefault(str(int(ProcessType.checked(pt))), {})[str(word_id)] = word
        return json.dumps(nested, ensure_ascii=False)

    def build(self, tier: str | None = None) -> RuleEngine:
        if self._built:
            raise ValueError("already built")
        engine = RuleEngine(self._rows, tier)
        self._built, self._rows = True, []
        return engine
