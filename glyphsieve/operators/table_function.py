"""Rules as SQL table functions: hits of a text by LATERAL join, and of a table that SQL has parted and ordered."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

HIT = [StructField("process_type", IntegerType()), StructField("word_id", LongType()), StructField("word", StringType())]


def register_table_functions(spark: SparkSession, shared, name: str) -> None:  # noqa: ANN001  a broadcast Scanner
    """Two table functions in SQL.

    name_hits(text): a row (process_type, word_id, word) for each rule that fires, by process type and id; none for a null text.
    name_hits_of(TABLE(t) [PARTITION BY ... ORDER BY ...], 'column'): the rows of t, for each rule that fires in their column, with
    the hit's columns and nth, how many rows of the partition so far this rule has fired in. A partition is read row by row; what is kept of it is
    one count a rule. Clashing names of t's columns are an error, as is a column that is no string.
    """

    class Hits:
        @staticmethod
        def analyze(text: AnalyzeArgument) -> AnalyzeResult:
            if text.isTable or not isinstance(text.dataType, StringType):
                raise ValueError(f"{name}_hits takes a string")
            return AnalyzeResult(StructType(HIT))

        def eval(self, text: str | None) -> Iterator[tuple]:
            scanner = shared.value
            for r in scanner.fired(text):
                yield (scanner.process_types[r], *scanner.rules[r][:2])

    class HitsOf:
        def __init__(self) -> None:
            self.seen: Counter[int] = Counter()

        @staticmethod
        def analyze(rows: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable or not column.isConstantExpression:
                raise ValueError(f"{name}_hits_of takes a TABLE and the name of one of its columns")
            own = {f.name: f for f in rows.dataType.fields}
            if not isinstance(own.get(column.value, StructField("", LongType())).dataType, StringType):
                raise ValueError(f"the table has no string column {column.value!r}")
            if clash := {*own} & {"process_type", "word_id", "word", "nth"}:
                raise ValueError(f"the table has columns of the result: {sorted(clash)}")
            return AnalyzeResult(StructType([*own.values(), *HIT, StructField("nth", LongType())]))

        def eval(self, rows: Row, column: str) -> Iterator[tuple]:
            scanner = shared.value
            for r in scanner.fired(rows[column]):
                self.seen[r] += 1
                yield (*rows, scanner.process_types[r], *scanner.rules[r][:2], self.seen[r])

    spark.udtf.register(f"{name}_hits", udtf(Hits))
    spark.udtf.register(f"{name}_hits_of", udtf(HitsOf))
