"""Rules as boolean column expressions: for few rules; runs inside generated code, pushes literals down, needs no shuffle."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphsieve.functions import variants
from glyphsieve.plans.compiler import Alternative, Compiled, Rule, Segment
from glyphsieve.plans.naive import word_character

WORD = "A-Za-z0-9_\\x{80}-\\x{10FFFF}"
MATCHES = "array<struct<word_id:bigint,word:string>>"


def quoted(text: str) -> str:
    """A Java regular expression for exactly text."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def regex(a: Alternative, overlapping: bool = False) -> str:
    left = f"(?<![{WORD}])" if a.left and word_character(a.pattern[0]) else ""
    right = f"(?![{WORD}])" if a.right and word_character(a.pattern[-1]) else ""
    body = left + quoted(a.pattern) + right
    return f"(?={body})" if overlapping else body


def found(text: Column, a: Alternative) -> Column:
    bounded = re.match(r"\(\?<!", regex(a)) or regex(a).endswith("])")
    return text.rlike(regex(a)) if bounded else F.contains(text, F.lit(a.pattern))


def reached(texts: list[Column], s: Segment) -> Column:
    """Whether some variant has quota hits of the segment."""
    if not s.alternatives:
        return F.lit(False)
    if s.quota == 1:
        return reduce(lambda a, b: a | b, [found(t, a) for t in texts for a in s.alternatives])
    counts = [reduce(lambda a, b: a + b, [F.regexp_count(t, F.lit(regex(a, True))) for a in s.alternatives]) for t in texts]
    return reduce(lambda a, b: a | b, [n >= s.quota for n in counts])


def fires(rule: Rule, texts: list[Column]) -> Column:
    parts = [reached(texts, s) for s in rule.needed] + [~reached(texts, s) for s in rule.segments if s.negative]
    return reduce(lambda a, b: a & b, parts)


def _by_type(compiled: Compiled, text: Column) -> dict[int, list[Column]]:
    return {int(pt): variants(pt, text, compiled.own) for pt in {r.process_type for r in compiled.rules}}


def predicate(compiled: Compiled, text: Column) -> Column:
    """Whether any rule fires; null or false where a text is null. As a filter it is pushed to the scan where it is made of literals.
    Every rule needs a pattern, so empty texts fire none."""
    texts = _by_type(compiled, text)
    return reduce(lambda a, b: a | b, [fires(r, texts[int(r.process_type)]) for r in compiled.rules])


def is_match(compiled: Compiled, text: Column) -> Column:
    return F.coalesce(predicate(compiled, text), F.lit(False))


def _each(compiled: Compiled, text: Column) -> list[Column]:
    """(word_id, word) of each rule where it fires, else null."""
    texts = _by_type(compiled, text)
    return [F.when(fires(r, texts[int(r.process_type)]), F.struct(F.lit(r.word_id).cast("long").alias("word_id"), F.lit(r.word).alias("word"))) for r in compiled.rules]


def process(compiled: Compiled, text: Column) -> Column:
    """Array of (word_id, word) of the rules that fire, by process type and id."""
    every = F.filter(F.array(*_each(compiled, text)), lambda x: x.isNotNull())
    return F.when(text != "", every).otherwise(F.array().cast(MATCHES)).cast(MATCHES)


def first(compiled: Compiled, text: Column) -> Column:
    """The first rule that fires, or null; rules behind it are not evaluated."""
    return F.coalesce(*_each(compiled, text))


def sql(compiled: Compiled, text: str) -> list[str] | None:
    """What fires() says of each rule, as SQL over a column name; None if a rule has transforms. Strings are written as bytes, so that no
    quote or escape of theirs is read as SQL."""
    if compiled.types() != [1]:
        return None
    constant = lambda s: f"CAST(X'{s.encode('utf-8', 'surrogatepass').hex()}' AS STRING)"

    def one(a: Alternative) -> str:
        own = regex(a)
        return f"rlike({text}, {constant(own)})" if own != quoted(a.pattern) else f"contains({text}, {constant(a.pattern)})"

    def segment(s: Segment) -> str:
        if not s.alternatives:
            return "false"
        if s.quota == 1:
            return "(" + " OR ".join(map(one, s.alternatives)) + ")"
        return "(" + " + ".join(f"regexp_count({text}, {constant(regex(a, True))})" for a in s.alternatives) + f" >= {s.quota})"

    return ["(" + " AND ".join([*map(segment, r.needed), *[f"NOT {segment(s)}" for s in r.segments if s.negative]]) + ")" for r in compiled.rules]
