"""Rules as relations: hits of patterns in variants are joined and aggregated; for hit rows and plans without Python."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphsieve.functions import variants
from glyphsieve.plans.compiler import Compiled
from glyphsieve.plans.expressions import WORD, quoted
from glyphsieve.plans.naive import word_character

SEED = 5  # patterns find their texts by a seed of so many characters, or by all if they have fewer
FEW = 64  # up to so many patterns of a process type, each is its own seed whatever it costs
ONE_BY_ONE = 512  # up to so many strings, looking for each by itself costs less than one expression for all that is tried at every place
TRIE = 20_000  # seeds of one length up to which one regular expression holds them
WINDOW = 1 << 20  # characters of a text that one task searches; longer texts are cut
BROADCAST_BYTES = 32 << 20
HITS = "rule int, segment int, process_type int, variant int, n long"


def _entries(docs: DataFrame, compiled: Compiled, seeds: dict[tuple[int, str], str], counted: bool) -> tuple[DataFrame, int]:
    """One row for each alternative, with its seed, the expression that counts it and whether one hit says all, and the rows' bytes."""
    rows, rules = [], compiled.rules
    for pt, pattern, left, right, rule, segment in compiled.entries():
        before = f"(?<![{WORD}])" if left and word_character(pattern[0]) else ""
        after = f"(?![{WORD}])" if right and word_character(pattern[-1]) else ""
        bounded = bool(before or after)
        once = not counted and not bounded and rules[rule].segments[segment].quota == 1
        rows.append((pt, pattern, f"(?={before}{quoted(pattern)}{after})", bounded, once, seeds[pt, pattern], rule, segment))
    made = docs.sparkSession.createDataFrame(rows, "process_type int, pattern string, regex string, bounded boolean, once boolean, seed string, rule int, segment int")
    return made, sum(len(r[1]) + len(r[2]) + 64 for r in rows)


def _trie(seeds: list[str]) -> str:
    """A Java regular expression for any of seeds, which are of one length; common beginnings are written once."""
    if not seeds[0]:
        return ""
    heads: dict[str, list[str]] = {}
    for x in seeds:
        heads.setdefault(x[0], []).append(x[1:])
    parts = [re.sub(r"([^\w\s]|[#\s])", r"\\\1", h, flags=re.ASCII) + _trie(rest) for h, rest in sorted(heads.items())]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def _occurring(form: Column, seeds: list[str]) -> Column:
    """The seeds that occur in form. Some hundred are looked for one by one; more by one expression for each length, as at each place at most
    one of a length begins; of so many that no expression holds them, all strings of their length are given."""
    if len(seeds) <= ONE_BY_ONE:
        return F.filter(F.array(*[F.lit(s) for s in seeds]), lambda s: F.contains(form, s))
    lengths = {n: sorted({x for x in seeds if len(x) == n}) for n in sorted({len(x) for x in seeds})}
    found = [F.regexp_extract_all(form, F.lit(f"(?s)(?=({_trie(own) if len(own) <= TRIE else f'.{{{n}}}'}))"), F.lit(1)) for n, own in lengths.items()]
    return F.array_distinct(F.concat(*found))


def _found(forms: DataFrame, seeds: dict[int, set[str]]) -> Column:
    own = F.when(F.lit(False), F.lit(None).cast("array<string>"))
    for pt in sorted(seeds):
        own = own.when(F.col("process_type") == pt, _occurring(F.col("form"), sorted(seeds[pt])))
    return own


def _grams(pattern: str) -> list[str]:
    return [pattern[k : k + SEED] for k in range(max(1, len(pattern) - SEED + 1))]


def choose_seeds(forms: DataFrame, compiled: Compiled, few: int = FEW) -> dict[tuple[int, str], str]:
    """The seed of each pattern of a process type: itself where there are few, else that of its SEED-character strings which the fewest forms hold.

    A pass over all forms counts each of the patterns' strings with partial sums, so that no pattern stands for a beginning that
    nearly every text has. What comes to the driver is one count for each string of the rules, which it holds already.
    """
    patterns: dict[int, set[str]] = {}
    for pt, pattern, *_ in compiled.entries():
        patterns.setdefault(pt, set()).add(pattern)
    seeds = {(pt, p): p for pt, own in patterns.items() if len(own) <= few for p in own}
    many = {pt: own for pt, own in patterns.items() if len(own) > few}
    if many:
        grams = {pt: {g for p in own for g in _grams(p)} for pt, own in many.items()}
        told = forms.where(F.col("process_type").isin(*many)).select("process_type", F.explode(_found(forms, grams)).alias("seed"))
        if max(map(len, grams.values())) > TRIE:  # then all strings of the forms are given
            own = forms.sparkSession.createDataFrame([(pt, g) for pt, gs in grams.items() for g in sorted(gs)], "process_type int, seed string")
            told = told.join(F.broadcast(own) if 64 * sum(map(len, grams.values())) <= BROADCAST_BYTES else own, ["process_type", "seed"])
        counts = {(r.process_type, r.seed): r["count"] for r in told.groupBy("process_type", "seed").count().collect()}
        seeds |= {(pt, p): min(_grams(p), key=lambda g: counts.get((pt, g), 0)) for pt, own in many.items() for p in own}
    return seeds


def forms_of(docs: DataFrame, compiled: Compiled, text: str, key: str, window: int = WINDOW) -> DataFrame:
    """__key, process_type, variant, form, lead, body: each distinct variant of each text under each process type.

    A form is searched for hits that start within body characters behind lead of context. Variants of up to window characters are one
    form; longer ones are cut into many, which are dealt out to all tasks: each has one character of context before and as many
    behind as the longest pattern, so hits that lie across a cut, and boundaries at it, are found where they start.
    """
    types = sorted({pt for pt, *_ in compiled.entries()})
    longest = max(len(e[1]) for e in compiled.entries())
    every = [F.struct(F.lit(pt).alias("process_type"), F.array_distinct(F.array(*variants(pt, F.col(text), compiled.own))).alias("texts")) for pt in types]
    each = lambda df: df.select(F.col(key).alias("__key"), F.explode(F.array(*every)).alias("f")).select("__key", F.col("f.process_type").alias("process_type"), F.posexplode("f.texts").alias("variant", "form"))
    texts = docs.where(F.col(text) != "")
    # no more bytes than characters: no text counts as short that is long; transforms may make a text longer, so its variants are measured
    whole = each(texts.where(F.octet_length(text) <= window)).select("*", F.lit(0).alias("lead"), F.length("form").alias("body"))
    size = max(window, longest)  # so that the context behind a window lies in the next one
    parts = F.regexp_extract_all("form", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))  # in one pass over the text
    before = lambda i: F.when(i > 0, F.right(F.get("parts", i - 1), F.lit(1))).otherwise("")
    behind = lambda i: F.coalesce(F.substr(F.get("parts", i + 1), F.lit(1), F.lit(longest)), F.lit(""))
    cut = lambda p, i: F.struct(F.concat(before(i), p, behind(i)).alias("form"), F.when(i > 0, 1).otherwise(0).alias("lead"), F.length(p).alias("body"))
    pieces = each(texts.where(F.octet_length(text) > window)).select("__key", "process_type", "variant", parts.alias("parts"))
    pieces = pieces.select("__key", "process_type", "variant", F.posexplode(F.transform("parts", cut)).alias("piece", "p"))
    # so many by number: a few windows make little data, but much work
    spread = pieces.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__key", "process_type", "variant", "piece")
    return whole.unionByName(spread.select("__key", "process_type", "variant", "p.form", "p.lead", "p.body"))


def hit_rows(docs: DataFrame, compiled: Compiled, text: str, key: str, window: int = WINDOW, counted: bool = True) -> DataFrame:
    """key, rule, segment, process_type, variant, n: hits of each alternative in each distinct variant of each text; of a variant that was cut
    (see forms_of) a row for each window with hits.

    Patterns find texts by an equi-join of their seeds (see choose_seeds) with those that occur in a form, and are then verified. Up to
    ONE_BY_ONE patterns are their own seeds, as choosing others takes a pass over all forms that costs more. Unless counted, n is 1 for hits of
    an alternative without boundaries in a segment that asks for one: the rest of the text is not searched.
    The table of patterns is broadcast if its bytes, known from the compiled rules, allow; else the join is an ordinary
    shuffle join by type and seed, whose hot seeds AQE splits.
    """
    each = forms_of(docs, compiled, text, key, window)
    seeds = choose_seeds(each, compiled, ONE_BY_ONE)
    entries, size = _entries(docs, compiled, seeds, counted)
    small = lambda df: F.broadcast(df) if size <= BROADCAST_BYTES else df
    own: dict[int, set[str]] = {}
    for (pt, _), seed in seeds.items():
        own.setdefault(pt, set()).add(seed)
    pairs = each.withColumn("s", F.explode(_found(each, own))).join(small(entries.withColumnRenamed("process_type", "p")), (F.col("process_type") == F.col("p")) & (F.col("s") == F.col("seed"))).drop("p")
    # of a window, up to the pattern's length behind its body, less a hit that starts in the context before and one just behind the body
    size_of = F.length("pattern")
    searched = F.substr("form", F.lit(1), F.col("lead") + F.col("body") + size_of)
    early = F.when(F.col("lead") > 0, F.regexp_count(F.substr("form", F.lit(1), size_of + 1), F.concat(F.lit("^"), "regex"))).otherwise(0)
    late = F.regexp_count(F.substr("form", F.col("lead") + F.col("body"), size_of + 1), F.concat(F.lit("^[\\s\\S]"), "regex"))
    whole = (F.col("lead") == 0) & (F.col("body") == F.length("form"))
    n = F.when(F.col("once"), 1).when(whole, F.regexp_count("form", F.col("regex"))).otherwise(F.regexp_count(searched, F.col("regex")) - early - late)
    # a filter on n itself would count twice; without boundaries, what a whole form contains is a hit
    sure = F.col("once") | (whole & ~F.col("bounded"))
    pairs = pairs.where(F.contains("form", F.col("pattern"))).where(sure | (n > 0))
    return pairs.select("__key", "rule", "segment", "process_type", "variant", n.cast("long").alias("n"))


def matches(docs: DataFrame, compiled: Compiled, text: str, key: str, window: int = WINDOW) -> DataFrame:
    """key, process_type, word_id, word: a row for each rule that fires in a row of docs; key must tell rows apart.

    Hits are summed over a segment's alternatives, then the largest sum of its variants is held against its quota.
    """
    hits = hit_rows(docs, compiled, text, key, window, counted=False)
    sums = hits.groupBy("__key", "rule", "segment", "variant").agg(F.sum("n").alias("n"))
    most = sums.groupBy("__key", "rule", "segment").agg(F.max("n").alias("n"))
    spark = docs.sparkSession
    quotas = spark.createDataFrame([(k, s.number, s.negative, s.quota) for k, r in enumerate(compiled.rules) for s in r.segments], "rule int, segment int, negative boolean, quota int")
    names = spark.createDataFrame([(k, int(r.process_type), r.word_id, r.word, len(r.needed)) for k, r in enumerate(compiled.rules)], "rule int, process_type int, word_id long, word string, needed int")
    fit = len(compiled.rules) * 200 <= BROADCAST_BYTES
    side = F.broadcast if fit else (lambda df: df)
    reached = most.join(side(quotas), ["rule", "segment"]).where("n >= quota")
    state = reached.groupBy("__key", "rule").agg(F.count(F.when(~F.col("negative"), 1)).alias("have"), F.bool_or("negative").alias("vetoed"))
    fired = state.join(side(names), "rule").where("have = needed and not vetoed")
    return fired.select(F.col("__key").alias(key), "process_type", "word_id", "word")
