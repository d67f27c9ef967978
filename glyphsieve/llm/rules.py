"""Quality rules whose thresholds come from mergeable quantile sketches; DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphsieve.llm.common import materialize, sized

#: What the sketches watch: a name, the value, and for shares, of which most documents have none at all, the part of a group's documents
#: that may not lie above the limit. These parts and RARE were chosen on the labels of sf0.1 (see README).
FEATURES: dict[str, tuple[str, float | None]] = {
    "symbol_share": ("n_symbols / greatest(word_chars, 1)", 0.9),
    "mean_word": ("word_chars / greatest(n_words, 1)", None),
    "dup_line_share": ("n_dup_lines / greatest(n_lines, 1)", 0.99),
    "repeat_share": ("n_repeat_words / greatest(n_words, 1)", 0.99),
}
#: Where fewer documents than that part have any of it, the limit is this quantile of the shares of those that have, once there are so many.
RARE, ENOUGH = 0.05, 20
SHARES = [f for f, (_, part) in FEATURES.items() if part is not None]
METRICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in words.

    Windows are 64-bit hashes. If all differ there is nothing to do; if few repeat, one scan finds where; else hashes
    are sorted with their places, so no text takes time in proportion to its length squared.
    """

    def covered(starts: Column) -> Column:
        empty = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"))
        return F.aggregate(starts, empty, step)["n"]

    def by_scan(hashes: Column, twice: Column) -> Column:
        return covered(F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: F.array_contains(twice, hashes[i])))

    def by_sort(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
        again = _let(pairs, lambda s: F.transform(F.filter(s, lambda x, k: F.coalesce(same(s, x, k), F.lit(False))), lambda x: x["i"]))
        return covered(F.array_sort(again))

    def count(hashes: Column) -> Column:
        twice = _let(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(s, lambda h, k: F.coalesce(F.get(s, k - 1) == h, F.lit(False)))))
        some = _let(twice, lambda t: F.when(F.size(t) <= 16, by_scan(hashes, t)).otherwise(by_sort(hashes)))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(some)

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(_let(windows, count))


def metrics(docs: DataFrame, *carry: str) -> DataFrame:
    """The columns carry and METRICS (long) of every whole text (null: empty)."""
    text = F.coalesce("text", F.lit(""))
    read = docs.select(*carry, text.alias("__text"), F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+", -1), lambda w: w != "").alias("__words"))
    lines = F.filter(F.split("__text", "\n", -1), lambda x: F.regexp_replace(x, "[ \\t\\n\\x0B\\f\\r]+", "") != "")
    lines = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    out = read.select(
        *carry,
        F.size("__words").cast("long").alias("n_words"),
        F.aggregate("__words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
    )
    return out.select(*carry, "n_words", "word_chars", "n_symbols", F.col("__lines.n").cast("long").alias("n_lines"), F.col("__lines.dup").cast("long").alias("n_dup_lines"), "n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def least_documents(part: float | None, least: int) -> int:
    """How many documents a group needs for a limit of its own: least, or so many that five lie beyond the quantile."""
    return least if part is None else max(least, round(5 / (1 - part)))


def sketches(measured: DataFrame, k: int = 4096) -> DataFrame:
    """lang, source, n, a KLL sketch of each feature over the measured documents that pass the base rules, and of shares also one over
    those that are not 0, with their number.

    Sketches merge: a group's may be built by any number of tasks, and groups may be merged to languages or to all.
    """
    shares = measured.where(~base_failed()).select("lang", "source", *[F.expr(e).cast("double").alias(f) for f, (e, _) in FEATURES.items()])
    cols = [F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(f, k).alias(f) for f in FEATURES]]
    for f in SHARES:
        some = F.when(F.col(f) > 0, F.col(f))
        cols += [F.count(some).alias(f"n_{f}"), F.kll_sketch_agg_double(some, k).alias(f"some_{f}")]
    return shares.groupBy("lang", "source").agg(*cols)


def thresholds(groups: DataFrame, least: int = 100, fence: int = 3) -> DataFrame:
    """lang, source, low_<feature>, high_<feature>.

    A share's limit is the quantile of its group that FEATURES names, and if that is 0 the quantile RARE of the shares above 0: so it
    is a share that some document has, however long texts are. The length of words has both limits: its quartiles, each
    parted from the other by fence times their ratio again (the outer fences of a box plot of logarithms). Groups with fewer than
    least_documents, or with fewer than ENOUGH shares above 0 where these tell, take their language's merged sketch, then all documents'.
    """

    def merged(*by: str) -> DataFrame:
        kept = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(f).alias(f) for f in FEATURES]]
        for f in SHARES:
            kept += [F.sum(f"n_{f}").alias(f"n_{f}"), F.kll_merge_agg_double(f"some_{f}").alias(f"some_{f}")]
        return groups.groupBy(*by).agg(*kept)

    def limits(of: DataFrame, prefix: str, *by: str, enough: int = ENOUGH) -> DataFrame:
        quantile = lambda f, q: F.kll_sketch_get_quantile_double(F.col(f), F.lit(q))
        away = lambda x, ratio: reduce(lambda a, _: a * ratio, range(fence), x)
        cols = []
        for f, (_, part) in FEATURES.items():
            if part is None:
                a, b = quantile(f, 0.25), quantile(f, 0.75)
                low, high = away(a, a / b), away(b, b / a)
            else:
                rare = F.when(F.col(f"n_{f}") >= enough, quantile(f"some_{f}", RARE))
                low, high = F.lit(None).cast("double"), F.when(quantile(f, part) > 0, quantile(f, part)).otherwise(rare)
            cols.append(F.struct(low.alias("low"), high.alias("high")).alias(f"{prefix}{f}"))
        return of.select(*[F.col(b).alias(f"{prefix}{b}") for b in by], F.col("n").alias(f"{prefix}n"), *cols)

    own = limits(groups, "g_", "lang", "source")
    langs = limits(merged("lang"), "l_", "lang")
    total = limits(merged().where("n > 0"), "", enough=1).first()  # one row, or none of an empty table
    joined = own.join(langs, F.col("g_lang").eqNullSafe(F.col("l_lang")), "left")
    overall = lambda f: F.struct(*[F.lit(total[f][s] if total else None).cast("double").alias(s) for s in ("low", "high")])

    def choose(f: str) -> Column:
        n = least_documents(FEATURES[f][1], least)
        known = lambda p: F.when((F.col(f"{p}n") >= n) & F.col(f"{p}{f}.high").isNotNull(), F.col(f"{p}{f}"))
        return F.coalesce(known("g_"), known("l_"), overall(f))

    return joined.select(F.col("g_lang").alias("lang"), F.col("g_source").alias("source"), *[choose(f)[s].alias(f"{s}_{f}") for f in FEATURES for s in ("low", "high")])


def judge(docs: DataFrame, k: int = 4096, least: int = 100, fence: int = 3) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines of every document of docs
    (doc_id, text, lang, source).

    Base rules fail texts of under 50 words or with over half their words in repeated windows. Of the rest, a document
    is kept while every feature lies inside the thresholds of its language and source, limits included; see sketches and thresholds. One
    without symbols, repeated lines or windows never fails by that feature.
    Texts are read once: their metrics are written, sketched and joined. KLL sketches draw lots once a group has more
    than k documents, so a document within the sketch's rank error of a fence may fall on either side.
    Nulls: a null text has no words (base_failed); null lang or source are a value like others; a null doc_id stays.
    Repeated rows are judged each. An empty table gives no rows. Texts of any length are measured whole, in one value. Other columns
    are not read.
    """
    measured = materialize(metrics(docs, "doc_id", "lang", "source"), "metrics")
    groups = materialize(sketches(measured, k), "sketches")
    limits = materialize(thresholds(groups, least, fence), "limits").select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *[f"{s}_{f}" for f in FEATURES for s in ("low", "high")])
    on = F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source"))
    joined = measured.join(sized(limits, 200), on, "left")
    inside = []
    for f, (e, _) in FEATURES.items():  # no limit (a group without any) fails none
        inside += [F.coalesce(F.expr(e) <= F.col(f"high_{f}"), F.lit(True)), F.coalesce(F.expr(e) >= F.col(f"low_{f}"), F.lit(True))]
    verdict = reduce(lambda a, b: a & b, inside)
    return joined.select("doc_id", *[m for m in METRICS if m != "n_lines"], base_failed().alias("base_failed"), (~base_failed() & verdict).alias("kept"), "n_lines")


def keep_good(docs: DataFrame, **options: float) -> DataFrame:
    """The rows of docs, columns unchanged, whose doc_id judge() rejects in no row. Rows of null doc_id share one verdict."""
    rejected = materialize(judge(docs, **options).where("not kept").select(F.col("doc_id").alias("__rejected")).distinct(), "rejected")
    return docs.join(sized(rejected, 16), docs["doc_id"].eqNullSafe(rejected["__rejected"]), "left_anti")
