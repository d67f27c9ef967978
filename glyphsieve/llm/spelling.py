"""Spelling variants by anagram hashing: words whose bags of letters differ by one letter are joined on integer keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphsieve.llm.common import discard, materialize, sized

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-z\\u00C0-\\u00FF]+"


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, run: the maximal runs of letters of whole texts, A-Z in lower case."""
    text = F.translate("text", UPPER, LOWER)
    return docs.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(f"({RUN})"), F.lit(1))).alias("run"))


def damaged(doc_id: Column, run: Column, every: int = 97) -> Column:
    """run without one letter, if every divides the crc32 of "<doc_id>:<run>": that at crc32 % length."""
    h = F.crc32(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def lexicon(docs: DataFrame, least_letters: int = 5, least_seen: int = 3, every: int = 97) -> DataFrame:
    """word, n: the words of docs and how often they occur; see group_spellings."""
    words = runs(docs).select(damaged(F.col("doc_id"), F.col("run"), every).alias("word")).where(F.length("word") >= least_letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_seen)


def _value(letter: Column) -> Column:
    c = F.ascii(letter).cast("long")
    return c * c * c * c * c


def keyed(words: DataFrame) -> DataFrame:
    """word, n, key, gone: each word with its anagram key (gone is null), the sum of its letters' powers, and with that key less one letter,
    for each distinct letter of it.

    A word that loses b has the key of one without b; words that exchange b for c meet where each has lost its own. No two exchanges of
    letters have the same value (tests), so a pair meets once.
    """
    modulus = F.lit((1 << 62) - 57)  # for words of millions of letters
    whole = F.aggregate("letters", F.lit(0).cast("long"), lambda a, x: (a + _value(x)) % modulus)
    gone = F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("letters")))
    each = words.select("word", "n", F.split("word", "").alias("letters")).select("word", "n", whole.alias("whole"), gone.alias("gone"))
    less = F.when(F.col("gone").isNull(), F.col("whole")).otherwise(F.pmod(F.col("whole") - _value(F.col("gone")), modulus))
    return each.select("word", "n", less.alias("key"), "gone")


def _ordered(rows: DataFrame) -> DataFrame:
    """rows of keyed() with kind and rest: what stays of the word, with its place, when its letter gone is taken from there (kind "r"), and
    without the place (kind "d", for words whole or lessened). Words one exchange apart agree in an "r", one removal apart in a "d"."""
    word, gone = F.col("word"), F.col("gone")
    left = lambda i: F.concat(F.substr(word, F.lit(1), i), F.substr(word, i + 2))
    places = F.filter(F.sequence(F.lit(0), F.length(word) - 1), lambda i: F.substr(word, i + 1, F.lit(1)) == gone)
    row = lambda kind, *rest: F.struct(F.lit(kind).alias("kind"), F.xxhash64(*rest).alias("rest"))
    lessened = F.concat(F.transform(places, lambda i: row("r", left(i), i)), F.array_distinct(F.transform(places, lambda i: row("d", left(i)))))
    return rows.select("*", F.explode(F.when(gone.isNull(), F.array(row("d", word))).otherwise(lessened)).alias("o")).select(*rows.columns, "o.kind", "o.rest")


def near_pairs(words: DataFrame, bucket_words: int = 512) -> DataFrame:
    """word, n, near, near_n: both ways, the words (word, n) that differ by exactly one inserted, deleted or replaced code point.

    Keys are joined, then the order of letters is verified. Where more than bucket_words share a key (many anagrams), so that their pairs
    would be too many, the order of the letters is part of the key; there also no pair is lost.
    """
    rows = materialize(keyed(words), "keys")
    crowded = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("words")).where(F.col("words") > bucket_words).select("key"), "crowded")
    crowded = sized(crowded, 16)

    def joined(of: DataFrame, *on: str) -> DataFrame:
        other = of.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("gone").alias("other_gone"), *on)
        both = of.join(other, [*on]).where(~F.col("gone").eqNullSafe(F.col("other_gone")) & (F.levenshtein("word", "near", 1) == 1))
        return both.select("word", "n", "near", "near_n")

    few = joined(rows.join(crowded, "key", "left_anti"), "key")
    many = joined(_ordered(rows.join(crowded, "key", "left_semi")), "key", "kind", "rest").distinct()
    return few.unionByName(many)


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form): forms are followed to the last, twice as far in each round. n at least doubles from a word to its
    form, so some five rounds reach the end of any chain."""
    heads = materialize(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = heads.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(heads.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(heads)
        heads = moved
        if not moved.where("moved").limit(1).count():
            return heads.select("word", "root")


def group_spellings(docs: DataFrame, least_letters: int = 5, least_seen: int = 3, every: int = 97, ratio: int = 2, bucket_words: int = 512) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of docs (doc_id, text).

    Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF in whole texts, A-Z in lower case; where the crc32 of "<doc_id>:<run>" is a
    multiple of every, one letter is taken out (planted misspellings). Those of at least least_letters that occur least_seen times or
    more (n) are kept. n_near counts the words at distance one (see near_pairs); form is the one of them that occurs most (ties: the
    smallest in code-point order), if ratio times as often as the word or more; root is the last form that forms lead to, else the word.
    Occurrences are counted with partial sums, so a word that is a third of all is a few rows a task; all later steps are on distinct words.
    Nulls: a null text has no words; a null doc_id counts as an empty one. Repeated rows count each. An empty table gives no rows. Texts of any
    length are read whole, in one value. Other columns are not read.
    """
    words = materialize(lexicon(docs, least_letters, least_seen, every), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_pairs(words, bucket_words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    known = words.join(near, "word", "left")
    fits = -F.col("best.less") >= ratio * F.col("n")
    forms = materialize(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), "forms")
    return forms.join(_roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
