"""Named queries of the rule engine over the test tables, and the SQL that must give the same rows."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphsieve.flags import ProcessType
from glyphsieve.functions import reduce_text_process, reduce_text_process_emit, text_process
from glyphsieve.operators import RuleEngine, RuleEngineBuilder, RuleVersions
from glyphsieve.operators.bitmaps import counted, fired_bitmaps, fired_together, merged
from glyphsieve.operators.time_joins import asof, within
from glyphsieve.sources import from_dataframe, from_dict, from_json, lines, read_names, read_table, register, rules_from_json_column
from glyphsieve.streaming import hit_counts, last_changes, rule_changes, rules_over_keys, run_in_parts, run_to_files, scratch_folder, session_hits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

WORD = "A-Za-z0-9_\\x{80}-\\x{10FFFF}"
DELETED = "regexp_replace(text, '[\\p{Cc}\\p{Cf}\\p{M}\\p{P}\\p{S}\\p{Z}]', '', 'g')"
LATIN = "replace(strip_accents(lower(text)), 'ß', 'ss')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def has(p: str, text: str = "text") -> str:
    return f"contains({text}, '{p}')"


def hits(p: str, text: str = "text") -> str:
    """SQL for overlapping occurrences."""
    return f"len(list_filter(range(1, length({text}) - {len(p)} + 2), lambda i: substring({text}, i, {len(p)}) = '{p}'))"


def _matching(name: str, rows: Iterable[tuple[int, int, str]], condition: str, tier: str | None = None) -> None:
    """A query for doc_id and whether any of rows fires, with its SQL condition."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _table(spark, sf_dir, "documents").select("doc_id", RuleEngine(rows, tier).is_match(F.col("text")).alias("matched"))

    run.__name__, run.__doc__ = name, f"doc_id and whether {[r[2] for r in rows]} fire."
    query(f"SELECT doc_id, coalesce({condition}, false) AS matched FROM documents")(run)


_matching("lit_is_match", [(1, 1, "tion")], has("tion"))
_matching("and_match", [(1, 1, "hello&world"), (1, 2, "the&and")], f"{has('the')} AND {has('and')}")
_matching("or_match", [(1, 1, "quele|thereon|ciónas")], f"{has('quele')} OR {has('thereon')} OR {has('ciónas')}")
_matching("not_match", [(1, 1, "the~tion")], f"{has('the')} AND NOT {has('tion')}")
_matching("mixed_ops", [(1, 1, "the|der&an~rr|zzz&en")], f"({has('the')} OR {has('der')}) AND {has('an')} AND {has('en')} AND NOT ({has('rr')} OR {has('zzz')})")
_matching("deep_not", [(1, 1, "en~thth~quele~ciónas")], f"{has('en')} AND NOT {has('thth')} AND NOT {has('quele')} AND NOT {has('ciónas')}")
_matching("repeat_and", [(1, 1, "anan&anan&anan")], f"{hits('anan')} >= 3")
_matching("repeat_not", [(1, 1, "the~anan~anan")], f"{has('the')} AND {hits('anan')} < 2")
_matching("repeat_or_sum", [(1, 1, "anan|enen&anan|enen&anan|enen")], f"{hits('anan')} + {hits('enen')} >= 3")
_matching("boundary_left", [(1, 1, "\\bthe")], f"regexp_matches(text, '(^|[^{WORD}])the')")
_matching("boundary_right", [(1, 1, "the\\b")], f"regexp_matches(text, 'the($|[^{WORD}])')")
_matching("boundary_both", [(1, 1, "\\bthe\\b")], f"regexp_matches(text, '(^|[^{WORD}])the($|[^{WORD}])')")
_matching("boundary_not", [(1, 1, "\\ben\\b~\\bthe\\b")], f"regexp_matches(text, '(^|[^{WORD}])en($|[^{WORD}])') AND NOT regexp_matches(text, '(^|[^{WORD}])the($|[^{WORD}])')")
_matching("delete_dual_scan", [(4, 1, "ofthe"), (4, 2, "a, an")], f"{has('ofthe')} OR {has('ofthe', DELETED)} OR {has('a, an')} OR {has('a, an', DELETED)}")
_matching("normalize_match", [(8, 1, "Éaux"), (8, 2, "GROSS")], f"{has('eaux', LATIN)} OR {has('gross', LATIN)}")
_matching("delete_normalize", [(12, 1, "Ofthe"), (12, 2, "CIONES")], " OR ".join(has(p, t) for p in ("ofthe", "ciones") for t in ("text", DELETED, LATIN.replace("text", DELETED))))
_matching("automaton_match", [(1, 1, "the&and~tion"), (1, 2, "\\bder\\b"), (12, 3, "ofthe")], f"({has('the')} AND {has('and')} AND NOT {has('tion')}) OR regexp_matches(text, '(^|[^{WORD}])der($|[^{WORD}])') OR {has('ofthe')} OR {has('ofthe', DELETED)} OR {has('ofthe', LATIN.replace('text', DELETED))}", "automaton")

_matching("segments_by_text", [(1, 1, "the&the|der&der|the")], f"{has('the')}")
_matching("empty_alternatives", [(1, 1, "quele||thereon"), (1, 2, "|ciónas|")], f"{has('quele')} OR {has('thereon')} OR {has('ciónas')}")
_matching("dangling_operators", [(1, 1, "ofthe&"), (1, 2, "&quele"), (1, 3, "ciónas~|"), (1, 4, "~~er&&tion")], f"{has('ofthe')} OR {has('quele')} OR {has('ciónas')} OR ({has('tion')} AND NOT {has('er')})")
_matching("vetoes_alone_are_no_rule", [(1, 1, "~the"), (1, 2, "tion&that")], f"{has('tion')} AND {has('that')}")
_matching("last_rule_of_an_id_stays", [(1, 1, "e"), (1, 1, "tion&that")], f"{has('tion')} AND {has('that')}")
_matching("needed_after_veto", [(1, 1, "the~tion&and")], f"{has('the')} AND {has('and')} AND NOT {has('tion')}")
_matching("backslash_and_nul", [(1, 1, "a\\z"), (1, 2, "e\0f"), (1, 3, "\\bthat")], f"contains(text, 'a\\z') OR contains(text, 'e' || chr(0) || 'f') OR regexp_matches(text, '(^|[^{WORD}])that')")
_MANY = [f"{a}{b}|qu" for a in "etaoinsh" for b in "etaoinsrh"]
_matching("many_segments", [(1, 1, "&".join(_MANY))], " AND ".join(f"({has(m[:2])} OR {has('qu')})" for m in _MANY), "automaton")
_matching("none_beside_another", [(5, 1, "ofthe~tion"), (3, 2, "quele")], f"(({has('ofthe')} OR {has('ofthe', DELETED)}) AND NOT ({has('tion')} OR {has('tion', DELETED)})) OR {has('quele')}")

RULES = [(1, 1, "the&and"), (1, 2, "tion~the"), (1, 3, "der|que"), (1, 4, "anan&anan"), (1, 5, "\\ben\\b")]
RULE_SQL = {
    1: f"{has('the')} AND {has('and')}", 2: f"{has('tion')} AND NOT {has('the')}", 3: f"{has('der')} OR {has('que')}",
    4: f"{hits('anan')} >= 2", 5: f"regexp_matches(text, '(^|[^{WORD}])en($|[^{WORD}])')",
}
FIRED = " UNION ALL ".join(f"SELECT doc_id, lang, source, CAST({k} AS BIGINT) AS word_id, '{w}' AS word FROM documents WHERE {RULE_SQL[k]}" for _, k, w in RULES)


def _fired(spark: SparkSession, sf_dir: str, tier: str | None = None) -> DataFrame:
    return RuleEngine(RULES, tier).explode_matches(_table(spark, sf_dir, "documents"), "text")


@query(f"SELECT doc_id, {has('the')} AND {has('and')} AND NOT {has('tion')} AND {has('en')} AND {has('er')} AS matched FROM documents")
def deep_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: doc_id and whether a rule of four needed and one vetoing segment fires."""
    return _table(spark, sf_dir, "documents").select("doc_id", RuleEngine([(1, 1, "the&and~tion&en&er")]).is_match(F.col("text")).alias("matched"))


@query(f"SELECT doc_id, word_id, word FROM ({FIRED})")
def process_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and rule that fires, by expressions."""
    return _fired(spark, sf_dir).select("doc_id", "word_id", "word")


@query(f"SELECT doc_id, word_id, word FROM ({FIRED})")
def process_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows by the automaton."""
    return _fired(spark, sf_dir, "automaton").select("doc_id", "word_id", "word")


@query(f"SELECT doc_id, 1 AS process_type, word_id, word FROM ({FIRED})")
def process_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows by joins and aggregates."""
    return RuleEngine(RULES).match_rows(_table(spark, sf_dir, "documents"), "text", "doc_id")


@query(f"SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_matches, coalesce(words, '') AS words FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY word_id) AS words FROM ({FIRED}) GROUP BY doc_id) USING (doc_id)")
def match_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with all its rules, none for some."""
    out = RuleEngine(RULES).match_df(_table(spark, sf_dir, "documents"), "text")
    return out.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join("matches.word", " ").alias("words"))


@query(f"SELECT d.doc_id, m.word_id, m.word FROM documents d LEFT JOIN (SELECT doc_id, min(word_id) AS word_id, arg_min(word, word_id) AS word FROM ({FIRED}) GROUP BY doc_id) m USING (doc_id)")
def find_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its first rule, or null."""
    first = RuleEngine(RULES).find_match(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", first["word_id"].alias("word_id"), first["word"].alias("word"))


@query(f"SELECT doc_id, min(word_id) AS word_id FROM ({FIRED}) GROUP BY doc_id")
def match_first_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches stop after the first of each document."""
    return RuleEngine(RULES).explode_matches(_table(spark, sf_dir, "documents"), "text", limit=1).select("doc_id", "word_id")


@query(f"SELECT d.doc_id, CAST(coalesce(n, 0) + 1 AS BIGINT) AS n_matches FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({FIRED}) GROUP BY doc_id) USING (doc_id)")
def process_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches appended to an array that holds one already."""
    one = F.array(F.struct(F.lit(0).cast("long").alias("word_id"), F.lit("kept").alias("word")))
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(RuleEngine(RULES).process_into(one, F.col("text"))).cast("long").alias("n_matches"))


@query(f"SELECT d.doc_id, coalesce(j, '[]') AS matches FROM documents d LEFT JOIN (SELECT doc_id, CAST(to_json(list({{'word_id': word_id, 'word': word}} ORDER BY word_id)) AS VARCHAR) AS j FROM ({FIRED}) GROUP BY doc_id) USING (doc_id)")
def process_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its rules as JSON."""
    return _table(spark, sf_dir, "documents").select("doc_id", RuleEngine(RULES).results_json(F.col("text")).alias("matches"))


@query(f"SELECT lang, count(*) AS docs FROM documents WHERE {RULE_SQL[1]} OR {RULE_SQL[3]} GROUP BY lang")
def sql_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules as a SQL function."""
    RuleEngine([RULES[0], RULES[2]]).register(spark, "two_rules")
    return spark.sql("SELECT lang, count(*) AS docs FROM {docs} WHERE two_rules_is_match(text) GROUP BY lang", docs=_table(spark, sf_dir, "documents"))


@query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE {RULE_SQL[4]}) WHERE r = 1")
def first_hit_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first matching document of each source."""
    hits_ = RuleEngine([RULES[3]]).semi(_table(spark, sf_dir, "documents"), "text")
    first = hits_.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    return first.where("r = 1").select("doc_id", "lang")


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey WHERE contains(lower(p_name), 'bolt') AND NOT contains(lower(p_name), 'small')")
def matched_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines of parts whose name fires a rule: matching composes with joins."""
    parts = RuleEngine([(8, 1, "BOLT~Small")]).semi(_table(spark, sf_dir, "part"), "p_name")
    return _table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber")


@query(f"SELECT doc_id, lang FROM documents WHERE EXISTS (SELECT 1 FROM ({FIRED}) f WHERE f.doc_id = documents.doc_id)")
def match_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which some rule fires."""
    return RuleEngine(RULES).semi(_table(spark, sf_dir, "documents"), "text").select("doc_id", "lang")


@query(f"SELECT doc_id, lang FROM documents WHERE NOT EXISTS (SELECT 1 FROM ({FIRED}) f WHERE f.doc_id = documents.doc_id)")
def match_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which no rule fires."""
    return RuleEngine(RULES).anti(_table(spark, sf_dir, "documents"), "text").select("doc_id", "lang")


@query(f"SELECT lang, word_id, word, count(*) AS docs FROM ({FIRED}) GROUP BY lang, word_id, word")
def rule_hits_per_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fired(spark, sf_dir).groupBy("lang", "word_id", "word").agg(F.count(F.lit(1)).alias("docs"))


@query(f"SELECT lang, source, count(*) AS hits FROM ({FIRED}) GROUP BY ROLLUP (lang, source)")
def hits_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fired(spark, sf_dir).rollup("lang", "source").agg(F.count(F.lit(1)).alias("hits"))


@query(f"SELECT word, count(*) AS docs FROM ({FIRED}) GROUP BY word, word_id ORDER BY docs DESC, word_id LIMIT 3")
def top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three rules that fire in most documents."""
    counted = _fired(spark, sf_dir).groupBy("word", "word_id").agg(F.count(F.lit(1)).alias("docs"))
    return counted.orderBy(F.desc("docs"), "word_id").limit(3).select("word", "docs")


def _set_sql(op: str) -> str:
    return f"SELECT doc_id FROM documents WHERE {RULE_SQL[1]} {op} SELECT doc_id FROM documents WHERE {RULE_SQL[3]}"


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _table(spark, sf_dir, "documents")
    return tuple(RuleEngine([RULES[k]]).semi(docs, "text").select("doc_id") for k in (0, 2))


@query(_set_sql("UNION"))
def rules_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(spark, sf_dir)
    return a.union(b).distinct()


@query(_set_sql("INTERSECT"))
def rules_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(spark, sf_dir)
    return a.intersect(b)


@query(_set_sql("EXCEPT"))
def rules_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(spark, sf_dir)
    return a.exceptAll(b)


JSON_RULES = '{"1": {"1": "the&and", "3": "der|que"}, "5": {"9": "ofthe"}}'


@query("SELECT CASE WHEN p_size < 25 THEN 1 ELSE 4 END AS process_type, CAST(p_partkey AS BIGINT) AS word_id, replace(p_name, ' ', '&') || '~' || p_type AS word FROM part")
def rules_json_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule tables in a JSON column, one for each part, as rows."""
    rule = F.concat(F.replace("p_name", F.lit(" "), F.lit("&")), F.lit("~"), F.col("p_type"))
    kind = F.when(F.col("p_size") < 25, "1").otherwise("4")
    tables = _table(spark, sf_dir, "part").select(F.to_json(F.create_map(kind, F.create_map(F.col("p_partkey").cast("string"), rule))).alias("j"))
    return rules_from_json_column(tables, F.col("j"))


@query(f"SELECT doc_id, {has('the')} AND {has('and')} OR {has('der')} OR {has('que')} OR {has('ofthe')} OR {has('ofthe', DELETED)} AS matched FROM documents")
def rules_json_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against rules from JSON bytes; type 5 is Delete, as None beside another type means nothing."""
    return _table(spark, sf_dir, "documents").select("doc_id", from_json(JSON_RULES.encode()).is_match(F.col("text")).alias("matched"))


@query(f"SELECT doc_id, CAST(1 AS BIGINT) AS word_id, 'ofthe' AS word FROM documents WHERE {has('ofthe')} UNION ALL SELECT doc_id, 1, 'ofthe,' FROM documents WHERE {has('ofthe,')} OR {has('ofthe,', DELETED)}")
def multi_type_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One id under two process types: two rules, two rows."""
    engine = RuleEngineBuilder().add_word(1, 1, "overwritten").add_word(1, 1, "ofthe").add_word(ProcessType.DELETE, 1, "ofthe,").build()
    return engine.explode_matches(_table(spark, sf_dir, "documents"), "text").select("doc_id", "word_id", "word")


@query("SELECT c_custkey, m.seg AS word FROM customer JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer) m ON contains(c_mktsegment, m.seg)")
def rules_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules made from a table's own values, matched against a column."""
    customers = _table(spark, sf_dir, "customer")
    rules = customers.select(F.lit(1).alias("process_type"), F.crc32("c_mktsegment").alias("word_id"), F.col("c_mktsegment").alias("word")).distinct()
    return from_dataframe(rules).explode_matches(customers, "c_mktsegment").select("c_custkey", "word")


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages found whole in documents, as a table of rules; over five million passages would be an error."""
    items = _table(spark, sf_dir, "benchmark").where("text is not null and text <> ''")
    if items.where(F.col("text").rlike("[&~|]")).limit(1).count():
        raise ValueError("benchmark texts hold rule operators")
    engine = from_dataframe(items.select(F.lit(1).alias("process_type"), F.col("item_id").alias("word_id"), F.col("text").alias("word")), tier="automaton")
    return engine.explode_matches(_table(spark, sf_dir, "documents"), "text").select("doc_id", F.col("word_id").alias("item_id"))


@query(f"SELECT doc_id, CAST(length({DELETED}) AS BIGINT) AS n, md5({DELETED}) AS h FROM documents")
def text_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without marks, punctuation, symbols, separators and controls."""
    return _table(spark, sf_dir, "documents").select("doc_id", text_process(ProcessType.DELETE, F.col("text")).alias("t")).select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("h"))


@query(f"SELECT doc_id, md5({LATIN}) AS h FROM documents")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in lower case, without accents, in compatibility forms."""
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(text_process(ProcessType.NORMALIZE, F.col("text"))).alias("h"))


@query(f"SELECT doc_id, md5({LATIN.replace('text', DELETED)}) AS h FROM documents")
def text_delete_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(text_process(ProcessType.DELETE_NORMALIZE, F.col("text"))).alias("h"))


@query(f"SELECT doc_id, CAST(1 + CAST({DELETED} <> text AS INT) + CAST({LATIN.replace('text', DELETED)} <> {DELETED} AS INT) AS BIGINT) AS steps, CAST(CASE WHEN {DELETED} <> text THEN 2 ELSE 1 END AS BIGINT) AS emitted FROM documents")
def reduce_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many forms a text passes through, and how many are emitted for patterns."""
    text = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(reduce_text_process(12, text)).cast("long").alias("steps"), F.size(reduce_text_process_emit(12, text)).cast("long").alias("emitted"))


#: Transforms of what stands in the texts for their letter e.
CASES = [
    (2, "測試", "测试"), (2, "ｱｲｳ", "アイウ"), (2, "龍馬", "龙马"), (16, "西安", " xi an"), (16, "한글", " han geul"), (16, "あいう", " a i u"), (16, "中あ한", " zhong a han"),
    (32, "西安", "xian"), (32, "한글", "hangeul"), (32, "カタ", "kata"), (64, "👍🏽", " thumbs_up"), (64, "🔥", " fire"), (64, "❤️", " red_heart"), (64, "🇩🇪", " d e"),
]
NAMES = "# names that stand in place of derived ones\n❤\tred_heart\n\ufe0f\t\n👍\tthumbs_up\n🏽\t\n🔥\tfire\n🇩\td\n🇪\te\n"


@query(" UNION ALL ".join(f"SELECT doc_id, {pt} AS process_type, '{a}' AS put, md5(replace(text, 'e', '{b}')) AS h FROM documents" for pt, a, b in CASES))
def transform_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Han variants, readings, kana, Hangul and pictographs (by names from a file), put into all texts."""
    with tempfile.NamedTemporaryFile("w", suffix=".tsv", encoding="utf-8") as f:  # read here, on the driver
        f.write(NAMES)
        f.flush()
        own = {64: read_names(f.name)}
    docs, out = _table(spark, sf_dir, "documents"), None
    for pt, put, _ in CASES:
        done = text_process(pt, F.replace("text", F.lit("e"), F.lit(put)), own if pt == 64 else None)
        some = docs.select("doc_id", F.lit(pt).alias("process_type"), F.lit(put).alias("put"), F.md5(done).alias("h"))
        out = some if out is None else out.unionByName(some)
    return out


HAN = ("etaoinsh", "測試龍馬門車書東", "测试龙马门车书东")


@query(f"SELECT doc_id, contains(text, 'the') AS plain, contains(text, 'then') OR contains(text, 'tion') AS spelt FROM documents")
def variant_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules under Han variants and under readings, over all texts with some letters put into Han."""
    plain, old, new = HAN
    text = F.translate("text", plain, old)
    simplified = RuleEngine([(2, 1, "the".translate(str.maketrans(plain, new)))])
    spelt = RuleEngine([(16, 1, "then".translate(str.maketrans(plain, new))), (16, 2, "tion".translate(str.maketrans(plain, old)))])
    return _table(spark, sf_dir, "documents").select("doc_id", simplified.is_match(text).alias("plain"), spelt.is_match(text).alias("spelt"))


@query("SELECT event_id, contains(event_type, 'click') OR contains(props, '69') AS flagged FROM events")
def events_type_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose type or properties fire a rule each."""
    both = RuleEngine([(1, 1, "click")]).is_match(F.col("event_type")) | RuleEngine([(1, 1, "69")]).is_match(F.col("props"))
    return _table(spark, sf_dir, "events").select("event_id", both.alias("flagged"))


@query(f"SELECT doc_id, ({RULE_SQL[1]}) OR ({RULE_SQL[2]}) AS matched FROM documents")
def rules_from_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against rules of a dictionary, by way of the builder's JSON."""
    builder = RuleEngineBuilder()
    for pt, words in {1: {1: RULES[0][2], 2: RULES[1][2]}}.items():
        for k, w in words.items():
            builder.add(pt, k, w)
    nested = {int(pt): {int(k): w for k, w in words.items()} for pt, words in json.loads(builder.to_json()).items()}
    return _table(spark, sf_dir, "documents").select("doc_id", from_dict(nested).is_match(F.col("text")).alias("matched"))


OWN_TABLE = "# own\ne\tee\nt\t\nU+0061\to\nn\tn\n"
OWN = "replace(replace(replace({t}, 'e', 'ee'), 't', ''), 'a', 'o')"


@query(f"SELECT doc_id, md5({OWN.format(t='text')}) AS h, contains({OWN.format(t='text')}, '{'thee and'.replace('e', 'ee').replace('t', '').replace('a', 'o')}') AS matched FROM documents")
def own_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transform's table from a file, in texts and in rules."""
    with tempfile.NamedTemporaryFile("w", suffix=".tsv", encoding="utf-8") as f:  # read here, on the driver
        f.write(OWN_TABLE)
        f.flush()
        own = {32: read_table(f.name)}
    text = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(text_process(32, text, own)).alias("h"), RuleEngine([(32, 1, "thee and")], own=own).is_match(text).alias("matched"))


@query("SELECT doc_id, md5(text) AS h FROM documents")
def no_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(text_process(0, F.col("text"))).alias("h"))


#: Rules made of parts: their names' words, under a process type by size; of the parts of one type and brand the last by rule stays.
PART_RULES = "SELECT CASE WHEN p_size < 25 THEN 1 ELSE 5 END AS process_type, CAST(length(p_brand) * 1000 + length(p_type) AS BIGINT) AS word_id, replace(p_name, ' ', '|') || '&' || p_type || '~' AS word FROM {part}"


def _part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PART_RULES, part=_table(spark, sf_dir, "part"))


@query(f"SELECT CASE WHEN process_type = 5 THEN 4 ELSE 1 END AS process_type, word_id, max(word) AS word FROM ({PART_RULES.format(part='part')}) GROUP BY ALL")
def rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An engine's rules, made of a table: the last of a type and id; None beside another type is nothing."""
    return from_dataframe(_part_rules(spark, sf_dir)).rules_df(spark)


@query(f"""WITH r AS (SELECT CASE WHEN process_type = 5 THEN 4 ELSE 1 END AS process_type, word_id, max(word) AS word FROM ({PART_RULES.format(part='part')}) GROUP BY ALL),
s AS (SELECT process_type, word_id, unnest(string_split(replace(word, '~', ''), '&')) AS segment FROM r)
SELECT DISTINCT process_type, word_id, unnest(string_split(segment, '|')) AS pattern, segment FROM s""")
def rule_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alternatives that are looked for, by rule and segment; equal ones of a segment count once."""
    engine = from_dataframe(_part_rules(spark, sf_dir))
    rules = engine.compiled.rules
    rows = [(pt, rules[rule].word_id, p, "|".join(a.pattern for a in rules[rule].segments[segment].alternatives)) for pt, p, _, _, rule, segment in engine.compiled.entries()]
    return spark.createDataFrame(rows, "process_type int, word_id long, pattern string, segment string")


@query(f"""WITH r AS (SELECT process_type, word_id, max(word) AS word FROM ({PART_RULES.format(part='part')}) GROUP BY ALL),
p AS (SELECT unnest(regexp_split_to_array(replace(word, '~', ''), '[&|]')) AS pattern FROM r)
SELECT (SELECT count(*) FROM r) AS rules, (SELECT count(DISTINCT pattern) FROM p) AS patterns, (SELECT string_agg(DISTINCT CASE WHEN process_type = 5 THEN 'delete' ELSE 'none' END, ',' ORDER BY CASE WHEN process_type = 5 THEN 'delete' ELSE 'none' END) FROM r) AS process_types""")
def engine_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rules, patterns and which process types an engine has that is made of a table."""
    s = from_dataframe(_part_rules(spark, sf_dir)).stats()
    return spark.createDataFrame([(s["rules"], s["patterns"], ",".join(s["process_types"]))], "rules long, patterns long, process_types string")


@query("SELECT n_nationkey, n_nationkey % 4 = 1 OR n_nationkey * 8 NOT BETWEEN 1 AND 127 AS refused FROM nation")
def rule_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules made of nations that can't be compiled: process types 0 and from 128 on, vetoes alone, operators alone, nothing."""

    def refused(pt: int, word: str) -> bool:
        try:
            RuleEngine([(pt, 1, word)])
        except ValueError:
            return True
        return False

    nations = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name").limit(1000).collect()  # a fixed list of nations
    bad = {1: "~{}", 5: "&|~", 9: "", 13: "|"}
    rows = [(r.n_nationkey, refused(r.n_nationkey * 8, bad.get(r.n_nationkey, "~{}").format(r.n_name) if r.n_nationkey % 4 == 1 else r.n_name)) for r in nations]
    return spark.createDataFrame(rows, "n_nationkey int, refused boolean")


@query(f"SELECT count(*) AS n, count(*) FILTER ({has('the')} AND {has('and')}) AS matched FROM (SELECT unnest(string_split(replace(text, chr(13), ''), chr(10))) AS text FROM documents)")
def line_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of text files against rules; the files are the documents, written as text."""
    path = scratch_folder(spark, "lines")
    _table(spark, sf_dir, "documents").select(F.coalesce(F.replace("text", F.lit("\r"), F.lit("")), F.lit("")).alias("value")).write.text(path)
    matched = RuleEngine([RULES[0]]).is_match(F.col("text"))
    return lines(spark, path).agg(F.count(F.lit(1)).alias("n"), F.count_if(matched).alias("matched"))


EVENT_RULES = [(1, 1, "c"), (1, 2, "p~v"), (8, 3, "VIEW|SIGNUP")]
EVENT_SQL = "SELECT date_trunc('hour', ts) AS window_start, CAST({k} AS BIGINT) AS word_id, '{w}' AS word, count(*) AS hits FROM events WHERE {c} GROUP BY ALL"
EVENTS = " UNION ALL ".join(EVENT_SQL.format(k=k, w=w, c=c) for k, w, c in ((1, "c", "contains(event_type, 'c')"), (2, "p~v", "contains(event_type, 'p') AND NOT contains(event_type, 'v')"), (3, "VIEW|SIGNUP", "contains(lower(event_type), 'view') OR contains(lower(event_type), 'signup')")))


@query(EVENTS)
def window_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule hits by hour of event time."""
    return hit_counts(_table(spark, sf_dir, "events"), RuleEngine(EVENT_RULES), "event_type", "ts", "1 hour")


@query(EVENTS)
def streaming_window_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts by a stream over the files, run until it has read them all, in complete mode."""
    schema = _table(spark, sf_dir, "events").schema
    # a stream reads folders: the table's own if it is one, else its file among its neighbours
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return run_to_files(hit_counts(stream, RuleEngine(EVENT_RULES), "event_type", "ts", "1 hour"), "complete")


@query(f"SELECT doc_id, 1 AS process_type, word_id, word FROM ({FIRED})")
def process_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that fire, in plain SQL: a table function joined laterally."""
    RuleEngine(RULES).register_table_functions(spark, "five")
    return spark.sql("SELECT d.doc_id, h.process_type, h.word_id, h.word FROM {docs} d, LATERAL five_hits(d.text) h", docs=_table(spark, sf_dir, "documents"))


@query(f"SELECT doc_id, source, word_id, row_number() OVER (PARTITION BY source, word_id ORDER BY doc_id) AS nth FROM ({FIRED})")
def partitioned_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits numbered within each source: a table function over a parted and ordered table."""
    RuleEngine(RULES).register_table_functions(spark, "five")
    rows = "TABLE(SELECT doc_id, source, text FROM {docs}) PARTITION BY source ORDER BY (doc_id)"
    return spark.sql(f"SELECT doc_id, source, word_id, nth FROM five_hits_of({rows}, 'text')", docs=_table(spark, sf_dir, "documents"))


EVENT_IDS = "list_concat(CASE WHEN contains(event_type, 'c') THEN [1] ELSE [] END, CASE WHEN contains(event_type, 'p') AND NOT contains(event_type, 'v') THEN [2] ELSE [] END, CASE WHEN contains(lower(event_type), 'view') OR contains(lower(event_type), 'signup') THEN [3] ELSE [] END)"
GAP, DELAY = "6 hours", "10 minutes"


def sessions_sql(rows: str) -> str:
    """Sessions of rows (user_id, ts, ids): a row opens one if it is more than the gap behind the one before."""
    opens = f"SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '{GAP}' THEN 0 ELSE 1 END AS opens FROM {rows}"
    numbered = f"SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM ({opens})"
    ids = "coalesce(array_to_string(list_sort(list_distinct(flatten(list(ids)))), ','), '')"
    return f"SELECT user_id, s, min(ts) AS session_start, max(ts) + INTERVAL '{GAP}' AS session_end, count(*) AS events, CAST(sum(len(ids)) AS BIGINT) AS hits, {ids} AS rules FROM ({numbered}) GROUP BY user_id, s"


SESSION = "user_id, session_start, session_end, events, hits, rules"
FOUND = f"WITH e AS (SELECT user_id, ts, event_type, {EVENT_IDS} AS ids FROM events)"
MARK = f"(SELECT date_trunc('millisecond', max(ts)) - INTERVAL '{DELAY}' FROM {{rows}})"


def _sessions(rows: DataFrame) -> DataFrame:
    return session_hits(rows, RuleEngine(EVENT_RULES), "event_type", "ts", "user_id", GAP, DELAY).withColumn("rules", F.array_join("rules", ","))


@query(f"{FOUND} SELECT {SESSION} FROM ({sessions_sql('e')})")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and rules by session of each user."""
    return _sessions(_table(spark, sf_dir, "events"))


@query(f"{FOUND} SELECT {SESSION} FROM ({sessions_sql('e')}) WHERE session_end <= {MARK.format(rows='e')}")
def streaming_user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions that a stream has closed when it has read all events: those that end before the last watermark."""
    schema = _table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return run_to_files(_sessions(stream), "append")


@query(f"""{FOUND}, a AS (SELECT * FROM e WHERE event_type <> 'error'), first AS MATERIALIZED ({sessions_sql('a')}),
open AS (SELECT a.* FROM a JOIN first f ON f.user_id = a.user_id AND a.ts BETWEEN f.session_start AND f.session_end - INTERVAL '{GAP}' WHERE f.session_end > {MARK.format(rows='a')}),
late AS (SELECT * FROM open UNION ALL SELECT * FROM e WHERE event_type = 'error' AND ts + INTERVAL '{GAP}' > {MARK.format(rows='a')})
SELECT {SESSION} FROM first WHERE session_end <= {MARK.format(rows='a')}
UNION ALL SELECT {SESSION} FROM ({sessions_sql('late')}) WHERE session_end <= {MARK.format(rows='e')}""")
def streaming_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors reach the stream after all other events: those behind the watermark are dropped, the rest join the sessions that are open."""
    events = _table(spark, sf_dir, "events")
    return run_in_parts([events.where("event_type <> 'error'"), events.where("event_type = 'error'")], _sessions, "append")


KEY_RULES = [(1, 1, "&".join(["signup"] * 13) + "~error" * 14), (1, 2, "&".join(["view|click"] * 27)), (8, 3, "&".join(["PURCHASE"] * 14) + "&View"), (1, 4, "view~purchase")]
_TIMES = "count(*) FILTER (WHERE event_type = '{}')".format
_KEYED = {1: f"{_TIMES('signup')} >= 13 AND {_TIMES('error')} < 14", 2: f"{_TIMES('view')} + {_TIMES('click')} >= 27", 3: f"{_TIMES('purchase')} >= 14 AND {_TIMES('view')} >= 1", 4: f"{_TIMES('view')} >= 1 AND {_TIMES('purchase')} < 1"}
KEYED = " UNION ALL ".join(f"SELECT CAST(user_id AS VARCHAR) AS user_id, CAST({k} AS BIGINT) AS word_id, '{w}' AS word FROM events GROUP BY user_id HAVING {_KEYED[k]}" for _, k, w in KEY_RULES)


@query(KEYED)
def user_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over all events of each user taken together."""
    return rules_over_keys(_table(spark, sf_dir, "events"), RuleEngine(KEY_RULES), "event_type", "user_id", "ts")


@query(KEYED)
def streaming_user_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by keyed state, as each user stands after the last change: vetoing errors, then purchases reach the stream last."""
    events = _table(spark, sf_dir, "events")
    parts = [events.where(c) for c in ("event_type not in ('error', 'purchase')", "event_type = 'error'", "event_type = 'purchase'")]
    engine = RuleEngine(KEY_RULES)
    changes = run_in_parts(parts, lambda s: rule_changes(s, engine, "event_type", "user_id", "ts", "60 days", "60 days"), "update")
    return last_changes(changes, "user_id")


#: A log of changes made of events: each error gives its user's rule (user_id modulo 10) another wording, or none, from then on.
CHANGE_LOG = "SELECT ts AS {at}, 1 AS process_type, CAST(user_id % 10 AS BIGINT) AS word_id, CASE CAST(floor(value) AS INT) % 4 WHEN 0 THEN NULL WHEN 1 THEN 'view|purchase' WHEN 2 THEN 'c~p' ELSE 'sign' END AS word FROM {events} WHERE event_type = 'error'"
CHANGED = f"""WITH log AS ({CHANGE_LOG.format(events="events", at='"at"')}),
spans AS (SELECT word_id, word, "at" AS valid_from, lead("at") OVER (PARTITION BY word_id ORDER BY "at") AS valid_to FROM (SELECT word_id, "at", arg_max(word, coalesce(word, '')) AS word FROM log GROUP BY word_id, "at")),
hits AS (SELECT event_id, event_type, ts FROM events)
SELECT event_id, word_id, word, valid_from FROM hits JOIN spans ON ts >= valid_from AND (valid_to IS NULL OR ts < valid_to) AND CASE word
  WHEN 'view|purchase' THEN contains(event_type, 'view') OR contains(event_type, 'purchase') WHEN 'c~p' THEN contains(event_type, 'c') AND NOT contains(event_type, 'p')
  WHEN 'sign' THEN contains(event_type, 'sign') ELSE false END"""


@query(CHANGED)
def changing_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events against the rules that were valid at their time, by a log of changes and deletions."""
    events = _table(spark, sf_dir, "events")
    versions = RuleVersions(spark.sql(CHANGE_LOG.format(events="{events}", at="at"), events=events))
    return versions.match(events.select("event_id", "event_type", "ts"), "event_type", "ts", "6 hours").select("event_id", "word_id", "word", "valid_from")


HITS_C = "SELECT event_id, user_id, ts FROM events WHERE contains(event_type, 'c')"


@query(f"SELECT h.event_id, o.o_orderkey, o.o_orderdate FROM ({HITS_C}) h ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON h.user_id = o.o_custkey AND h.ts >= o.o_orderdate")
def hits_after_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hit of a rule in events with its user's last order before it: an as-of join."""
    hits_ = RuleEngine([(1, 1, "c")]).semi(_table(spark, sf_dir, "events"), "event_type")
    found = asof(hits_, _table(spark, sf_dir, "orders"), ("user_id", "o_custkey"), ("ts", "o_orderdate"), ["o_orderdate", "o_orderkey"], "30 days")
    return found.select("event_id", "o_orderkey", "o_orderdate")


@query(f"SELECT h.event_id, p.event_id AS bought_id FROM ({HITS_C}) h ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON h.user_id = p.user_id AND h.ts >= p.ts")
def hits_after_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hit with its user's last purchase until then."""
    events = _table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"), F.col("event_id").alias("bought_id"))
    return asof(RuleEngine([(1, 1, "c")]).semi(events, "event_type"), bought, ("user_id", "user_id"), ("ts", "bought"), ["bought_id"], "6 hours").select("event_id", "bought_id")


@query("SELECT h.event_id, p.event_id AS bought_id FROM (SELECT * FROM events WHERE contains(event_type, 'view') OR contains(event_type, 'click')) h JOIN events p ON p.event_type = 'purchase' AND h.user_id = p.user_id AND h.ts >= p.ts AND h.ts < p.ts + INTERVAL '2 days'")
def hits_within_two_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in the two days behind each of their user's purchases: a range join by buckets of a day."""
    events = _table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("bought_id"), F.col("ts").alias("opens"), (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("closes"))
    hits_ = RuleEngine([(1, 1, "view|click")]).semi(events, "event_type")
    return within(hits_, bought, ("user_id", "user_id"), "ts", "opens", "closes", ["bought_id"]).select("event_id", "bought_id")


@query(f"SELECT lang, source, CAST(count(DISTINCT word_id) AS BIGINT) AS n_rules FROM ({FIRED}) GROUP BY GROUPING SETS ((lang, source), (lang), ())")
def rule_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the rules fire in any document of each language and source, each language, and at all, by bitmaps that are merged."""
    fine = fired_bitmaps(_table(spark, sf_dir, "documents"), RuleEngine(RULES), "text", "lang", "source")
    none = F.lit(None).cast("string")
    langs = counted(merged(fine, "lang"), "lang").withColumn("source", none)
    total = counted(merged(fine.withColumn("all", F.lit(1)), "all"), "all").select(none.alias("lang"), none.alias("source"), "n_rules")
    return counted(fine, "lang", "source").unionByName(langs).unionByName(total)


@query(f"SELECT a.lang, a.word_id AS first, b.word_id AS second, count(*) AS rows FROM ({FIRED}) a JOIN ({FIRED}) b ON a.doc_id = b.doc_id AND a.word_id < b.word_id GROUP BY ALL")
def rules_fired_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents of each language two rules fire in together."""
    return fired_together(_table(spark, sf_dir, "documents"), RuleEngine(RULES), "text", "lang")


BENCH_RULES = "SELECT 1 AS process_type, item_id AS word_id, regexp_extract(text, '^[A-Za-z]+ [A-Za-z]+') || '&' || regexp_extract(text, '([A-Za-z]+)[^A-Za-z]*$', 1) AS word FROM {t} WHERE regexp_matches(text, '^[A-Za-z]+ [A-Za-z]+') AND regexp_matches(text, '[A-Za-z]+[^A-Za-z]*$')"


@query(f"SELECT process_type, CAST(word_id AS BIGINT) AS word_id, word FROM ({BENCH_RULES.format(t='benchmark')})")
def rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule files made of the benchmark's passages (the first two words and the last), read as a table of rules by the data source."""
    return _rule_files(spark, sf_dir)


def _rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    items = _table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract("text", "^[A-Za-z]+ [A-Za-z]+", 0).alias("a"), F.regexp_extract("text", "([A-Za-z]+)[^A-Za-z]*$", 1).alias("b")).where("a <> '' and b <> ''")
    rule = F.to_json(F.create_map(F.lit("1"), F.create_map(F.col("item_id").cast("string"), F.concat("a", F.lit("&"), "b"))))
    path = scratch_folder(spark, "rules")
    items.select(rule.alias("value")).write.text(path)
    return spark.read.format("glyphsieve").option("kind", "rules").load(path).select("process_type", "word_id", "word")


@query(f"SELECT d.doc_id, r.word_id FROM documents d JOIN (SELECT *, string_split(word, '&') AS w FROM ({BENCH_RULES.format(t='benchmark')})) r ON contains(d.text, r.w[1]) AND contains(d.text, r.w[2])")
def rule_files_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against the rules of those files, by joins."""
    engine = from_dataframe(_rule_files(spark, sf_dir))
    return engine.match_rows(_table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "word_id")


@query("SELECT count(*) AS n, CAST(sum(length(l)) AS BIGINT) AS chars, count(*) FILTER (contains(l, 'the')) AS matched FROM (SELECT unnest(string_split(replace(text, chr(13), ''), chr(10))) AS l FROM benchmark)")
def streamed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a stream reads from growing files: the benchmark's passages, written in two parts."""
    register(spark)
    items = _table(spark, sf_dir, "benchmark").select("item_id", F.replace("text", F.lit("\r"), F.lit("")).alias("value"))
    cut = items.agg(F.avg("item_id")).first()[0]
    path, out = scratch_folder(spark, "lines"), scratch_folder(spark, "stream")
    for part in (items.where(F.col("item_id") <= cut), items.where(F.col("item_id") > cut)):
        part.select("value").write.mode("append").text(path)
        stream = spark.readStream.format("glyphsieve").option("kind", "lines").option("piece", 4096).load(path)
        found = run_to_files(stream, "append", out)
    matched = RuleEngine([(1, 1, "the")]).is_match(F.col("text"))
    return found.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.count_if(matched).alias("matched"))


@query(f"SELECT doc_id, word_id, word FROM ({FIRED})")
def committed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of documents, written with a commit by a stream and read back."""
    register(spark)
    schema = _table(spark, sf_dir, "documents").schema
    docs = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents.parquet*")
    path, state = scratch_folder(spark, "results"), scratch_folder(spark, "state")
    found = RuleEngine(RULES).explode_matches(docs, "text").select("doc_id", "word_id", "word")
    found.writeStream.format("glyphsieve").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.format("glyphsieve").load(path)
