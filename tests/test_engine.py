"""Engine endpoints, sources, transforms and streams."""

import json
import os
import pickle
import random
import shutil
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphsieve import tables
from glyphsieve.flags import ProcessType
from glyphsieve.functions import process_text, reduce_text, reduce_text_emit, reduce_text_process, reduce_text_process_emit, text_process, transforms
from glyphsieve.operators import RuleEngine, RuleEngineBuilder
from glyphsieve.sources import from_dataframe, from_dict, from_json, lines, read_names, read_table, rules_from_json_column
from glyphsieve.streaming import hit_counts, match_stream

RULES = [(1, 1, "hello"), (1, 2, "hello&world"), (4, 3, "wor.ld")]


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


@pytest.mark.parametrize("tier", ["expressions", "automaton"])
def test_endpoints(spark, tier):
    docs = frame(spark, "hello world", "nothing", None, "", "wor.ld")
    engine = RuleEngine(RULES, tier)
    assert [r.id for r in engine.semi(docs, "text").orderBy("id").collect()] == [0, 4]
    assert [r.id for r in engine.anti(docs, "text").orderBy("id").collect()] == [1, 2, 3]
    first = {r.id: r.f and r.f.word_id for r in docs.select("id", engine.find_match(F.col("text")).alias("f")).collect()}
    assert first == {0: 1, 1: None, 2: None, 3: None, 4: 3}
    assert {(r.id, r.word_id) for r in engine.explode_matches(docs, "text").collect()} == {(0, 1), (0, 2), (4, 3)}
    assert engine.explode_matches(docs, "text", limit=1).count() == 2
    kept = docs.select("id", F.size(engine.process_into(F.lit(None), F.col("text"))).alias("n"))
    assert {r.id: r.n for r in kept.collect()} == {0: 2, 1: 0, 2: 0, 3: 0, 4: 1}
    assert engine.stats() == {"rules": 3, "patterns": 3, "process_types": ["delete", "none"], "tier": tier}
    assert engine.size_bytes() > 0 and "3 rules" in repr(engine)
    again = pickle.loads(pickle.dumps(engine))
    assert docs.where(again.is_match(F.col("text"))).count() == 2


def test_sources(spark, tmp_path):
    nested = {"1": {"1": "hello", "2": "hello&world"}, "4": {"3": "wor.ld"}}
    engine = from_json(json.dumps(nested).encode())
    assert json.loads(engine.to_json()) == nested
    assert from_dict({1: {1: "hello"}}).compiled.patterns == ["hello"]
    for bad in (b"", b"123", b"invalid", b"[]", b"{}", b"{1:{}}", b'{"a":1}', b'{"1":[]}'):
        with pytest.raises(ValueError):
            from_json(bad)
    with pytest.raises(TypeError):
        from_json("{}")
    with pytest.raises(TypeError):
        from_dict({"1": {1: "x"}})
    with pytest.raises(TypeError):
        from_dict({1: {1: 2}})
    df = rules_from_json_column(spark.createDataFrame([(json.dumps(nested),)], "j string"), F.col("j"))
    assert {tuple(r) for r in df.collect()} == {(1, 1, "hello"), (1, 2, "hello&world"), (4, 3, "wor.ld")}
    assert from_dataframe(df).compiled.patterns == engine.compiled.patterns
    builder = RuleEngineBuilder().add(1, 1, 'say "hi"')
    assert json.loads(builder.to_json()) == {"1": {"1": 'say "hi"'}}
    (tmp_path / "t.txt").write_text("one\ntwo\n", encoding="utf-8")
    assert sorted(r.text for r in lines(spark, str(tmp_path / "t.txt")).collect()) == ["one", "two"]
    (tmp_path / "t.tsv").write_text("# note\nａ\ta\nb\tb\nａ\tz\nU+200D\t\n", encoding="utf-8")
    assert read_table(tmp_path / "t.tsv") == {0xFF41: "z", 0x200D: None}


def test_tables(spark):
    assert len(tables.delete()) == 11321 and len(tables.numbers()) == 1912
    assert tables.translate(8, "ＡＢⅣ①℉") == "ab41°f" and tables.translate(8, "́") == "́"
    assert all(c in tables.delete() for c in tables.emoji() if c > 0x2000)


def test_transforms(spark):
    cases = [(2, "hello ｶﾀｶﾅ world", "hello カタカナ world"), (4, "a!!b", "ab"), (8, "Café", "cafe"), (16, "カタカナ", " ka ta ka na"), (64, "Hello 🔥 World", "Hello  fire World"), (68, "a🔥", "a")]
    for pt, text, want in cases:
        got = frame(spark, text, None, "").select(text_process(pt, F.col("text")).alias("t")).collect()
        assert [r.t for r in got] == [want, None, ""], pt
    steps = frame(spark, "！Ａ！測試！１！").select(reduce_text_process(14, F.col("text")).alias("r"), reduce_text_process_emit(14, F.col("text")).alias("e")).first()
    assert steps.r == ["！Ａ！測試！１！", "！Ａ！测试！１！", "Ａ测试１", "a测试1"]
    assert steps.e == ["！Ａ！测试！１！", "a测试1"]
    last = frame(spark, "Ａ！漢語西安１").select(reduce_text_process(62, F.col("text")).alias("r")).first().r[-1]
    assert last == "a han yu xi an1"
    with pytest.raises(ValueError):
        text_process(128, F.col("text"))


def test_strings_and_columns_agree(spark):
    texts = ["！Ａ！測試！１！", "A B 測試 Ａ １", "Ａ！漢語西安１", "plain", "", "🔥 é"]
    assert reduce_text_emit(14, texts[0]) == ["！Ａ！测试！１！", "a测试1"]
    for pt in (1, 2, 4, 12, 14, 62, 64, 80):
        got = frame(spark, *texts).select("id", text_process(pt, F.col("text")).alias("t"), reduce_text_process(pt, F.col("text")).alias("r"), reduce_text_process_emit(pt, F.col("text")).alias("e")).orderBy("id").collect()
        assert [(r.t, r.r, r.e) for r in got] == [(process_text(pt, t), reduce_text(pt, t), reduce_text_emit(pt, t)) for t in texts], pt


class Counted(dict):
    """A table that counts what is asked of it."""

    asked = 0

    def get(self, *key):
        self.asked += 1
        return super().get(*key)

    def __getitem__(self, key):
        self.asked += 1
        return super().__getitem__(key)


def test_a_table_is_asked_once_a_character_not_once_a_place(spark):
    rng = random.Random(15)
    few, swap, many = {ord("西"): " xi", ord("安"): " an", ord("x"): None}, {ord("a"): "b", ord("b"): "aa"}, {c: f" {c}" for c in range(0x4E00, 0x4E40)}
    texts = ["".join(rng.choice("西安xabc é🔥" + "".join(map(chr, range(0x4E00, 0x4E20)))) for _ in range(n)) for n in (1, 5, 400, 9, 3000)]
    texts = [*texts, "", None, "plain", "ab" * 500, "安", None]
    for table in (few, swap, many, few | many, {}):
        counted = Counted(table)
        got = transforms.mapped(pa.array(["kept out", *texts], pa.string()).slice(1), counted)
        assert got.to_pylist() == [t and t.translate(table) for t in texts]
        assert counted.asked < 200
    assert transforms.mapped(pa.array([], pa.string()), few).to_pylist() == []
    # texts are not searched for each of the table's characters in the JVM before they are mapped
    plan = frame(spark, "西安").select(text_process(16, F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "translate" not in plan.lower()


def test_results_leave_a_task_piece_by_piece(spark):
    """No result of a whole batch is held: pieces are small but for a single long text, in order, and land in their own rows."""
    table = {ord("西"): " xi"}
    texts = ["西安" * n for n in (10, 300_000, 0, 700_000, 5)] + [None, None] + ["西" * 1000] * 3000
    pieces = list(transforms.mapped_pieces(pa.array(texts, pa.string()), table))
    assert [t for p in pieces for t in p.to_pylist()] == [t and t.translate(table) for t in texts]
    assert len(pieces) > 4 and all(len(p) == 1 or sum(len(t or "") for t in p.to_pylist()) <= 4 / 3 * transforms.PIECE for p in pieces)
    docs = spark.range(6000, numPartitions=1).select("id", F.when(F.col("id") % 7 > 0, F.concat("id", F.lit(" "), F.repeat(F.lit("西x"), 300))).alias("text"))
    both = F.struct(text_process(16, F.col("text")).alias("a"), text_process(32, F.col("text")).alias("b"))
    want = [F.replace("text", F.lit("西"), F.lit(to)) for to in (" xi", "xi")]
    got = docs.select("id", "text", both.alias("r")).select((F.col("r.a").eqNullSafe(want[0]) & F.col("r.b").eqNullSafe(want[1])).alias("right"))
    assert got.groupBy("right").count().collect() == [(True, 6000)]


def test_own_tables(spark, tmp_path):
    """Tables of one's own take the place of derived ones, in texts, patterns and every plan."""
    (tmp_path / "t.tsv").write_text("ж\tzh\nѣ\tе\n#\nx\t\n", encoding="utf-8")
    own = {16: read_table(tmp_path / "t.tsv")}
    assert own[16] == {ord("ж"): "zh", ord("ѣ"): "е", ord("x"): None}
    docs = frame(spark, "ждѣx", "zhaxb", "plain", None)
    assert [r.t for r in docs.select(text_process(16, F.col("text"), own).alias("t")).collect()] == ["zhде", "zhab", "plain", None]
    assert process_text(16, "ждѣx", own) == "zhде" and reduce_text(16, "x", own) == ["x", ""]
    for tier in ("expressions", "automaton"):
        engine = RuleEngine([(16, 1, "жxд"), (16, 2, "zhab"), (16, 3, "西")], tier, own)
        assert {(r.id, r.word_id) for r in engine.explode_matches(docs, "text").collect()} == {(0, 1), (1, 2)}
        assert {(r.id, r.word_id) for r in engine.match_rows(docs, "text", "id").collect()} == {(0, 1), (1, 2)}


def test_no_transform_leaves_the_text(spark):
    assert process_text(0, "A b") == "A b" and reduce_text(0, "A") == ["A"]
    got = frame(spark, "A b").select(text_process(0, F.col("text")).alias("t"), reduce_text_process(0, F.col("text")).alias("r")).first()
    assert got.t == "A b" and got.r == ["A b"]


def test_pictographs(spark, tmp_path):
    names = tables.emoji()
    assert names[ord("™")] == " trade_mark" and names[ord("℗")] == " sound_recording_copyright" and names[ord("🔥")] == " fire"
    assert names[ord("👦")] == " boy" and names[0xFE0F] is None and names[0x1F1E6] == " a"
    assert not {ord(c) for c in "©→■♭⠿"} & names.keys()  # symbols that are no pictographs stay
    (tmp_path / "names.tsv").write_text("# own\n❤\tred heart\n\ufe0f\t\n👍\tthumbs_up\n", encoding="utf-8")
    own = {64: read_names(tmp_path / "names.tsv")}
    assert frame(spark, "❤️ 👍", "🔥").select(text_process(64, F.col("text"), own).alias("t")).orderBy("id").collect()[0].t == " red_heart  thumbs_up"
    assert RuleEngine([(64, 1, "red_heart")], own=own).semi(frame(spark, "a ❤️", "❤"), "text").count() == 2
    with pytest.raises(FileNotFoundError):
        read_names(tmp_path / "none.tsv")
    (tmp_path / "bad.tsv").write_text("ab\tx\n")
    with pytest.raises(ValueError, match="no single character"):
        read_names(tmp_path / "bad.tsv")


@pytest.mark.skipif("GLYPHSIEVE_NAMES" not in os.environ, reason="names a file of lines character<TAB>name")
def test_every_line_of_a_file_of_names(spark):
    path = Path(os.environ["GLYPHSIEVE_NAMES"])
    rows = [x.partition("\t")[::2] for x in path.read_text(encoding="utf-8").split("\n") if x and x[0] != "#"]
    own = {64: read_names(path)}
    got = frame(spark, *[c for c, _ in rows]).select("id", text_process(64, F.col("text"), own).alias("t")).orderBy("id").collect()
    assert [r.t for r in got] == [f" {n}" if n else "" for _, n in rows] and len({c for c, _ in rows}) == len(own[64]) == len(rows)
    derived = tables.emoji()
    print(f"{sum(derived.get(k) == v for k, v in own[64].items())} of {len(rows)} as derived")


@pytest.mark.parametrize("tier", ["expressions", "automaton"])
def test_clashing_columns(spark, tier):
    docs = frame(spark, "hello").withColumn("word", F.lit("own")).withColumn("matches", F.lit(1))
    engine = RuleEngine([(1, 5, "hello")], tier)
    assert [(r.word, r.word_id, r.match_word) for r in engine.explode_matches(docs, "text").collect()] == [("own", 5, "hello")]
    assert engine.explode_matches(docs, "text", limit=1).first().word_id == 5
    with pytest.raises(ValueError):
        engine.match_df(docs, "text")


def test_rules_too_many_to_broadcast(spark, monkeypatch):
    from glyphsieve.operators import engine as module

    monkeypatch.setattr(module, "MOST_BYTES", 10)
    with pytest.raises(ValueError, match="match_rows"):
        RuleEngine(RULES, "automaton").is_match(F.col("text"))
    with pytest.raises(ValueError, match="more than 1 rules"):
        from_dataframe(spark.createDataFrame(RULES, "process_type int, word_id long, word string"), most=1)


def test_json_and_sql(spark):
    assert ProcessType.from_json(ProcessType(12).to_json()) == 12
    for bad in ("0", "128", "true", "1.5", '"x"'):
        with pytest.raises(ValueError):
            ProcessType.from_json(bad)
    docs = frame(spark, "hello world", None)
    engine = RuleEngine(RULES)
    assert [r.j for r in docs.select(engine.results_json(F.col("text")).alias("j")).collect()] == ['[{"word_id":1,"word":"hello"},{"word_id":2,"word":"hello&world"}]', "[]"]
    engine.register(spark, "greet")
    docs.createOrReplaceTempView("greeted")
    assert [tuple(r) for r in spark.sql("SELECT greet_is_match(text), greet_process(text) FROM greeted ORDER BY id").collect()] == [(True, [1, 2]), (False, [])]


def test_delete_is_the_table_in_the_jvm_too(spark):
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    got = frame(spark, every).select(text_process(ProcessType.DELETE, F.col("text")).alias("t")).first().t
    assert got == every.translate(tables.delete())


def test_text_as_its_own_pattern(spark):
    """A text's transformed form, taken as a rule, fires in the text."""
    texts = ["Hello World 42", "Ünïcode ﬁt", "測試 abc", "X1 y2 Z3"]
    for pt in (2, 8, 16, 32, 10):
        rows = [(pt, k, t) for k, t in enumerate(texts)]
        got = RuleEngine(rows, "automaton").match_df(frame(spark, *texts), "text").collect()
        assert all(r.id in [m.word_id for m in r.matches] for r in got), pt


def test_stream(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", t) for m, t in ((1, "hello"), (2, "hello world"), (40, "wor.ld"), (41, None))]
    spark.createDataFrame(rows, "ts string, text string").select(F.col("ts").cast("timestamp").alias("ts"), "text").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "in"))
    for tier in ("expressions", "automaton"):
        engine = RuleEngine(RULES, tier)
        for name, df, mode in ((f"m_{tier}", match_stream(stream, engine, "text"), "append"), (f"c_{tier}", hit_counts(stream, engine, "text", "ts", "30 minutes"), "complete")):
            df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        assert sorted(len(r.matches) for r in spark.table(f"m_{tier}").collect()) == [0, 1, 1, 2]
        assert sorted((r.word_id, r.hits) for r in spark.table(f"c_{tier}").collect()) == [(1, 2), (2, 1), (3, 1)]


def test_single_literal_reaches_the_scan(spark, tmp_path):
    """contains() of one literal is pushed to the Parquet scan, and only asked columns are read."""
    path = str(tmp_path / "t")
    frame(spark, "hello", "x").withColumn("extra", F.lit(1)).write.parquet(path)
    plan = lambda *rules: RuleEngine([(1, k, w) for k, w in enumerate(rules)]).semi(spark.read.parquet(path), "text").select("id")._jdf.queryExecution().toString()
    assert "StringContains(text,hello)" in plan("hello") and "extra" not in plan("hello").split("ReadSchema")[1]
    both = plan("hello&world")
    assert "StringContains(text,hello)" in both and "StringContains(text,world)" in both
    assert "Or(StringContains(text,a),StringContains(text,b))" in plan("a", "b")


def test_entry_without_the_training_data_operators(tmp_path):
    """The rest imports and has its queries when the llm folders and the pipeline are gone."""
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "glyphsieve", tmp_path / "glyphsieve", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()) > 40 and set(e.oracle_sql()) <= set(e.queries()) and not any(q.startswith('op') for q in e.queries()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.split()[-1] == "True"


def test_entry_queries_have_oracles(spark):
    import __spark_entry__ as entry

    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and "deep_and" in names
    assert entry.entry(spark).columns == ["doc_id", "matched"]
