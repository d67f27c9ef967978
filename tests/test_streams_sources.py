"""Table functions, sessions, keyed state, changing rules, joins by time, bitmaps, long texts, and the data source."""

import collections
import datetime as dt
import json
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphsieve.operators import RuleEngine, RuleVersions
from glyphsieve.operators.bitmaps import counted, fired_bitmaps, fired_together, merged
from glyphsieve.operators.time_joins import asof, within
from glyphsieve.plans import naive, relational
from glyphsieve.plans.compiler import compile_rules
from glyphsieve.sources import datasource, register
from glyphsieve.streaming import last_changes, rule_changes, rules_over_keys, run_in_parts, session_hits

START = dt.datetime(2024, 1, 1)


def minutes(n):
    return START + dt.timedelta(minutes=n)


def test_table_functions(spark):
    docs = spark.createDataFrame([(1, "a", "hello world"), (2, "a", "hello"), (3, "b", None), (4, "b", ""), (5, "a", "hello x")], "id long, g string, text string")
    docs.createOrReplaceTempView("t_docs")
    RuleEngine([(1, 1, "hello"), (1, 2, "hello&world"), (4, 3, "wor")], "automaton").register_table_functions(spark, "tf")
    got = spark.sql("SELECT id, h.* FROM t_docs, LATERAL tf_hits(text) h").collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1, "hello"), (1, 1, 2, "hello&world"), (1, 4, 3, "wor"), (2, 1, 1, "hello"), (5, 1, 1, "hello")]
    nth = spark.sql("SELECT id, word_id, nth FROM tf_hits_of(TABLE(t_docs) PARTITION BY g ORDER BY (id DESC), 'text')").collect()
    assert sorted(tuple(r) for r in nth) == [(1, 1, 3), (1, 2, 1), (1, 3, 1), (2, 1, 2), (5, 1, 1)]
    for bad in ("SELECT * FROM tf_hits(3)", "SELECT * FROM tf_hits_of(TABLE(t_docs), 'none')", "SELECT * FROM tf_hits_of(TABLE(SELECT text, 1 AS word_id FROM t_docs), 'text')"):
        with pytest.raises(Exception, match="takes a string|no string column|columns of the result"):
            spark.sql(bad).collect()


def test_few_rules_become_sql(spark):
    rules = [(1, 1, "it's&\\bend\\b"), (1, 2, "a\\b|\"q\"~x"), (1, 3, "ab&ab|é")]
    texts = ["it's the end", "it's bending", "a\\b", '"q" x', "ab cab", "ab é", "abé", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    docs.createOrReplaceTempView("f_docs")
    engine = RuleEngine(rules)
    engine.register(spark, "few")
    got = spark.sql("SELECT id, few_is_match(text) AS m, few_process(text) AS ids FROM f_docs")
    assert "Python" not in got._jdf.queryExecution().toString()
    want = {k: [i for i, _ in naive.process(engine.compiled, t)] for k, t in enumerate(texts)}
    assert {r.id: (r.m, r.ids) for r in got.collect()} == {k: (bool(v), v) for k, v in want.items()}
    RuleEngine(rules, "automaton").register(spark, "few_scanned")
    assert {r.id: (r.m, r.ids) for r in spark.sql("SELECT id, few_scanned_is_match(text) AS m, few_scanned_process(text) AS ids FROM f_docs").collect()} == {k: (bool(v), v) for k, v in want.items()}


def test_sessions_of_odd_rows(spark):
    rows = [("u", minutes(0), "ab"), ("u", minutes(10), "x"), ("u", minutes(20), "b"), ("u", minutes(31), "a"), (None, minutes(5), "a"), (None, minutes(6), None), ("v", None, "a"), ("v", minutes(1), "")]
    df = spark.createDataFrame(rows, "who string, at timestamp, text string").withColumn("events", F.lit("clash"))
    engine = RuleEngine([(1, 1, "a"), (1, 2, "b")])
    got = session_hits(df, engine, "text", "at", "who", "10 minutes").collect()
    want = [(None, minutes(5), minutes(16), 2, 1, [1]), ("u", minutes(0), minutes(30), 3, 3, [1, 2]), ("u", minutes(31), minutes(41), 1, 1, [1]), ("v", minutes(1), minutes(11), 1, 0, [])]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert session_hits(df.where("false"), engine, "text", "at", "who").count() == 0


KEYED = [(1, 1, "a&a&b~v"), (8, 2, "C|d&E"), (1, 3, "\\ba\\b&x"), (4, 4, "zz~q~q")]


def test_rules_over_keys_against_texts_put_together(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["k1", "k2", "k3", "hot", "hot", "hot", None]), minutes(rng.randint(0, 50)), " ".join(rng.choice("a b v c d E x z.z q aa".split()) for _ in range(rng.randint(0, 3)))) for _ in range(60)]
    rows += [("k1", minutes(3), None), ("k4", None, "a a b")]
    df = spark.createDataFrame(rows, "who string, at timestamp, text string").repartition(3)
    engine = RuleEngine(KEYED)
    compiled = engine.compiled
    want = set()
    for who in {r[0] for r in rows}:
        sums = collections.Counter()
        for key, at, text in rows:
            if key == who and text and at:
                for n, r in enumerate(compiled.rules):
                    forms = naive.text_variants(r.process_type, text)
                    for s in r.segments:
                        sums[n, s.number] += max(sum(naive.hits(v, a) for a in s.alternatives) for v in forms)
        want |= {(who, r.word_id) for n, r in enumerate(compiled.rules) if all((sums[n, s.number] >= s.quota) != s.negative for s in r.segments)}
    assert {(r.who, r.word_id) for r in rules_over_keys(df, engine, "text", "who", "at").collect()} == want and want
    changes = run_in_parts([df.where("minute(at) < 20"), df.where("minute(at) >= 20 or at is null")], lambda s: rule_changes(s, engine, "text", "who", "at", "10 days", "10 days"), "update")
    assert {(r.who, r.word_id) for r in last_changes(changes, "who").collect()} == want


def test_state_of_a_key_changes_and_ends(spark):
    parts = [[("u", minutes(0), "a")], [("u", minutes(1), "a b")], [("u", minutes(2), "v")], [("w", minutes(500), "x")], [("u", minutes(501), "a a b")]]
    frames = [spark.createDataFrame(p, "who string, at timestamp, text string") for p in parts]
    changes = run_in_parts(frames, lambda s: rule_changes(s, RuleEngine([(1, 1, "a&a&b~v")], "automaton"), "text", "who", "at", "1 hour", "1 minute"), "update")
    got = [(r.version, r.word_id, r.fired, r.closed) for r in changes.where("key = 'u'").collect()]
    # it fires, is vetoed, is dropped when the watermark is an hour on, and fires anew
    assert sorted(got, key=str) == sorted([(1, 1, True, False), (2, 1, False, False), (3, None, None, True), (1, 1, True, False)], key=str)


def test_rule_versions_against_looking_up_each_row(spark):
    rng = random.Random(6)
    words = ["a", "b&c", "a~b", "c|d", None, "~x", "dd"]
    log = [(minutes(rng.randint(0, 40)), rng.choice([1, 4, 5]), rng.randint(1, 4), rng.choice(words), k) for k in range(60)] + [(None, 1, 1, "a", 99), (minutes(1), 1, None, "a", 98)]
    docs = [(k, minutes(rng.randint(-5, 60)), " ".join(rng.choice("abcd") for _ in range(3))) for k in range(80)] + [(100, None, "a"), (101, minutes(30), None), (102, minutes(30), "")]
    df = spark.createDataFrame(docs, "id long, ts timestamp, text string")
    versions = RuleVersions(spark.createDataFrame(log, "at timestamp, process_type int, word_id long, word string, seq long"), "seq")
    want = set()
    for k, ts, text in docs:
        valid = {}
        for at, pt, i, word, seq in sorted((x for x in log if x[0] and x[2]), key=lambda x: (x[0], x[4])):
            if ts and at <= ts:
                valid[4 if pt == 5 else pt, i] = (word, at)
        for (pt, i), (word, at) in valid.items():
            if word not in (None, "~x") and naive.process(compile_rules([(pt, i, word)]), text):
                want.add((k, pt, i, word, at))
    got = [(r.id, r.process_type, r.word_id, r.word, r.valid_from) for r in versions.match(df, "text", "ts", "7 minutes").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    engine = versions.at(minutes(20))
    assert {(int(r.process_type), r.word_id, r.word) for r in engine.compiled.rules} <= {(r.process_type, r.word_id, r.word) for r in versions.intervals.collect()}
    empty = RuleVersions(spark.createDataFrame([], "at timestamp, process_type int, word_id long, word string"))
    assert empty.match(df, "text", "ts").collect() == [] and empty.match(df, "text", "ts").columns[:3] == df.columns


def timed(rng, n, keys, **more):
    return [(rng.choice(keys), minutes(rng.randint(0, 400)) if rng.random() > 0.05 else None, k) for k in range(n)]


def test_asof_against_looking_back(spark):
    rng = random.Random(9)
    keys = ["hot"] * 5 + ["a", "b", None]
    left, right = timed(rng, 300, keys), timed(rng, 120, keys)
    a, b = (spark.createDataFrame(x, f"{k} string, {t} timestamp, {i} long") for x, (k, t, i) in ((left, "k t i".split()), (right, "rk rt j".split())))
    want = {}
    for k, t, i in left:
        before = [(rt, j) for rk, rt, j in right if k is not None and rk == k and t and rt and rt <= t]
        want[i] = max(before)[1] if before else None
    for width in ("5 minutes", "1 day"):
        found = asof(a, b, ("k", "rk"), ("t", "rt"), ["j", "rt"], width)
        assert {r.i: r.j for r in found.collect()} == want and found.count() == len(left)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError, match="already"):
        asof(a, b.withColumnRenamed("j", "i"), ("k", "rk"), ("t", "rt"), ["i"])
    assert asof(a.where("false"), b, ("k", "rk"), ("t", "rt"), ["j"]).count() == 0
    assert {r.j for r in asof(a, b.where("false"), ("k", "rk"), ("t", "rt"), ["j"]).collect()} == {None}


def test_range_join_against_all_pairs(spark):
    rng = random.Random(10)
    keys = ["hot"] * 5 + ["a", None]
    points = timed(rng, 200, keys)
    spans = [(k, t, t + dt.timedelta(minutes=rng.choice([-3, 0, 1, 30, 4000])) if t and rng.random() > 0.1 else None, j) for k, t, j in timed(rng, 80, keys)]
    a = spark.createDataFrame(points, "k string, t timestamp, i long")
    b = spark.createDataFrame(spans, "rk string, opens timestamp, closes timestamp, j long")
    want = sorted((i, j) for k, t, i in points for rk, x, y, j in spans if k is not None and k == rk and t and x and x <= t and (y is None or t < y))
    for width in ("5 minutes", "1 day"):
        found = within(a, b, ("k", "rk"), "t", "opens", "closes", ["j"], width)
        assert sorted((r.i, r.j) for r in found.collect()) == want and want
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert within(a.where("false"), b, ("k", "rk"), "t", "opens", "closes", ["j"]).count() == 0


def test_bitmaps_against_sets(spark):
    rng = random.Random(12)
    rules = [(1, k * 9001, w) for k, w in enumerate("abcdefg", 1)]  # ids of several buckets
    docs = [(k, rng.choice(["x", "y", None]), rng.choice("mn"), "".join(rng.choice("abcdefghij") for _ in range(3))) for k in range(60)] + [(100, "x", "m", None), (101, "z", "m", "zzz")]
    df, engine = spark.createDataFrame(docs, "id long, g string, h string, text string"), RuleEngine(rules)
    fired = {k: {i for _, i, w in rules if t and w in t} for k, _, _, t in docs}
    sets = collections.defaultdict(set)
    for k, g, h, _ in docs:
        sets[g, h] |= fired[k]
    fine = fired_bitmaps(df, engine, "text", "g", "h")
    assert {(r.g, r.h): r.n_rules for r in counted(fine, "g", "h").collect()} == {k: len(v) for k, v in sets.items() if v}
    want = collections.defaultdict(set)
    for (g, _), v in sets.items():
        want[g] |= v
    assert {r.g: r.n_rules for r in counted(merged(fine, "g"), "g").collect()} == {k: len(v) for k, v in want.items() if v}
    assert "partial_bitmap_construct_agg" in fine._jdf.queryExecution().toString()
    pairs = collections.Counter((g, a, b) for k, g, _, _ in docs for a in fired[k] for b in fired[k] if a < b)
    assert {(r.g, r.first, r.second): r.rows for r in fired_together(df, engine, "text", "g").collect()} == pairs


def test_long_texts_in_windows(spark):
    """Texts cut into windows of a few characters give what whole texts give: hits across cuts, overlaps, boundaries at cuts, counts."""
    rng = random.Random(13)
    texts = ["".join(rng.choice("ab b.aÉ測") for _ in range(n)) for n in (0, 1, 5, 29, 30, 31, 60, 200, 1000)] + ["ab" * 40, "a" * 90, " " * 50 + "ab", None]
    rules = [(1, 1, "aaa&aaa&aaa"), (1, 2, "\\bab\\b"), (1, 3, "ab&ab&ab~bb~bb"), (4, 4, "ab a"), (4, 5, "abab"), (8, 6, "É測|ba"), (1, 7, "b\\b&\\ba"), (14, 8, "测|aé")]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    compiled = compile_rules(rules)
    whole = relational.hit_rows(docs, compiled, "text", "id").collect()
    for window in (5, 16, 33):
        cut = relational.hit_rows(docs, compiled, "text", "id", window)
        sums, want = collections.Counter(), collections.Counter()
        for of, rows in ((sums, cut.collect()), (want, whole)):
            for r in rows:
                of[tuple(r)[:-1]] += r.n
        assert sums == want and want, window
        fired = {(r.id, r.word_id) for r in relational.matches(docs, compiled, "text", "id", window).collect()}
        assert fired == {(k, i) for k, t in enumerate(texts) for i, _ in naive.process(compiled, t)}


def test_a_long_text_is_dealt_to_all_tasks(spark):
    docs = spark.range(1).select("id", F.expr("repeat('some words and others ', 100000)").alias("text"))
    forms = relational.forms_of(docs, compile_rules([(1, 1, "others some")]), "text", "id", 1 << 14)
    sizes = [sum(1 for _ in p) for p in forms.select("body").rdd.glom().collect()]
    assert sum(sizes) > 100 and sum(n > 0 for n in sizes) == 4 and max(sizes) < 0.5 * sum(sizes)
    assert relational.hit_rows(docs, compile_rules([(1, 1, "others some")]), "text", "id", 1 << 14).agg(F.sum("n")).first()[0] == 99_999


def test_seeds_are_the_rarest(spark):
    """Patterns that begin as nearly every text does are found by what is rare in them; far fewer pairs are verified."""
    rng = random.Random(14)
    rare = sorted({"".join(rng.choice("qxzjkvw") for _ in range(6)) for _ in range(120)})
    rules = [(1, k, f"hello {w}") for k, w in enumerate(rare)]
    texts = [f"hello world, hello {rng.choice(rare) if k % 4 == 0 else 'you'} and hello again" for k in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    engine = RuleEngine(rules)
    seeds = relational.choose_seeds(relational.forms_of(docs, engine.compiled, "text", "id"), engine.compiled)
    assert len(seeds) == len(rare) > relational.FEW and "hello" not in seeds.values() and all(s in p for (_, p), s in seeds.items())
    joined = lambda seed: sum(seed(p) in t for t in texts for _, p in seeds)
    assert 3 * joined(lambda p: seeds[1, p]) < joined(lambda p: p[: relational.SEED])
    got = {(r.id, r.word_id) for r in engine.match_rows(docs, "text", "id").collect()}
    assert got == {(k, i) for k, t in enumerate(texts) for i, _ in naive.process(engine.compiled, t)}


def test_some_hundred_patterns_take_one_pass(spark):
    """They are looked for as they are, without a pass over all texts for seeds before; a rule that asks for one hit does not count them all."""
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 4)))
    rules = [(1, k, rng.choice(("{}&{}", "{}|{}", "\\b{}~{}", "{}&{}&{}~{}", "{}&{}|{}&{}")).format(*(word() for _ in range(4)))) for k in range(150)]
    rules += [(12, 500 + k, f"{word()}x{k}&{word()}") for k in range(80)] + [(1, 900, "ab&ab&ab"), (1, 901, "abc")]
    texts = ["".join(rng.choice("abcé x7.") for _ in range(n)) for n in (0, 3, 30, 300, 900)] + [None, "abab abab", "x1a" * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    compiled = compile_rules(rules)
    assert relational.FEW < len({p for pt, p, *_ in compiled.entries() if pt == 1}) <= relational.ONE_BY_ONE
    spark.sparkContext.setJobGroup("one pass", "")
    try:
        found = relational.matches(docs, compiled, "text", "id")
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("one pass")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = {(k, pt, i) for pt in (1, 12) for k, t in enumerate(texts) for i, _ in naive.process(compile_rules([r for r in rules if r[0] == pt]), t)}
    for window in (7, None):
        found = relational.matches(docs, compiled, "text", "id", window) if window else found
        assert {(r.id, r.process_type, r.word_id) for r in found.collect()} == want
    few = compile_rules([(1, 1, "ab"), (1, 2, "ab&ab"), (1, 3, "\\bab")])
    hits = lambda counted: {(r["__key"], r.rule): r.n for r in relational.hit_rows(docs, few, "text", "id", counted=counted).where("__key = 6").collect()}
    assert hits(True) == {(6, 0): 4, (6, 1): 4, (6, 2): 2} and hits(False) == {(6, 0): 1, (6, 1): 4, (6, 2): 2}


def test_rule_and_table_files(spark, tmp_path):
    register(spark)
    (tmp_path / "a.json").write_text('{"1": {"1": "x&y", "2": "z"}, "4": {"3": "w"}}')
    (tmp_path / "b.json").write_text('{"1": {"4": "p"}}\n\n{"2": {"5": "q"}}\n')
    (tmp_path / "_skipped").write_text("no rules")
    read = spark.read.format("glyphsieve").option("kind", "rules")
    assert sorted(tuple(r) for r in read.load(str(tmp_path)).collect()) == [("a.json", 1, 1, "x&y"), ("a.json", 1, 2, "z"), ("a.json", 4, 3, "w"), ("b.json", 1, 4, "p"), ("b.json", 2, 5, "q")]
    (tmp_path / "c.json").write_text("[1]")
    with pytest.raises(Exception, match="c.json holds no rules"):
        read.load(str(tmp_path)).collect()
    (tmp_path / "t.tsv").write_text("# note\nａ\ta\n測\t测\n‍\t\n", encoding="utf-8")
    got = spark.read.format("glyphsieve").option("kind", "table").load(f"file://{tmp_path}/t.tsv").collect()
    assert [(r.key, r.value) for r in got] == [("ａ", "a"), ("測", "测"), ("‍", None)]
    for options, path in (({"kind": "no"}, str(tmp_path)), ({"kind": "rules"}, "s3://bucket/x"), ({"kind": "rules"}, str(tmp_path / "none"))):
        with pytest.raises(Exception, match="no kind|mounted folders|there is no"):
            spark.read.format("glyphsieve").options(**options).load(path).collect()
    os.mkdir(tmp_path / "empty")
    assert read.load(str(tmp_path / "empty")).count() == 0


def test_lines_by_pieces_and_as_files_grow(spark, tmp_path):
    register(spark)
    lines = ["", "one", "two words", "é" * 40, "", "x" * 200, "last\r", "no end"]
    path = tmp_path / "in"
    path.mkdir()
    (path / "a.txt").write_text("\n".join(lines), encoding="utf-8", newline="")
    for piece in (1, 7, 64, 1 << 20):
        got = spark.read.format("glyphsieve").options(kind="lines", piece=piece).load(str(path)).orderBy("start").collect()
        assert [r.text for r in got] == [x.rstrip("\r") for x in lines]
        data = (path / "a.txt").read_bytes()
        assert all(r.start == 0 or data[r.start - 1 : r.start] == b"\n" for r in got)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        stream = spark.readStream.format("glyphsieve").options(kind="lines", piece=16).load(str(path))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.text for r in spark.read.parquet(out).collect())

    assert run() == sorted(x.rstrip("\r") for x in lines[:-1])  # the last line has no end yet
    with open(path / "a.txt", "a") as f:
        f.write(" now\nmore\n")
    (path / "b.txt").write_text("other\n")
    assert run() == sorted([x.rstrip("\r") for x in lines[:-1]] + ["no end now", "more", "other"])
    assert run() == sorted([x.rstrip("\r") for x in lines[:-1]] + ["no end now", "more", "other"])


def test_results_count_once_they_are_committed(spark, tmp_path):
    register(spark)
    path = str(tmp_path / "results")
    df = spark.range(100).select("id", F.concat(F.lit("w"), "id").alias("word"), F.array("id").alias("ids")).repartition(4)
    df.write.format("glyphsieve").mode("append").save(path)
    read = lambda: spark.read.format("glyphsieve").load(path)
    assert read().count() == 100 and read().schema == df.schema
    bad = df.withColumn("word", F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("word")))
    with pytest.raises(Exception, match="no"):
        bad.write.format("glyphsieve").mode("append").save(path)
    assert read().count() == 100
    datasource.sweep(path)  # of tasks that were killed
    staged = {p.name for p in (tmp_path / "results" / datasource.STAGED).iterdir()}
    assert read().count() == 100 and staged == {os.path.basename(f) for f in datasource.committed(tmp_path / "results")}  # nothing of the failed write is left
    df.limit(5).write.format("glyphsieve").mode("append").save(path)
    assert read().count() == 105
    df.limit(7).write.format("glyphsieve").mode("overwrite").save(path)
    assert read().count() == 7 and read().select("word").columns == ["word"]
    df.where("false").write.format("glyphsieve").mode("append").save(path)
    assert read().count() == 7
    with pytest.raises(Exception, match="nothing is committed"):
        spark.read.format("glyphsieve").load(str(tmp_path / "none"))


def test_a_batch_that_is_run_again_counts_once(tmp_path):
    batch = pa.RecordBatch.from_pydict({"x": [1, 2]})

    def write(number):
        w = datasource.CommittedStreamWriter(tmp_path, False)
        messages = [w.write(iter([batch])), w.write(iter([])), None]
        w.commit(messages, number)
        return messages

    write(0), write(1)
    again = write(1)
    assert len(datasource.committed(tmp_path)) == 2 and not (tmp_path / again[0].file).exists()
    lost = datasource.CommittedStreamWriter(tmp_path, False)
    m = lost.write(iter([batch]))
    lost.abort([m, None], 2)
    assert len(datasource.committed(tmp_path)) == 2 and not (tmp_path / m.file).exists()
    assert sum(json.loads(c.read_text())["rows"] for c in datasource.commits(tmp_path)) == 4
