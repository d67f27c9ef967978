"""Rule language: every plan against golden cases and the plain interpreter."""

import random

import pytest
from pyspark.sql import functions as F

from glyphsieve.flags import EmptyPatterns, InvalidProcessType, ProcessType, RuleError
from glyphsieve.operators import RuleEngine, RuleEngineBuilder
from glyphsieve.operators.automaton import Scanner
from glyphsieve.plans import naive
from glyphsieve.plans.compiler import compile_rules, parse

# process type, rule, texts in which it fires, texts in which it does not
CASES = [
    (1, "hello&world", ["hello world"], ["hello"]),
    (1, "hello&world&hello", ["hello hello world"], ["hello world"]),
    (1, "无&法&无&天", ["无无法天"], ["无法天"]),
    (1, "a&a&b", ["a a b"], ["a b"]),
    (1, "abc&bc&c", ["abc"], []),
    (1, "&".join("a" * 10), ["a " * 10], ["a " * 9]),
    (1, "a&a&b&b&b", ["a a b b b"], ["a b b b", "a a b b"]),
    (1, "hello~world", ["hello"], ["world hello", "hello hello world"]),
    (1, "apple~pp", [], ["apple"]),
    (1, "a~b~b", ["a", "a b"], ["a b b", "a b b b"]),
    (1, "x&y&z~a~b", ["x y z", "z y x"], ["x y z a", "x y z b"]),
    (1, "a&b~c&d", ["a b d"], ["a b c d"]),
    (1, "color|colour", ["color", "colour"], ["xyz"]),
    (1, "c||d", ["c", "d"], []),
    (1, "color|colour&bright", ["bright colour"], ["bright", "color"]),
    (1, "hello~bad|evil", ["hello"], ["hello bad", "hello evil"]),
    (1, "a|b&c|d~e|f", ["a c", "b d"], ["a", "a c e", "b d f"]),
    (1, "\\bcat\\b", ["the cat sat", "cat", "cat!", ",cat,", "cat.dog"], ["concatenate", "scat", "cats", "_cat_", "my_cat_name", "écat", "cat！"]),
    (1, "\\bcat", ["cats", "catch"], ["scat"]),
    (1, "cat\\b", ["scat"], ["cats"]),
    (1, "\\bcat\\b~\\bcatch\\b", ["the cat catches fish"], ["the cat catch"]),
    (1, "bright&color|colour~\\bdark\\b", ["bright darken color"], ["bright dark color"]),
    (1, "hello\0world", ["hello\0world"], ["hello world"]),
    (1, "aa&aa&aa", ["aaaa"], ["aaa"]),
    (1, "hello&", ["hello"], ["x"]),
    (1, "&world", ["world"], ["x"]),
    (1, "a~|", ["a", "a |"], []),
    (8, "\\bcat\\b", ["the CAT sat"], ["CONCATENATE"]),
    (4, "ab", ["ab", "a*b", "a b"], ["ac"]),
    (4, "a*b", ["a*b", "xa*by"], ["ab", "a b"]),
    (4, "hello world", ["hello world"], ["helloworld"]),
    (5, "apple~pie", ["apple"], ["apple p.i.e"]),
    (12, "Hello World", ["hello world"], ["Hello World"]),
    (12, "HelloWorld", ["Hello World", "h.e.l.l.o world"], []),
    (6, "测试", ["测试", "測試", "测！试", "測！試"], []),
    (16, "xian", ["先"], ["西安"]),
    (32, "xian", ["先", "西安"], []),
    (18, "测试", ["测试", "測試", "策士"], []),
    (64, "fire", ["🔥"], ["x"]),
    (64, "thumbs_up", ["👍🏽"], []),
    (68, "fire", ["fire"], ["🔥"]),
    (80, "fire", ["中🔥"], []),
]


def test_goldens(spark):
    texts = sorted({t for c in CASES for t in c[2] + c[3]})
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").cache()
    for pt, rule, yes, no in CASES:
        want = {t: True for t in yes} | {t: False for t in no}
        compiled = compile_rules([(pt, 7, rule)])
        assert {t: bool(naive.process(compiled, t)) for t in want} == want, rule
        scanner = Scanner(compiled)
        assert {t: scanner.is_match(t) for t in want} == want, rule
        got = {r.text: r.m for r in docs.select("text", RuleEngine([(pt, 7, rule)], "expressions").is_match(F.col("text")).alias("m")).collect()}
        assert {t: got[t] for t in want} == want, rule


def test_plans_agree(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(sorted({t for c in CASES for t in c[2] + c[3]}))] + [(900, None), (901, "")], "id long, text string").cache()
    rows = [(pt, k, rule) for k, (pt, rule, _, _) in enumerate(CASES)]
    compiled = compile_rules(rows)
    want = {r.id: naive.process(compiled, r.text) for r in docs.collect()}
    for tier in ("expressions", "automaton"):
        got = {r.id: [(m.word_id, m.word) for m in r.matches] for r in RuleEngine(rows, tier).match_df(docs, "text").collect()}
        assert got == want, tier
    flat = sorted((r.id, r.word_id) for r in RuleEngine(rows).match_rows(docs, "text", "id").collect())
    assert flat == sorted((k, w) for k, ms in want.items() for w, _ in ms)


def test_every_pair_of_transforms(spark):
    texts = ["Ａ！測試 Ｂ", "Café 西安!", "🔥 ＨＯＴ 中🔥", "plain Text", "①② x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").cache()
    rows = []
    for a in range(7):
        for b in range(a + 1, 7):
            pt = 1 << a | 1 << b
            rows += [(pt, 10 * pt + k, w) for k, w in enumerate(["测试", "cafe", "fire", "xi", "hot&x~y", "text"])]
    compiled = compile_rules(rows)
    want = {k: naive.process(compiled, t) for k, t in enumerate(texts)}
    for tier in ("expressions", "automaton"):
        got = {r.id: [(m.word_id, m.word) for m in r.matches] for r in RuleEngine(rows, tier).match_df(docs, "text").collect()}
        assert got == want


def test_many_segments():
    for n in (64, 65, 300):
        words = [f"<{k}>" for k in range(n)]
        compiled = compile_rules([(1, 1, "&".join(words))])
        scanner = Scanner(compiled)
        assert scanner.is_match(" ".join(words)) and not scanner.is_match(" ".join(words[1:]))
        vetoed = Scanner(compile_rules([(1, 1, "&".join(words) + "~no")]))
        assert vetoed.is_match(" ".join(words)) and not vetoed.is_match(" ".join([*words, "no"]))


def test_one_id_under_two_types():
    compiled = compile_rules([(1, 1, "apple"), (4, 1, "banana")])
    assert naive.process(compiled, "apple b.a.n.a.n.a") == [(1, "apple"), (1, "banana")]


def test_random_rules_agree(spark):
    rng = random.Random(5)
    letters = "ab *é测"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 3)))
    rows, texts = [], ["".join(rng.choice(letters + "AB ") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    for k in range(120):
        rule = word()
        for _ in range(rng.randint(0, 3)):
            rule += rng.choice("&~|") + rng.choice(["", "\\b"]) + word() + rng.choice(["", "\\b"])
        rows.append((rng.choice([1, 2, 4, 8, 12, 14]), k, rule))
    compiled = compile_rules(rows)
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {k: naive.process(compiled, t) for k, t in enumerate(texts)}
    assert any(want.values())
    scanner = Scanner(compiled)
    for k, t in enumerate(texts):
        assert [(m["word_id"], m["word"]) for m in scanner.process(t)] == want[k]
        assert scanner.is_match(t) == bool(want[k])
    flat = sorted((r.id, r.process_type, r.word_id) for r in RuleEngine(rows).match_rows(docs, "text", "id").collect())
    pt_of = {k: ProcessType(pt).normalized() for pt, k, _ in rows}
    assert flat == sorted((k, int(pt_of[w]), w) for k, ms in want.items() for w, _ in ms)
    few = rows[:20]
    part = compile_rules(few)
    got = {r.id: [m.word_id for m in r.matches] for r in RuleEngine(few, "expressions").match_df(docs, "text").collect()}
    assert got == {k: [w for w, _ in naive.process(part, t)] for k, t in enumerate(texts)}


def test_errors():
    for rows in ([], [(1, 1, "")], [(1, 1, "&~")], [(1, 1, "~a")], [(1, 1, "|")]):
        with pytest.raises(EmptyPatterns):
            compile_rules(rows)
    for pt in (0, 128, -1):
        with pytest.raises(InvalidProcessType):
            compile_rules([(pt, 1, "a")])
    with pytest.raises(RuleError):
        compile_rules([(1, 1, None)])
    assert parse(ProcessType.NONE, 1, "~a") is None
    builder = RuleEngineBuilder().add_word(1, 1, "a").add_word(1, 1, "b")
    assert builder.build("automaton").compiled.rules[0].word == "b"
    with pytest.raises(ValueError):
        builder.build()


def test_flags():
    assert ProcessType(5).normalized() == ProcessType.DELETE and ProcessType(1).normalized() == ProcessType.NONE
    assert ProcessType(14).snake_case() == "variant_norm_delete_normalize"
    assert [int(s) for s in ProcessType(74).steps()] == [2, 8, 64]
