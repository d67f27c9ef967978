"""Histogram top-k, centroid clustering and spelling variants, against brute force, on small tables with odd rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphsieve.llm import blocks, centroids, spelling, topk

VECTORS = "vec_id long, embedding array<double>, label int, rank string, score string, cluster string, uid string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", "clash", "clash", "clash") for i, v in rows], VECTORS)


def odd_vectors(dim=3, scale=1.0, n=60):
    rng = random.Random(8)
    rows = [(k, [rng.uniform(-scale, scale) for _ in range(dim)]) for k in range(n)]
    same = [(k, rows[5][1]) for k in range(200, 330)]  # more copies than are sought or let through
    odd = [(400, None), (450, []), (451, []), (500, [None] * dim), (550, [float("nan")] * dim), (600, [float("inf")] * dim), (650, [0.0] * dim), (700, [1.0] * (dim + 1)), (750, [2.0] * (dim + 1)), (None, rows[5][1]), (None, rows[0][1]), (50, rows[7][1]), (50, rows[7][1])]
    return rows + same + odd


def top_by_force(rows, k, scale):
    usable = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(usable):
        if i is not None and i % 50 == 0:
            scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), j is None, j or 0, j) for b, (j, w) in enumerate(usable) if a != b and len(v) == len(w)]
            out += [(i, r + 1, j, -s) for r, (s, _, _, j) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("scale", "options"), [(1.0, {"wave_bytes": 600, "group_queries": 2, "block_rows": 7}), (1.0, {"surplus": 0}), (2e6, {})])
def test_topk_against_all_scores(spark, scale, options):
    rows = odd_vectors(scale=scale)
    got = topk.exact_top(vectors(spark, rows), F.col("vec_id") % 50 == 0, k=5, **options).collect()
    assert sorted((tuple(r) for r in got), key=repr) == top_by_force(rows, 5, 256)


def test_topk_of_no_rows_and_of_few(spark):
    assert topk.exact_top(vectors(spark, []), F.col("vec_id") % 50 == 0).collect() == []
    assert topk.exact_top(vectors(spark, [(1, [1.0]), (2, [2.0])]), F.col("vec_id") % 50 == 0).collect() == []
    got = topk.exact_top(vectors(spark, [(0, [1.0]), (2, [-2.0])]), F.col("vec_id") % 50 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 2, -512 * 256)]
    with pytest.raises(ArithmeticError):
        topk.exact_top(vectors(spark, [(0, [1e9]), (2, [1e9])]), F.col("vec_id") % 50 == 0)


def test_topk_rounds_narrow_to_one_value(spark):
    """200 scores that differ by less than a bin of the first histogram: the next one parts them."""
    rows = [(0, [float(1 << 20), 1.0])] + [(k, [float(1 << 20), k / 256]) for k in range(1, 201)]
    got = topk.exact_top(vectors(spark, rows), F.col("vec_id") == 0, k=3, surplus=0).collect()
    assert sorted((r["rank"], r.vec_id) for r in got) == [(1, 200), (2, 199), (3, 198)]


def clusters_by_force(rows, k, rounds, dim, scale):
    kept = [(i, tuple(int(np.floor(scale * x)) for x in v)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cs = [v for _, v in order[:k]]
    for r in range(rounds + 1):
        who = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cs)) for _, v in kept]
        if r < rounds:
            for n in range(len(cs)):
                own = [v for (_, v), (_, w) in zip(kept, who, strict=True) if w == n]
                cs[n] = tuple(sum(x) // len(own) for x in zip(*own, strict=True)) if own else cs[n]
    per = collections.Counter()
    for d, n in who:
        per[n] += d
    return sorted(((i, n, d, per[n], sum(per.values()), hashlib.sha256(",".join(map(str, cs[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, who, strict=True)), key=repr)


@pytest.mark.parametrize("scale", [1.0, 1e6, 3e6])
def test_clusters_against_plain_rounds(spark, scale):
    rows = odd_vectors(scale=scale)
    got = centroids.cluster(vectors(spark, rows), k=6, dim=3, block_rows=16).collect()
    assert sorted((tuple(r) for r in got), key=repr) == clusters_by_force(rows, 6, 3, 3, 64)


def test_clusters_of_no_rows_and_of_few(spark):
    assert centroids.cluster(vectors(spark, []), dim=3).collect() == []
    rows = [(3, [0.5, 0.5]), (4, [0.5, 0.5]), (5, [9.0, 9.0])]
    got = centroids.cluster(vectors(spark, rows), k=16, dim=2).collect()
    assert sorted((tuple(r) for r in got), key=repr) == clusters_by_force(rows, 16, 3, 2, 64)
    with pytest.raises(Exception, match="do not fit in a long"):
        centroids.cluster(vectors(spark, [(1, [1e300])]), dim=1)


def test_distances_are_exact_at_any_magnitude():
    for top in (1 << 10, 1 << 24, 1 << 29, 1 << 40):
        rng = np.random.default_rng(top)
        x, c = rng.integers(-top, top, (20, 5)), rng.integers(-top, top, (4, 5)).tolist()
        want = [[sum((int(a) - b) ** 2 for a, b in zip(row, y, strict=True)) for y in c] for row in x]
        assert centroids.distances(x, c).tolist() == want
    assert blocks.products(np.array([[1 << 30, 3]]), np.array([[1 << 30, 5]]), 2.0**61).tolist() == [[(1 << 60) + 15]]


TEXTS = "doc_id long, text string, word string, n string, form string, key string, gone string"
LETTERS = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]


def words_of(docs, every=97):
    low = {ord(c): c.lower() for c in spelling.UPPER}
    n = collections.Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(low)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def apart(a, b):
    """Whether a and b differ by exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spellings_by_force(docs, every=97):
    n = words_of(docs, every)
    near = {w: [x for x in n if apart(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: b if b and n[b] >= 2 * n[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def odd_docs():
    rng = random.Random(3)
    base = ["letters", "señora", "garçon", "straße", "listen", "silent", "enlist", "inlets", "aaaaab", "aaaaaab", "ÀÉÎÕÜ", "Éàîõü"]

    def typo(w):
        i, c = rng.randrange(len(w)), rng.choice("aeéßz")
        return rng.choice([w, w, w, w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w.upper()])

    texts = [" ".join(typo(rng.choice(base)) for _ in range(200)) for _ in range(20)]
    long = " ".join(typo(rng.choice(base)) for _ in range(21_000))
    rows = [*enumerate(texts), (20, texts[0]), (20, texts[0]), (None, texts[1]), (21, None), (22, ""), (23, " ...  "), (24, long), (25, "x" * 30_000 + " " + "y" * 5000)]
    return [*rows, (26, "no ĺetter ×÷×÷× ×÷×÷× ×÷×÷×")]


@pytest.mark.parametrize(("every", "bucket_words"), [(97, 512), (5, 4)])
def test_spellings_against_all_pairs(spark, every, bucket_words):
    docs = odd_docs()
    df = spark.createDataFrame([(i, t, "clash", "clash", "clash", "clash", "clash") for i, t in docs], TEXTS)
    got = spelling.group_spellings(df, every=every, bucket_words=bucket_words).collect()
    want = spellings_by_force(docs, every)
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n) for r in got) == want
    assert any(r[1] for r in want) and any(r[4] > 3 for r in want)


def test_spellings_of_no_rows(spark):
    assert spelling.group_spellings(spark.createDataFrame([], TEXTS)).collect() == []
    assert spelling.group_spellings(spark.createDataFrame([(1, None, *["c"] * 5), (2, "a b c", *["c"] * 5)], TEXTS)).collect() == []


def test_many_anagrams_are_not_paired_with_each_other(spark):
    """5,040 words of the same letters and two one letter away: pairs of a key are not listed, links are found all the same."""
    words = ["".join(p) for p in itertools.permutations("abcdefg")] + ["abcdefh", "abcdef"]
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    pairs = spelling.near_pairs(df, 16)
    assert sorted((r.word, r.near) for r in pairs.collect()) == sorted((a, b) for x in ("abcdefh", "abcdef") for y in words if apart(x, y) for a, b in ((x, y), (y, x)) if a == x or y not in ("abcdefh", "abcdef"))


def test_chains_of_forms_lead_to_the_last(spark):
    chain = ["aaaaaa" + "b" * k for k in range(40)]
    forms = spark.createDataFrame([(w, chain[k + 1] if k + 1 < len(chain) else None) for k, w in enumerate(chain)], "word string, form string")
    assert {r.root for r in spelling._roots(forms).collect()} == {chain[-1]}


def test_no_two_exchanges_have_one_value():
    values = [ord(c) ** 5 for c in LETTERS]
    differences = [a - b for a in values for b in values if a != b]
    assert len(set(differences)) == len(differences) and not set(differences) & set(values)
