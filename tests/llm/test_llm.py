"""The operators for training data, against brute force, round trips and held-out labels, on small tables with odd rows."""

import collections
import hashlib
import html
import io
import itertools
import random
import re
import struct
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glyphsieve.llm import chat, common, cotrain, extract, licenses, neardup, packing, pieces, queries, rules, tokens, vptree, wavelet

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, "en", f"src{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)], DOCS)


def odd_texts():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    long = " ".join(rng.choice(words) for _ in range(6000))
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 200))) for _ in range(12)]
    return [None, "", "  \n ", "one", "one", "two words", *prose, prose[0], prose[0], prose[1] + " tail", long, long, "x" * 5000, "\u0000  ▁ 中文 🔥", "<|endoftext|> a"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, a null doc_id, a repeated doc_id, and extra columns named as results are."""
    df = make(spark, odd_texts()).unionByName(make(spark, ["null id"]).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(make(spark, ["other text of an id that is taken"], first=6))
    for c in ("kept", "n_tokens", "class_id", "score", "rank", "__rejected", "host", "piece"):
        df = df.withColumn(c, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="module")
def none(spark):
    return make(spark, ["x"]).where("doc_id < 0")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def texts_by_id(df):
    return {r.doc_id: r.text for r in df.collect()}


# --- 1


def page(body, host="h.example", k=0, head=""):
    return (k, f"https://{host}/{k}", f"<!DOCTYPE html><html><head><title>t</title><script>if (a<b) x('</p>')</script>{head}</head><body>{body}</body></html>")


def test_extract_articles(spark):
    body = (
        "<header><a href=/>Site</a></header><nav><ul><li><a href=/a>A</a></li></ul></nav><div class='cookie-notice'>We use cookies</div>"
        "<main><article class=post><h1>Head &amp; line</h1><p>One\n  two <b>thr</b>ee<br>four<p>Five &#233;&nbsp;six<aside>aside</aside><div class='ad'>Buy</div>"
        "<form><label>Mail</label><input></form><ul><li>item<li>next</ul><!-- hidden --><style>p{}</style><table><tr><td>c1<td>c2</table></article>"
        "<section id='comments'><article>First!</article></section></main><aside>More</aside><footer>&copy; me</footer>"
    )
    rows = [page(body, k=k) for k in range(4)] + [(9, None, None), (10, "", ""), (None, "https://h.example/x", "plain &lt;text&gt; only"), (11, "https://h.example/y", "<article><p>cut <b>off &am")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit(1))
    got = {r.page_id: r for r in extract.extract(df).collect()}
    assert got[0].text == "Head & line One two three four Five é six item next c1 c2"
    assert got[9].text == "" and got[10].text == "" and got[None].text == "plain <text> only" and got[11].text == "cut off &am"
    assert all(r.n_chars == len(r.text) for r in got.values()) and got[9].url is None
    assert extract.extract(df.where("page_id < 0")).count() == 0


def test_extract_repeated_articles_are_not_the_article(spark):
    """Readers' articles under a neutral name repeat, so the template tells them from the one that occurs once."""
    readers = lambda k: "".join(f"<article>Reader {k} {i}</article>" for i in range(k % 3))
    rows = [page(f"<main><p>Lead in</p><article class=a><p>Story {k}</p></article><div id=below>{readers(k)}</div></main>", k=k) for k in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract.extract(df).collect()} == {k: f"Story {k}" for k in range(9)}


def test_extract_by_template_without_article(spark):
    """Text that is on most pages of a host is template; what differs below the main path is the content."""
    rows = []
    for k in range(6):
        body = f"<div id=top>Welcome to our site</div><div id=links><a href=1>Link {k}</a></div><div id=body><h2>Story {k}</h2><p>{'word%d ' % k * 30}</p><p>The end of story {k}</p></div><div>All the same below</div>"
        rows.append(page(body, "t.example", k))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in extract.extract(df, salts=2).collect():
        assert r.text == f"Story {r.page_id} {' '.join(['word%d' % r.page_id] * 30)} The end of story {r.page_id}"
    made = extract.templates(df).first()
    assert made.host == "t.example" and made.host_pages == 6 and len(made.fixed) == 2 and made.root.endswith("/div.body")
    first = made.classes[0]
    assert first.parent == -1 and first.once and "/html/body/div.body/p" not in first.tokens
    assert any(c.parent == 0 and not c.once and "/html/body/div.body/p" in c.tokens for c in made.classes)


def test_extract_template_inside_articles(spark):
    """Neutral boxes in an article that each page of a host repeats are template; text that two pages share is not."""
    box = "<div class=box><p>Tell your friends</p></div>"
    rows = [page(f"<article><h1>Title {k}</h1><p>{'Seen twice' if k < 2 else f'Own {k}'}</p>{box}<p>End of {k}</p><p>Written by our staff</p></article>", "i.example", k) for k in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract.extract(df).collect()} == {k: f"Title {k} {'Seen twice' if k < 2 else f'Own {k}'} End of {k}" for k in range(5)}


def test_extract_long_boilerplate(spark):
    """Long blocks that a host repeats are template as short ones are, with an article element or without."""
    legal = "All rights in these pages are ours and " * 20
    rows = [page(f"<{tag}><p>Story {k} {'told ' * 50}</p><p>{legal}</p><p>End of {k}</p><p>Short line</p></{tag}>", f"{tag}.example", k) for tag in ("article", "div") for k in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert all(r.text == f"Story {r.page_id} {'told ' * 50}End of {r.page_id}" for r in extract.extract(df).collect())


def test_extract_repeated_rows_and_long_pages(spark):
    rows = [page("<article><p>Same page</p></article>", "r.example", 1)] * 5 + [page(f"<nav>Menu</nav><article>{'<p>long words</p>' * 30_000}</article>", "l.example", k) for k in (2, 3)]
    got = collections.Counter((r.page_id, r.text) for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    long = " ".join(["long words"] * 30_000)
    assert got == {(1, "Same page"): 5, (2, long): 1, (3, long): 1}


def test_extract_neutral_markup(spark):
    """Where every element is a div without a name, the template alone finds the articles of the test pages, and of pages with a
    long notice that all repeat; without it each page comes out with all its text."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<(/?)(nav|article|footer)(?=[ >])", "<$1div"), ' class="ad"', ""))
    legal = "We keep what you read here to ourselves and tell nobody of it at all " * 5  # 70 words
    own = [page(f"<div><a href=/>Home</a></div><div><h1>Title {k}</h1><div><p>{f'word{k} ' * 60}</p><p>{legal}</p></div></div><div>Seen {k} times</div>", "n.example", 10_000 + k) for k in range(5)]
    bare = bare.select("page_id", "url", "html").unionByName(spark.createDataFrame(own, "page_id long, url string, html string"))
    got = {r.page_id: r.text for r in extract.extract(bare).collect()}
    want = {r.page_id: r.text for r in extract.extract(pages).collect()}
    large = {r.host for r in extract.templates(pages).where("host_pages >= 3").collect()}
    hosts = {r.page_id: r.h for r in pages.select("page_id", extract.host(F.col("url")).alias("h")).collect()}
    sure = [k for k in want if hosts[k] in large]
    assert len(sure) > 200 and all(got[k] == want[k] for k in sure) and sum(got[k] == v for k, v in want.items()) >= 0.98 * len(want)
    assert all(got[10_000 + k] == f"Title {k} {' '.join([f'word{k}'] * 60)}" for k in range(5))
    none = frozenset()
    off = {r.page_id: extract.main_text(extract.parse(r.html or ""), none, none, none, "") for r in bare.collect()}
    assert sum(off[k] != got[k] for k in got) >= 0.98 * len(got)


def varied(k, rng):
    """A page of a blog: classes of body, wrapper and article and some ids are its own."""
    words = ["news", "sport", "travel", "food", "music", "science"]
    pick = lambda: rng.choice(words)
    story = f"<h1>Title {k}</h1><p>{f'word{k} ' * 40}</p>" + "".join(f"<p id='p{chr(97 + k % 26)}{k}x{j}'>Part {j} of story {k}</p>" for j in range(2))
    return (
        f"<body class='category-{pick()} tag-{pick()}'><div class='menu-row'><a href=/>Home</a></div><div class='page w-1/2 {pick()}-{pick()}' id='wrap-{rng.randrange(1 << 40):x}'>"
        f"<div class='inner' id='s{rng.randrange(1 << 40):x}'><div class='post-{k} entry {pick()}'>{story}</div></div></div>"
        f"<div class='low {pick()}'><p>Read by {rng.randrange(999)} people</p><p>Story {k} seen times today by readers</p></div>"
    ), f"Title {k} {' '.join([f'word{k}'] * 40)} Part 0 of story {k} Part 1 of story {k}"


@pytest.mark.parametrize("n", [12, 3000])
def test_extract_survives_classes_and_ids_of_single_pages(spark, n):
    """Classes and ids that vary by page leave the template as it is, and nothing of a host grows with its pages."""
    rng = random.Random(n)
    made = [varied(k, rng) for k in range(n)]
    df = spark.createDataFrame([(k, f"https://blog.example/{k}", f"<html><head><title>T</title></head>{body}</body></html>") for k, (body, _) in enumerate(made)], "page_id long, url string, html string").repartition(8)
    got = {r.page_id: r.text for r in extract.extract(df).collect()}
    assert sum(got[k] == want for k, (_, want) in enumerate(made)) == n, next((got[k], want) for k, (_, want) in enumerate(made) if got[k] != want)
    names = extract.stable_names(df).first().names
    assert {"div.entry", "div.inner", "div.menu-row", "div.w-0_0"} <= set(names) and len(names) < 20
    vectors = extract.token_vectors(df)
    assert extract.slots_of(vectors, 0.5).count() < 30


def test_extract_neutral_markup_with_a_class_on_each_body(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: r.text for r in extract.extract(pages).collect()}
    bare = pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<(/?)(nav|article|footer)(?=[ >])", "<$1div"), ' class="ad"', ""))
    word = F.element_at(F.array(*[F.lit(w) for w in ("news", "sport", "travel", "food", "music", "science")]), (F.pmod(F.xxhash64("page_id"), F.lit(6)) + 1).cast("int"))
    bare = bare.withColumn("html", F.regexp_replace("html", F.lit("<body"), F.concat(F.lit('<body class="'), word, F.lit('"'))))
    got = {r.page_id: r.text for r in extract.extract(bare).collect()}
    assert sum(got[k] == v for k, v in want.items()) >= 247 and bare.where("html like '%<body class=%'").count() == len(want)


def test_extract_names_alone_do_not_drop_articles(spark):
    """Wrappers and builder elements named like chrome keep their text; boxes that the template confirms go."""
    story = lambda k: f"<h1>Title {k}</h1><p>{'word%d ' % k * 40}</p>"
    wrapped = {
        "wrap": lambda k: f"<div class='layout sidebar-right'><article>{story(k)}</article></div>",
        "open": lambda k: f"<div id='comments-open'><div class='widget-area'><main>{story(k)}</main></div></div>",
        "widget": lambda k: f"<div class=widget><article>{story(k)}</article></div>",
        "plain": lambda k: f"<div class='layout sidebar-right'><div class=body>{story(k)}</div></div>",
        "built": lambda k: f"<article><div class='elementor-widget-heading'><h1>Title {k}</h1></div><div class='elementor-widget-text'><p>{'word%d ' % k * 40}</p></div><div class=related><p>See {k + 1}</p></div></article>",
        "reader": lambda k: f"<div class=body>{story(k)}</div><section id=comments><article>Reader {k}</article></section>",
        "inmain": lambda k: f"<main><p>Lead {k}</p><div class='layout sidebar-right'><article>{story(k)}</article></div></main>",
    }
    for pages in (1, 5):
        rows = [page(body(k), f"{name}.example", k) for name, body in wrapped.items() for k in range(pages)]
        df = spark.createDataFrame(rows, "page_id long, url string, html string")
        got = {(r.url.split("/")[2].split(".")[0], r.page_id): r.text for r in extract.extract(df).collect()}
        for (name, k), text in got.items():
            assert text == f"Title {k} {' '.join([f'word{k}'] * 40)}", (pages, name, text)


def test_extract_salted_join_is_the_same(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = sorted((r.page_id, r.text) for r in extract.extract(pages).collect())
    monkeypatch.setattr(extract, "BROADCAST_BYTES", 0)
    assert sorted((r.page_id, r.text) for r in extract.extract(pages, salts=3).collect()) == want
    for r, (key, text) in zip(sorted(pages.collect(), key=lambda r: r.page_id), want, strict=True):
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        plain = html.unescape(re.sub(r"<[^>]*>", "\n", re.sub("</?b>", "", inner)))
        assert key == r.page_id and text == " ".join(plain.split())


# --- 2


def test_cotrain_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train = labels.where("doc_id % 3 <> 0")
    got = {r.doc_id: r for r in cotrain.classify(docs, train).collect()}
    held = [(r.quality, got[r.doc_id]) for r in labels.where("doc_id % 3 = 0").collect()]
    assert len(got) == docs.count() and len(held) > 100
    assert np.mean([q == r.kept for q, r in held]) > 0.97
    again = {r.doc_id: r.score for r in cotrain.classify(docs.repartition(7), train).collect()}
    assert all(abs(again[k] - r.score) < 1e-6 for k, r in got.items())
    kept = {r.doc_id for r in cotrain.keep_good(docs, train).collect()}
    assert kept == {k for k, r in got.items() if r.kept}


def test_cotrain_views_teach_each_other():
    """Metadata decides most rows; the text view learns rows of a kind that few labels show from it, and no lesson makes it worse."""
    gains = []
    for draw, shown in ((1, 20), (1, 80), (2, 20), (2, 80), (3, 40), (3, 80)):
        rng = np.random.default_rng(draw)
        n = 900
        good = rng.random(n) < 0.5
        kind = np.arange(n) % 2
        text = rng.normal(size=(n, 4))
        text[:, 0] += np.where(kind == 0, np.where(good, 3, -3), 0)
        text[:, 1] += np.where(kind == 1, np.where(good, 3, -3), 0)
        meta = np.stack([good * 1.0 + rng.normal(size=n) * 0.12, rng.normal(size=n)], 1)
        label = np.where((np.arange(n) < 300) & ((kind == 0) | (np.arange(n) < shown)), good, np.nan)
        alone, taught = (cotrain.train(text, meta, label, rounds=r).scores(text, meta)[0] for r in (0, 4))
        gains.append((((taught > 0.5) == good)[kind == 1]).mean() - (((alone > 0.5) == good)[kind == 1]).mean())
    assert min(gains) >= 0 and max(gains) > 0.03


def test_cotrain_learns_from_all_rows_without_a_label(spark):
    """The same model as in memory on all 4,000 rows without a label: none is left out."""
    rng = random.Random(5)
    word = lambda k: rng.choice(("fine", "plain", "words", "long") if rng.random() < (0.75 if k % 2 else 0.25) else ("BUY!!", "$$$", "now", "win"))
    texts = [" ".join(word(k) for _ in range(rng.randint(3, 30))) for k in range(4200)]
    sources = [k % 2 if rng.random() < 0.96 else 1 - k % 2 for k in range(4200)]
    named = spark.createDataFrame(list(enumerate(f"s{x}" for x in sources)), "k long, s string")
    docs = make(spark, texts).drop("source").join(named.withColumnRenamed("s", "source"), F.col("doc_id") == F.col("k")).drop("k")
    key = docs.select("doc_id", F.xxhash64("doc_id", F.lit(17)).alias("h"), (F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 31)) / float(1 << 31)).alias("chance")).orderBy("h", "doc_id").collect()
    chance = {r.doc_id: r.chance for r in key}
    changed = lambda a, b: not np.allclose(a.text.weights, b.text.weights, atol=1e-2) or not np.allclose(a.meta.weights, b.meta.weights, atol=1e-2)
    for n in (60, 90, 120, 160, 200, 240):  # until a lesson stays
        order = [r.doc_id for r in key if r.doc_id < n] + [r.doc_id for r in key if r.doc_id >= n]
        cells = np.array([cotrain.metadata_cell(f"s{sources[k]}", "en", len(texts[k])) for k in order])
        text, meta = cotrain.split_views(np.array([cotrain.read_views(texts[k]) for k in order]), cells)
        label = np.array([k % 2 if k < n else np.nan for k in order])
        want = cotrain.train(text, meta, label, chance=np.array([chance[k] for k in order]))
        if changed(want, cotrain.train(text, meta, label, rounds=0)):
            break
    else:
        raise AssertionError("no lesson stays")
    got = cotrain.fit(docs, spark.createDataFrame([(k, k % 2, 0) for k in range(n)], "doc_id long, quality int, toxic int"))
    assert np.allclose(got.text.weights, want.text.weights, atol=1e-4) and np.allclose(got.meta.weights, want.meta.weights, atol=1e-4)


def test_cotrain_reads_one_row_of_a_labelled_id(spark):
    """A labelled doc_id on many rows is one row to learn from, and the same model comes out."""
    texts = [" ".join(("fine plain words" if k % 2 else "BUY!! now").split() * (k % 7 + 1)) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    docs = make(spark, texts)
    again = docs.unionByName(docs.where("doc_id = 3").crossJoin(spark.range(500)).drop("id"))
    a, b = (cotrain.fit(d, labels) for d in (docs, again))
    assert np.allclose(a.text.weights, b.text.weights) and np.allclose(a.meta.weights, b.meta.weights)


def test_cotrain_exchange_of_a_round():
    """What a round passes, against sorting all rows by sureness; and both views are then fitted on just that."""
    rng = np.random.default_rng(6)
    n, share = 2000, 0.05
    good = rng.random(n) < 0.6
    views = [rng.normal(size=(n, 3)) + np.where(good, 2, -2)[:, None] * np.array([1, 0.5, 0]) for _ in (0, 1)]
    label = np.where(np.arange(n) < 300, good, np.nan)
    seen = []

    class Spy(cotrain.Pool):
        def total(self, of):
            out = super().total(of)
            seen.append(out)
            return out

    free = np.arange(300, n)
    pool = Spy(cotrain.Rows((views[0][free], views[1][free]), rng.random(len(free))))
    taught = cotrain.train(*views, label, rounds=1, share=share, pool=pool)
    start = cotrain.train(*views, label, rounds=0)
    least, prior, learnt = np.log(0.97 / 0.03), np.nanmean(label), []
    taught_is = lambda a, b: np.array_equal(a.weights, b.weights)  # noqa: E731  a lesson that lowered nothing is undone
    logits = [np.clip(m.logit(views[v][free]) * start.platt[v][0] + start.platt[v][1], -30, 30) for v, m in enumerate((start.text, start.meta))]
    sides = [z > 0 for z in logits]
    held = np.concatenate([np.flatnonzero(label == kind)[::5] for kind in (0, 1)])
    seed = np.setdiff1d(np.arange(300), held)
    for v, model in enumerate((taught.text, taught.meta)):
        other = 1 - v
        may = (np.abs(logits[other]) > least) & ~((np.abs(logits[v]) > least) & (sides[v] != sides[other]))
        chosen = np.zeros(len(free), bool)
        for side, part in ((False, 1 - prior), (True, prior)):
            own = np.flatnonzero(may & (sides[other] == side))
            own = own[np.argsort(-np.abs(logits[other][own]))][: round(int(share * len(free)) * part)]
            chosen[own] = True
        assert chosen.sum() > 50 and (sides[other] == good[free])[chosen].mean() > 0.98
        counted = [x[7 * v] for x in seen if len(x) == 14]  # moments of both views in one pass; bins of sureness part rows a little otherwise
        assert len(counted) == 1 and abs(counted[0] - chosen.sum()) <= 3
        more = cotrain.Taught(cotrain.Pool(cotrain.Rows((views[0][free][chosen], views[1][free][chosen]), np.zeros(int(chosen.sum())))), v, [])
        more.moments_of = lambda rows: cotrain._moments(rows.views[v])  # noqa: B023
        more.newton_of = lambda rows, mean, scale, w: cotrain._newton(rows.views[v], sides[other][chosen].astype(float), mean, scale, w)  # noqa: B023
        want = cotrain.fit_views([cotrain.Task(views[v][seed], label[seed], cotrain.PENALTY[v], more, (start.text, start.meta)[v].weights)], cotrain.STEPS)[0]
        stays = taught_is(model, (start.text, start.meta)[v])
        assert stays or np.allclose(model.weights, want.weights, atol=0.05)
        learnt.append(not stays)
    assert any(learnt) and len(seen) <= 1 + 1 + cotrain.STEPS


def test_cotrain_with_few_labels():
    """With 60 labels of two views that tell much and are independent, four rounds do better than none; a view that tells nothing doesn't teach."""
    rng = np.random.default_rng(7)
    n, right = 6000, collections.defaultdict(list)
    for _ in range(6):
        good = rng.random(n) < 0.5
        noisy = [rng.normal(size=(n, 12)) + np.where(good, 1, -1)[:, None] * np.array([1.2] * 4 + [0] * 8) for _ in (0, 1)]
        label = np.where(np.arange(n) < 60, good, np.nan)
        for rounds in (0, 4):
            right[rounds].append((((cotrain.train(*noisy, label, rounds=rounds).scores(*noisy)[2] > 0.5) == good)[60:]).mean())
        blank = rng.normal(size=(n, 5))
        a, b = (cotrain.train(noisy[0], blank, label, rounds=r) for r in (0, 4))
        assert np.allclose(a.text.weights, b.text.weights)
    assert np.mean(right[4]) > np.mean(right[0])


def test_cotrain_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    for few in (labels, labels.where("doc_id < 0")):
        got = cotrain.classify(odd, few).collect()
        assert len(got) == odd.count() and not any(r.kept for r in got if r.doc_id in (0, 1, 2)) and sum(r.kept for r in got) == odd.count() - 3
    kept = cotrain.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert cotrain.classify(none, labels).count() == 0


# --- 3


def encoded(texts):
    codec = tokens.ChunkEncoder(tokens.default_tokenizer())
    return [e + struct.pack("<I", 1) for e in codec._whole([t or "" for t in texts])]


def test_encoder_equals_the_library():
    codec = tokens.ChunkEncoder(tokens.default_tokenizer(), entries=50)
    assert codec.by_piece
    rng = random.Random(2)
    alphabet = [chr(c) for c in [*range(9, 14), *range(28, 127), *range(160, 0x250), 0x300, 0x301, 0x3A3, 0x3C3, 0x4E2D, 0x1F525]]
    texts = ["".join(rng.choice(alphabet) if rng.random() < 0.6 else rng.choice(" '\n.9as") for _ in range(50)) for _ in range(800)]
    texts += ["", "it's 'RE don'T'", "a\x1cb c", "x <|endoftext|>y", "İstanbul ΑΣ", None or "", "<|startoftext|>"]
    assert codec.encode(texts) == codec._whole(texts)
    assert codec.encode(texts[:50], batch_chars=10) == codec._whole(texts[:50])


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (7, 2), (5000, 49408), (3000, 3), (1000, 1 << 17)):
        ids = np.minimum(rng.zipf(1.3, n), top - 1).astype(np.uint32) if top > 1 else np.zeros(n, np.uint32)
        w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes())
        assert (w.decode() == ids).all()
        for i in range(0, n, max(1, n // 40)):
            assert w.access(i) == ids[i]
        for t in {*ids[:10].tolist(), 0, 5, 1 << 20}:
            places = np.flatnonzero(ids == t)
            assert w.count(t) == len(places) and w.occurrences(t)[:30] == places[:30].tolist() and w.select(t, len(places)) == -1
            assert w.rank(t, n // 2) == (places < n // 2).sum()
    with pytest.raises(IndexError):
        w.access(1000)
    ids = rng.integers(0, 500, 3 * 8 * wavelet.PIECE + 77)  # planes of several pieces
    w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes())
    assert w.access(len(ids) - 1) == ids[-1] and len(w._pieces) <= 2 * w.width  # not all were unpacked
    places = np.flatnonzero(ids == 7)
    assert (w.decode() == ids).all() and w.count(7) == len(places) and [w.select(7, k) for k in (0, 1000, len(places) - 1)] == places[[0, 1000, -1]].tolist()
    assert all(w.access(int(i)) == ids[i] for i in rng.integers(0, len(ids), 50)) and w.rank(7, 800_000) == (places < 800_000).sum()


def test_token_store(spark, docs, odd, none):
    for df, shard in ((docs, 5000), (odd, 1000), (odd, 1 << 20)):
        path = wavelet.write_store(df, tokens.default_tokenizer(), 1, shard)
        got = sorted(wavelet.read_documents(spark, path).collect(), key=lambda r: r.start)
        rows = df.select("doc_id", "text").collect()
        want = collections.defaultdict(list)
        for r, ids in zip(rows, encoded([r.text for r in rows]), strict=True):
            want[r.doc_id].append(ids)
        assert [r.doc_id for r in got] == sorted([r.doc_id for r in rows], key=lambda k: (k is not None, k))
        start = 0
        for r in got:
            ids = bytes(r.ids)
            assert ids in want[r.doc_id] and (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
            start += r.n_tokens
        assert wavelet.lookup(spark, path, [1]).agg(F.sum("n")).first()[0] >= len(rows)
    found = wavelet.lookup(spark, path, [1, 560], places=True).collect()
    assert all(len(r.places) == r.n and all(p >= r.first_token for p in r.places) for r in found)
    assert wavelet.token_store(none, tokens.default_tokenizer()).count() == 0


# --- 4


def scan_one(text, templates=licenses.TEMPLATES):
    words = licenses.words_of(text)
    joined = b" " + b" ".join(words) + b" "
    return {t: found for t, m in templates if (found := licenses.Template(t, m).find(words, joined))}


def test_template_automata_accept_what_their_regex_does():
    rng = random.Random(3)
    markups = ["a [[b c]] d", "a {{1..2}} b [[a]]", "[[a]] b {{0..2}} c", "a [[b [[c]] ]] d d", "b b [[b]] a", "a ((b|c d|d [[a]])) b", "[[a|b c]] d ((c|d)) a"]
    for m in markups:
        t, pattern = licenses.Template("x", m), re.compile(licenses.template_regex(m))
        for _ in range(600):
            words = [rng.choice(["a", "b", "c", "d"]) for _ in range(rng.randint(0, 9))]
            found = t.find([w.encode() for w in words], f" {' '.join(words)} ".encode())
            assert bool(found) == bool(re.search(r"(?:^|(?<= ))" + pattern.pattern, "".join(f"{w} " for w in words))), (m, words)
            for s, e in found:
                assert pattern.fullmatch("".join(f"{w} " for w in words[s:e]))
    for bad in ("[[a", "{{0..3}}", "[[a b]]", "a | b", "((a]] b", "a ))"):
        with pytest.raises(ValueError):
            licenses.Template("x", bad)


def test_license_texts_altered():
    """Every template accepts texts made from its own markup, in any case and punctuation, and none with a mandatory word changed."""
    rng = random.Random(11)

    def sample(tokens, at=0, until=()):
        """Words of one text of the markup, each with whether it is mandatory; and where the region ends."""
        out, choices = [], []
        while at < len(tokens) and tokens[at] not in until:
            t = tokens[at]
            if t in ("[[", "(("):
                own, at = sample(tokens, at + 1, ("]]", "))"))
                out += [(w, False) for w in rng.choice(own + ([[]] if t == "[[" else []))]
            elif t == "|":
                choices.append([w for w, _ in out])
                out = []
            elif t.startswith("{{"):
                least, most = map(int, t[2:-2].split(".."))
                out += [(f"any{rng.randint(0, 9)}", False) for _ in range(rng.randint(least, most))]
            else:
                out += [(w.decode(), True) for w in licenses.words_of(t)]
            at += 1
        return (choices + [[w for w, _ in out]], at) if until else out

    for label, markup in licenses.TEMPLATES:
        template = licenses.Template(label, markup)
        for _ in range(6):
            words = sample(licenses._MARKUP.findall(markup))
            text = "Intro, words: " + "".join(rng.choice((w.upper(), w.title(), w)) + rng.choice((" ", ", ", "\n", "-")) for w, _ in words) + "the rest."
            own = licenses.words_of(text)
            assert template.find(own, b" " + b" ".join(own) + b" "), (label, text)
            must = [k for k, (_, m) in enumerate(words) if m]
            k = rng.choice(must)
            other = licenses.words_of(" ".join("zzz" if i == k else w for i, (w, _) in enumerate(words)))
            if sum(w == words[k][0] for w, _ in words) == 1:
                assert not template.find(other, b" " + b" ".join(other) + b" "), (label, words[k])
    bsd = licenses._BSD + " neither the name of the owner nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission "
    end = licenses._BSD_END.replace("{{1..12}}", "the copyright holder or contributors")
    assert [*scan_one(bsd + end)] == ["bsd-3-text"] and [*scan_one(licenses._BSD + " " + end)] == ["bsd-2-text"]
    assert not scan_one(bsd + "this software is provided by them as is") and not scan_one(bsd + end.replace("strict liability", "liability"))


def test_license_texts_need_all_their_wording():
    grant = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. """
    end = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
    assert [*scan_one(grant + end)] == ["mit-text"]
    assert not scan_one(grant + "The Software shall be used for Good, not Evil. " + end)
    assert not scan_one(grant) and not scan_one(grant + end.replace("TORT", "TORTS")) and not scan_one(grant + end.replace("FITNESS FOR A PARTICULAR PURPOSE", "FITNESS"))


def test_license_names_and_tags():
    told = {
        "Licensed under the Apache License 2.0": "apache-2.0", "GNU GPL v3": "gpl-3.0", "released under the GNU LGPL 2.1 or later": "lgpl-2.1", "// SPDX-License-Identifier: Apache-2.0": "apache-2.0", "SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3.0",
        "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause", "distribute it under the GNU Library General Public License, version 2": None, "you can modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2": "lgpl-2.0",
        "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.": "lgpl-title",
    }
    for text, label in told.items():
        assert [*scan_one(text)] == ([label] if label else []), text


def test_license_anchors_pass_over_no_template():
    built = [licenses.Template(*t) for t in licenses.TEMPLATES]
    index = licenses.Anchors(built)
    for t in built:
        assert t in index.of([b"some", *t.anchor, b"words"])
    assert index.of([b"some", b"words"]) == []


def test_spdx_templates():
    text = 'Licensed under the <<var;name="name";original="Acme";match=".{1,30}">> License<<beginOptional>>, Version <<var;name="v";original="2";match="(1.0|2)">><<endOptional>> (the "License").'
    markup = licenses.from_spdx(text)
    t = licenses.Template("x", markup)
    ask = lambda x: bool(t.find(w := licenses.words_of(x), b" " + b" ".join(w) + b" "))
    assert ask("licensed under the Foo Bar License the license") and ask("LICENSED UNDER THE A LICENSE, version 1.0, the License")
    assert not ask("licensed under the License the license") and not ask("licensed under the A License version 3 the license")
    with pytest.raises(ValueError):
        licenses.from_spdx('<<var;name="a";original="b";match="[0-9]+">>')


def test_license_scan(spark, odd, none):
    texts = [
        "Foo.\nLicensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.", "all rights reserved ALL RIGHTS  reserved",
        "licensed under the apache licence version 2 0", "Licensed under the Apache License, Version 2.0", "the general public license general public license", None, "cc cc by",
        "licensed under a Creative Commons Attribution 4.0 International License", "you can modify it under the terms of the GNU Lesser General Public License, version 2.1 or later", "GNU General Public License v3.0",
    ]
    got = {r.doc_id: r for r in licenses.scan(make(spark, texts)).collect()}
    labels = {k: r.labels for k, r in got.items()}
    assert labels == {0: "cc-by,cc-by-nc-4.0", 1: "gpl,gpl-3.0", 2: "mit", 3: "all-rights-reserved,reserved", 4: "", 5: "apache-2.0", 6: "gpl", 7: "", 8: "cc-by", 9: "cc-by-4.0", 10: "gpl,lgpl-2.1", 11: "gpl"}
    assert (got[3].n_base, got[3].first_word, got[3].last_word, got[3].n_words) == (2, 0, 3, 6)
    assert (got[6].score, got[7].score, got[5].score, got[7].first_word) == (0.5, 0.0, 1.0, None)
    assert got[1].spans[0].start == 0 and got[1].spans[0].end == 12
    for r in licenses.scan(odd).collect():
        assert r.n_words >= 0 and r.score in (0, 0.5, 1)
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(none).count() == 0


# --- 5


def check_packing(rows, capacity):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append(r)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(bins)


def test_packing(spark, docs, odd, none):
    for df, capacity, chunk in ((docs, 4096, 4096), (docs, 512, 64), (odd, 256, 8)):
        rows = packing.pack(df, tokens.default_tokenizer(), capacity=capacity, chunk_items=chunk).collect()
        total = sum(r.length for r in rows)
        bins = check_packing(rows, capacity)
        small = np.array([r.length for r in rows if r.length < capacity])
        least = packing.lower_bound(small, capacity) + len(rows) - len(small)
        assert -(-total // capacity) <= least <= bins <= 1.01 * least + 1
        source = df.select("doc_id", "text").collect()
        want = collections.Counter()
        for r, ids in zip(source, encoded([r.text for r in source]), strict=True):
            for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                own = ids[s : s + 4 * capacity]
                want[r.doc_id, k, s // 4, len(own) // 4, zlib.crc32(own)] += 1
        assert want == collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert packing.pack(none, tokens.default_tokenizer()).count() == 0


def test_packing_is_optimal_where_brute_force_can_tell():
    rng = np.random.default_rng(7)

    def least(sizes, capacity):
        for n in range(-(-sum(sizes) // capacity), len(sizes) + 1):
            if any(all(sum(s for s, b in zip(sizes, put, strict=True) if b == k) <= capacity for k in range(n)) for put in itertools.product(range(n), repeat=len(sizes))):
                return n
        return 0

    for seed in range(8):
        sizes = rng.integers(10, 70, 7)
        p = packing.Packer(sizes, 100, seed)
        best = p.evolve([p.fresh() for _ in range(4)], 60)[0]
        assert p.bound <= len(best[1]) == least(sizes.tolist(), 100)
        assert (np.bincount(best[0], sizes, len(best[1])) == best[1]).all() and best[1].max() <= 100


def test_crossover_keeps_every_item_once_and_injects_whole_bins():
    sizes = np.random.default_rng(1).integers(1, 60, 300)
    p = packing.Packer(sizes, 100, 3)
    a, b = p.fresh(), p.fresh()
    child = p.cross(a, b)
    assert (np.bincount(child[0], sizes, len(child[1])) == child[1]).all() and child[1].max() <= 100 and child[1].min() > 0
    groups = lambda x: {tuple(np.flatnonzero(x[0] == k)) for k in range(len(x[1]))}
    assert groups(child) & groups(b)
    for _ in range(5):
        child = p.refill(child, 3, 0.1)
        assert (np.bincount(child[0], sizes, len(child[1])) == child[1]).all() and child[1].max() <= 100 and child[1].min() > 0


def test_breeding_saves_bins():
    """From orders drawn by lot, generations come to the least number of bins; where best fit by size misses it, they go below."""
    rng = np.random.default_rng(5)
    sizes = np.minimum(rng.lognormal(6.3, 0.9, 3000).astype(int) + 1, 4095)
    p = packing.Packer(sizes, 4096, 1)
    first = [p.fresh() for _ in range(6)]
    assert min(len(x[1]) for x in first) > len(p.evolve(first, 60)[0][1]) == p.bound
    small = packing.Packer(rng.integers(1, 100, 2000) % 127 + 1, 128, 2)
    greedy = len(small.decreasing()[1])
    hard = packing.Packer(np.repeat([44, 43, 41, 27, 29], [200, 210, 190, 90, 110]), 128, 3)
    worst = len(hard.decreasing()[1])
    assert greedy >= small.bound and len(hard.evolve([hard.decreasing(), *[hard.fresh() for _ in range(5)]], 200)[0][1]) < worst


# --- 6


def brute(docs_rows, threshold=0.8):
    rows = [(k, r.doc_id, (r.text or "").encode().split()) for k, r in enumerate(docs_rows)]
    sets = {k: frozenset(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)]) for k, d, w in rows if w and d is not None}
    links, parent = collections.Counter(), {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    least = {}
    ids = {k: d for k, d, _ in rows}
    for k in sets:
        least[find(k)] = min(least.get(find(k), 1 << 60), ids[k])
    return collections.Counter((d, least[find(k)] if k in sets else d, links[k]) for k, d, _ in rows)


def near_family(n, size, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 400)}" for _ in range(size)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(size)] = f"e{rng.randint(0, 50)}"
        out.append(" ".join(own))
    return out


def test_jaccard_join(spark, docs, odd, none, monkeypatch):
    family = make(spark, near_family(60, 120, 6, 1) + near_family(40, 60, 3, 2) + ["a b c d", "a b c d", "a b c"])
    for df in (docs, odd, family):
        got = collections.Counter((r.doc_id, r.class_id, r.n_links) for r in neardup.jaccard_join(df).collect())
        assert got == brute(df.select("doc_id", "text").collect())
    monkeypatch.setattr(neardup, "BUCKET", 7)
    monkeypatch.setattr(neardup, "CLUSTER", 9)  # groups in pairs of blocks
    got = neardup.jaccard_join(family).collect()
    assert collections.Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute(family.collect())
    assert all(r.copy_of is not None and r.class_id <= r.copy_of <= r.doc_id for r in got)
    assert neardup.jaccard_join(none).count() == 0
    kept = neardup.keep_one(family)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.class_id for r in got}) and kept.columns == family.columns


def test_bayesian_test_keeps_the_threshold():
    """Pairs at the threshold pass with a chance of all but the tolerance, pairs far below hardly ever."""
    need = neardup.least_matches(0.8, 1e-5)
    rng = np.random.default_rng(0)
    alive = lambda s: np.mean([all(np.cumsum(rng.random(96) < s)[neardup.LOOK * (k + 1) - 1] >= m for k, m in enumerate(need)) for _ in range(4000)])
    assert alive(0.8) > 0.999 and alive(0.3) < 0.001 and need == sorted(need)


def test_connected_components(spark):
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 202), (202, 200)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {k: 0 for k in range(31)} | {k: 100 for k in range(100, 140)} | {k: 200 for k in (200, 201, 202)}


def test_row_groups_in_a_fresh_process():
    """A worker gets its batches from a stream, so nothing but the module itself has imported parts of pyarrow."""
    code = """
import sys
import pyarrow as pa
from glyphsieve.llm import common
batches = pa.ipc.open_stream(sys.stdin.buffer)
print([t.column("k").to_pylist() for t in common.row_groups(batches, ["k"])])
"""
    batches = [pa.RecordBatch.from_pydict({"k": k}, pa.schema([("k", pa.int64())])) for k in ([1, 1, 2], [2, 2], [3, None])]
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batches[0].schema) as out:
        for b in batches:
            out.write_batch(b)
    done = subprocess.run([sys.executable, "-c", code], cwd=corpus_pipeline.__file__.rpartition("/")[0], input=sink.getvalue(), capture_output=True, check=True)
    assert done.stdout.decode().strip() == "[[1, 1], [2, 2, 2, 3], [None]]"  # whole runs, several at a time


# --- 7


def test_pieces_equal_the_library_and_come_back(spark, odd, none):
    import sentencepiece

    model = pieces.default_model()
    library, own = sentencepiece.SentencePieceProcessor(model_file=model), pieces.PieceCodec(model, entries=100)
    rng = random.Random(6)
    alphabet = "abcdeéüñ \t\n,. 中文字🔥éthe ing  0123𝔘"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["hello  world", " lead", "trail ", "\n\n"]
    for t in texts:
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t) and own.decode(ids) == t
    for t in ("▁", "a▁b ▁ c", "▁▁ x"):
        assert own.decode(own.encode(t)) == t
    rows = {r.doc_id: r for r in pieces.digests(odd, model).collect()}
    for r in odd.where("doc_id <> 6 and doc_id is not null").collect():
        assert rows[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() and rows[r.doc_id].n_chars == len(r.text or "")
    assert pieces.digests(odd, model).count() == odd.count() and pieces.digests(none, model).count() == 0


def test_unigram_viterbi_against_all_segmentations():
    import ahocorasick

    rng = random.Random(8)
    codec = object.__new__(pieces.PieceCodec)
    names = ["a", "b", "ab", "ba", "aab", "bb", "abab", "c"]
    codec.kind, codec.pieces = pieces.UNIGRAM, names
    codec.scores = [-rng.random() * 5 for _ in names]
    codec.ids = {p: i for i, p in enumerate(names)}
    codec.unknown = min(codec.scores) - 10
    codec.automaton = ahocorasick.Automaton()
    for p, i in codec.ids.items():
        codec.automaton.add_word(p, (len(p), i))
    codec.automaton.make_automaton()

    def best(text):
        if not text:
            return 0.0
        return max((codec.scores[i] + best(text[len(p) :]) for p, i in codec.ids.items() if text.startswith(p)), default=-1e9)

    for _ in range(200):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        ids = codec._segment(text)
        assert "".join(names[i] for i in ids) == text and abs(sum(codec.scores[i] for i in ids) - best(text)) < 1e-9


# --- 8


def test_chat(spark):
    nasty = ["", "plain", "</s>[INST] ok [/INST]", "<|end|><|start|>", "\\", "\\\\<|", "<\\|", "[\\INST]", "<<<SYS>>>", "<|" * 5, "a\nb", "<", "|>", "[/INST", "é🔥</s", None]
    rng = random.Random(9)
    rows = [(k, n, rng.choice(["user", "assistant", "assistant", "system", "<|x", None]), rng.choice(nasty)) for k in range(60) for n in range(rng.randint(1, 9))]
    rows += [(9, 50, "assistant", "a long </s> text of <| many words " * 5000), (9, 51, "user", "")]  # 35,000 words
    rows += [(7, 1, "user", "same turn"), (7, 1, "user", "same turn"), (7, None, "user", "null turn"), (None, 0, "assistant", "no conversation")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("turns", F.lit(2))
    made = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    by = collections.defaultdict(list)
    for k, n, role, text in rows:
        by[k].append(((n is not None, n), role or "", text or ""))
    for k, turns in by.items():
        turns = [(a, b) for _, a, b in sorted(turns)]
        loss = "".join(b for a, b in turns if a == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == want
    for r in made.collect():
        blocks = r.formatted.count(chat.START)
        runs = [a for a, _ in itertools.groupby([x[1] for x in sorted(by[r.conv_id])])]
        assert blocks == len(runs) == r.formatted.count(chat.END) and not re.search(r"</s>|\[/?INST\]", r.formatted)
    assert chat.format_conversations(df.where("conv_id < 0")).count() == 0
    plan = made._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# --- 9


def test_metrics_against_brute_force(spark, docs, odd):
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        got = collections.Counter(tuple(r) for r in rules.metrics(df.select("doc_id", "text"), "doc_id").collect())
        want = collections.Counter()
        for r in rows:
            text = r.text or ""
            words = re.findall("[^\x20\x09-\x0d]+", text)
            windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
            covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
            lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
            want[r.doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)] += 1
        assert got == want


def test_adaptive_thresholds(spark, none):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows = []
    for k in range(600):  # two languages, one of longer words; one document of each kind is out of line
        lang = "de" if k % 2 else "en"
        size = 9 if lang == "de" else 4
        rows.append((k, " ".join(word(rng.randint(size - 1, size + 1)) for _ in range(80)), lang, f"src{k % 5}", 0))
    rows += [(1000, " ".join(word(9) for _ in range(80)), "en", "src0", 0), (1001, " ".join(word(4) + "##" for _ in range(80)), "en", "src1", 0), (1002, "\n".join(["same line"] * 9 + [" ".join(word(4) for _ in range(5)) for _ in range(8)]), "en", "src1", 0)]
    rows += [(1010, "\n".join(["same line"] * 2 + [" ".join(word(4) for _ in range(5)) for _ in range(16)]), "en", "src1", 0)]  # the least of its kind
    rows += [(1003, "too short", None, None, 0), (1004, " ".join(["a b c"] * 40), "en", "src0", 0), (1005, None, "en", "src0", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in rules.judge(df).collect()}
    assert all(got[k].kept for k in range(600))
    assert [got[k].kept for k in (1000, 1001, 1002, 1003, 1004, 1005)] == [False] * 6
    assert [got[k].base_failed for k in (1000, 1001, 1003, 1004, 1005)] == [False, False, True, True, True]
    assert sorted(r.doc_id for r in rules.keep_good(df).collect()) == [*range(600), 1010]
    assert rules.judge(none).count() == 0 and rules.keep_good(none).count() == 0
    again = {r.doc_id: r.kept for r in rules.judge(df.withColumn("text", F.regexp_replace("text", "a", "aa"))).collect()}
    assert [again[k] for k in (1000, 1001)] == [False] * 2 and all(again[k] for k in range(600))  # limits move with the data
    plan = rules.metrics(df, "doc_id")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def sketched(spark, values):
    """Groups as sketches() makes them, of (source, value) for every feature; words have a length."""
    rows = spark.createDataFrame([("en", g, *[float(x) if f in rules.SHARES else float(x) or 1.0 for f in rules.FEATURES]) for g, x in values], ["lang", "source", *rules.FEATURES])
    cols = [F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(f, 4096).alias(f) for f in rules.FEATURES]]
    for f in rules.SHARES:
        some = F.when(F.col(f) > 0, F.col(f))
        cols += [F.count(some).alias(f"n_{f}"), F.kll_sketch_agg_double(some, 4096).alias(f"some_{f}")]
    return common.materialize(rows.groupBy("lang", "source").agg(*cols), "g")


def test_every_threshold_follows_the_data(spark):
    """Groups of other shares have other limits, in proportion: no constant is in them."""
    shares = [(g, x * scale) for g, scale in (("a", 1.0), ("b", 3.0)) for x in np.random.default_rng(4).uniform(0.01, 0.02, 600).tolist()]
    a, b = sorted(rules.thresholds(sketched(spark, shares)).collect(), key=lambda r: r.source)
    assert all(abs(b[c] / a[c] - 3) < 1e-9 for f in rules.FEATURES for c in (f"low_{f}", f"high_{f}") if a[c] is not None)
    assert all(a[f"low_{f}"] is None and 0.01 <= a[f"high_{f}"] <= 0.02 for f in rules.SHARES)
    # where hardly any have some, the limit is low among those that have; the one of a group alone makes no limit there
    few = [("a", 0.0)] * 980 + [("a", 0.3 + k / 1000) for k in range(20)] + [("b", 0.0)] * 999 + [("b", 0.5)] + [("c", 0.0)] * 50
    a, b, c = sorted(rules.thresholds(sketched(spark, few)).collect(), key=lambda r: r.source)
    assert a.high_symbol_share == 0.3 and b.high_symbol_share == c.high_symbol_share == 0.301
    none = rules.thresholds(sketched(spark, [("a", 0.0)] * 600)).first()
    assert all(none[f"high_{f}"] is None for f in rules.SHARES)


def test_each_rule_rejects_labelled_bad_documents(spark):
    """On the labels of sf0.1, on which the parts in FEATURES were chosen, each rule rejects bad documents; on those of odd doc_id all
    together reject most of them, and hardly any good one."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    measured = common.materialize(rules.metrics(docs, "doc_id", "lang", "source"), "m")
    limits = rules.thresholds(common.materialize(rules.sketches(measured), "s"))
    values = measured.where(~rules.base_failed()).join(labels, "doc_id").join(limits.withColumnsRenamed({"lang": "l", "source": "s"}), F.expr("lang = l and source = s"))
    over = [F.coalesce(F.expr(e) > F.col(f"high_{f}"), F.lit(False)).alias(f"over_{f}") for f, (e, _) in rules.FEATURES.items()]
    read = values.select("doc_id", "quality", *over, *[f"high_{f}" for f in rules.SHARES]).collect()
    assert all(sum(r[f"over_{f}"] for r in read if not r.quality) > 0 for f in rules.FEATURES)
    assert all(0 < r[f"high_{f}"] < 1 for f in rules.SHARES for r in read)
    rejected = lambda q, odd: np.mean([any(r[f"over_{f}"] for f in rules.FEATURES) for r in read if r.quality == q and r.doc_id % 2 == odd])
    assert rejected(0, 1) > 0.9 and rejected(1, 1) < 0.025


def test_sketches_merge(spark, docs):
    """Thresholds of merged group sketches lie within the rank error of the exact quartiles of all."""
    measured = common.materialize(rules.metrics(docs, "doc_id", "lang", "source"), "metrics")
    groups = rules.sketches(measured)
    merged = groups.agg(F.kll_merge_agg_double("mean_word").alias("s")).select(F.kll_sketch_get_quantile_double("s", F.lit(0.25)).alias("q")).first().q
    values = sorted(r.word_chars / r.n_words for r in measured.where(~rules.base_failed()).collect())
    rank = np.searchsorted(values, merged) / len(values)
    assert abs(rank - 0.25) < 0.03


def test_rules_odd_rows(odd):
    assert rules.judge(odd).count() == odd.count()
    kept = rules.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() <= odd.count()


# --- 10


def test_nearest(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(700, 16)) * rng.uniform(0.2, 3, (700, 1))
    v[100:140] = v[100]  # ties
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    rows += [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] + [1.0] * 15), (1060, [None] + [1.0] * 15), (1080, [float("inf")] + [1.0] * 15), (1100, []), (None, [1.0] * 16), (1120, [1.0, 2.0]), (20, v[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("uid", F.lit(2))
    got = collections.defaultdict(list)
    for r in vptree.nearest(df, F.col("vec_id") % 20 == 0, k=20, shard_vectors=150, block_queries=20).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    x = np.vstack((v, v[3])).astype(np.float32).astype(float)
    ids = np.array([*range(700), 20])
    for q in range(0, 700, 20):
        own = np.flatnonzero(ids == q)
        want = []
        for o in own:
            s = np.add.accumulate(x * x[o], 1)[:, -1]
            s[o] = -np.inf
            order = np.lexsort((ids, -s))[:20]
            want += [(k + 1, int(ids[i]), float(s[i])) for k, i in enumerate(order)]
        assert sorted(got[q]) == sorted(want)
    assert set(got) == set(range(0, 700, 20))
    assert vptree.nearest(df.where("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0
    few = vptree.nearest(df.where("vec_id < 5"), F.col("vec_id") == 0).collect()
    assert [r.rank for r in few] == [1, 2, 3, 4]


def test_nearest_of_long_vectors(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(60, 3000))
    got = vptree.nearest(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=3).orderBy("rank").collect()
    want = [int(i) for i in np.argsort(-(v @ v[0])) if i][:3]
    assert [r.vec_id for r in got] == want


def test_relaxed_trees_find_most_and_look_at_less():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 6)) * 4
    v = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 6)) * 0.5
    reach = np.sqrt((v**2).sum(1)).max()
    tree = vptree.Tree(v, reach)
    tree = vptree.Tree.load(tree.parts(), 6, reach)  # as it is written and read
    exact = np.argsort(-(v[:50] @ v.T), 1)[:, :10]
    looked = {}
    for factor in (1.0, 0.5):
        search = vptree._Search
        n = [0]

        class Counting(search):
            def scan(self, lo, hi, who):
                n[0] += len(who) * (hi - lo)
                search.scan(self, lo, hi, who)

        vptree._Search = Counting
        try:
            q, place, _ = tree.search(v[:50], 10, factor, np.full(50, -1), np.arange(4000))
        finally:
            vptree._Search = search
        recall = np.mean([len(set(place[q == k]) & set(exact[k])) / 10 for k in range(50)])
        looked[factor] = n[0]
        assert recall == 1 if factor == 1 else recall >= 0.9
    assert looked[0.5] <= looked[1.0] < 50 * 4000


# --- pipeline and queries


def kept_by_classifier(docs, labels):
    """The classifier in memory, over sorted lists; docs are rows, each with its hash and chance."""
    known = {r.doc_id: r.quality for r in labels}
    rows = sorted(docs, key=lambda r: (r.doc_id not in known, r.h, r.doc_id))
    cells = np.array([cotrain.metadata_cell(r.source, r.lang, len((r.text or "").encode())) for r in rows])
    text, meta = cotrain.split_views(np.array([cotrain.read_views(r.text or "") for r in rows]), cells)
    model = cotrain.train(text, meta, np.array([known.get(r.doc_id, np.nan) for r in rows], float), chance=np.array([r.chance for r in rows]))
    return {r.doc_id for r, score in zip(rows, model.scores(text, meta)[2], strict=True) if score >= 0.5 and (r.text or "").strip()}


def kept_by_rules(docs):
    """The rules by exact quantiles of sorted lists."""
    read = {}
    for r in docs:
        text = r.text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        n = len({j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)})
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        chars, dup, symbols = sum(map(len, words)), len(lines) - len(set(lines)), len(re.findall(r"[#*$%&|<>]", text))
        if len(words) >= 50 and 2 * n <= len(words):
            read[r.doc_id] = (r.lang, r.source), (symbols / chars, chars / len(words), dup / len(lines), n / len(words))

    parts = (0.9, None, 0.99, 0.99)
    quantile = lambda x, q: sorted(x)[max(0, int(np.ceil(q * len(x) - 1e-9)) - 1)]

    def limit(of, k, enough):
        x = [v[k] for _, v in of]
        if parts[k] is None:
            low, high = quantile(x, 0.25), quantile(x, 0.75)
            return low * (low / high) ** 3, high * (high / low) ** 3
        some = [v for v in x if v > 0]
        return 0, quantile(x, parts[k]) or (quantile(some, 0.05) if len(some) >= enough else None)

    kept = set()
    for d, (group, values) in read.items():
        fine = True
        for k in range(4):
            least = 100 if parts[k] is None else max(100, round(5 / (1 - parts[k])))
            own, lang = [x for x in read.values() if x[0] == group], [x for x in read.values() if x[0][0] == group[0]]
            known = [limit(x, k, 20) for x in (own, lang) if len(x) >= least]
            low, high = next((x for x in known if x[1] is not None), limit(list(read.values()), k, 1))
            fine &= high is None or low * (1 - 1e-12) <= values[k] <= high * (1 + 1e-12)
        kept |= {d} if fine else set()
    return kept


def test_pipeline(spark):
    """Each stage's decisions on what the one before kept, against plain versions over lists."""
    sf = "/root/testdata/sf0.001"
    step = docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    chance = (F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 31)) / float(1 << 31)).alias("chance")
    plain = (lambda rows: kept_by_classifier(rows, labels), kept_by_rules, lambda rows: {d for d, c, _ in brute(rows) if d == c})
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], plain, strict=True):
        before = step
        step = common.materialize(stage(spark, step, sf), name)
        assert step.columns == docs.columns and 0 < step.count() < before.count()
        assert {r.doc_id for r in step.collect()} == want(before.select("*", F.xxhash64("doc_id", F.lit(17)).alias("h"), chance).collect()), name
    rows = corpus_pipeline.run(spark, sf).collect()
    texts = step.select("doc_id", "text").collect()
    assert collections.Counter((r.doc_id, r.length) for r in rows) == collections.Counter((r.doc_id, min(4096, n - s)) for r, ids in zip(texts, encoded([r.text for r in texts]), strict=True) for n in [len(ids) // 4] for s in range(0, n, 4096))
    assert check_packing(rows, 4096) <= packing.lower_bound(np.array([r.length for r in rows]), 4096) + 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_duplicates", "best_fit_packing"]


def test_pipeline_odd_rows(spark, odd, none):
    for start in (odd, none):
        step = start
        for name, stage in corpus_pipeline.STAGES:
            step = common.materialize(stage(spark, step, SF).select("*"), name)
        assert step.count() >= 0


def test_every_operator_has_its_query():
    assert [int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES] == list(range(1, 11)) and set(queries.ORACLE) <= set(queries.QUERIES)
