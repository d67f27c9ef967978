"""Quality classifier by co-training: a text view and a metadata view teach each other, then score every document."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphsieve.llm.common import discard, materialize, sized, texts_of, tidy

SOURCE_SLOTS, LANG_SLOTS, LENGTH_SLOTS = 64, 16, 16
GRAM_SLOTS = 64  # for words, pairs of words and runs of three bytes each
LAYOUT = 6
_LINE = re.compile(rb"[^\n]*[^\s][^\n]*")


def read_views(text: str) -> np.ndarray:
    """The text view of a whole text, then the LAYOUT numbers that belong to its metadata; rounded to half precision, as they are stored.

    Text view: shares of hashed words, pairs of words and runs of three bytes, of single punctuation marks, of capitals among letters,
    repeated words and the mean word. Nothing in it tells the text's length.
    Layout: shares of capitals, digits, bytes beyond ASCII, white space and marks, and of lines that repeat.
    """
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    codes = np.frombuffer(raw, np.uint8)
    seen = np.bincount(codes, minlength=256)
    upper, lower, digits = seen[65:91].sum(), seen[97:123].sum(), seen[48:58].sum()
    high, space = seen[128:].sum(), seen[32] + seen[9:14].sum()
    marks = np.concatenate((seen[33:48], seen[58:65], seen[91:97], seen[123:127]))
    words = raw.split()
    lines = _LINE.findall(raw)
    m, k = max(1, len(words)), max(1, len(lines))
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    shape = [upper / max(1, upper + lower), 1 - len(set(words)) / m, repeats / m, np.log1p(n / m)]
    slots = lambda h: np.bincount(h >> np.uint32(26), minlength=GRAM_SLOTS)
    wide, own = codes.astype(np.uint32), np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    a, b, c = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
    grams = np.concatenate((slots(own * a) / m, slots(own[:-1] * b + own[1:] * c) / m, slots(wide[:-2] * a + wide[1:-1] * b + wide[2:] * c) / n))
    layout = [upper / n, digits / n, high / n, space / n, marks.sum() / n, 1 - len(set(lines)) / k]
    return np.concatenate((shape, np.sqrt(marks / n), np.sqrt(grams), layout)).astype(np.float16)


def metadata_cell(source: str | None, lang: str | None, n_bytes: int) -> int:
    """Source and language, hashed to slots, and the size's power of two, as one number."""
    slot = lambda x, n: zlib.crc32(b"\0" if x is None else x.encode("utf-8", "surrogatepass")) % n
    return (slot(source, SOURCE_SLOTS) * LANG_SLOTS + slot(lang, LANG_SLOTS)) * LENGTH_SLOTS + min(LENGTH_SLOTS - 1, int(np.log2(n_bytes + 1)))


def split_views(read: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text views and metadata views of rows of read_views and metadata_cell; a cell is a one in each of its three slots."""
    slots, rows = np.zeros((len(cells), SOURCE_SLOTS + LANG_SLOTS + LENGTH_SLOTS)), np.arange(len(cells))
    slots[rows, cells // (LANG_SLOTS * LENGTH_SLOTS)] = 1
    slots[rows, SOURCE_SLOTS + cells // LENGTH_SLOTS % LANG_SLOTS] = 1
    slots[rows, SOURCE_SLOTS + LANG_SLOTS + cells % LENGTH_SLOTS] = 1
    read = read.astype(np.float64)
    return read[:, :-LAYOUT], np.hstack((slots, read[:, -LAYOUT:]))


def _newton(x: np.ndarray, y: np.ndarray, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Curvature and slope of the loss at w, summed over rows; flat, the slope last."""
    z = np.hstack((np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))))
    p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
    return np.concatenate((((z * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ z).ravel(), z.T @ (p - y)))


def _moments(x: np.ndarray) -> np.ndarray:
    return np.concatenate(([len(x)], x.sum(0), (x * x).sum(0)))


@dataclass
class Logistic:
    """Logistic regression with an L2 penalty, on standardised features, by Newton's method."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]


#: Newton steps of a round over the rows without a label: they start from the weights of the round before, which are near. With a pass that
#: finds the surest rows and one for moments, a round is three passes.
STEPS = 1


@dataclass
class Task:
    """What a logistic regression is fitted on: rows at hand, and sums over rows elsewhere, which all together count as these do, and half
    each at most."""

    x: np.ndarray
    y: np.ndarray
    penalty: float
    more: Taught | None = None
    start: np.ndarray | None = None


def fit_views(tasks: list[Task], steps: int = 30) -> list[Logistic]:
    """A logistic regression for each task. Those with rows elsewhere share each pass over them: one for the moments, one a step."""
    away = [t for t in tasks if t.more]
    width = [t.x.shape[1] + 1 for t in away]
    sums = iter(_together(away[0].more.pool, [t.more.moments_of for t in away], [2 * k - 1 for k in width]) if away else ())
    fitted: list[tuple[Task, np.ndarray, np.ndarray, np.ndarray, float]] = []
    for t in tasks:
        own, k, share = _moments(t.x), t.x.shape[1], 0.0
        if t.more:
            others = next(sums)
            share = min(HALF, len(t.x) / max(1.0, others[0]))
            own = own + share * others
        mean = own[1 : k + 1] / own[0]
        scale = np.maximum(np.sqrt(np.maximum(own[k + 1 :] / own[0] - mean * mean, 0)), 1e-3)
        fitted.append((t, mean, scale, np.zeros(k + 1) if t.start is None else t.start, share))
    for _ in range(steps):
        each = [partial(t.more.newton_of, mean=mean, scale=scale, w=w) for t, mean, scale, w, _ in fitted if t.more]
        sums = iter(_together(away[0].more.pool, each, [k * k + k for k in width]) if away else ())
        most = 0.0
        for n, (t, mean, scale, w, share) in enumerate(fitted):
            ridge = np.full(len(w), t.penalty)
            ridge[-1] = 1e-6
            own = _newton(t.x, t.y, mean, scale, w) + (share * next(sums) if t.more else 0)
            step = np.linalg.solve(own[: -len(w)].reshape(len(w), len(w)) + np.diag(ridge), own[-len(w) :] + ridge * w)
            fitted[n] = t, mean, scale, w - step, share
            most = max(most, np.abs(step).max())
        if most < 1e-4:
            break
    return [Logistic(mean, scale, w) for _, mean, scale, w, _ in fitted]


@dataclass
class CoTrained:
    """Both views' classifiers, each with the Platt scaling of its held-out logits, and the weights that combine them."""

    text: Logistic | None
    meta: Logistic | None
    platt: tuple[np.ndarray, np.ndarray]
    blend: np.ndarray

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated chance of good quality by text, by metadata, and by both."""
        if self.text is None:
            return (np.ones(len(text)),) * 3
        logits = [view.logit(x) * s[0] + s[1] for view, x, s in ((self.text, text, self.platt[0]), (self.meta, meta, self.platt[1]))]
        sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
        both = np.stack([*logits, np.ones(len(text))], 1) @ self.blend
        return sigmoid(logits[0]), sigmoid(logits[1]), sigmoid(both)


def _calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression on a few raw logits, with softened labels."""
    soft = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    z, w = np.hstack((np.clip(x, -20, 20), np.ones((len(x), 1)))), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(z.shape[1]), z.T @ (p - soft) + 1e-3 * w)
        w = w - np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


BINS = 4096
HALF = 0.5  # most that a pseudo-label counts


@dataclass
class Lesson:
    """What a view passes to the other in a round: of the rows that it has not passed before and of which the other is not sure the other
    way, those it is surest of on either side.

    A cut is a bin of sureness and the share of that bin that is passed with all above.
    """

    model: Logistic
    platt: np.ndarray
    least: float  # logit of the chance to be passed
    teaches: bool = True
    cuts: tuple[tuple[int, float], tuple[int, float]] = ((0, 1.0), (0, 1.0))  # bad, good

    def sureness(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Side of each row (1 good) and its bin; the bin is -1 where the row is not sure enough."""
        logit = np.clip(self.model.logit(x) * self.platt[0] + self.platt[1], -30, 30)
        over = (np.abs(logit) - self.least) / (30 - self.least)
        return (logit > 0).astype(int), np.where(over > 0, np.minimum(over * BINS, BINS - 1), -1).astype(int)


Round = tuple[Lesson, Lesson]  # of the text view and of the metadata view


@dataclass
class Rows:
    """Rows without a label: both views, and a number in [0, 1) of each row that breaks ties."""

    views: tuple[np.ndarray, np.ndarray]
    chance: np.ndarray

    def offered(self, v: int, of: Round) -> tuple[np.ndarray, np.ndarray]:
        """Side and bin by view v in a round; the bin is -1 where it is not sure, or the other view is sure of the other side."""
        (side, level), (other, sure) = (of[u].sureness(self.views[u]) for u in (v, 1 - v))
        return side, np.where((sure >= 0) & (other != side), -1, level)

    def passed(self, v: int, rounds: list[Round]) -> np.ndarray:
        """The label that view v gave each row in the first round that passed it, else nan."""
        out = np.full(len(self.chance), np.nan)
        for r in rounds:
            if r[v].teaches:
                side, level = self.offered(v, r)
                bins, shares = np.array([c[0] for c in r[v].cuts])[side], np.array([c[1] for c in r[v].cuts])[side]
                out = np.where(np.isnan(out) & (level >= 0) & ((level > bins) | (level == bins) & (self.chance < shares)), side, out)
        return out

    def levels(self, rounds: list[Round], asked: Round) -> np.ndarray:
        """For each view and side the number of rows in each bin, of those that the view has not passed yet."""
        out = np.zeros((2, 2, BINS))
        for v in (0, 1):
            if asked[v].teaches:
                side, level = self.offered(v, asked)
                new = np.isnan(self.passed(v, rounds)) & (level >= 0)
                out[v] = np.bincount(side[new] * BINS + level[new], minlength=2 * BINS).reshape(2, BINS)
        return out.ravel()

    def learnt(self, v: int, rounds: list[Round]) -> tuple[np.ndarray, np.ndarray]:
        """View v of the rows that the other view passed, and their labels."""
        y = self.passed(1 - v, rounds)
        return self.views[v][~np.isnan(y)], y[~np.isnan(y)]


class Pool:
    """All rows without a label, in memory."""

    def __init__(self, rows: Rows):
        self.rows, self.size = rows, len(rows.chance)

    def total(self, of: Callable[[Rows], np.ndarray]) -> np.ndarray:
        return of(self.rows)


class TablePool(Pool):
    """All rows without a label, in a table (view, cell, chance): each task adds up its rows, and of many tasks a few add up the sums."""

    def __init__(self, table: DataFrame):
        self.table, self.size, self.parts = table, table.count(), table.rdd.getNumPartitions()

    def total(self, of: Callable[[Rows], np.ndarray]) -> np.ndarray:
        def added(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
            sums = sum(parts, 0.0)
            if isinstance(sums, np.ndarray):
                yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

        def rows(b: pa.RecordBatch) -> np.ndarray:
            read = np.frombuffer(b"".join(b.column("view").to_pylist()), np.float16).reshape(b.num_rows, -1)
            return of(Rows(split_views(read, b.column("cell").to_numpy()), b.column("chance").to_numpy()))

        some = self.table.mapInArrow(lambda batches: added(rows(b) for b in batches if b.num_rows), "sums binary")
        if self.parts > 64:
            some = some.repartition(math.isqrt(self.parts)).mapInArrow(lambda batches: added(np.frombuffer(x) for b in batches for x in b.column(0).to_pylist()), "sums binary")
        return sum(np.frombuffer(r.sums) for r in some.collect())


@dataclass
class Taught:
    """Sums over view v of the rows of a pool that the other view passed."""

    pool: Pool
    v: int
    rounds: list[Round]

    def __getstate__(self) -> dict:  # tasks get what to sum, not the table
        return {"pool": None, "v": self.v, "rounds": self.rounds}

    def moments_of(self, rows: Rows) -> np.ndarray:
        return _moments(rows.learnt(self.v, self.rounds)[0])

    def newton_of(self, rows: Rows, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> np.ndarray:
        return _newton(*rows.learnt(self.v, self.rounds), mean, scale, w)


def _together(pool: Pool, sums: list[Callable[[Rows], np.ndarray]], sizes: list[int]) -> list[np.ndarray]:
    """Several sums of known sizes over the rows of a pool, in one pass."""
    return np.split(pool.total(lambda rows: np.concatenate([f(rows) for f in sums])), np.cumsum(sizes)[:-1])


def _cut(counts: np.ndarray, most: int) -> tuple[int, float]:
    """The bin, and the share of it, that leaves most rows of a histogram at and above it; all if there are no more."""
    above = np.cumsum(counts[::-1])[::-1]
    if above[0] <= most:
        return 0, 1.0
    k = int(np.flatnonzero(above >= most)[-1])
    return k, float((most - above[k] + counts[k]) / counts[k])


def _loss(logit: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y > 0.5, -logit, logit)).mean())


PENALTY = (5.0, 10.0)
LEAST_HELD = 10  # held-out rows without which no lesson can be judged, so that none is given


def train(text: np.ndarray, meta: np.ndarray, label: np.ndarray, rounds: int = 4, confident: float = 0.97, share: float = 0.1, trust: float = 0.5, pool: Pool | None = None, chance: np.ndarray | None = None) -> CoTrained:
    """Co-train on rows in a fixed order; label is 1, 0 or nan (no label). Rows without a label are those of pool, if there is one.

    A fifth of the labelled rows of each kind is held out for calibration only. In each round both views are fitted and calibrated;
    each passes the rows without a label of which it is surest (chance over confident either way, at most share of
    them in a round and in the labels' own proportion) to the other as pseudo-labels, which together count as much as the labels at
    most. A view teaches only while its loss on held-out rows is under trust times that of knowing the labels' proportion alone. A lesson
    that doesn't lower the other's loss there is undone, so each view ends as it was in its best round; a round without a lesson is the last, and with fewer than LEAST_HELD rows held out there is none.
    Rows that are equally sure at the cut are told apart by chance, a number in [0, 1) of each row.
    """
    known = np.flatnonzero(~np.isnan(label))
    held = np.concatenate([known[label[known] == kind][::5] for kind in (0, 1)])
    seed = np.setdiff1d(known, held)
    if len(known) < 20 or any(len(np.unique(label[part])) < 2 for part in (held, seed)):
        return CoTrained(None, None, (np.array([1, 0]), np.array([1, 0])), np.array([1, 0, 0]))
    views = (text, meta)
    if pool is None:
        free = np.flatnonzero(np.isnan(label))
        ties = np.arange(len(label)) * 0.6180339887498949 % 1 if chance is None else chance
        pool = Pool(Rows((text[free], meta[free]), ties[free]))
    prior = float(label[known].mean())
    blind = _loss(np.full(len(held), np.log(prior / (1 - prior))), label[held])
    done: list[Round] = []
    fitted: list[tuple[Logistic, np.ndarray] | None] = [None, None]

    def fit(*vs: int) -> list[tuple[Logistic, np.ndarray]]:
        taught = lambda v: Taught(pool, v, done) if any(r[1 - v].teaches for r in done) else None
        models = fit_views([Task(views[v][seed], label[seed], PENALTY[v], taught(v), fitted[v][0].weights if fitted[v] else None) for v in vs], STEPS if done else 30)
        return [(m, _calibrate(m.logit(views[v][held])[:, None], label[held])) for v, m in zip(vs, models, strict=True)]

    def loss(v: int, f: tuple[Logistic, np.ndarray]) -> float:
        return _loss(np.clip(f[0].logit(views[v][held]) * f[1][0] + f[1][1], -30, 30), label[held])

    fitted = fit(0, 1)
    least = [loss(v, f) for v, f in enumerate(fitted)]
    for _ in range(rounds if pool.size and len(held) >= LEAST_HELD else 0):
        asked: Round = tuple(Lesson(m, a, float(np.log(confident / (1 - confident))), bool(a[0] > 0 and loss(v, (m, a)) < trust * blind)) for v, (m, a) in enumerate(fitted))
        if not any(x.teaches for x in asked):
            break
        levels = pool.total(lambda rows: rows.levels(done, asked)).reshape(2, 2, BINS)  # noqa: B023
        if not levels.any():
            break
        most = max(1, int(share * pool.size))
        for v in (0, 1):
            asked[v].cuts = tuple(_cut(levels[v][side], max(1, round(most * part))) for side, part in ((0, 1 - prior), (1, prior)))
        done.append(asked)
        learners = [v for v in (0, 1) if asked[1 - v].teaches]
        for v, model in zip(learners, fit(*learners), strict=True):
            now = loss(v, model)
            asked[1 - v].teaches = now < least[v]
            if now < least[v]:
                fitted[v], least[v] = model, now
        if not any(x.teaches for x in asked):
            break
    (text_model, a), (meta_model, b) = fitted
    logits = np.stack((text_model.logit(text[held]) * a[0] + a[1], meta_model.logit(meta[held]) * b[0] + b[1]), 1)
    return CoTrained(text_model, meta_model, (a, b), _calibrate(logits, label[held]))


def _views(docs: DataFrame) -> DataFrame:
    """key, label, view (of both kinds) and metadata cell of each row of docs (key, label, text, lang, source)."""

    def view(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column("text"))
            v = [read_views(t).tobytes() for t in texts]
            m = [metadata_cell(s, g, len(t.encode("utf-8", "surrogatepass"))) for s, g, t in zip(b.column("source").to_pylist(), b.column("lang").to_pylist(), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("label"), pa.array(v, pa.binary()), pa.array(m, pa.int32())], ["key", "label", "view", "cell"])
            tidy()

    return docs.mapInArrow(view, "key long, label double, view binary, cell int")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 3000, **options: float) -> CoTrained:
    """Train on at most max_labelled labelled documents, the first by a hash of doc_id, and on all rows without a label.

    Views of the rows without a label are written once; every round passes over all of them. What reaches the driver are
    the labelled documents' views, and sums of bounded size from a few tasks. Labels that disagree
    on a doc_id count as their rounded mean; with under 20 labels, or one kind alone, nothing is learned and every score is 1.
    """
    spark = docs.sparkSession
    agreed = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.round(F.avg("quality")).cast("double").alias("label"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("key"), "text", "lang", "source").where("key is not null")
    seed = keyed.select("key").distinct().join(agreed, "key").orderBy(F.xxhash64("key", F.lit(17)), "key").limit(max_labelled).collect()
    asked = spark.createDataFrame([(r.key, r.label) for r in seed], "key long, label double")
    rows = keyed.join(F.broadcast(asked), "key")  # bounded by max_labelled
    one = F.min(F.struct("view", "cell", "label")).alias("x")  # of rows that share a labelled doc_id one is read
    found = {r.key: r.x for r in _views(rows.select("key", "label", "text", "lang", "source")).groupBy("key").agg(one).collect()}
    order = [found[r.key] for r in seed]
    if len(order) < 20:
        return train(np.zeros((0, 1)), np.zeros((0, 1)), np.zeros(0))
    views = _views(keyed.select("key", F.lit(None).cast("double").alias("label"), "text", "lang", "source"))
    chance = (F.pmod(F.xxhash64("key", F.lit(29)), F.lit(1 << 31)) / F.lit(float(1 << 31))).alias("chance")
    free = materialize(views.join(sized(agreed.select("key"), 16), "key", "left_anti").select("view", "cell", chance), "views")
    text, meta = split_views(np.array([np.frombuffer(r.view, np.float16) for r in order]), np.array([r.cell for r in order]))
    model = train(text, meta, np.array([r.label for r in order]), pool=TablePool(free), **options)
    discard(free)
    return model


SCORED = "score double, text_score double, meta_score double"


def _scored(docs: DataFrame, model: CoTrained, carry: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred weights
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in carry] + [f"__{c}" for c in SCORED.split(", ")])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column("__text"))
            read = np.array([read_views(t) for t in texts], np.float16).reshape(len(texts), -1)
            cells = np.array([metadata_cell(s, g, len(t.encode("utf-8", "surrogatepass"))) for s, g, t in zip(b.column("__source").to_pylist(), b.column("__lang").to_pylist(), texts, strict=True)], int)
            some, meta, both = shared.value.scores(*split_views(read, cells))
            wordless = np.array([not t.strip() for t in texts], bool)
            both = np.where(wordless, 0.0, both)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carry], pa.array(both), pa.array(some), pa.array(meta)], [*carry, *[f"__{c.split()[0]}" for c in SCORED.split(", ")]])
            tidy()

    return docs.select(*carry, F.col("text").alias("__text"), F.col("lang").alias("__lang"), F.col("source").alias("__source")).mapInArrow(score, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options: float) -> DataFrame:
    """doc_id, score, text_score, meta_score, kept of every row of docs (doc_id, text, lang, source).

    kept says whether the combined, calibrated chance of good quality reaches threshold.
    Nulls: a null text is empty; a text without words scores 0 and is not kept; null lang or source are a value like
    others; a null doc_id is scored, but never trains. Repeated rows are scored each. A text of any length is read whole, in one
    worker. An empty table gives no rows,
    a label table too small to learn from keeps every text that has words. Other columns are not read.
    """
    scored = _scored(docs.select("doc_id", "text", "lang", "source"), fit(docs, labels, **options), ["doc_id"])
    return scored.select("doc_id", F.col("__score").alias("score"), F.col("__text_score").alias("text_score"), F.col("__meta_score").alias("meta_score"), (F.col("__score") >= threshold).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options: float) -> DataFrame:
    """The rows of docs, columns unchanged, whose doc_id classify() rejects in no row. Rows of null doc_id share one verdict."""
    rejected = materialize(classify(docs, labels, threshold, **options).where("not kept").select(F.col("doc_id").alias("__rejected")).distinct(), "rejected")
    return docs.join(sized(rejected, 16), docs["doc_id"].eqNullSafe(rejected["__rejected"]), "left_anti")
