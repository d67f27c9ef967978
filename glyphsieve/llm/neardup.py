"""N-gram Jaccard join: MinHash values compared bit by bit under a Bayesian test, what is left verified exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphsieve.llm.common import connected_components, discard, map_runs, materialize, sized, texts_of, tidy

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4  # a pair at similarity 0.8 shares no band with a chance of 3 in a million
LOOK = 16  # MinHash values compared between two looks at the posterior
TOLERANCE = 1e-5
BUCKET = 256  # members of a bucket that one task compares; larger buckets are compared in pairs of blocks
CLUSTER = 512  # the same for candidate clusters, whose shingle sets are compared exactly

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept and doubled as texts ask for more."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, n.bit_length())
        _POWERS[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64)))) for b in (_BASE, _UNBASE)]
    return _POWERS[0], _POWERS[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of that many words between white space; of a shorter text, its words as one run.

    A run's hash comes from prefix sums over the bytes of the words joined by one space, so no word is handled alone.
    """
    raw = np.frombuffer(b" ".join(text.encode("utf-8", "surrogatepass").split()), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    power, unpower = _powers(len(raw) + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)])))
    gaps = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(raw)]))
    n = max(1, len(starts) - words + 1)
    starts, ends = starts[:n], ends[-n:]
    return np.unique(_mix((sums[ends] - sums[starts]) * unpower[starts] + (ends - starts).astype(np.uint64)))


_SEEDS = [_mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))[i::2] for i in (0, 1)]


def minhashes(hashes: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima, each the high half of a multiply-add of the 64-bit hashes."""
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    a, b = _SEEDS[0] | np.uint64(1), _SEEDS[1]
    for at in range(0, len(hashes), 512):
        np.minimum(out, (hashes[at : at + 512, None] * a + b).min(0), out)
    return (out >> np.uint64(32)).astype(np.uint32)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For LOOK, 2 LOOK, ... values compared: the fewest matches with which a pair goes on.

    With a uniform prior, m matches of n make the similarity Beta(m+1, n-m+1); the posterior chance that it reaches
    the threshold is that of at most m successes in n+1 throws at the threshold.
    """
    out = []
    for n in range(LOOK, BANDS * ROWS + 1, LOOK):
        chance, m = 0.0, -1
        while chance < tolerance:
            m += 1
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _fingerprint(h: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set of hashes, as two signed integers."""
    pair = np.array([_mix(h).sum(dtype=np.uint64), _mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)], np.uint64)
    return tuple(pair.view(np.int64).tolist())


SIGNED = "uid long, doc_id long, set_a long, set_b long, n_shingles long, bands array<long>, signature binary"


def signed(docs: DataFrame) -> DataFrame:
    """For each row: a 128-bit fingerprint of its shingle set, band keys, and the low 16 bits of its MinHash values."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        lanes = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                fps, sizes, keys, sigs = [], [], [], []
                for text in texts_of(some.column(1)):
                    h = shingles(text)
                    sizes.append(len(h))
                    fps.append(_fingerprint(h))
                    if not len(h):
                        keys.append(None)
                        sigs.append(None)
                        continue
                    m = minhashes(h)
                    rows = m.reshape(BANDS, ROWS).astype(np.uint64)
                    key = lanes.copy()
                    for r in range(ROWS):
                        key = _mix(key * np.uint64(31) + rows[:, r])
                    keys.append(key.view(np.int64))
                    sigs.append(m.astype("<u2").tobytes())
                fps, n = np.array(fps, np.int64).reshape(-1, 2), len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(uid, uid + n)), some.column(0), pa.array(fps[:, 0]), pa.array(fps[:, 1]), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                    [c.split()[0] for c in SIGNED.split(", ")],
                )
                uid += n
            tidy()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, SIGNED)


def _settle(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component among n, given edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(label, before):
            return label


def _dealt(members: DataFrame, node: str, size: int, count: str) -> DataFrame:
    """members with block and blocks: a group of up to size members (count has how many) is one block; a larger one is dealt
    by a hash of the node."""
    blocks = F.ceil(F.col(count) / size).cast("int")
    return members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(node), F.col("blocks")).cast("int")).drop(count)


def _paired(members: DataFrame) -> DataFrame:
    """members with i, j in place of blocks: one row for each pair of blocks that holds its block, so every two members meet."""
    own = F.col("block")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    kept = [c for c in members.columns if c != "blocks"]
    return members.select(*kept, F.explode(pairs).alias("__p")).select(*kept, F.col("__p.i").alias("i"), F.col("__p.j").alias("j"))


def _candidates(reps: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(a, b) edges that join representatives into candidate clusters: each bucket's pairs that survive the Bayesian
    test, reduced to a star for each of the bucket's components. No list of pairs leaves a task.

    Near copies share many bands, whose buckets often hold the same members: of each set of members one bucket is compared, told by
    their number and two sums without carry of their hashes, which are added up before anything is shuffled."""
    keyed = reps.select("rep", F.explode("bands").alias("bucket"))
    sums = [F.bit_xor(F.xxhash64("rep", F.lit(k))).alias(f"sum_{k}") for k in (0, 1)]
    held = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *sums).where("n > 1")
    chosen = materialize(held.groupBy("n", "sum_0", "sum_1").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "chosen")
    shared = keyed.join(sized(chosen, 24), "bucket")
    buckets = materialize(_paired(_dealt(shared, "rep", BUCKET, "n")), "buckets")
    members = buckets.join(reps.select("rep", "signature"), "rep")
    need = least_matches(threshold, tolerance)

    def compare(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            keys = np.stack([t.column(c).to_numpy() for c in ("bucket", "i", "j")])
            rep, block = t.column("rep").to_numpy(), t.column("block").to_numpy()
            sig = np.frombuffer(b"".join(t.column("signature").to_pylist()), "<u2").reshape(-1, BANDS * ROWS)
            if len(rep) < 2:
                continue
            group = np.concatenate(([0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(0))))
            mixed = keys[1] != keys[2]
            found: list[tuple[np.ndarray, np.ndarray]] = []
            active, shift = np.arange(len(rep)), 0
            while True:
                shift += 1
                active = active[active + shift < len(rep)]
                active = active[group[active] == group[active + shift]]
                if not len(active):
                    break
                a, b = active, active + shift
                other = ~mixed[a] | (block[a] != block[b])
                a, b = a[other], b[other]
                matches = np.zeros(len(a), np.int64)
                for k, least in enumerate(need):
                    part = slice(k * LOOK, (k + 1) * LOOK)
                    matches += (sig[a, part] == sig[b, part]).sum(1)
                    alive = matches >= least
                    a, b, matches = a[alive], b[alive], matches[alive]
                    if not len(a):
                        break
                if len(a):
                    found.append((a, b))
            if found:
                root = _settle(len(rep), np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
                moved = np.flatnonzero(root != np.arange(len(rep)))
                yield pa.RecordBatch.from_arrays([pa.array(rep[root[moved]]), pa.array(rep[moved])], ["a", "b"])
            tidy()

    edges = materialize(map_runs(members, ["bucket", "i", "j"], compare, "a long, b long", ["rep"]), "candidates")
    discard(chosen, buckets)
    return edges


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two lists of sets: frequent shingles by a matrix product, rare ones pair by pair."""
    sets = [*left, *right]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((len(left), len(right)), np.float32)
    often = times > 8
    number = np.full(len(times), -1)
    number[often] = np.arange(int(often.sum()))
    for at in range(0, int(often.sum()), 4096):
        use = (number[column] >= at) & (number[column] < at + 4096)
        dense = np.zeros((len(sets), min(4096, int(often.sum()) - at)), np.float32)
        dense[owner[use], number[column[use]] - at] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    rare = ~often[column] & (times[column] > 1)
    order = np.argsort(column[rare], kind="stable")
    col, who = column[rare][order], owner[rare][order]
    for shift in range(1, 8):
        same = np.flatnonzero(col[shift:] == col[:-shift])
        a, b = who[same], who[same + shift]
        cross = (a < len(left)) & (b >= len(left))
        np.add.at(out, (a[cross], b[cross] - len(left)), 1)
    return out


def _verified(docs: DataFrame, clusters: DataFrame, threshold: float) -> DataFrame:
    """(kind, node, value): kind 0, links of a representative counted in documents; kind 1, a star edge of a true component."""

    carried = ["cluster", "rep", "copies", "blocks", "block"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                own = [shingles(x) for x in texts_of(some.column("text"))]
                asked = zip(some.column("set_a").to_pylist(), some.column("set_b").to_pylist(), strict=True)
                same = pa.array([_fingerprint(h) == x for h, x in zip(own, asked, strict=True)])  # a doc_id may name several texts
                kept = pa.RecordBatch.from_arrays([*[some.column(c) for c in carried], pa.array([h.tobytes() for h in own], pa.binary())], [*carried, "shingles"])
                yield kept.filter(same)
            tidy()

    texts = docs.select(F.col("doc_id").cast("long").alias("__doc"), "text").join(sized(clusters, 64), F.col("__doc") == F.col("of_doc"))
    held = texts.select(*carried, "set_a", "set_b", "text").mapInArrow(sets, "cluster long, rep long, copies long, blocks int, block int, shingles binary")

    def verify(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            keys = np.stack([t.column(c).to_numpy() for c in ("cluster", "i", "j")])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            kind, node, value = [], [], []
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), t.num_rows], strict=True):
                if e - s < 2:
                    continue
                rep, copies, block = (t.column(c)[s:e].to_numpy() for c in ("rep", "copies", "block"))
                i, j = keys[1, s], keys[2, s]
                once = np.flatnonzero(np.concatenate(([True], rep[1:] != rep[:-1])))  # repeated rows bring the same set again
                rep, copies, block = rep[once], copies[once], block[once]
                own = [np.frombuffer(t.column("shingles")[s + x].as_py(), np.uint64) for x in once.tolist()]
                low = np.flatnonzero(block == i)
                high = np.flatnonzero(block == j) if i != j else low
                if not len(low) or not len(high):
                    continue
                shared = _intersections([own[x] for x in low], [own[x] for x in high])
                size = np.array([len(x) for x in own], np.float64)
                union = size[low][:, None] + size[high][None, :] - shared
                near = shared >= threshold * union - 1e-9
                if i == j:
                    np.fill_diagonal(near, False)
                links = np.zeros(len(rep))
                links[low] += near @ copies[high].astype(np.float64)
                if i != j:
                    links[high] += near.T @ copies[low].astype(np.float64)
                a, b = np.nonzero(near)
                root = _settle(len(rep), low[a], high[b])
                linked, moved = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(rep)))
                kind += [0] * len(linked) + [1] * len(moved)
                node += [*rep[linked].tolist(), *rep[moved].tolist()]
                value += [*links[linked].astype(np.int64).tolist(), *rep[root[moved]].tolist()]
            if kind:
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(node, pa.int64()), pa.array(value, pa.int64())], ["kind", "node", "value"])
            tidy()

    return map_runs(_paired(held), ["cluster", "i", "j"], verify, "kind int, node long, value long", ["rep"])


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, class_id, copy_of, n_links of every row of docs (doc_id, text): near copies by 5-word shingles.

    Two documents are linked if the Jaccard similarity of their shingle sets is at least threshold. class_id is the
    smallest doc_id of the connected component, copy_of the smallest doc_id with the same shingle set, n_links the
    number of documents linked to this one, copies included.
    1. Rows of one shingle set are one class of copies; its row of the smallest doc_id stands for all.
    2. Representatives that share a MinHash band are compared in steps of LOOK values; a pair is dropped once its posterior
       chance of reaching the threshold is under tolerance. Survivors join candidate clusters.
    3. In a candidate cluster every pair is verified on its whole shingle sets; links are counted where they are found.
    Large buckets and clusters are dealt to tasks in pairs of blocks; no pairs are listed, none dropped.
    Nulls: a null text is empty. A text without words has no shingles, is linked to nothing and its own class. A row
    of null doc_id takes no part: class_id and copy_of null, no links. Rows that repeat a doc_id are copies of each
    other only if their shingle sets agree; if not, each has its own links and the smallest class. An empty table gives no rows.
    Other columns are not read.
    """
    rows = materialize(signed(docs), "signed")
    part = rows.where("doc_id is not null and n_shingles > 0")
    classes = materialize(part.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "uid")).alias("first"), F.count(F.lit(1)).alias("copies")), "classes")
    many = materialize(classes.where("copies > 1").select(F.col("set_a").alias("__a"), F.col("set_b").alias("__b"), "first", "copies"), "many")
    joined = part.join(sized(many, 48), (F.col("set_a") == F.col("__a")) & (F.col("set_b") == F.col("__b")), "left")
    firsts = F.coalesce("first", F.struct("doc_id", "uid"))
    joined = joined.select("uid", "doc_id", firsts.alias("first"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "set_a", "set_b", "bands", "signature")
    reps = joined.where("uid = first.uid").select(F.col("uid").alias("rep"), "doc_id", "copies", "set_a", "set_b", "bands", "signature")
    reps = materialize(reps, "reps")

    near = _candidates(reps.select("rep", "bands", "signature"), threshold, tolerance)
    found = connected_components(near, "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    large = materialize(found.groupBy(F.col("cluster").alias("large")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CLUSTER), "large")
    sizes = found.join(sized(large, 24), F.col("cluster") == F.col("large"), "left").select("rep", "cluster", F.coalesce("n", F.lit(1)).alias("n"))
    clusters = _dealt(sizes, "rep", CLUSTER, "n").join(reps.select("rep", "copies", "set_a", "set_b", F.col("doc_id").alias("of_doc")), "rep")
    clusters = materialize(clusters, "clusters")
    verified = materialize(_verified(docs, clusters, threshold), "verified")
    links = verified.where("kind = 0").groupBy(F.col("node").alias("l_rep")).agg(F.sum("value").alias("links"))
    parts = connected_components(verified.where("kind = 1"), "node", "value").join(reps.select(F.col("rep").alias("node"), "doc_id"), "node")
    named = parts.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    classed = parts.join(named, "component").select(F.col("node").alias("c_rep"), "class_id")
    facts = materialize(links.join(classed, F.col("l_rep") == F.col("c_rep"), "full").select(F.coalesce("l_rep", "c_rep").alias("rep"), "links", "class_id"), "facts")
    discard(classes, reps, near, clusters, verified)
    out = joined.select("doc_id", "copies", F.col("first.uid").alias("first_uid"), F.col("first.doc_id").alias("copy_of"))
    out = out.join(sized(facts, 32), F.col("first_uid") == F.col("rep"), "left")
    out = out.select("doc_id", F.coalesce("class_id", "copy_of").alias("class_id"), "copy_of", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rest = rows.where("doc_id is null or n_shingles = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(rest)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of docs, columns unchanged, that stay when each group of near copies keeps its smallest doc_id. Rows that repeat
    this doc_id stay with it, and rows of null doc_id all stay."""
    drop = materialize(jaccard_join(docs, threshold, tolerance).where("doc_id <> class_id").select(F.col("doc_id").alias("__drop")).distinct(), "drop")
    return docs.join(sized(drop, 16), docs["doc_id"] == drop["__drop"], "left_anti")
