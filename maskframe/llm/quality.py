"""Quality rules: isolation forests on rule statistics, their thresholds calibrated on labelled rows that they were not grown on."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, bytes_of, cut, slices, texts_of

SYMBOLS = "#*$%&|<>"
#: Rows that one tree takes its splits from, drawn for each tree from all labelled rows of its half.
FIT_ROWS = 256
#: Steps a unit of score.
SCALE = 1 << 16
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What else the features are made of, see :func:`more_stats`.
MORE = ("n_lines", "n_marks", "n_capitals", "n_digits")
_MIX = np.random.default_rng(20240601).integers(1, 2**63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def repeated_words(words: list, window: int = 5) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the text, its first place included."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    m = n - window + 1
    # A window's rank among the pairs, triples ... seen: exact, since each step numbers distinct combinations.
    code = at[:m]
    for k in range(1, window):
        key = code * (len(ids) + 1) + at[k : k + m]
        if k == window - 1:
            code = key
        else:
            code = np.unique(key, return_inverse=True)[1].astype(np.int64)
            if code.max() == m - 1:
                return 0
    order = np.argsort(code, kind="stable")
    same = np.diff(code[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def rule_stats(text: str, raw: bytes) -> tuple[int, int, int, int, int]:
    words = raw.split()
    chars = len(text) - sum(map(text.count, ASCII_SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def features(stats: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """What the forest splits on: rates, so that a long document is not an anomaly for its length."""
    n = np.maximum(stats[:, 0], 1).astype(float)
    return np.column_stack([stats[:, 1] / n, stats[:, 2] / n, stats[:, 3] / np.maximum(extra[:, 0], 1), stats[:, 4] / n, extra[:, 1] / n, extra[:, 2] / n, extra[:, 3] / n])


def more_stats(text: str, raw: bytes) -> tuple[int, int, int, int]:
    """Lines with a word, exclamation and question marks, capital letters, digits."""
    up = raw.translate(None, bytes(b for b in range(256) if not 65 <= b <= 90))
    digits = raw.translate(None, bytes(b for b in range(256) if not 48 <= b <= 57))
    return sum(1 for x in raw.split(b"\n") if x.strip()), raw.count(b"!") + raw.count(b"?"), len(up), len(digits)


_G = 0x9E3779B97F4A7C15


def drawn(h: np.ndarray, tree: int) -> np.ndarray:
    """A number for each row hash and tree; a tree draws the rows whose numbers are lowest."""
    x = h.astype(np.uint64) ^ np.uint64(_G * (2 * tree + 1) % 2**64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def mean_path(size) -> np.ndarray:
    """Mean path length in a tree of ``size`` rows, twice the harmonic number less two; ``size`` need not be whole."""
    z = np.asarray(size, float) + 7
    h = np.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) + 0.57721566490153286
    return 2 * (h - sum(1 / (z - k) for k in range(1, 7))) - 2


def grow(x: np.ndarray, psi: int, rng: np.random.Generator) -> tuple:
    """A tree's features, values, left children and depths of its nodes, split at random as far as ``psi`` rows reach on average."""
    limit = int(np.ceil(np.log2(max(psi, 2))))
    feat, val, left, level, todo = [-1], [0.0], [0], [0], [(0, x)]
    while todo:
        i, part = todo.pop()
        span = part.max(0) - part.min(0) if len(part) else np.zeros(x.shape[1])
        some = np.flatnonzero(span > 0)
        if level[i] >= limit or len(part) <= 1 or not len(some):
            continue
        f = int(rng.choice(some))
        v = rng.uniform(part[:, f].min(), part[:, f].max())
        feat[i], val[i], left[i] = f, v, len(feat)
        for _side in range(2):
            feat.append(-1), val.append(0.0), left.append(0), level.append(level[i] + 1)
        low = part[:, f] < v
        todo += [(left[i], part[low]), (left[i] + 1, part[~low])]
    return np.array(feat), np.array(val), np.array(left), np.array(level)


def leaves(tree: tuple, x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    feat, val, left, _ = tree
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while True:
        f = feat[at]
        inner = f >= 0
        if not inner.any():
            return at
        at = np.where(inner, left[at] + (x[rows, np.maximum(f, 0)] >= val[at]), at)


@dataclass
class Forest:
    """Isolation trees as arrays: at node i split ``feature[i] < value[i]`` to ``left[i]``, else left + 1; leaves have feature -1.

    As published, a tree takes its splits from ``psi`` rows drawn for it alone. What lies in its leaves is counted over all rows:
    a leaf's path length is its depth and the mean path of as many rows as ``psi`` rows would have there, so that it doesn't
    depend on what the draw happened to hold. Scores are whole multiples of 1 / ``SCALE``.
    """

    trees: list = field(default_factory=list)
    psi: int = FIT_ROWS
    threshold: float = 2.0

    @classmethod
    def of(cls, trees: list, counts: list, n: int, psi: int) -> Forest:
        """From trees and, for each, the number of the ``n`` rows in every node."""
        psi = min(psi, n)
        return cls([(f, v, left, level + mean_path(psi * np.asarray(c) / n)) for (f, v, left, level), c in zip(trees, counts)], psi)

    @classmethod
    def grown(cls, x: np.ndarray, trees: range = range(100), psi: int = FIT_ROWS, h: np.ndarray | None = None, fold: int = 0) -> Forest:
        """The same in memory, for rows with the hashes ``h`` (default: their places)."""
        h, out = np.arange(len(x)) if h is None else h, []
        for t in trees if len(x) > 1 else []:
            out.append(grow(x[np.lexsort([h, drawn(h, t)])[:psi]], min(psi, len(x)), np.random.default_rng([7, fold, t])))
        return cls.of(out, [np.bincount(leaves(t, x), minlength=len(t[0])) for t in out], len(x), psi)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / that of psi rows): near 1 for anomalies, 0 without trees."""
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total = np.zeros(len(x))
        for tree in self.trees:
            total += tree[3][leaves(tree, x)]
        return np.rint(SCALE * 2.0 ** (-total / len(self.trees) / max(mean_path(self.psi), 1e-9))) / SCALE


#: Labelled bad rows that a threshold must reject for each good one, and the share of good ones it may reject at most.
RATIO, LOSS = 10.0, 0.005


def threshold(s: np.ndarray, good: np.ndarray, bad: np.ndarray, ratio: float = RATIO, loss: float = LOSS) -> float:
    """The threshold that rejects the most bad rows net of ``ratio`` times the good ones; beyond all scores if none gains.

    ``s`` are distinct scores, the highest first, ``good`` and ``bad`` the numbers of rows that have them.
    """
    g, b = np.cumsum(good), np.cumsum(bad)
    gain = np.where(g <= loss * max(1, good.sum()), b - ratio * g, -1.0)
    best = int(gain.argmax()) if len(gain) else 0
    if not len(gain) or gain[best] <= 0:
        return 2.0
    # Half way to the next score, so that rows between the two are judged by the nearer one.
    return float((s[best] + s[best + 1]) / 2) if best + 1 < len(s) else float(s[best]) - 1e-9


def calibrate(scores: np.ndarray, good: np.ndarray, **options) -> float:
    """:func:`threshold` for a score and a label a row."""
    s, at = np.unique(-scores, return_inverse=True)
    n = np.bincount(at[good], minlength=len(s)) if len(s) else np.zeros(0, int)
    return threshold(-s, n, np.bincount(at, minlength=len(s)) - n, **options)


def parts(width: int) -> list[tuple[list[int], range]]:
    """The columns of each pair of forests, and the numbers of its trees: 50 on all columns, 20 on each."""
    return [(list(range(width)), range(50)), *(([i], range(50 + 20 * i, 70 + 20 * i)) for i in range(width))]


class Forests:
    """A pair of forests on all features and a pair on each; a document fails by any pair of which both forests reject it.

    ``fold`` parts the labelled rows: one forest of a pair grows on fold 0 and takes its threshold from the scores of fold 1,
    of which its trees have seen nothing; the other one the other way round. A fold without rows grows no trees and sets no
    threshold, so its pairs reject nothing: few labels never decide by rows that the trees have seen.
    """

    def __init__(self, x: np.ndarray, good: np.ndarray, fold: np.ndarray, h: np.ndarray | None = None, rows: int = FIT_ROWS, **options):
        """Fitted in memory; :func:`fit` gives the same forests for tables of any size."""
        self.parts, h = [], np.arange(len(x)) if h is None else h
        for cols, trees in parts(x.shape[1]) if len(x) else []:
            pair = []
            for k in range(2):
                mine, other = fold == k, fold == 1 - k
                f = Forest.grown(x[mine][:, cols], trees, rows, h[mine], k)
                f.threshold = calibrate(f.score(x[other][:, cols]), good[other], **options) if f.trees else 2.0
                pair.append(f)
            self.parts.append((cols, pair))

    @classmethod
    def of(cls, fitted: list) -> Forests:
        """From columns and pairs of forests."""
        out = cls.__new__(cls)
        out.parts = fitted
        return out

    def judged(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The highest score of each row (of a pair the lower one), and whether a pair rejects it."""
        top, out = np.zeros(len(x)), np.zeros(len(x), bool)
        for cols, pair in self.parts:
            scores = [f.score(x[:, cols]) for f in pair]
            top = np.maximum(top, np.minimum(*scores))
            out |= np.logical_and(*(s > f.threshold for s, f in zip(scores, pair)))
        return top, out


def stats_of(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    col = batch.column(text)
    pairs = list(zip(texts_of(col), bytes_of(col)))
    return np.array([rule_stats(*p) for p in pairs], np.int64).reshape(-1, 5), np.array([more_stats(*p) for p in pairs], np.int64).reshape(-1, 4)


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: ``doc_id``, the rule statistics and what else the features are made of."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_t"):
            cols = np.hstack(stats_of(b, "_t"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c) for c in cols.T)], names=["doc_id", *STATS, *MORE])

    kind = docs.select(F.col(key)).dtypes[0][1]
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_t")).mapInArrow(count, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in (*STATS, *MORE)))


def arrays_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The statistics of a batch of :func:`counted`."""
    stats, extra = (np.column_stack([batch.column(c).to_numpy() for c in names]) for names in (STATS, MORE))
    return stats, extra


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", rows: int = FIT_ROWS, **options) -> Forests:
    """Forests grown on half of the labelled rows, good and bad, with thresholds that spare the good ones of the other half.

    ``stats`` is what :func:`counted` gives. Every labelled document with a word counts, once an id: any of them may be drawn for
    a tree (``rows`` of them a tree), all are counted in the leaves of their half and in the thresholds of the other one's forests.
    What comes to the driver is the model: trees, counts a leaf, thresholds. Without labelled rows there is no forest and none
    is rejected.
    """
    spark, width = stats.sparkSession, 7
    lab = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(label).alias("_good"))
    one = stats.where("doc_id is not null and n_words > 0").groupBy(F.col("doc_id").alias("_k")).agg(F.min(F.struct(*STATS, *MORE)).alias("s")).join(lab, "_k")
    known = cut(one.select(F.xxhash64("_k").alias("h"), (F.col("_good") == 1).alias("good"), F.pmod(F.xxhash64(F.lit("fold"), "_k"), F.lit(2)).cast("int").alias("fold"), "s.*"))
    n = {r["fold"]: r["n"] for r in known.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    if not n:
        return Forests.of([])
    tables = parts(width)
    cols_of = {t: cols for cols, trees in tables for t in trees}
    some = {k: m for k, m in n.items() if m > 1}

    def halves(b: pa.RecordBatch) -> Iterator[tuple]:
        x, fold = features(*arrays_of(b)), b.column("fold").to_numpy()
        for k in range(2):
            at = np.flatnonzero(fold == k)
            if len(at):
                yield k, x[at], b.column("h").to_numpy()[at], b.column("good").to_numpy(zero_copy_only=False)[at]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, x, h, _ in halves(b):
                if k not in some:
                    continue
                # About half as many again as wanted, of which the lowest stay: all rows of a small half.
                most = np.uint64(min(2**64 - 1, int(2**64 * (1.5 * rows + 64) / some[k])))
                for t in cols_of:
                    at = np.flatnonzero(drawn(h, t) <= most)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(np.full(len(at), t, np.int32)), pa.array(h[at]), pa.array(list(x[at]), pa.list_(pa.float64()))], names=["fold", "tree", "h", "x"])

    def growing(t: pa.Table) -> pa.Table:
        k, tree, h = t.column("fold")[0].as_py(), t.column("tree")[0].as_py(), t.column("h").to_numpy()
        x = np.array(t.column("x").to_pylist())[:, cols_of[tree]]
        got = grow(x[np.lexsort([h, drawn(h, tree)])[:rows]], min(rows, some[k]), np.random.default_rng([7, k, tree]))
        return pa.table({"fold": pa.array([k], pa.int32()), "tree": pa.array([tree], pa.int32()), **{c: pa.array([v.tolist()]) for c, v in zip(("feat", "val", "left", "level"), got)}})

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in batches:
            for k, x, _, _ in halves(b):
                for t, cols in cols_of.items() if k in some else []:
                    tree = model.value[k, t]
                    sums[k, t] = sums.get((k, t), 0) + np.bincount(leaves(tree, x[:, cols]), minlength=len(tree[0]))
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sums], pa.int32()), pa.array([t for _, t in sums], pa.int32()), pa.array([c.tolist() for c in sums.values()], pa.list_(pa.int64()))], names=["fold", "tree", "n"])

    def adding(t: pa.Table) -> pa.Table:
        return t.slice(0, 1).select(["fold", "tree"]).append_column("n", pa.array([np.sum(t.column("n").to_pylist(), axis=0).tolist()], pa.list_(pa.int64())))

    def scoring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in batches:
            for k, x, _, good in halves(b):
                for p, (cols, pair) in enumerate(judges.value):
                    if pair[1 - k].trees:
                        at = np.rint(pair[1 - k].score(x[:, cols]) * SCALE).astype(np.int64) * 2 + good
                        sums[p, 1 - k] = sums.get((p, 1 - k), 0) + np.bincount(at, minlength=4 * SCALE)
        for (p, k), c in sums.items():
            at = np.flatnonzero(c.reshape(-1, 2).any(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p, np.int32)), pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(c[2 * at + 1]), pa.array(c[2 * at])], names=["part", "fold", "score", "good", "bad"])

    def calibrating(t: pa.Table) -> pa.Table:
        t = t.sort_by([("score", "descending")])
        at = threshold(t.column("score").to_numpy() / SCALE, t.column("good").to_numpy(), t.column("bad").to_numpy(), **options)
        return t.slice(0, 1).select(["part", "fold"]).append_column("at", pa.array([at]))

    grown = known.mapInArrow(draw, "fold int, tree int, h long, x array<double>").groupBy("fold", "tree").applyInArrow(growing, "fold int, tree int, feat array<long>, val array<double>, left array<long>, level array<long>").collect()
    trees = {(r["fold"], r["tree"]): tuple(np.array(r[c]) for c in ("feat", "val", "left", "level")) for r in grown}
    model = spark.sparkContext.broadcast(trees)
    counts = {(r["fold"], r["tree"]): r["n"] for r in known.mapInArrow(counting, "fold int, tree int, n array<long>").groupBy("fold", "tree").applyInArrow(adding, "fold int, tree int, n array<long>").collect()}
    fitted = [(cols, [Forest.of([trees[k, t] for t in numbers], [counts[k, t] for t in numbers], some[k], rows) if k in some else Forest() for k in range(2)]) for cols, numbers in tables]
    judges = spark.sparkContext.broadcast(fitted)
    # At most 2 SCALE scores a forest, however many rows.
    tally = known.mapInArrow(scoring, "part int, fold int, score long, good long, bad long").groupBy("part", "fold", "score").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    for r in tally.groupBy("part", "fold").applyInArrow(calibrating, "part int, fold int, at double").collect():
        fitted[r["part"]][1][r["fold"]].threshold = r["at"]
    return Forests.of(fitted)


def verdict(stats: np.ndarray, extra: np.ndarray, forests: Forests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    failed = (stats[:, 0] < 10) | (100 * stats[:, 4] > 20 * stats[:, 0])
    score, rejected = forests.judged(features(stats, extra))
    return failed, score, ~failed & ~rejected


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row a document: ``doc_id``, the rule statistics, ``base_failed``, ``score`` and ``kept``.

    Null and empty texts have no words and fail the base rule; repeated rows are judged each; an empty table gives none;
    other columns are ignored, whatever their names. Texts are read once, their statistics fit the model and are judged.
    """
    stats = cut(counted(docs, key, text))
    model = docs.sparkSession.sparkContext.broadcast(fit(stats, labels, key, **options))
    names = ["doc_id", *STATS, "base_failed", "score", "kept"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, e = arrays_of(b)
            failed, score, kept = verdict(s, e, model.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(b.column(c) for c in STATS), pa.array(failed), pa.array(score), pa.array(kept)], names=names)

    kind = stats.dtypes[0][1]
    return stats.mapInArrow(judge, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in STATS) + ", base_failed boolean, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all their columns, that :func:`quality` keeps."""
    model = docs.sparkSession.sparkContext.broadcast(fit(counted(docs, key, text), labels, key, **options))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            yield b.filter(pa.array(verdict(*stats_of(b, text), model.value)[2]))

    return docs.mapInArrow(keep, docs.schema)
