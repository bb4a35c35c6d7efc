"""MinHash near-duplicates by an LSH forest.

Each distinct shingle set gets ``TREES`` short signatures. Every tree is one sorted order of these signatures; neighbours there
share a longest common prefix. A region of the order - the rows under one prefix - is as deep as it must be to hold at most
``REGION`` rows, but never deeper than ``DEPTH`` values: what is still crowded there is compared in full, in blocks against
blocks. So the number of orders bounds the share of missed pairs whatever the size of the crowd. Candidates are confirmed
on full sets. A first round takes a few orders and only a spanning forest of each region's candidates, and contracts what is
confirmed; the second takes all orders and, in each region, the rows with a candidate in another component: their sets come
together once and all of their pairs between components are counted in one product. So a large group of copies is never
written out as pairs, and no pair is passed over unless its ends are connected already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, bytes_of, connected, cut, n_parts, slices

#: A pair at similarity 0.8 meets in none of the orders with probability (1 - 0.8 ** DEPTH) ** TREES at most: 8e-5.
TREES, DEPTH, SKETCH = 18, 4, 64
REGION = 64
#: Rows of a side of the blocks in which a crowded region is compared.
SIDE = 512
#: Orders that the first round takes, and their values: it only has to find enough links, so it may go deeper.
FIRST, FIRST_DEPTH = 3, 8
#: Estimates this far below the threshold are more than four standard errors off.
MARGIN = 0.21
#: Ids up to this number (8 bytes each) may be broadcast; beyond it the join shuffles.
BROADCAST_IDS = 400_000

_RNG = np.random.default_rng(972_611)
_MUL = (_RNG.integers(0, 2**31, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)[:, None]
_XOR = _RNG.integers(0, 2**32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)[:, None]
_P = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """64-bit hashes of words; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(raw: bytes, width: int, table: Words) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; a shorter text is one shingle; empty without words."""
    words = raw.translate(LOWER_AZ).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(table.__getitem__, words), np.uint64, n)
    k = min(width, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = out * _P + h[i : n - k + 1 + i]
    return np.unique(mixed(out + np.uint64(k)))


def signature(s: np.ndarray) -> np.ndarray:
    """The least values of the set under each hash function, cut to 16 bits."""
    x, least = (s >> np.uint64(32)).astype(np.uint32), None
    for i in range(0, len(x), 2048):
        v = ((x[i : i + 2048] ^ _XOR) * _MUL).min(1)
        least = v if least is None else np.minimum(least, v)
    # The smallest values crowd near zero; another round spreads them before the cut.
    return ((least * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(">u2")


def set_ids(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(doc_id, n, sid, sig, sketch): size, identity and signature of every document's set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Words()
        for b in slices(batches, "_t"):
            n, sid, sig, sk = [], [], [], []
            for raw in bytes_of(b.column("_t")):
                s = shingles(raw, width, table)
                n.append(len(s))
                v = signature(s) if len(s) else None
                sid.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(v.tobytes() if len(s) else None)
                sk.append(v.astype(np.uint8)[:SKETCH].tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(c, pa.binary()) for c in (sid, sig, sk))], names=["doc_id", "n", "sid", "sig", "sketch"])

    kind = docs.select(F.col(key)).dtypes[0][1]
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_t")).mapInArrow(sign, f"doc_id {kind}, n long, sid binary, sig binary, sketch binary")


def regions(tree: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, int, bool]]:
    """(first, end, crowded) of the regions of sorted rows; crowded: more than ``REGION`` rows.

    A region goes deeper while it is crowded, to whole keys at most.
    """
    n = len(tree)
    if n < 2:
        return
    same = (keys[1:] == keys[:-1]).astype(np.uint8)
    lcp = np.where(tree[1:] == tree[:-1], np.cumprod(same, axis=1, dtype=np.uint8).sum(1), 0).astype(np.int64)
    todo = [(0, n, 0)]
    while todo:
        a, z, d = todo.pop()
        if z - a < 2:
            continue
        if d and z - a <= REGION:
            yield a, z, False
            continue
        if d == keys.shape[1]:
            yield a, z, True
            continue
        breaks = np.flatnonzero(lcp[a : z - 1] < d + 1) + a + 1
        ends = np.concatenate([[a], breaks, [z]])
        some = np.flatnonzero(np.diff(ends) > 1)
        todo += [(int(ends[i]), int(ends[i + 1]), d + 1) for i in some]


def likely(sketch: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of rows ``i`` against rows ``j``: whether they may reach the threshold, and the estimate."""
    # Equal bytes are counted eight at a time, then across the bytes of a word.
    same = (sketch[i][:, None, :] == sketch[j][None, :, :]).view(np.uint64).sum(2)
    est = ((same * np.uint64(0x0101010101010101)) >> np.uint64(56)) / sketch.shape[1]
    small, large = np.minimum(n[i][:, None], n[j][None, :]), np.maximum(n[i][:, None], n[j][None, :])
    return (est >= least - MARGIN) & (small >= least * large - 1e-9), est


def forest(i: np.ndarray, j: np.ndarray, est: np.ndarray) -> list[int]:
    """The candidates that a spanning forest takes, the likeliest first."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    out = []
    for k in np.argsort(-est, kind="stable").tolist():
        a, b = top(int(i[k])), top(int(j[k]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append(k)
    return out


def near(batches: Iterator[pa.RecordBatch], least: float, first: bool) -> Iterator[pa.RecordBatch]:
    """Of one stretch of the sorted orders, in the first round (a, b): a spanning forest of the candidates; later (group, rep):
    the rows of each region that have a candidate in another component."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    wide = lambda c, k, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind).reshape(-1, k)
    tree, rep, n, comp = (t.column(c).to_numpy() for c in ("tree", "rep", "n", "comp"))
    keys, sketch = wide("key", FIRST_DEPTH if first else DEPTH, ">u2"), wide("sketch", SKETCH, np.uint8)
    found = []
    group = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32

    def candidates(i: np.ndarray, j: np.ndarray, best: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ok, est = likely(sketch, n, i, j, least)
        ok &= comp[i][:, None] != comp[j][None, :]
        if best:  # each row's likeliest partner
            top = np.where(ok, est, -1.0).argmax(1)
            x = np.flatnonzero(ok[np.arange(len(i)), top])
            y = top[x]
        else:
            x, y = np.nonzero(ok)
        return i[x], j[y], est[x, y]

    for a, z, crowded in regions(tree, keys):
        rows = np.arange(a, z)
        if not crowded:
            i, j, est = candidates(rows, rows)
            keep = i < j
            i, j, est = i[keep], j[keep], est[keep]
        elif first:
            got = [candidates(np.arange(s, min(s + REGION, z)), np.arange(max(a, s - REGION // 2), min(s + REGION + REGION // 2, z)), True) for s in range(a, z, REGION)]
            i, j, est = (np.concatenate(x) for x in zip(*got))
        else:  # all pairs but those within the largest component, in blocks against blocks: the exact way for crowded regions
            _, at, size = np.unique(comp[rows], return_inverse=True, return_counts=True)
            large = at == size.argmax()
            rest, every = rows[~large], np.concatenate([rows[~large], rows[large]])
            for s in range(0, len(rest), SIDE):
                for u in range(s, len(every), SIDE):
                    got = [candidates(rest[v : min(v + REGION, s + SIDE)], every[u : u + SIDE]) for v in range(s, min(s + SIDE, len(rest)), REGION)]
                    some = np.unique(np.concatenate([x for g in got for x in g[:2]]))
                    if len(some):
                        found.append(np.column_stack([np.full(len(some), group), rep[some]]))
                        group += 1
            continue
        if not len(i):
            continue
        if first:
            keep = forest(i, j, est)
            found.append(np.sort(np.column_stack([rep[i[keep]], rep[j[keep]]]), axis=1))
        else:
            some = np.unique(np.concatenate([i, j]))
            found.append(np.column_stack([np.full(len(some), group), rep[some]]))
            group += 1
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def neighbours(classes: DataFrame, least: float, first: bool) -> DataFrame:
    spark = classes.sparkSession
    rows = classes.select("rep", "n", "comp", "sketch", "sig", F.explode(F.sequence(F.lit(0), F.lit((FIRST if first else TREES) - 1))).alias("tree"))
    wide = 2 * (FIRST_DEPTH if first else DEPTH)
    rows = rows.select("tree", F.expr(f"substring(sig, tree * {wide} + 1, {wide})").alias("key"), "rep", "n", "comp", "sketch")
    # Ranges of the orders: a large group of copies is cut into as many stretches as it fills.
    placed = rows.repartitionByRange(n_parts(spark), "tree", "key", "rep").sortWithinPartitions("tree", "key", "rep")
    return cut(placed.mapInArrow(lambda it: near(it, least, first), "a long, b long").distinct())


def some_docs(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` whose key is among ``ids``; broadcast only if there are few."""
    ids = ids.select(F.col("id").alias(key))
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_semi")


def sets_of(docs: DataFrame, ids: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, s): the full sets of the documents ``ids``."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Words()
        for b in slices(batches, "_t"):
            got = [shingles(raw, width, table).tobytes() for raw in bytes_of(b.column("_t"))]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(got, pa.binary())], names=["id", "s"])

    return some_docs(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("_t")), ids, "id").mapInArrow(sets, "id long, s binary").where(F.length("s") > 0)


def confirmed(docs: DataFrame, pairs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union, on full sets."""
    full = sets_of(docs, cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), key, text, width)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("x"), b.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                ok.append(100 * inter >= percent * (len(x) + len(y) - inter))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    both = pairs.join(full.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(full.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    return cut(both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").distinct())


def linked_across(sets: list[np.ndarray], comp: np.ndarray, percent: int, columns: int = 4096) -> np.ndarray:
    """A spanning forest (two columns of indices) of the links between rows of different components.

    Intersections are counted as one product of incidence matrices, a stretch of their columns at a time; hashes that one
    row has alone are left out before. Rows of the largest component aren't compared with each other.
    """
    names, at, count = np.unique(comp, return_inverse=True, return_counts=True)
    rest = np.flatnonzero(at != count.argmax())
    n = np.array([len(x) for x in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), n)
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    some = times[code] > 1
    row, code = row[some], number[code[some]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    inter = np.zeros((len(rest), len(sets)), np.float64)
    for c in range(0, int(code[-1]) + 1 if len(code) else 0, columns):
        lo, hi = np.searchsorted(code, [c, c + columns])
        x = np.zeros((len(sets), columns), np.float32)
        x[row[lo:hi], code[lo:hi] - c] = 1
        inter += x[rest] @ x.T
    i, j = np.nonzero((100 * inter >= percent * (n[rest][:, None] + n[None, :] - inter)) & (comp[rest][:, None] != comp[None, :]))
    i = rest[i]
    keep = forest(i, j, np.zeros(len(i)))
    return np.column_stack([i[keep], j[keep]])


def across(docs: DataFrame, members: DataFrame, classes: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """Links between different components within the groups (a: group, b: row)."""
    full = sets_of(docs, cut(members.select(F.col("b").alias("id")).distinct()), key, text, width)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(t: pa.Table) -> pa.RecordBatch:
            rep = t.column("b").to_numpy()
            links = linked_across([np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("s")], t.column("comp").to_numpy(), percent)
            return pa.RecordBatch.from_arrays([pa.array(rep[links[:, 0]]), pa.array(rep[links[:, 1]])], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column("a").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
            for s, e in zip(edges, edges[1:]):
                if held and held[0].column("a")[0].as_py() != int(g[s]):
                    yield told(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(s, e - s))
        if held:
            yield told(pa.Table.from_batches(held))

    rows = members.join(classes.select(F.col("rep").alias("b"), "comp"), "b").join(full.select(F.col("id").alias("b"), "s"), "b")
    placed = rows.select("a", "b", "comp", "s").repartition(n_parts(docs.sparkSession), "a").sortWithinPartitions("a")
    return cut(placed.mapInArrow(check, "a long, b long").distinct())


def with_components(classes: DataFrame, links: DataFrame) -> DataFrame:
    found = connected(links).select(F.col("id").alias("rep"), "component")
    return classes.drop("comp").join(found, "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: ``doc_id, n_shingles, component_id, kept``.

    Documents with 100 * intersection >= ``percent`` * union of their sets are linked; ``component_id`` is the smallest id
    reachable. Null and empty texts and texts of white space have no shingles and are linked with nothing; so are
    documents without an id (their component is null, and they are kept). Rows that repeat an id are rows of one
    document. An empty table gives none; other columns are ignored. Ids are integers.
    """
    signed = cut(set_ids(docs, key, text, width))
    # Equal sets are one class; its rows meet in partial minima, not as pairs.
    classes = signed.where("n > 0 and doc_id is not null").groupBy("sid").agg(F.min("doc_id").cast("long").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    classes = cut(classes.withColumn("comp", F.col("rep")))
    links = confirmed(docs, neighbours(classes, percent / 100, True), key, text, width, percent)
    contracted = cut(with_components(classes, links))
    links = links.unionByName(across(docs, neighbours(contracted, percent / 100, False), contracted, key, text, width, percent))
    done = cut(connected(links))
    where = classes.select("sid", "rep").join(done.withColumnRenamed("id", "rep"), "rep", "left").select("sid", F.coalesce("component", "rep").alias("component"))
    # A document whose rows differ belongs to all of their classes: the least component holds.
    rows = signed.select("doc_id", "n", "sid").join(where, "sid", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", F.col("doc_id").cast("long")))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all their columns, whose document is the first of its group."""
    gone = cut(near_duplicates(docs, key, text, **options).where(~F.col("kept")).select(F.col("doc_id").alias("id")).distinct())
    name = "_gone"
    while name in docs.columns:
        name += "_"
    ids = gone.select(F.col("id").alias(name))
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, F.col(key) == F.col(name), "left_anti")
