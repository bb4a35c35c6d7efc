"""Embedding near-duplicates by randomised-rotation binary codes.

A random rotation turns each vector; the signs of its coordinates are its code, stored with the factor that makes inner products
with the code unbiased. Stretches of the code, as many and as long as the number of vectors asks for, are the keys of tables that
bring likely pairs into one bucket.

Codes travel first, without vectors: per input partition and bucket one packed row. In a bucket the Hamming distances of the whole
codes and their confidence bound leave open few pairs that met in no earlier table; only the vectors that have one are
fetched, once a bucket. There the unbiased estimates and their bounds decide which pairs are recomputed in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected, cut, n_parts, union_find

#: Vectors a bucket on average; vectors that are compared in one piece; chance that a pair at the threshold meets in no table.
PER_BUCKET, BLOCK, MISS = 256, 1024, 1e-4
#: Standard errors of the confidence bounds.
SIGMAS = 5.0
#: Crowded buckets up to this number may be broadcast.
BROADCAST_ROWS = 100_000


@lru_cache(16)
def rotation(d: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, d]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def layout(n: int, least: float) -> tuple[int, int]:
    """(bits, tables): prefixes of log2(n / PER_BUCKET) bits, and tables until a pair at ``least`` meets almost surely."""
    bits = min(30, max(3, math.ceil(math.log2(max(n, 2) / PER_BUCKET)))) if n > PER_BUCKET else 3
    meet = (1 - math.acos(least) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log1p(-meet)))


def coded(vectors: DataFrame, key: str, embedding: str, bits: int, tables: int) -> DataFrame:
    """(vec_id, d, x, same, code, factor) of the vectors that can be compared; the code has the signs of ``bits * tables`` turned
    coordinates, and all of the first rotation's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = [], {}
            for i, v in enumerate(b.column("_v")):
                if not v.is_valid or not len(v.values):
                    continue
                v = v.values.to_numpy(zero_copy_only=False)  # null components come as NaN
                x = v.astype(np.float64)
                if np.isfinite(x).all() and x.any():
                    rows.setdefault(len(x), []).append((i, v))
            for d, some in rows.items():
                raw = np.stack([v for _, v in some])
                x = raw.astype(np.float64)
                x = x / np.abs(x).max(1)[:, None]
                x /= np.linalg.norm(x, axis=1)[:, None]
                turned = np.hstack([x @ rotation(d, s) for s in range(-(-bits * tables // d))])
                factor = np.abs(turned[:, :d]).sum(1) / math.sqrt(d)
                ids = b.column("vec_id").take(pa.array([i for i, _ in some], pa.int64()))
                wide = np.ascontiguousarray(raw if raw.dtype == np.float32 else x, raw.dtype if raw.dtype == np.float32 else np.float64)
                code = np.packbits(turned[:, : max(d, bits * tables)] > 0, axis=1)
                yield pa.RecordBatch.from_arrays([ids, pa.array([d] * len(some), pa.int32()), pa.array([r.tobytes() for r in wide], pa.binary()), pa.array([xxhash.xxh3_128_digest(r.tobytes()) for r in wide], pa.binary()), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(factor.astype(np.float32))], names=["vec_id", "d", "x", "same", "code", "factor"])

    return vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).alias("_v")).mapInArrow(run, "vec_id long, d int, x binary, same binary, code binary, factor float")


def wide_codes(codes: list[bytes], d: int, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes as 64-bit words (what lies beyond the tables' bits cleared), and the tables' keys, one row a vector."""
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    sign = np.unpackbits(raw, axis=1)[:, : bits * tables]
    keys = sign.reshape(len(codes), tables, bits).astype(np.int32) @ (1 << np.arange(bits)).astype(np.int32)
    packed = np.packbits(sign, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64), keys


def dealt(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(d, slot, n, reps, codes): the vectors of one partition that share a bucket, in one row; a slot is table << 32 | key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rep, dim, codes = b.column("rep").to_numpy(), b.column("d").to_numpy(), b.column("code").to_pylist()
            for d in np.unique(dim):
                rows = np.flatnonzero(dim == d)
                _, keys = wide_codes([codes[i] for i in rows], int(d), bits, tables)
                out = []
                for t in range(tables):
                    order = np.argsort(keys[:, t], kind="stable")
                    k = keys[order, t]
                    edges = np.flatnonzero(np.diff(np.r_[-1, k]))
                    for a, z in zip(edges, [*edges[1:], len(k)]):
                        some = rows[order[a:z]]
                        out.append((int(d), t << 32 | int(k[a]), z - a, rep[some].tobytes(), b"".join([codes[i] for i in some])))
                cols = list(zip(*out)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["d", "slot", "n", "reps", "codes"])

    return classes.select("rep", "d", "code").mapInArrow(run, "d int, slot long, n long, reps binary, codes binary")


def open_rows(words: np.ndarray, keys: np.ndarray, table: int, n_bits: int, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """The rows among ``a`` and ``b`` with a pair, one of each, that may reach the threshold and met in no earlier table."""
    p = math.acos(least) / math.pi
    # Bits are counted as independent; those of one rotation differ less from their mean than that (a test measures it).
    most = n_bits * p + SIGMAS * math.sqrt(n_bits * p * (1 - p))
    hit_a, hit_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    for s in range(0, len(a), 256):
        i = a[s : s + 256]
        far = np.zeros((len(i), len(b)), np.uint16)
        for w in range(words.shape[1]):
            far += np.bitwise_count(words[i, w][:, None] ^ words[b, w][None, :])
        x, y = np.nonzero(far <= most)
        keep = i[x] != b[y]
        x, y = x[keep], y[keep]
        for c in range(0, len(x), 1 << 20):
            u, v = x[c : c + (1 << 20)], y[c : c + (1 << 20)]
            new = np.ones(len(u), bool)
            for t in range(table):
                new &= keys[i[u], t] != keys[b[v], t]
            hit_a[s + u[new]] = hit_b[v[new]] = True
    return np.unique(np.concatenate([a[hit_a], b[hit_b]]))


def opened(batches: Iterator[pa.RecordBatch], bits: int, tables: int, least: float) -> Iterator[pa.RecordBatch]:
    """(group, rep, slot) of one stretch of whole buckets or pairs of blocks: the vectors that have an open pair there."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    p = pa.Table.from_batches(parts).combine_chunks()
    col = lambda c: p.column(c).to_numpy()
    slot, dim, lo, hi, s = (col(c) for c in ("slot", "d", "lo", "hi", "s"))
    edges = np.flatnonzero(np.r_[True, (np.diff(slot) != 0) | (np.diff(dim) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)])
    group = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    for x, z in zip(edges, [*edges[1:], len(slot)]):
        g = p.slice(x, z - x)
        rep = np.frombuffer(b"".join(g.column("reps").to_pylist()), np.int64)
        if len(rep) < 2:
            continue
        raw = b"".join(g.column("codes").to_pylist())
        size = len(raw) // len(rep)
        words, keys = wide_codes([raw[i : i + size] for i in range(0, len(raw), size)], int(dim[x]), bits, tables)
        part = block_of(rep, int(s[x]))
        a, b = np.flatnonzero(part == lo[x]), np.flatnonzero(part == hi[x])
        some = open_rows(words, keys, int(slot[x]) >> 32, bits * tables, a, b, least)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), group)), pa.array(rep[some]), pa.array(np.full(len(some), slot[x])), pa.array(part[some] == lo[x]), pa.array(part[some] == hi[x])], names=["group", "rep", "slot", "low", "high"])
            group += 1


def block_of(rep: np.ndarray, blocks: int) -> np.ndarray:
    """The block of a crowded bucket that a vector belongs to."""
    h = rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(blocks)).astype(np.int64)


def compared(t: dict, a: np.ndarray, b: np.ndarray, table: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (the first one smaller if both lists are the same) of rows ``a`` with rows ``b`` that meet in no earlier table."""
    d = t["d"]
    code = np.unpackbits(t["code"][b], axis=1, count=d).astype(np.float32) * 2 - 1
    factor = t["factor"][b]
    bound = SIGMAS * math.sqrt(1 - least * least) * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(1, d - 1))
    turned = (t["unit"][a] @ rotation(d, 0)).astype(np.float32)
    out = []
    for s in range(0, len(a), 512):
        est = turned[s : s + 512] @ code.T / (math.sqrt(d) * factor)
        i, j = np.nonzero(est + bound >= least - 1e-6)
        i, j = a[s + i], b[j]
        keep = (i != j) & (~(t["both"][i] & t["both"][j]) | (i < j))
        i, j = i[keep], j[keep]
        for c in range(0, len(i), 200_000):
            x, y = i[c : c + 200_000], j[c : c + 200_000]
            ok = np.einsum("ij,ij->i", t["unit"][x], t["unit"][y]) >= least
            x, y = x[ok], y[ok]
            new = np.ones(len(x), bool)
            for k in range(table):
                new &= t["keys"][x, k] != t["keys"][y, k]
            out.append(np.column_stack([x[new], y[new]]))
    pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def linked(batches: Iterator[pa.RecordBatch], bits: int, tables: int, least: float) -> Iterator[pa.RecordBatch]:
    """(id, n, to) of one stretch of groups: links counted at each end, and a spanning forest of them as edges."""
    counts: dict[int, int] = {}
    forest: list[np.ndarray] = []

    def settle(g: pa.Table) -> None:
        d, slot, rep = g.column("d")[0].as_py(), g.column("slot")[0].as_py(), g.column("rep").to_numpy()
        raw, n = b"".join(g.column("x").to_pylist()), g.num_rows
        x = np.frombuffer(raw, np.float32 if len(raw) == 4 * d * n else np.float64).reshape(-1, d).astype(np.float64)
        x = x / np.abs(x).max(1)[:, None]
        codes = g.column("code").to_pylist()
        low, high = (g.column(c).to_numpy(zero_copy_only=False) for c in ("low", "high"))
        t = {"d": d, "unit": x / np.linalg.norm(x, axis=1)[:, None], "code": np.frombuffer(b"".join(codes), np.uint8).reshape(n, -1), "factor": g.column("factor").to_numpy().astype(np.float64), "keys": wide_codes(codes, d, bits, tables)[1], "both": low & high}
        i, j = compared(t, np.flatnonzero(low), np.flatnonzero(high), slot >> 32, least)
        if not len(i):
            return
        w = g.column("m").to_numpy()
        total = np.bincount(i, w[j], n) + np.bincount(j, w[i], n)
        for k in np.flatnonzero(total):
            counts[int(rep[k])] = counts.get(int(rep[k]), 0) + int(total[k])
        root = union_find(n, np.column_stack([i, j]))
        some = np.flatnonzero(root != np.arange(n))
        forest.append(np.column_stack([rep[some], rep[root[some]]]))

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        g = b.column("group").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
        for s, e in zip(edges, edges[1:]):
            if held and held[0].column("group")[0].as_py() != int(g[s]):
                settle(pa.Table.from_batches(held))
                held = []
            held.append(b.slice(s, e - s))
    if held:
        settle(pa.Table.from_batches(held))
    pairs = np.unique(np.concatenate(forest), axis=0) if forest else np.zeros((0, 2), np.int64)
    keys, values = np.fromiter(counts, np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))
    n = len(keys) + len(pairs)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[keys, pairs[:, 0]]), pa.array(np.r_[values, np.zeros(len(pairs), np.int64)]), pa.array(np.r_[keys, pairs[:, 1]], mask=np.arange(n) < len(keys))], names=["id", "n", "to"])


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", least: float = 0.95) -> DataFrame:
    """One row a vector: ``vec_id, n_links, component_id, kept``.

    Null, empty and zero vectors and those with a null or non-finite component link with nothing; vectors of different
    lengths don't link; rows that repeat a vector are links of each other. Without an id a vector links with nothing. An
    empty table gives none; other columns are ignored. Ids are integers.
    """
    spark = vectors.sparkSession
    bits, tables = layout(vectors.count(), least)
    signed = cut(coded(vectors.where(F.col(key).isNotNull()), key, embedding, bits, tables))
    # Equal vectors are one class of so many members.
    classes = cut(signed.groupBy("d", "same").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("x").alias("x"), F.first("code").alias("code"), F.first("factor").alias("factor")))
    slots = dealt(classes, bits, tables)
    sizes = slots.groupBy("d", "slot").agg(F.sum("n").alias("n"))
    crowded = cut(sizes.where(F.col("n") > BLOCK).select("d", "slot", F.ceil(F.col("n") / BLOCK).cast("int").alias("s")))
    few = F.broadcast(crowded) if crowded.count() <= BROADCAST_ROWS else crowded
    # Every pair of blocks of a crowded bucket is a bucket of its own; a row goes where one of its vectors' blocks belongs.
    rows = slots.join(few, ["d", "slot"], "left").withColumn("s", F.coalesce("s", F.lit(1)))
    rows = split_rows(rows).repartition(n_parts(spark), "slot", "lo", "hi", "d").sortWithinPartitions("slot", "lo", "hi", "d")
    groups = cut(rows.mapInArrow(lambda it: opened(it, bits, tables, least), "group long, rep long, slot long, low boolean, high boolean"))
    vecs = groups.join(classes.select("rep", "d", "m", "x", "code", "factor"), "rep").repartition(n_parts(spark), "group").sortWithinPartitions("group")
    found = cut(vecs.mapInArrow(lambda it: linked(it, bits, tables, least), "id long, n long, to long"))
    counts = found.where("to is null").groupBy("id").agg(F.sum("n").alias("n"))
    done = connected(found.where("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b")))
    per = classes.select("d", "same", "rep", "m").join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(done.withColumnRenamed("id", "rep"), "rep", "left")
    per = per.select("d", "same", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    linked_rows = signed.select("vec_id", "d", "same").join(per, ["d", "same"]).select("vec_id", "n", "component")
    alone = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).alias("_v"))
    bad = alone.where(F.col("vec_id").isNull() | F.col("_v").isNull() | (F.size("_v") == 0) | F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("_v", lambda x: x != 0))
    every = linked_rows.unionByName(bad.select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("component")))
    return every.select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("vec_id"), F.lit(True)).alias("kept"))


def split_rows(rows: DataFrame) -> DataFrame:
    """(d, slot, s, lo, hi, reps, codes): rows of crowded buckets taken apart by blocks, each block once for every block it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["d", "slot", "s", "lo", "hi", "reps", "codes"]
        for b in batches:
            s = b.column("s").to_numpy()
            plain = np.flatnonzero(s == 1)
            if len(plain):
                p = b.take(pa.array(plain))
                zero = pa.array(np.zeros(len(plain), np.int64))
                yield pa.RecordBatch.from_arrays([p.column("d"), p.column("slot"), p.column("s"), zero, zero, p.column("reps"), p.column("codes")], names=names)
            for i in np.flatnonzero(s > 1):
                reps, raw = np.frombuffer(b.column("reps")[i].as_py(), np.int64), b.column("codes")[i].as_py()
                codes = np.frombuffer(raw, np.uint8).reshape(len(reps), -1)
                part, n = block_of(reps, int(s[i])), int(s[i])
                out = []
                for k in np.unique(part):
                    some = part == k
                    r, c = reps[some].tobytes(), codes[some].tobytes()
                    out += [(int(min(k, o)), int(max(k, o)), r, c) for o in range(n)]
                lo, hi, r, c = zip(*out)
                k = len(out)
                yield pa.RecordBatch.from_arrays([pa.array([b.column("d")[i].as_py()] * k, pa.int32()), pa.array([b.column("slot")[i].as_py()] * k, pa.int64()), pa.array([n] * k, pa.int32()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(r, pa.binary()), pa.array(c, pa.binary())], names=names)

    return rows.select("d", "slot", "s", "reps", "codes").mapInArrow(run, "d int, slot long, s int, lo long, hi long, reps binary, codes binary")
