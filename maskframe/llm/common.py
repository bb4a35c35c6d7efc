"""Helpers shared by the operators: lineage cuts, sizing, hashing and connected components."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every contract: space and the controls from tab to return.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: A-Z to a-z on UTF-8 bytes; bytes of longer sequences are untouched.
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, local sessions (tests) get one of their own;
    a cluster without it is an error, since its executors share no temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder: later stages reread the files, also after executors are lost."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def n_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def held_out(key: str, mod: int) -> F.Column:
    """True where crc32 of the key's decimal text leaves remainder 2; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % mod == 2


def texts_of(column: pa.Array) -> list[str]:
    """Whole texts, null as empty."""
    return [x or "" for x in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """Whole texts as UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of ``column``, so that long texts don't pile up in a worker."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(np.fromiter((len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column).cast(pa.large_binary())), np.int64, batch.num_rows)) if batch.nbytes > most else None
        if sizes is None or sizes[-1] <= most:
            yield batch
            continue
        cuts = [0, *np.flatnonzero(np.diff(sizes // most)) + 1, batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


#: Edges (16 bytes each) up to this number are joined up in one task; more of them in rounds over all tasks.
TASK_EDGES = 1_000_000


def joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of all the edges (u, v) of one task."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    ids, at = np.unique(np.concatenate([t.column("u").to_numpy(), t.column("v").to_numpy()]), return_inverse=True)
    root = union_find(len(ids), at.reshape(2, -1).T)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["id", "component"])


def connected(edges: DataFrame, rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """Components of an undirected graph: (id, component), the smallest id reachable.

    A counted, small number of edges is one task's union-find. Beyond it large-star and small-star contraction alternate,
    natively and with partial minima, so that a vertex of any degree is one aggregate and a join that adaptive execution can
    split; each round is checkpointed. Both give the same rows. ``edges`` has the long columns ``a`` and ``b``; loops,
    repeats and either order are accepted. Only ids that have an edge are returned.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    if edges.count() <= task_edges:
        return edges.coalesce(1).mapInArrow(joined_up, "id long, component long")
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with a long ``rank`` from 0 in the given order, found by range partitions and their counts, not in one task.

    ``df`` should be checkpointed; the counts that reach the driver are one per partition.
    """
    spark = df.sparkSession
    placed = cut(df.repartitionByRange(n_parts(spark), *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    start, at = [], 0
    for part in sorted(counts):
        start.append((part, at))
        at += counts[part]
    offsets = F.broadcast(spark.createDataFrame(start, "_part int, _start long"))  # one row a partition
    return placed.join(offsets, "_part").withColumn("rank", (F.col("_row") + F.col("_start")).cast("long")).drop("_part", "_row", "_start")


def union_find(n: int, pairs: np.ndarray) -> np.ndarray:
    """Roots (the smallest index of each set) of ``n`` items joined by ``pairs`` (two columns of indices)."""
    root = list(range(n))
    for a, b in pairs.tolist():
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        while root[b] != b:
            root[b] = root[root[b]]
            b = root[b]
        if a != b:
            root[max(a, b)] = min(a, b)
    for i in range(n):
        root[i] = root[root[i]]
    return np.array(root, np.int64)
