"""Samples without a file: two squares that don't overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rng

SIDE = 16


def make(spark: SparkSession, seed: int, count: int, size: int = 64) -> tuple[DataFrame, DataFrame]:
    """(samples, instances): one square in each half, labels 1 and 2; boxes end after the last pixel."""
    if count < 1:
        raise ValueError("at least one sample")
    return squares(spark.range(count).select(F.col("id").alias("sample_id")), seed, size)


def squares(ids: DataFrame, seed: int, size: int = 64) -> tuple[DataFrame, DataFrame]:
    """The same for every ``sample_id`` of a table."""
    if size < 2 * SIDE:
        raise ValueError(f"a canvas of at least {2 * SIDE} pixels")
    s = ids.select("sample_id", F.lit(size).alias("h"), F.lit(size).alias("w"))
    half = size // 2
    draw = lambda name, lo, hi: rng.integer(name, lo, hi, F.col("sample_id") + seed)
    one = [F.struct(F.lit(i).cast("long").alias("slot"), F.lit(i + 1).cast("long").alias("label"), draw(f"x{i}", i * half, i * half + half - SIDE).alias("x1"), draw(f"y{i}", 0, size - SIDE).alias("y1")) for i in range(2)]
    inst = s.select("sample_id", F.explode(F.array(*one)).alias("i")).select("sample_id", "i.*")
    return s, inst.select("*", (F.col("x1") + SIDE).alias("x2"), (F.col("y1") + SIDE).alias("y2"), F.col("slot").cast("int").alias("instance_id"))
