"""Ranks without a window over a whole table: counts of stretches of the key, then ranks within each stretch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, order: str, stretch: Column, *by: str, name: str = "rank") -> DataFrame:
    """``df`` with a long rank from 0 by ``order`` within ``by``. ``stretch`` numbers parts of the key that follow each other.

    Rows are windowed by stretch only. The stretches' counts, one row each, are summed up in an array a group of ``by``.
    """
    part = df.withColumn("_stretch", stretch.cast("long"))
    counts = part.groupBy(*by, "_stretch").agg(F.count("*").alias("_n"))
    every = counts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_stretch", "_n"))).alias("_all"))
    # The running total as a fold: each stretch with the rows before it.
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<_stretch:bigint,_before:bigint>>").alias("out"))
    fold = F.aggregate("_all", start, lambda acc, s: F.struct((acc["at"] + s["_n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(s["_stretch"].alias("_stretch"), acc["at"].alias("_before")))).alias("out")), lambda acc: acc["out"])
    before = every.select(*by, F.explode(fold).alias("s")).select(*by, "s.*")
    within = F.row_number().over(Window.partitionBy(*by, "_stretch").orderBy(order)) - 1
    return part.withColumn("_within", within).join(before, [*by, "_stretch"]).withColumn(name, (F.col("_before") + F.col("_within")).cast("long")).drop("_stretch", "_within", "_before")
