"""Batches: ragged to rectangular and back, and the conditions under which samples may share one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def batches(samp: DataFrame, layers: str = "layers", intrinsics: str = "has_intrinsics") -> DataFrame:
    """One row a batch: its samples, whether they agree in size and layers, and whether all of them have intrinsics."""
    return samp.groupBy("batch_id").agg(F.count("*").alias("n"), F.count_distinct("h", "w").alias("sizes"), F.count_distinct(layers).alias("layer_sets"), F.bool_and(intrinsics).alias("intrinsics"))


def batch_violations(per_batch: DataFrame) -> DataFrame:
    from ..model import violations

    return violations(per_batch, {"one_size": F.col("sizes") == 1, "one_layer_set": F.col("layer_sets") == 1}, "batch_id")


def padded(samp: DataFrame, inst: DataFrame, slots: int, **fill: object) -> DataFrame:
    """Every sample with slots 0 to ``slots - 1``; those without an instance are invalid and zero."""
    rest = [c for c in inst.columns if c not in ("sample_id", "slot")]
    own = inst.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("slot", *rest))).alias("own"))
    # Slots are made where a sample meets its instances, so that they don't travel.
    out = samp.select("sample_id").join(own, "sample_id", "left").select("sample_id", "own", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("at"))
    one = F.get("own", F.col("at"))
    return out.select("sample_id", F.col("at").cast("long").alias("slot"), *[F.coalesce(one[c], F.lit(0)).alias(c) for c in rest], F.coalesce(F.col("at") < F.size("own"), F.lit(False)).alias("valid"))


def overflow(inst: DataFrame, slots: int) -> DataFrame:
    """Samples with more instances than slots: padding refuses them."""
    return inst.groupBy("sample_id").agg(F.count("*").alias("n")).where(F.col("n") > slots)


def compact(pad: DataFrame) -> DataFrame:
    """Valid slots only, numbered anew in slot order."""
    n = Window.partitionBy("sample_id").orderBy("slot")
    return pad.where("valid").withColumn("slot", (F.row_number().over(n) - 1).cast("long")).drop("valid")


def all_or_none(samp: DataFrame, present: dict[str, Column]) -> DataFrame:
    """(batch_id, layer, n, present) of layers that some samples of a batch have and others don't."""
    one = samp.select("batch_id", F.explode(F.array(*[F.struct(F.lit(k).alias("layer"), c.cast("int").alias("has")) for k, c in present.items()])).alias("l")).select("batch_id", "l.*")
    return one.groupBy("batch_id", "layer").agg(F.count("*").alias("n"), F.sum("has").alias("present")).where((F.col("present") > 0) & (F.col("present") < F.col("n")))


def collate(samp: DataFrame, inst: DataFrame, slots: int = 32) -> tuple[DataFrame, DataFrame]:
    """The padded relation, and the samples that don't fit in it."""
    return padded(samp, inst, slots), overflow(inst, slots)


def to_record(df: DataFrame, *cols: str) -> DataFrame:
    """One JSON text a row; null layers are left out."""
    return df.select("sample_id", F.to_json(F.struct(*cols), {"ignoreNullFields": "true"}).alias("record"))


def from_record(df: DataFrame, schema: str) -> DataFrame:
    """Back from JSON; keys the schema doesn't name are ignored."""
    return df.select("sample_id", F.from_json("record", schema).alias("r")).select("sample_id", "r.*")
