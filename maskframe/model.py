"""Relations, their schemas, and validation as a relation of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the label layers.
IGNORE_INDEX, MAX_INSTANCES = 255, 256

SAMPLES = "batch_id long, pos long, n long, sample_id long, h int, w int, hv int, wv int"
INSTANCES = "sample_id long, slot long, label long, instance_id long, x1 double, y1 double, x2 double, y2 double, valid boolean"
#: Bit x of word ``k`` is pixel (k * bits.WORD + x, y); empty words are not stored.
MASK_ROWS = "sample_id long, slot long, y int, k int, bits long"
#: A label layer as one bitmap per scanline word and class.
LABEL_BITS = "sample_id long, y int, k int, class_id long, bits long"
PIXEL_ROWS = "sample_id long, y int, ch int, vals array<double>"
BANK = "idx long, class_id long, image binary, alpha binary, embedding array<float>"
LAYERS = ("image", "instance", "panoptic", "semantic", "depth", "normals")


def violations(df: DataFrame, rules: dict[str, Column], *keys: str) -> DataFrame:
    """(keys, rule): one row for each rule whose condition a row breaks; a null condition counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(*keys, F.explode(broken).alias("rule"))


def strict(df: DataFrame, found: DataFrame) -> DataFrame:
    """``df``, unless there are violations: then an error. The one place that acts on data, for callers who ask for it."""
    first = found.take(3)
    if first:
        raise ValueError(f"violations: {[r.asDict() for r in first]}")
    return df


def sample_rules() -> dict[str, Column]:
    depth, metric, has_intrinsics = F.col("has_depth"), F.col("metric_depth"), F.col("has_intrinsics")
    return {"depth_needs_validity": depth == F.col("has_depth_valid"), "masks_need_ids": F.col("has_masks") == F.col("has_ids"), "metric_needs_intrinsics": ~(metric & depth) | has_intrinsics}


def active_layers(df: DataFrame, present: dict[str, Column], name: str = "layers") -> DataFrame:
    """Adds the array of layers whose column is present, in layer order."""
    return df.withColumn(name, F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in present.items()])))


def every(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)
