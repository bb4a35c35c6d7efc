"""Preprocessing plans: resize, crop, padding and sanitising, as projections and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import bits, rng
from .composite import tight_boxes


def resize_plan(samp: DataFrame, low: float, high: float, th: int, tw: int, seed: int = 0) -> DataFrame:
    """Adds ``k, nh, nw``: a scale drawn relative to the target size; sizes round half to even."""
    s = F.lit(low) + rng.uniform(f"resize{seed}", "sample_id") * F.lit(high - low)
    k = F.least(F.lit(float(th)) * s / F.col("h"), F.lit(float(tw)) * s / F.col("w"))
    return samp.withColumn("k", k).withColumn("nh", F.rint(F.col("h") * F.col("k")).cast("long")).withColumn("nw", F.rint(F.col("w") * F.col("k")).cast("long"))


def crop_plan(sized: DataFrame, th: int, tw: int, seed: int = 0) -> DataFrame:
    """Adds the crop's place (bounds included), what of the image is in it, and how much is filled."""
    top = rng.integer(f"cropy{seed}", F.lit(0), F.greatest(F.lit(0), F.col("nh") - th), "sample_id")
    left = rng.integer(f"cropx{seed}", F.lit(0), F.greatest(F.lit(0), F.col("nw") - tw), "sample_id")
    c = sized.withColumn("top", top).withColumn("left", left).withColumn("ch", F.least(F.lit(th), F.col("nh"))).withColumn("cw", F.least(F.lit(tw), F.col("nw")))
    return c.withColumn("fill_rows", F.lit(th) - F.col("ch")).withColumn("fill_cols", F.lit(tw) - F.col("cw"))


def large_scale_jitter(samp: DataFrame, size: int | tuple[int, int], low: float = 0.1, high: float = 2.0, seed: int = 0) -> DataFrame:
    """Resize and crop in one plan; one number is a square."""
    th, tw = (size, size) if isinstance(size, int) else size
    return crop_plan(resize_plan(samp, low, high, th, tw, seed), th, tw, seed)


#: What a crop beyond the image is filled with, by layer.
CROP_FILL = {"image": 0, "padding": 1, "instance": 0, "semantic": 255, "panoptic": 255}
#: What padding to a multiple fills with, by layer; the image reflects instead where it can.
PAD_FILL = {"image": 0, "instance": 0, "semantic": 255, "panoptic": 255, "depth": 0, "depth_valid": 0, "normals": 0, "padding": 1}


def crop_masks(rows: DataFrame, plan: DataFrame, tw: int, th: int) -> DataFrame:
    """Mask rows inside the crop: rows shift by ``top``, pixels by ``left``, what lies beyond is cut; fill is clear.

    A source word falls into two target words at most; rows of one word are disjoint.
    """
    j = bits.keyed(rows).join(plan.select("sample_id", "top", "left"), "sample_id").withColumn("y", (F.col("y") - F.col("top")).cast("int")).where((F.col("y") >= 0) & (F.col("y") < th))
    spot = F.col("k") * bits.WORD - F.col("left")
    first, shift = F.floor(spot / bits.WORD).cast("int"), F.pmod(spot, F.lit(bits.WORD)).cast("int")
    low = F.call_function("shiftleft", F.col("bits"), shift).bitwiseAND(bits.full(bits.WORD))
    high = F.call_function("shiftright", F.col("bits"), F.lit(bits.WORD) - shift)
    two = F.array(F.struct(first.alias("k"), low.alias("bits")), F.struct((first + 1).alias("k"), high.alias("bits")))
    keep = [c for c in j.columns if c not in ("k", "bits", "top", "left")]
    out = j.select(*keep, F.explode(two).alias("w")).select(*keep, "w.k", "w.bits").where((F.col("k") >= 0) & (F.col("k") < bits.n_words(tw)))
    return out.withColumn("bits", F.col("bits").bitwiseAND(bits.full(tw, F.col("k")))).where("bits <> 0")


def crop_values(vals: Column, left: Column, tw: int, fill: float) -> Column:
    """A scanline's crop, filled on the right."""
    part = F.slice(vals, left.cast("int") + 1, tw)
    return F.concat(part, F.array_repeat(F.lit(fill), F.lit(tw) - F.size(part)))


def sanitize_boxes(inst: DataFrame, least: float = 1.0) -> DataFrame:
    return inst.where((F.col("x2") - F.col("x1") >= least) & (F.col("y2") - F.col("y1") >= least))


def sanitize_instances(rows: DataFrame, least: int = 10) -> DataFrame:
    """(sample_id, slot, label, box, area): tight boxes of the instances whose mask has at least ``least`` pixels."""
    if least < 0:
        raise ValueError("the least area can't be negative")
    return tight_boxes(rows, "sample_id", "slot", "label").where(F.col("area") >= least)


def pad_plan(samp: DataFrame, p: int) -> DataFrame:
    """Adds the rows and columns that bring a canvas to multiples of ``p``, at the bottom and right only."""
    if p <= 0:
        raise ValueError("the multiple must be positive")
    d = samp.withColumn("pad_h", F.pmod(-F.col("h"), F.lit(p))).withColumn("pad_w", F.pmod(-F.col("w"), F.lit(p)))
    # Reflection needs more pixels than it adds.
    return d.withColumn("reflect", (F.col("pad_h") < F.col("h")) & (F.col("pad_w") < F.col("w"))).withColumn("changed", (F.col("pad_h") > 0) | (F.col("pad_w") > 0))


def reflected(x: Column, w: Column) -> Column:
    """The pixel that padding column ``x`` (from ``w`` on) repeats."""
    return F.when(x < w, x).otherwise(2 * (w - 1) - x)


def pad_values(vals: Column, w: int, pad: int) -> Column:
    """A scanline with ``pad`` pixels more: reflected, or zero where there aren't enough to reflect."""
    if pad >= w:
        return F.concat(vals, F.array_repeat(F.lit(0.0), pad))
    return F.concat(vals, F.reverse(F.slice(vals, w - pad, pad))) if pad else vals
