"""Inverse affine gather. The map is separable, so a target row reads one source row (two when bilinear), found by equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import bits


def source_row(y: Column) -> Column:
    return (y - F.col("ty")) / F.col("scale")


def source_col(x: Column | int) -> Column:
    """Source column of target column x, as a real number; mirrored about the valid width under a flip."""
    sx = ((F.lit(float(x)) if isinstance(x, int) else x) - F.col("tx")) / F.col("scale")
    return F.when(F.col("hflip"), F.col("wv") - 1 - sx).otherwise(sx)


def carried(df: DataFrame, w: int, outer: bool = False) -> DataFrame:
    """Words of the source (``sk``, ``src_bits``) as words of the target (``k``, ``bits``), nearest neighbour.

    The map is monotone along a scanline, so a stretch of set pixels becomes a stretch: its ends are found by arithmetic, whatever
    the width. Rows of one target word are disjoint. With ``outer`` rows without a pixel stay, as word 0 without one.
    """
    some = df.withColumn("_r", (F.explode_outer if outer else F.explode)(bits.runs(F.col("src_bits"))))
    first, last = F.col("sk") * bits.WORD + F.col("_r.a"), F.col("sk") * bits.WORD + F.col("_r.b")
    flip = F.col("hflip")
    near = lambda x: F.rint(source_col(x))
    begins = lambda x: F.when(flip, near(x) <= last).otherwise(near(x) >= first)
    ends = lambda x: F.when(flip, near(x) >= first).otherwise(near(x) <= last)
    # Half a pixel before the first and after the last source column, give or take one for ties and rounding.
    lo = F.ceil(F.when(flip, F.col("wv") - 1 - last - 0.5).otherwise(first - 0.5) * F.col("scale") + F.col("tx"))
    hi = F.floor(F.when(flip, F.col("wv") - 1 - first + 0.5).otherwise(last + 0.5) * F.col("scale") + F.col("tx"))
    some = some.withColumn("_lo", lo).withColumn("_hi", hi)
    x1 = F.when(begins(F.col("_lo") - 1), F.col("_lo") - 1).when(begins(F.col("_lo")), F.col("_lo")).otherwise(F.col("_lo") + 1)
    x2 = F.when(ends(F.col("_hi") + 1), F.col("_hi") + 1).when(ends(F.col("_hi")), F.col("_hi")).otherwise(F.col("_hi") - 1)
    some = some.withColumn("_x1", F.greatest(F.lit(0), x1).cast("int")).withColumn("_x2", (F.least(F.lit(w - 1), x2) + 1).cast("int"))
    put = F.when(F.col("_r").isNotNull() & (F.col("_x1") < F.col("_x2")), bits.words(F.col("_x1"), F.col("_x2")))
    return some.withColumn("_w", (F.explode_outer if outer else F.explode)(put)).withColumn("k", F.coalesce("_w.k", F.lit(0))).withColumn("bits", F.coalesce("_w.bits", bits.zero())).drop("_r", "_lo", "_hi", "_x1", "_x2", "_w")


def boxes(slots: DataFrame) -> DataFrame:
    """Boxes where they land: mirrored about the valid width, then scaled and moved."""
    left = F.when(F.col("hflip"), F.col("wv") - 1 - F.col("x2")).otherwise(F.col("x1"))
    right = F.when(F.col("hflip"), F.col("wv") - 1 - F.col("x1")).otherwise(F.col("x2"))
    to = lambda v, t: v * F.col("scale") + F.col(t)
    return slots.select("*", to(left, "tx").alias("wx1"), to(F.col("y1"), "ty").alias("wy1"), to(right, "tx").alias("wx2"), to(F.col("y2"), "ty").alias("wy2"))


def rows_between(top: Column, bottom: Column, height: int) -> Column:
    """The target rows that may read source rows from ``top`` to ``bottom``; empty if none lies on the canvas."""
    lo = F.greatest(F.lit(0), F.floor((top - 1) * F.col("scale") + F.col("ty"))).cast("int")
    hi = F.least(F.lit(height - 1), F.ceil((bottom + 1) * F.col("scale") + F.col("ty"))).cast("int")
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def masks(slots: DataFrame, rows: DataFrame, h: int, w: int) -> DataFrame:
    """(sample_id, slot, label, instance_id, y, k, bits) of valid paste slots, nearest neighbour, clear outside the source.

    A word may have several rows, which are disjoint.
    """
    at = slots.where("paste_valid").withColumn("y", F.explode(rows_between(F.col("y1"), F.col("y2"), h))).withColumn("sy", F.rint(source_row(F.col("y"))).cast("int"))
    src = bits.keyed(rows).select(F.col("sample_id").alias("src_id"), "slot", F.col("y").alias("sy"), F.col("k").alias("sk"), F.col("bits").alias("src_bits"))
    out = carried(at.join(src, ["src_id", "slot", "sy"]), w)
    return out.select("sample_id", "slot", "label", "instance_id", "y", "k", "bits")


def shown(rows: DataFrame, h: int, w: int) -> DataFrame:
    """Rows of sources that stand beside their placements (``sy, sk, src_bits`` and those of :func:`placement.place`), seen from the
    target: adds ``y, k, bits``. Nothing is joined, so rows stay with their target; a word may have several rows, which are disjoint.
    """
    near = lambda y: F.rint(source_row(y)).cast("int") == F.col("sy")
    return carried(rows.withColumn("y", F.explode(F.filter(rows_between(F.col("sy"), F.col("sy"), h), near))), w)


def label_bits(placed: DataFrame, labels: DataFrame, h: int, w: int) -> DataFrame:
    """A label layer of the source, bitmaps per class, seen from the target."""
    at = placed.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(h - 1)))).withColumn("sy", F.rint(source_row(F.col("y"))).cast("int"))
    src = bits.keyed(labels).select(F.col("sample_id").alias("src_id"), F.col("y").alias("sy"), "class_id", F.col("k").alias("sk"), F.col("bits").alias("src_bits"))
    return carried(at.join(src, ["src_id", "sy"]), w).select("sample_id", "y", "k", "class_id", "bits")


def gate_bits(placed: DataFrame, valid: DataFrame, h: int, w: int) -> DataFrame:
    """A validity bitmap (sample_id, y, k, ok) of the source seen from the target; outside is invalid. Rows of a word are disjoint."""
    at = placed.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(h - 1)))).withColumn("sy", F.rint(source_row(F.col("y"))).cast("int"))
    src = bits.keyed(valid).where("ok <> 0").select(F.col("sample_id").alias("src_id"), F.col("y").alias("sy"), F.col("k").alias("sk"), F.col("ok").alias("src_bits"))
    return carried(at.join(src, ["src_id", "sy"], "left"), w, outer=True).select("sample_id", "y", "k", F.col("bits").alias("ok"))


def bilinear(placed: DataFrame, pixels: DataFrame, h: int, w: int, vals: str = "vals", by: tuple[str, ...] = ("ch",)) -> DataFrame:
    """(sample_id, y, by..., vals): four taps, each zero outside the source."""
    spot = placed.withColumn("sx", F.transform(F.sequence(F.lit(0), F.lit(w - 1)), lambda x: source_col(x))).withColumn("x0", F.transform("sx", lambda s: F.floor(s).cast("int")))
    at = spot.select("sample_id", "src_id", "ty", "scale", "sx", "x0", F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("y")).withColumn("sy", source_row(F.col("y"))).withColumn("y0", F.floor("sy").cast("int")).withColumn("fy", F.col("sy") - F.col("y0"))
    # Both rows of a target row meet in one aggregate; a row without either on the canvas is all zeros.
    near = at.withColumn("tap", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("ry", F.col("y0") + F.col("tap"))
    src = pixels.select(F.col("sample_id").alias("src_id"), F.col("y").alias("ry"), *by, F.col(vals).alias("row"))
    got = near.where((F.col("ry") >= 0) & (F.col("ry") < h)).join(src, ["src_id", "ry"])
    keep = ("sample_id", "y", *by)
    # Along a row first: every tap is one interpolated row, so the aggregate only has two rows to weigh.
    tap = lambda i: F.coalesce(F.when(i >= 0, F.get("row", i)), F.lit(0.0))
    line = F.zip_with("sx", "x0", lambda s, i: (1 - (s - i)) * tap(i) + (s - i) * tap(i + 1))
    got = got.select(*keep, "tap", "fy", line.alias("line"))
    some = got.groupBy(*keep).agg(F.first("fy").alias("fy"), F.max(F.when(F.col("tap") == 0, F.col("line"))).alias("r0"), F.max(F.when(F.col("tap") == 1, F.col("line"))).alias("r1"))
    zero = F.array_repeat(F.lit(0.0), w)
    return some.select(*keep, F.zip_with(F.coalesce("r0", zero), F.coalesce("r1", zero), lambda a, b: (1 - F.col("fy")) * a + F.col("fy") * b).alias("vals"))


def normals_flip(rows: DataFrame, ch: str = "ch", vals: str = "vals") -> DataFrame:
    """Mirrored rows turn the x component's sign; lengths are left as sampled."""
    return rows.withColumn(vals, F.when(F.col("hflip") & (F.col(ch) == 0), F.transform(vals, lambda v: -v)).otherwise(F.col(vals)))
