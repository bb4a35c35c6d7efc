"""Choosing a source for each target and placing its instances: an equi-join by computed position, never a cross join."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor, gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rng


@dataclass(frozen=True)
class Placement:
    """How sources are drawn and placed; unknown fields are refused by the constructor."""

    scale: tuple[float, float] = (0.5, 2.0)
    hflip: float = 0.5
    paste: float = 1.0
    k_range: tuple[int, int] = (1, 256)
    patch: int | None = None
    seed: int = 0

    def __post_init__(self) -> None:
        if not 0 < self.scale[0] <= self.scale[1]:
            raise ValueError("scale bounds must be positive and in order")
        if not (0 <= self.hflip <= 1 and 0 <= self.paste <= 1):
            raise ValueError("probabilities lie in [0, 1]")
        if not 0 <= self.k_range[0] <= self.k_range[1]:
            raise ValueError("k_range bounds must be in order")


def offdiagonal(samp: DataFrame, seed: int = 0) -> DataFrame:
    """Adds ``src_pos``: uniform over the other samples of the batch; null where a sample is alone."""
    step = F.floor(rng.uniform(f"src{seed}", "sample_id") * (F.col("n") - 1))
    return samp.withColumn("src_pos", F.when(F.col("n") > 1, F.pmod(F.col("pos") + 1 + step, F.col("n"))).cast("long"))


def cyclic(samp: DataFrame) -> DataFrame:
    """Adds ``src_pos``: the next sample of the batch, the first after the last; null where a sample is alone."""
    return samp.withColumn("src_pos", F.when(F.col("n") > 1, F.pmod(F.col("pos") + 1, F.col("n"))).cast("long"))


def random_subset(inst: DataFrame, seed: int = 0) -> DataFrame:
    """(sample_id, slot): the distinct ones of as many draws with replacement as a sample has instances."""
    n = inst.groupBy("sample_id").agg(F.count("*").alias("m"))
    d = n.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    return d.select("sample_id", F.floor(rng.uniform(f"subset{seed}", "sample_id", "draw") * F.col("m")).cast("long").alias("slot")).distinct()


def scale_draw(c: Placement, *key: str) -> Column:
    lo, hi = c.scale
    return F.lit(lo) + rng.uniform(f"scale{c.seed}", *key) * F.lit(hi - lo)


def aligned_grid(c: Placement, h: int, w: int) -> tuple[float, int, int]:
    """(quantum, first, last): multiples of the quantum map whole patches to whole patches; an empty grid is an error."""
    q = c.patch / gcd(h, w)
    first, last = max(ceil(c.scale[0] / q), 1), floor(c.scale[1] / q)
    if last < first:
        raise ValueError("no scale in the range is aligned with the patches")
    return q, first, last


def aligned_scale_draw(c: Placement, h: int, w: int, *key: str) -> Column:
    q, first, last = aligned_grid(c, h, w)
    return rng.integer(f"scale{c.seed}", first, last, *key) * F.lit(q)


def aligned_scale(c: Placement) -> Column:
    """As :func:`aligned_scale_draw`, by each canvas's own size (``h``, ``w``); without a scale in the range it is an error."""
    # The largest divisor of the patch that divides both sides times what of them divides further: gcd(h, w) by Euclid's steps.
    pair = F.struct(F.col("h").cast("long").alias("a"), F.col("w").cast("long").alias("b"))
    g = F.aggregate(F.sequence(F.lit(1), F.lit(64)), pair, lambda p, _: F.when(p["b"] == 0, p).otherwise(F.struct(p["b"].alias("a"), F.pmod(p["a"], F.greatest(p["b"], F.lit(1).cast("long"))).alias("b"))), lambda p: p["a"])
    q = F.lit(float(c.patch)) / g
    first, last = F.greatest(F.ceil(F.lit(c.scale[0]) / q), F.lit(1).cast("long")), F.floor(F.lit(c.scale[1]) / q)
    drawn = rng.integer(f"scale{c.seed}", first, last, "sample_id") * q
    return F.when(last < first, F.raise_error(F.lit("no scale in the range is aligned with the patches")).cast("double")).otherwise(drawn)


def flipped_right(x1: Column, x2: Column, wv: Column, hflip: Column) -> Column:
    """The right edge as it counts for placing: mirrored about the valid width under a flip."""
    return F.when(hflip, wv - 1 - x1).otherwise(x2)


def place(samp: DataFrame, inst: DataFrame, c: Placement = Placement(), eligible: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(placements, paste_slots): one row a target, and one row a target and source slot.

    Placements carry ``src_id, scale, hflip, ty, tx, hv, wv`` (valid extent of the source); slots carry the source box and
    label and ``paste_valid``. Targets alone in their batch have neither.
    """
    drawn = offdiagonal(samp, c.seed).where("src_pos is not null").select("batch_id", "pos", "sample_id", "src_pos", "h", "w")
    view = samp.select("batch_id", F.col("pos").alias("src_pos"), F.col("sample_id").alias("src_id"), "hv", "wv")
    drawn = drawn.join(view, ["batch_id", "src_pos"])
    scale = aligned_scale(c) if c.patch else scale_draw(c, "sample_id")
    drawn = drawn.withColumn("scale", scale).withColumn("hflip", rng.uniform(f"flip{c.seed}", "sample_id") < c.hflip).withColumn("do_paste", rng.uniform(f"paste{c.seed}", "sample_id") < c.paste).withColumn("kmax", rng.integer(f"k{c.seed}", c.k_range[0], c.k_range[1], "sample_id"))
    ok = eligible if eligible is not None else F.lit(True)
    src = inst.select(F.col("sample_id").alias("src_id"), "slot", "label", "instance_id", "x1", "y1", "x2", "y2", ok.alias("eligible"))
    on = drawn.join(src, "src_id", "left").withColumn("right", flipped_right(F.col("x1"), F.col("x2"), F.col("wv"), F.col("hflip")))
    w = Window.partitionBy("sample_id")
    room = lambda size, edge: F.greatest(F.lit(0.0), F.col(size) - F.coalesce(F.max(F.col(edge) * F.col("scale")).over(w), F.lit(0.0)))
    snap = lambda t: F.floor(t / c.patch) * float(c.patch) if c.patch else t
    on = on.withColumn("ty", snap(rng.uniform(f"ty{c.seed}", "sample_id") * room("h", "y2"))).withColumn("tx", snap(rng.uniform(f"tx{c.seed}", "sample_id") * room("w", "right")))
    fits = (F.col("y2") * F.col("scale") + F.col("ty") <= F.col("h")) & (F.col("right") * F.col("scale") + F.col("tx") <= F.col("w"))
    inside = (F.col("y2") <= F.col("hv")) & (F.col("x2") <= F.col("wv"))
    on = on.withColumn("gate", F.coalesce(F.col("eligible") & fits & inside & F.col("do_paste"), F.lit(False)))
    nth = F.sum(F.col("gate").cast("int")).over(w.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    on = on.withColumn("paste_valid", F.col("gate") & (nth <= F.col("kmax")))
    placed = on.groupBy("sample_id").agg(*[F.first(x).alias(x) for x in ("batch_id", "src_id", "scale", "hflip", "ty", "tx", "hv", "wv", "kmax")])
    return placed, on.where("slot is not null").select("sample_id", "src_id", "slot", "label", "instance_id", "x1", "y1", "x2", "y2", "right", "scale", "hflip", "ty", "tx", "h", "w", "hv", "wv", "kmax", "gate", "paste_valid")


def valid_extent(padding: DataFrame, width: int) -> DataFrame:
    """(sample_id, hv, wv) from padding bitmaps (sample_id, y, pad): rows and columns that hold a pixel that isn't padding."""
    from .. import bits

    # Columns that are live in some line, and lines that have a live pixel in some word.
    live = bits.keyed(padding).withColumn("live", bits.without(bits.full(width, F.col("k")), F.col("pad"))).where("live <> 0")
    wide = live.groupBy("sample_id", "k").agg(F.bit_or("live").alias("any"), F.collect_set("y").alias("ys"))
    return padding.select("sample_id").distinct().join(wide, "sample_id", "left").groupBy("sample_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ys")))).alias("hv"), F.coalesce(F.sum(F.bit_count("any")), F.lit(0)).cast("int").alias("wv"))


def bank_place(targets: DataFrame, bank: DataFrame, n_bank: int, crop: tuple[int, int], c: Placement = Placement()) -> DataFrame:
    """A bank crop for each target: uniform pick, crop at the origin, its box the whole crop; no cap on pastes.

    ``bank`` has ``idx`` from 0 to ``n_bank - 1`` and ``class_id``; the room to move bounds the place, so every crop fits
    that is not larger than the canvas when scaled.
    """
    h, w = crop
    t = targets.withColumn("idx", F.floor(rng.uniform(f"bank{c.seed}", "sample_id") * n_bank).cast("long")).withColumn("scale", scale_draw(c, "sample_id")).withColumn("hflip", rng.uniform(f"flip{c.seed}", "sample_id") < c.hflip)
    room = lambda edge, canvas: F.greatest(F.lit(0.0), F.col(canvas) - F.lit(float(edge)) * F.col("scale"))
    t = t.withColumn("ty", rng.uniform(f"ty{c.seed}", "sample_id") * room(h, "h")).withColumn("tx", rng.uniform(f"tx{c.seed}", "sample_id") * room(w, "w"))
    fits = (F.lit(float(h)) * F.col("scale") <= F.col("h")) & (F.lit(float(w)) * F.col("scale") <= F.col("w"))
    return t.withColumn("paste_valid", fits & (rng.uniform(f"paste{c.seed}", "sample_id") < c.paste)).join(bank, "idx")
