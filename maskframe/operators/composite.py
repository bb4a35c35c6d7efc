"""Mask algebra and compositing on scanline bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import bits


def union(warped: DataFrame) -> DataFrame:
    """(sample_id, y, k, paste): OR of the warped masks; words without any are absent."""
    return bits.keyed(warped).groupBy(*bits.LINE).agg(F.bit_or("bits").alias("paste"))


def effective(paste: Column, src: Column, tgt: Column, tgt_ok: Column, src_pad: Column | None, w: int, k: Column | None = None) -> Column:
    """The paste mask (a word) after the depth test: nearer than the target, or the target's depth is invalid; source padding never pastes.

    ``src`` and ``tgt`` are whole scanlines, ``k`` the number of the word.
    """
    from_ = F.lit(0) if k is None else k * bits.WORD
    spot = lambda vals, x: F.get(vals, from_ + x)
    nearer = bits.where(min(w, bits.WORD), lambda x: F.coalesce(spot(src, x) < spot(tgt, x), F.lit(False)))
    m = paste.bitwiseAND(nearer.bitwiseOR(F.bitwise_not(tgt_ok)))
    return m if src_pad is None else bits.without(m, src_pad)


def select_values(mask: Column, src: Column, tgt: Column, w: int) -> Column:
    """Source values where the mask is set, target values elsewhere. ``mask``: one word, or the words of a scanline (:func:`bits.lines`)."""
    return F.transform(tgt, lambda v, x: F.when(bits.at(mask, x) == 1, F.get(src, x)).otherwise(v))


def select_line(mask: Column, src: Column, tgt: Column) -> Column:
    """As :func:`select_values`, for scanlines of any width: ``mask`` has the words of :func:`bits.lines`."""
    return F.transform(tgt, lambda v, x: F.when(bits.pixel(mask, x), F.get(src, x)).otherwise(v))


def select_labels(target: DataFrame, source: DataFrame, mask: DataFrame) -> DataFrame:
    """A label layer after the paste: target bitmaps outside the mask, the source's inside; one aggregate joins the two."""
    target, source, mask = map(bits.keyed, (target, source, mask))
    old = target.join(mask, bits.LINE, "left").select(*bits.LINE, "class_id", bits.without(F.col("bits"), F.coalesce("paste", F.lit(0).cast("long"))).alias("bits"))
    new = source.join(mask, bits.LINE).select(*bits.LINE, "class_id", F.col("bits").bitwiseAND(F.col("paste")).alias("bits"))
    return old.unionByName(new).where("bits <> 0").groupBy(*bits.LINE, "class_id").agg(F.bit_or("bits").alias("bits"))


def depth_valid(paste: Column, src_ok: Column, tgt_ok: Column) -> Column:
    """Inside the raw paste mask both must be valid; outside the target's validity holds."""
    return paste.bitwiseAND(src_ok).bitwiseAND(tgt_ok).bitwiseOR(bits.without(tgt_ok, paste))


def beside(rows: DataFrame, paste: DataFrame) -> DataFrame:
    """``rows`` with the paste mask of their word, 0 without one. Both are put under each other: what is dealt by sample stays there."""
    rows = bits.keyed(rows)
    every = rows.withColumn("_row", F.lit(True)).unionByName(bits.keyed(paste).select(*bits.LINE, "paste", F.lit(False).alias("_row")), allowMissingColumns=True)
    met = every.withColumn("paste", F.coalesce(F.bit_or("paste").over(Window.partitionBy(*bits.LINE)), bits.zero()))
    return met.where("_row").select(*rows.columns, "paste")


def survivors(rows: DataFrame, paste: DataFrame) -> DataFrame:
    """Target masks less what was pasted; rows that vanish keep bits 0, so that areas count them."""
    return beside(rows, paste).withColumn("bits", bits.without(F.col("bits"), F.col("paste"))).drop("paste")


def survivor_area(rows: DataFrame, paste: DataFrame) -> DataFrame:
    """(sample_id, slot, label, before, after): areas of the target masks, both sums over one partitioning."""
    left = beside(rows, paste).withColumn("rest", bits.without(F.col("bits"), F.col("paste")))
    return left.groupBy("sample_id", "slot", "label").agg(F.sum(F.bit_count("bits")).alias("before"), F.sum(F.bit_count("rest")).alias("after"))


def kept_targets(areas: DataFrame, frac: float = 0.1) -> DataFrame:
    """Targets of which at least ``frac`` of the area is left; all of them if ``frac`` isn't positive."""
    return areas.where(F.col("after") >= F.lit(frac) * F.col("before")) if frac > 0 else areas


def drop_and_merge(rows: DataFrame, warped: DataFrame, frac: float, slots: int) -> DataFrame:
    """(sample_id, slot, label, instance_id, y, k, bits): targets less what was pasted, those kept of :func:`kept_targets`, and the pastes
    in the slots that :func:`merge_slots` gives them.

    Both sides' words are dealt by sample once, or not at all if they are so already; union, areas, drop and merge are windows there.
    """
    cols = ["sample_id", "slot", "label", "instance_id", "y", "k", "bits"]
    slot = F.col("slot").cast("long").alias("slot")
    side = lambda df, pasted: bits.keyed(df).withColumn("slot", slot).select(*cols, F.lit(pasted).alias("pasted"))
    every = side(rows, False).unionByName(side(warped, True))
    over = lambda *by: Window.partitionBy("sample_id", *by)
    # The widest window comes first, so that the others find the words dealt by sample.
    every = every.withColumn("pastes", F.array_sort(F.collect_set(F.when(F.col("pasted") & (F.col("bits") != 0), F.col("slot"))).over(over())))
    paste = F.bit_or(F.when(F.col("pasted"), F.col("bits"))).over(over("y", "k"))
    cut = F.when(F.col("pasted"), F.col("bits")).otherwise(bits.without(F.col("bits"), F.coalesce(paste, F.lit(0).cast("long"))))
    every = every.withColumn("left", cut)
    if frac > 0:
        of = over("pasted", "slot")
        every = every.withColumn("before", F.sum(F.bit_count("bits")).over(of)).withColumn("after", F.sum(F.bit_count("left")).over(of)).where(F.col("pasted") | (F.col("after") >= F.lit(frac) * F.col("before")))
    held = F.collect_set(F.when(~F.col("pasted"), F.col("slot"))).over(over())
    every = every.where("not pasted or bits <> 0").withColumn("free", F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long")), held))
    # The n-th paste goes to the n-th free slot; surplus ones find none.
    to = F.when(F.col("pasted"), F.get("free", F.array_position("pastes", F.col("slot")).cast("int") - 1)).otherwise(F.col("slot"))
    return every.select("sample_id", to.alias("slot"), "label", "instance_id", "y", "k", F.col("left").alias("bits")).where("slot is not null and bits <> 0")


def merge_slots(kept: DataFrame, pasted: DataFrame, slots: int) -> DataFrame:
    """(sample_id, slot, src_slot): the n-th paste goes to the n-th slot that is free after the drop; surplus pastes go.

    ``kept`` holds the surviving (sample_id, slot) and ``pasted`` the valid (sample_id, slot) of the pastes.
    """
    held = kept.groupBy("sample_id").agg(F.collect_set(F.col("slot").cast("int")).alias("held"))
    n = F.row_number().over(Window.partitionBy("sample_id").orderBy("slot"))
    want = pasted.select("sample_id", F.col("slot").alias("src_slot"), n.alias("nth"))
    # A sample's slots are a short array: the n-th free one is looked up, without a row for every slot.
    free = F.array_except(F.sequence(F.lit(0), F.lit(slots - 1)), F.coalesce("held", F.array().cast("array<int>")))
    at = want.join(held, "sample_id", "left").withColumn("free", free)
    return at.where(F.col("nth") <= F.size("free")).select("sample_id", F.element_at("free", F.col("nth")).cast("long").alias("slot"), "src_slot")


def visible(rows: DataFrame) -> DataFrame:
    """Mask rows of which only what later slots don't cover is left: the last mask wins."""
    rows = bits.keyed(rows)
    later = Window.partitionBy(*bits.LINE).orderBy(F.col("slot").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("bits", bits.without(F.col("bits"), F.coalesce(F.bit_or("bits").over(later), F.lit(0).cast("long"))))


def label_layer(lines: DataFrame, rows: DataFrame, default: Column, w: int) -> DataFrame:
    """Class bitmaps: the default class with the instances' labels painted over it in slot order.

    ``lines`` has a row for every scanline (sample_id, y); ``default`` is a column of it.
    """
    rows = bits.keyed(rows)
    own = visible(rows).where("bits <> 0").groupBy(*bits.LINE, F.col("label").alias("class_id")).agg(F.bit_or("bits").alias("bits"))
    any_ = rows.groupBy(*bits.LINE).agg(F.bit_or("bits").alias("any"))
    every = lines.withColumn("k", F.explode(bits.numbers(w)) if w > bits.WORD else F.lit(0))
    rest = every.join(any_, bits.LINE, "left").select(*bits.LINE, default.alias("class_id"), bits.without(bits.full(w, F.col("k")), F.coalesce("any", F.lit(0).cast("long"))).alias("bits"))
    return own.unionByName(rest.where("bits <> 0")).groupBy(*bits.LINE, "class_id").agg(F.bit_or("bits").alias("bits"))


def painted(rows: DataFrame) -> DataFrame:
    """Two label layers of each sample in one pass: ``rows`` (sample_id, side, slot, class_id, y, k, bits, valid) paint the target's (side
    0) and the source's as the target sees it (side 1), later slots over earlier ones; the valid ones of side 1 are what is pasted.

    Adds ``paste``, ``seen`` (what of a row later slots leave) and ``after`` (what of it there is in the layer after the paste).
    Rows dealt by sample stay where they are.
    """
    later = Window.partitionBy(*bits.LINE, "side").orderBy(F.col("slot").desc()).rowsBetween(Window.unboundedPreceding, -1)
    paste = F.bit_or(F.when(F.col("valid"), F.col("bits"))).over(Window.partitionBy(*bits.LINE))
    met = rows.withColumn("paste", F.coalesce(paste, bits.zero())).withColumn("seen", bits.without(F.col("bits"), F.coalesce(F.bit_or("bits").over(later), bits.zero())))
    return met.withColumn("after", F.when(F.col("side") == 0, bits.without(F.col("seen"), F.col("paste"))).otherwise(F.col("seen").bitwiseAND(F.col("paste"))))


def given_back(rows: DataFrame, stuff: Column, tau: float) -> DataFrame:
    """:func:`painted` rows whose ``after`` has background classes given back that fell below ``tau`` of their area."""
    of = Window.partitionBy("sample_id", "class_id")
    own = F.when(F.col("side") == 0, F.col("seen")).otherwise(bits.zero())
    gone = stuff & (F.col("pre") > 0) & (F.col("post") < F.lit(tau) * F.col("pre"))
    rows = rows.withColumn("pre", F.sum(F.bit_count(own)).over(of)).withColumn("post", F.sum(F.bit_count("after")).over(of)).withColumn("gone", gone)
    back = F.bit_or(F.when(F.col("gone"), own.bitwiseAND(F.col("paste")))).over(Window.partitionBy(*bits.LINE))
    rows = rows.withColumn("back", F.coalesce(back, bits.zero()))
    after = F.when(F.col("side") == 1, bits.without(F.col("after"), F.col("back"))).when(F.col("gone"), F.col("seen")).otherwise(F.col("after"))
    return rows.withColumn("after", after)


def histograms(rows: DataFrame) -> DataFrame:
    """(sample_id, class_id, pre, post, under): areas of the classes before and after the paste, and what of those before it covers."""
    own = F.when(F.col("side") == 0, F.col("seen")).otherwise(bits.zero())
    return rows.groupBy("sample_id", "class_id").agg(F.sum(F.bit_count(own)).alias("pre"), F.sum(F.bit_count("after")).alias("post"), F.sum(F.bit_count(own.bitwiseAND(F.col("paste")))).alias("under"))


def shrunk(both: DataFrame, stuff: Column, tau: float) -> DataFrame:
    """As :func:`collapsed`, of the :func:`histograms` of both layers."""
    return both.where(stuff & (F.col("pre") > 0) & (F.col("post") < F.lit(tau) * F.col("pre")))


def histogram(labels: DataFrame) -> DataFrame:
    return labels.groupBy("sample_id", "class_id").agg(F.sum(F.bit_count("bits")).alias("area"))


def collapsed(before: DataFrame, after: DataFrame, stuff: Column, tau: float) -> DataFrame:
    """(sample_id, class_id, pre, post) of background classes that fell below ``tau`` of their area."""
    j = before.where(stuff).withColumnRenamed("area", "pre").join(after.withColumnRenamed("area", "post"), ["sample_id", "class_id"], "left").withColumn("post", F.coalesce("post", F.lit(0)))
    return j.where((F.col("pre") > 0) & (F.col("post") < F.lit(tau) * F.col("pre"))).select("sample_id", "class_id", "pre", "post")


def revert_rows(labels: DataFrame, gone: DataFrame, paste: DataFrame) -> DataFrame:
    """(sample_id, y, k, revert): pixels of the paste mask whose class before the paste collapsed."""
    own = bits.keyed(labels).join(gone.select("sample_id", "class_id"), ["sample_id", "class_id"], "left_semi").groupBy(*bits.LINE).agg(F.bit_or("bits").alias("own"))
    return own.join(bits.keyed(paste), bits.LINE).select(*bits.LINE, F.col("own").bitwiseAND(F.col("paste")).alias("revert")).where("revert <> 0")


def tight_boxes(rows: DataFrame, *by: str) -> DataFrame:
    """Tight boxes with inclusive maxima, of the masks that have a pixel."""
    word = F.col("k") * bits.WORD
    some = bits.keyed(rows).where("bits <> 0").groupBy(*by).agg(F.min(word + bits.first(F.col("bits"))).alias("x1"), F.min("y").alias("y1"), F.max(word + bits.last(F.col("bits"))).alias("x2"), F.max("y").alias("y2"), F.sum(F.bit_count("bits")).alias("area"))
    return some.select(*by, "x1", "y1", "x2", "y2", "area")


def fresh_ids(before: DataFrame, pasted: DataFrame) -> DataFrame:
    """(sample_id, slot, instance_id): pastes numbered on from the largest id of their target."""
    top = before.groupBy("sample_id").agg(F.max("instance_id").alias("top"))
    n = F.row_number().over(Window.partitionBy("sample_id").orderBy("slot"))
    return pasted.withColumn("nth", n).join(top, "sample_id", "left").select("sample_id", "slot", (F.coalesce("top", F.lit(0)) + F.col("nth")).alias("instance_id"))


def survivor_rule(areas: DataFrame, least: int = 50, most_gone: float = 0.99) -> DataFrame:
    """The per-sample kernel's rule for survivors: some area, at least ``least``, and not more than ``most_gone`` of it lost."""
    lost = 1 - F.col("after") / (F.col("before") + F.lit(1e-8))
    return areas.withColumn("keep", (F.col("after") > 0) & (F.col("after") >= least) & (lost <= most_gone))
