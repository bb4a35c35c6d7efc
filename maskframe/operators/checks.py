"""The invariants as relations: one row (sample_id, name, ok, n_bad) a sample and check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import bits
from .composite import tight_boxes


def report(name: str, ids: DataFrame, bad: DataFrame) -> DataFrame:
    """A report for every sample of ``ids``; ``bad`` has (sample_id, n_bad) of those that break the rule."""
    return ids.select("sample_id").join(bad.select("sample_id", F.col("n_bad").cast("long").alias("n_bad")), "sample_id", "left").select("sample_id", F.lit(name).alias("name"), (F.coalesce("n_bad", F.lit(0)) == 0).alias("ok"), F.coalesce("n_bad", F.lit(0)).cast("long").alias("n_bad"))


def counted(df: DataFrame, condition: Column) -> DataFrame:
    return df.groupBy("sample_id").agg(F.sum(condition.cast("long")).alias("n_bad"))


def identity(ids: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """A mask that lies within masks from before must share its label with one of them.

    Masks are compared by the rows both have: contained means that as many rows meet, each without a pixel outside.
    """
    before, after = bits.keyed(before), bits.keyed(after)
    # A word may have several rows, so words are put together before they are counted.
    after = after.groupBy("sample_id", "slot", "label", "y", "k").agg(F.bit_or("bits").alias("bits"))
    a = after.where("bits <> 0").select("sample_id", F.col("slot").alias("a"), F.col("label").alias("la"), "y", "k", F.col("bits").alias("ab"))
    a = a.withColumn("rows", F.count("*").over(Window.partitionBy("sample_id", "a")))
    b = before.select("sample_id", F.col("slot").alias("b"), F.col("label").alias("lb"), "y", "k", F.col("bits").alias("bb"))
    # Both sides' words are put under each other, so that they stay with their sample: a word's few masks meet in its arrays.
    every = a.select(*bits.LINE, F.struct("a", "la", "ab", "rows").alias("after")).unionByName(b.select(*bits.LINE, F.struct("b", "lb", "bb").alias("before")), allowMissingColumns=True)
    met = every.groupBy(*bits.LINE).agg(F.collect_list("after").alias("after"), F.collect_list("before").alias("before")).where(F.size("before") > 0)
    met = met.select("sample_id", "before", F.explode("after").alias("a")).select("sample_id", "a.*", F.explode("before").alias("b")).select("sample_id", "a", "la", "ab", "rows", "b.*")
    meet = met.where(bits.without(F.col("ab"), F.col("bb")) == 0).groupBy("sample_id", "a", "b", "la", "lb", "rows").agg(F.count("*").alias("met"))
    within = meet.where("met = rows")
    per = within.groupBy("sample_id", "a").agg(F.bool_or(F.col("la") == F.col("lb")).alias("same"))
    return report("instance.identity_preserved", ids, counted(per, ~F.col("same")))


def subtracts_union(ids: DataFrame, masks: DataFrame, paste: DataFrame) -> DataFrame:
    """No mask lies on both sides of the union of the pastes."""
    j = bits.keyed(masks).join(bits.keyed(paste), bits.LINE, "left").withColumn("paste", F.coalesce("paste", F.lit(0).cast("long")))
    per = j.groupBy("sample_id", "slot").agg(F.bool_or(F.col("bits").bitwiseAND(F.col("paste")) != 0).alias("i"), F.bool_or(bits.without(F.col("bits"), F.col("paste")) != 0).alias("o"))
    return report("instance.target_masks_subtract_paste_union", ids, counted(per, F.col("i") & F.col("o")))


def boxes_fit(ids: DataFrame, inst: DataFrame, rows: DataFrame, atol: float = 1.0, rtol: float = 1e-5) -> DataFrame:
    """Boxes are those of the masks, to a pixel."""
    t = tight_boxes(rows, "sample_id", "slot").select("sample_id", "slot", *[F.col(c).alias(f"t{c}") for c in ("x1", "y1", "x2", "y2")])
    j = inst.join(t, ["sample_id", "slot"])
    off = reduce(lambda a, b: a | b, [F.abs(F.col(c) - F.col(f"t{c}")) > atol + rtol * F.abs(F.col(f"t{c}")) for c in ("x1", "y1", "x2", "y2")])
    return report("instance.bbox_recomputed_from_mask", ids, counted(j, off))


def no_small(ids: DataFrame, areas: DataFrame, tau: Column | int) -> DataFrame:
    t = F.lit(tau) if isinstance(tau, int) else tau
    return report("instance.small_area_dropped", ids, counted(areas, F.col("area") < t))


def no_overlap(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """Masks of a class don't overlap: their areas add up to the area of their union."""
    per = bits.keyed(rows).groupBy("sample_id", "label", "y", "k").agg((F.sum(F.bit_count("bits")) - F.bit_count(F.bit_or("bits"))).alias("over"))
    per = per.groupBy("sample_id", "label", "y").agg(F.max("over").alias("over"))
    return report("instance.no_same_class_overlap", ids, per.groupBy("sample_id").agg(F.sum((F.col("over") > 0).cast("long")).alias("n_bad")))


def thing_stuff(ids: DataFrame, semantic: DataFrame, things: DataFrame, is_thing: Column, ignore: int = 255) -> DataFrame:
    """A pixel has no instance exactly if its class is background; ignored pixels don't count.

    ``things`` has (sample_id, y, z): the pixels with an instance.
    """
    j = bits.keyed(semantic).where(F.col("class_id") != ignore).join(bits.keyed(things), bits.LINE, "left").withColumn("z", F.coalesce("z", F.lit(0).cast("long")))
    wrong = F.when(is_thing, bits.without(F.col("bits"), F.col("z"))).otherwise(F.col("bits").bitwiseAND(F.col("z")))
    return report("panoptic.thing_stuff_consistent", ids, j.groupBy("sample_id").agg(F.sum(F.bit_count(wrong)).alias("n_bad")))


def bijection(ids: DataFrame, things: DataFrame, rows: DataFrame) -> DataFrame:
    """Every pixel with an instance lies in exactly one mask: none uncovered, none covered twice."""
    z = bits.keyed(things)
    # Only what masks have where there are instances counts.
    on = bits.keyed(rows).join(z, bits.LINE).withColumn("bits", F.col("bits").bitwiseAND(F.col("z")))
    per = on.groupBy(*bits.LINE).agg(F.bit_or("bits").alias("any"), F.sum(F.bit_count("bits")).alias("sum"))
    j = z.join(per, bits.LINE, "left")
    any_ = F.coalesce("any", F.lit(0).cast("long"))
    per = j.groupBy("sample_id", "y").agg(F.sum(F.bit_count(bits.without(F.col("z"), any_))).alias("bare"), F.max(F.when(F.col("sum") > F.bit_count(any_), 1).otherwise(0)).alias("twice"))
    return report("panoptic.pixel_bijection", ids, per.groupBy("sample_id").agg(F.sum(F.col("bare") + F.col("twice")).alias("n_bad")))


def fresh_ids(ids: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids that weren't there are larger than all that were; 0 is background."""
    new = after.where("instance_id <> 0").join(before.select("sample_id", "instance_id"), ["sample_id", "instance_id"], "left_anti").select("sample_id", "instance_id").distinct()
    top = before.groupBy("sample_id").agg(F.max("instance_id").alias("top"))
    return report("panoptic.fresh_instance_ids", ids, counted(new.join(top, "sample_id"), F.col("instance_id") <= F.col("top")))


def stuff_area(ids: DataFrame, before: DataFrame, after: DataFrame, stuff: Column, tau: int) -> DataFrame:
    """A background class neither vanishes from above ``tau`` pixels nor lives on with up to ``tau``."""
    j = before.where(stuff).withColumnRenamed("area", "pre").join(after.withColumnRenamed("area", "post"), ["sample_id", "class_id"], "left").withColumn("post", F.coalesce("post", F.lit(0)))
    return stuff_areas(ids, j, F.lit(True), tau)


def stuff_areas(ids: DataFrame, both: DataFrame, stuff: Column, tau: int) -> DataFrame:
    """As :func:`stuff_area`, of the areas before and after in one relation (``pre``, ``post``)."""
    j = both.where(stuff & (F.col("pre") > 0))
    return report("panoptic.stuff_area_threshold", ids, counted(j, ((F.col("post") == 0) & (F.col("pre") > tau)) | ((F.col("post") > 0) & (F.col("post") <= tau))))


def single_class(ids: DataFrame, semantic: DataFrame) -> DataFrame:
    """One class a pixel: the classes' bitmaps don't overlap."""
    per = bits.keyed(semantic).groupBy(*bits.LINE).agg((F.sum(F.bit_count("bits")) - F.bit_count(F.bit_or("bits"))).alias("over"))
    return report("semantic.single_class_per_pixel", ids, per.groupBy("sample_id").agg(F.sum("over").alias("n_bad")))


def ignore_kept(ids: DataFrame, before: DataFrame, after: DataFrame, ignore: int = 255) -> DataFrame:
    """Ignored pixels stay ignored."""
    b = bits.keyed(before).where(F.col("class_id") == ignore).select(*bits.LINE, F.col("bits").alias("b"))
    a = bits.keyed(after).where(F.col("class_id") == ignore).select(*bits.LINE, F.col("bits").alias("a"))
    j = b.join(a, bits.LINE, "left")
    return report("semantic.ignore_preserved", ids, j.groupBy("sample_id").agg(F.sum(F.bit_count(bits.without(F.col("b"), F.coalesce("a", F.lit(0).cast("long"))))).alias("n_bad")))


def depth_monotone(ids: DataFrame, lines: DataFrame, w: int) -> DataFrame:
    """Inside the effective mask the depth is the smaller of both. ``lines``: sample_id, y, mask, src, tgt, out."""
    from_ = F.col("k") * bits.WORD if "k" in lines.columns else F.lit(0)
    spot = lambda c, x: F.get(c, from_ + x)
    wrong = bits.where(min(w, bits.WORD), lambda x: F.coalesce(spot("out", x) != F.least(spot("src", x), spot("tgt", x)), F.lit(False)))
    return report("depth.monotonicity", ids, lines.groupBy("sample_id").agg(F.sum(F.bit_count(wrong.bitwiseAND(F.col("mask")))).alias("n_bad")))


def depth_join(ids: DataFrame, lines: DataFrame) -> DataFrame:
    """Validity inside the mask is that of both sides, outside that of the target. ``lines``: sample_id, y, mask, src_ok, tgt_ok, out_ok."""
    want = F.col("mask").bitwiseAND(F.col("src_ok")).bitwiseAND(F.col("tgt_ok")).bitwiseOR(bits.without(F.col("tgt_ok"), F.col("mask")))
    return report("depth.validity_join", ids, lines.groupBy("sample_id").agg(F.sum(F.bit_count(want.bitwiseXOR(F.col("out_ok")))).alias("n_bad")))


def metric_rescaled(ids: DataFrame, rows: DataFrame, atol: float = 1e-5, rtol: float = 1e-5) -> DataFrame:
    """Depth follows the focal lengths: d * sqrt(fxt*fyt) / sqrt(fxs*fys). ``rows``: sample_id, d, out, fxt, fyt, fxs, fys."""
    want = F.col("d") * F.sqrt(F.col("fxt") * F.col("fyt")) / F.sqrt(F.col("fxs") * F.col("fys"))
    return report("depth.metric_intrinsics_rescale", ids, counted(rows, F.abs(F.col("out") - want) > atol + rtol * F.abs(want)))


def unit_normals(ids: DataFrame, rows: DataFrame, atol: float = 1e-5) -> DataFrame:
    """Normals have length one where they're valid. ``rows``: sample_id, nx, ny, nz, valid."""
    norm = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    return report("normals.unit_norm_on_valid", ids, counted(rows.where("valid"), F.abs(norm - 1) > atol))


def camera_frame(ids: DataFrame, rows: DataFrame, h: int, w: int) -> DataFrame:
    """Three channels of h rows of w values. ``rows``: sample_id, ch, y, vals."""
    per = rows.groupBy("sample_id").agg(F.count_distinct("ch").alias("c"), F.count_distinct("ch", "y").alias("n"), F.min(F.size("vals")).alias("lo"), F.max(F.size("vals")).alias("hi"))
    return report("normals.camera_frame_convention", ids, per.select("sample_id", (~((F.col("c") == 3) & (F.col("n") == 3 * h) & (F.col("lo") == w) & (F.col("hi") == w))).cast("long").alias("n_bad")))


def summary(*reports: DataFrame) -> DataFrame:
    """(name, n, n_ok, n_bad) over all samples."""
    every = reduce(DataFrame.unionByName, reports)
    return every.groupBy("name").agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("long")).alias("n_ok"), F.sum("n_bad").alias("n_bad"))


def outcomes(*reports: DataFrame) -> DataFrame:
    """(sample_id, ok): whether a sample passed all its checks."""
    return reduce(DataFrame.unionByName, reports).groupBy("sample_id").agg(F.bool_and("ok").alias("ok"))


#: Which layers a check needs on both sides, and whether it needs the audit of the paste.
GATES: dict[str, tuple[frozenset[str], bool]] = {
    "semantic.single_class_per_pixel": (frozenset({"semantic"}), False),
    "semantic.ignore_preserved": (frozenset({"semantic"}), False),
    "instance.no_same_class_overlap": (frozenset({"instance"}), False),
    "instance.identity_preserved": (frozenset({"instance"}), False),
    "instance.bbox_recomputed_from_mask": (frozenset({"instance"}), True),
    "instance.target_masks_subtract_paste_union": (frozenset({"instance"}), True),
    "instance.small_area_dropped": (frozenset({"instance"}), True),
    "panoptic.pixel_bijection": (frozenset({"panoptic", "instance"}), False),
    "panoptic.fresh_instance_ids": (frozenset({"panoptic"}), True),
    "panoptic.thing_stuff_consistent": (frozenset({"panoptic", "semantic"}), True),
    "panoptic.stuff_area_threshold": (frozenset({"panoptic", "semantic"}), True),
    "depth.monotonicity": (frozenset({"depth"}), True),
    "depth.validity_join": (frozenset({"depth"}), True),
    "normals.camera_frame_convention": (frozenset({"normals"}), False),
    "normals.unit_norm_on_valid": (frozenset({"normals"}), False),
}


def applicable(layers: set[str], audit: bool) -> list[str]:
    """The checks that run for layers active on both sides."""
    return [name for name, (need, with_audit) in GATES.items() if need <= layers and (audit or not with_audit)]


def per_sample(reports: DataFrame, layers: DataFrame, audit: bool = True) -> DataFrame:
    """Reports of the checks that apply to each sample; ``layers`` has (sample_id, layers)."""
    gates = [F.struct(F.lit(n).alias("name"), F.array(*[F.lit(x) for x in sorted(need)]).alias("need")) for n, (need, w) in GATES.items() if audit or not w]
    want = layers.select("sample_id", "layers", F.explode(F.array(*gates)).alias("g")).where(F.size(F.array_except("g.need", "layers")) == 0).select("sample_id", "g.name")
    return reports.join(want, ["sample_id", "name"], "left_semi")
