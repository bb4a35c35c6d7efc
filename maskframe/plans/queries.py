"""One query an operator: a callable of (session, directory), and the DuckDB SQL of the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bits, model, rng
from ..operators import checks, composite, containers, harmonize, placement, prep, sampling, stats, warp
from ..sources import testdata as td
from .oracle import gathered, sql, u
from .relations import Catalogue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function of a :class:`Catalogue` under its name."""

    def put(f: Callable[[Catalogue], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: one_word(f(Catalogue(spark, sf_dir)))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def one_word(df: DataFrame) -> DataFrame:
    """The catalogue's canvases have one word a scanline, so its number is left out of scanlines."""
    return df.drop("k") if "y" in df.columns else df


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def present() -> dict:
    return {"image": F.lit(True), "instance": F.col("sample_id") % 7 != 0, "panoptic": F.col("sample_id") % 3 == 0, "semantic": F.col("sample_id") % 2 == 0, "depth": F.col("sample_id") % 5 < 2, "normals": F.col("sample_id") % 5 == 0}


# ---- containers


@query("select o_orderkey as sample_id, 1 + (o_orderkey % 7 <> 0)::int + (o_orderkey % 3 = 0)::int + (o_orderkey % 2 = 0)::int + (o_orderkey % 5 < 2)::int + (o_orderkey % 5 = 0)::int as n_layers, concat_ws(',', 'image', case when o_orderkey % 7 <> 0 then 'instance' end, case when o_orderkey % 3 = 0 then 'panoptic' end, case when o_orderkey % 2 = 0 then 'semantic' end, case when o_orderkey % 5 < 2 then 'depth' end, case when o_orderkey % 5 = 0 then 'normals' end) as layers from orders")
def active_layers(c: Catalogue) -> DataFrame:
    return model.active_layers(c.ids, present()).select("sample_id", F.size("layers").alias("n_layers"), F.array_join("layers", ",").alias("layers"))


@query(sql("select i.sample_id, i.slot, coalesce(s.label, 0) as label, coalesce(s.x1, 0) as x1, coalesce(s.y2, 0) as y2, s.slot is not null as valid from (select sample_id, unnest(range(0, 20)) as slot from samp) i left join inst s using (sample_id, slot)", "samp", "inst"))
def collate_padded(c: Catalogue) -> DataFrame:
    return containers.padded(c.samples, c.instances.select("sample_id", "slot", "label", "x1", "y2"), 20).select("sample_id", "slot", "label", "x1", "y2", "valid")


@query("select l_orderkey as sample_id, count(*) as n from lineitem group by 1 having count(*) > 8")
def collate_overflow_violations(c: Catalogue) -> DataFrame:
    return containers.overflow(c.instances, 8)


@query(sql("select sample_id, row_number() over (partition by sample_id order by slot) - 1 as slot, label from inst where label % 3 <> 0", "inst"))
def unpad_roundtrip(c: Catalogue) -> DataFrame:
    pad = containers.padded(c.samples, c.instances.select("sample_id", "slot", "label"), 20)
    return containers.compact(pad.withColumn("valid", F.col("valid") & (F.col("label") % 3 != 0))).select("sample_id", "slot", "label")


@query(sql("select batch_id, count(*) as n, 1 as sizes, count(distinct (sample_id % 3 = 0)) as layer_sets, bool_and(sample_id % 11 <> 0) as intrinsics from samp group by 1", "samp"))
def batch_ragged(c: Catalogue) -> DataFrame:
    s = c.samples.withColumn("layers", F.when(F.col("sample_id") % 3 == 0, "a").otherwise("b")).withColumn("has_intrinsics", F.col("sample_id") % 11 != 0)
    return containers.batches(s)


@query(sql("select batch_id, 'one_layer_set' as rule from samp group by 1 having count(distinct (sample_id % 3 = 0)) <> 1", "samp"))
def batch_violations(c: Catalogue) -> DataFrame:
    s = c.samples.withColumn("layers", F.when(F.col("sample_id") % 3 == 0, "a").otherwise("b")).withColumn("has_intrinsics", F.lit(True))
    return containers.batch_violations(containers.batches(s))


@query(sql("select batch_id, 'depth' as layer, count(*) as n, sum((sample_id % 5 < 2)::int)::bigint as present from samp group by 1 having sum((sample_id % 5 < 2)::int) between 1 and count(*) - 1", "samp"))
def stack_all_or_none(c: Catalogue) -> DataFrame:
    return containers.all_or_none(c.samples, {"image": F.lit(True), "depth": F.col("sample_id") % 5 < 2})


@query("select o_orderkey as sample_id, unnest(list_filter([case when o_orderkey % 5 = 1 then 'depth_needs_validity' end, case when o_orderkey % 7 = 3 then 'masks_need_ids' end, case when o_orderkey % 4 = 0 and o_orderkey % 3 <> 0 then 'metric_needs_intrinsics' end], lambda x: x is not null)) as rule from orders")
def sample_violations(c: Catalogue) -> DataFrame:
    k = F.col("sample_id")
    s = c.ids.select("sample_id", F.lit(True).alias("has_depth"), (k % 5 != 1).alias("has_depth_valid"), F.lit(True).alias("has_masks"), (k % 7 != 3).alias("has_ids"), (k % 4 == 0).alias("metric_depth"), (k % 3 == 0).alias("has_intrinsics"))
    return model.violations(s, model.sample_rules(), "sample_id")


@query("select o_orderkey as sample_id, o_orderkey % 20 as label, case when o_orderkey % 3 = 0 then o_orderkey % 5 end as depth from orders")
def record_roundtrip(c: Catalogue) -> DataFrame:
    k = F.col("sample_id")
    rec = containers.to_record(c.ids.select("sample_id", (k % 20).alias("label"), F.when(k % 3 == 0, k % 5).alias("depth"), F.lit(1).alias("extra")), "label", "depth", "extra")
    return containers.from_record(rec, "label long, depth long")


# ---- preprocessing

_K = f"least(16::double * s / 16, 16::double * s / 16)"
_RESIZE = f"(select sample_id, k, cast(round_even(16 * k, 0) as bigint) as nh, cast(round_even(16 * k, 0) as bigint) as nw from (select sample_id, {_K} as k from (select sample_id, 0.1::double + {u('resize0')} * 1.9::double as s from samp)))"


@query(sql(f"select sample_id, round(k, 6) as k, nh, nw from {_RESIZE}", "samp"))
def resize_plan(c: Catalogue) -> DataFrame:
    return prep.resize_plan(c.samples, 0.1, 2.0, 16, 16).select("sample_id", r6("k", "k"), "nh", "nw")


@query(sql(f"select sample_id, cast(floor({u('cropy0')} * (greatest(0, nh - 16) + 1)) as bigint) as top, cast(floor({u('cropx0')} * (greatest(0, nw - 16) + 1)) as bigint) as \"left\", 16 - least(16, nh) as fill_rows, 16 - least(16, nw) as fill_cols from {_RESIZE}", "samp"))
def crop_plan(c: Catalogue) -> DataFrame:
    return prep.crop_plan(prep.resize_plan(c.samples, 0.1, 2.0, 16, 16), 16, 16).select("sample_id", "top", "left", F.col("fill_rows").cast("long"), F.col("fill_cols").cast("long"))


@query(sql("select sample_id, slot, sum(bit_count((bits >> (sample_id % 4)) & 255))::bigint as area from mrows where y - sample_id % 3 between 0 and 7 and (bits >> (sample_id % 4)) & 255 <> 0 group by 1, 2", "mrows"))
def crop_masks(c: Catalogue) -> DataFrame:
    plan = c.ids.select("sample_id", (F.col("sample_id") % 3).alias("top"), (F.col("sample_id") % 4).alias("left"))
    return prep.crop_masks(c.rows, plan, 8, 8).groupBy("sample_id", "slot").agg(F.sum(F.bit_count("bits")).alias("area"))


@query(sql("select sample_id, slot from inst where x2 - x1 >= 3 and y2 - y1 >= 4", "inst"))
def sanitize_boxes(c: Catalogue) -> DataFrame:
    return prep.sanitize_boxes(c.instances.where("y2 - y1 >= 4"), 3).select("sample_id", "slot")


@query(sql("select sample_id, slot, label, min(x) as x1, min(y) as y1, max(x) as x2, max(y) as y2, count(*) as area from pixels group by 1, 2, 3 having count(*) >= 10", "pixels"))
def sanitize_by_area(c: Catalogue) -> DataFrame:
    return prep.sanitize_instances(c.rows, 10)


@query(sql("select sample_id, slot, min(x) as x1, min(y) as y1, max(x) as x2, max(y) as y2, count(*) as area from (select *, unnest(range(0, 16)) as x from rest) where (rest >> x) & 1 = 1 group by 1, 2", "rest"))
def tight_boxes(c: Catalogue) -> DataFrame:
    return composite.tight_boxes(composite.survivors(c.rows, c.paste), "sample_id", "slot")


@query(sql("select sample_id, (7 - h2 % 7) % 7 as pad_h, (5 - w2 % 5) % 5 as pad_w, ((7 - h2 % 7) % 7 < h2 and (5 - w2 % 5) % 5 < w2) as reflect from (select sample_id, hv as h2, wv as w2 from samp)", "samp").replace("(5 - w2 % 5) % 5", "(7 - w2 % 7) % 7"))
def pad_to_multiple_plan(c: Catalogue) -> DataFrame:
    return prep.pad_plan(c.samples.select("sample_id", F.col("hv").alias("h"), F.col("wv").alias("w")), 7).select("sample_id", F.col("pad_h").cast("long"), F.col("pad_w").cast("long"), "reflect")


@query(sql("select sample_id, y, round(list_sum(list_transform(range(0, 21), lambda x: x * ((sample_id * 31 + y * 7 + (case when x < 16 then x else 30 - x end) * 13) % 256) / 255.0::double)), 6) as v from lines", "lines"))
def pad_reflect_rows(c: Catalogue) -> DataFrame:
    p = td.pixel_rows(c.lines).withColumn("vals", prep.pad_values(F.col("vals"), 16, 5))
    return p.select("sample_id", "y", r6(F.aggregate(F.transform("vals", lambda v, i: v * i), F.lit(0.0), lambda a, b: a + b), "v"))


# ---- placement


@query(sql("select p.sample_id, p.src_id, p.sample_id <> p.src_id as other from pair p", "pair"))
def source_offdiagonal(c: Catalogue) -> DataFrame:
    return c.placements.select("sample_id", "src_id", (F.col("sample_id") != F.col("src_id")).alias("other"))


@query(sql("select sample_id, case when n > 1 then (pos + 1) % n end as src_pos from samp", "samp"))
def source_cyclic(c: Catalogue) -> DataFrame:
    return placement.cyclic(c.samples).select("sample_id", "src_pos")


@query(sql(f"select distinct sample_id, cast(floor({u('subset0', "sample_id || '|' || d")} * m) as bigint) as slot from (select sample_id, m, unnest(range(0, m)) as d from (select sample_id, count(*) as m from inst group by 1))", "inst"))
def source_random_subset(c: Catalogue) -> DataFrame:
    return placement.random_subset(c.instances)


@query(sql("select sample_id, round(scale, 6) as scale from drawn", "drawn"))
def scale_draw(c: Catalogue) -> DataFrame:
    return c.placements.select("sample_id", r6("scale", "scale"))


@query(sql(f"select sample_id, (2 + cast(floor({u('scale0')} * 7) as bigint)) * 0.25::double as scale from samp", "samp"))
def aligned_scale_draw(c: Catalogue) -> DataFrame:
    return c.samples.select("sample_id", placement.aligned_scale_draw(placement.Placement(patch=4), 16, 16, "sample_id").alias("scale"))


@query(sql("select sample_id, hflip from drawn", "drawn"))
def hflip_draw(c: Catalogue) -> DataFrame:
    return c.placements.select("sample_id", "hflip")


@query(sql("select sample_id, slot, \"right\" as x_edge, y2 as y_edge from edges where slot is not null", "edges"))
def effective_edges(c: Catalogue) -> DataFrame:
    return c.slots.select("sample_id", "slot", F.col("right").alias("x_edge"), F.col("y2").alias("y_edge"))


@query(sql("select sample_id, round(ty, 6) as ty, round(tx, 6) as tx from place", "place"))
def translate_draw(c: Catalogue) -> DataFrame:
    return c.placements.select("sample_id", r6("ty", "ty"), r6("tx", "tx"))


@query(sql("select sample_id, slot, gate from gates", "gates"))
def paste_valid_gate(c: Catalogue) -> DataFrame:
    return c.slots.select("sample_id", "slot", "gate")


@query(sql("select sample_id, kmax, count(*) as n, sum(gate::int)::bigint as passed, sum(paste_valid::int)::bigint as pasted from slots group by 1, 2", "slots"))
def k_cap(c: Catalogue) -> DataFrame:
    return c.slots.groupBy("sample_id", "kmax").agg(F.count("*").alias("n"), F.sum(F.col("gate").cast("long")).alias("passed"), F.sum(F.col("paste_valid").cast("long")).alias("pasted"))


@query(sql("select sample_id, hv, wv from samp", "samp"))
def valid_extent(c: Catalogue) -> DataFrame:
    pad = td.scanlines(c.samples, "hv", "wv").select("sample_id", "y", td.padding_bits(F.col("hv"), F.col("wv"), F.col("y")).alias("pad"))
    return placement.valid_extent(pad, 16).select("sample_id", F.col("hv").cast("long"), F.col("wv").cast("long"))


@query(sql("select sample_id, slot from inst where label < 14", "inst"))
def source_eligible(c: Catalogue) -> DataFrame:
    things = c.spark.range(14).withColumnRenamed("id", "label")
    return c.instances.join(F.broadcast(things), "label", "left_semi").select("sample_id", "slot")


@query(sql(f"select s.sample_id, b.idx, b.class_id, round(scale, 6) as scale, round({u('ty0', 's.sample_id')} * greatest(0, 16 - 8 * scale), 6) as ty, round({u('tx0', 's.sample_id')} * greatest(0, 16 - 8 * scale), 6) as tx, (8 * scale <= 16) as paste_valid from (select *, 0.5::double + {u('scale0')} * 1.5::double as scale, cast(floor({u('bank0')} * (select count(*) from bank)) as bigint) as pick from samp) s join bank b on b.idx = s.pick", "samp", "bank"))
def bank_place(c: Catalogue) -> DataFrame:
    bank = _bank(c)
    return placement.bank_place(c.samples, bank, bank.count(), (8, 8)).select("sample_id", "idx", "class_id", r6("scale", "scale"), r6("ty", "ty"), r6("tx", "tx"), "paste_valid")


# ---- warp


@query(sql("select sample_id, slot, round((case when hflip then wv - 1 - x2 else x1 end) * scale + tx, 6) as x1, round(y1 * scale + ty, 6) as y1, round((case when hflip then wv - 1 - x1 else x2 end) * scale + tx, 6) as x2, round(y2 * scale + ty, 6) as y2 from slots", "slots"))
def transform_boxes(c: Catalogue) -> DataFrame:
    return warp.boxes(c.slots).select("sample_id", "slot", *[r6(f"w{b}", b) for b in ("x1", "y1", "x2", "y2")])


@query(sql("select sample_id, slot, label, y, bits from warped", "warped"))
def warp_mask_nearest(c: Catalogue) -> DataFrame:
    return c.warped.select("sample_id", "slot", "label", "y", "bits")


_TAP = "(case when {y} between 0 and 15 and {x} between 0 and 15 then ((src_id * 31 + cast({y} as bigint) * 7 + cast({x} as bigint) * 13) % 256) / 255.0::double else 0 end)"
_TAPS = " + ".join(f"({wy}) * ({wx}) * " + _TAP.format(y=f"(floor(sy) + {dy})", x=f"(floor(sx) + {dx})") for dy, wy in ((0, "1 - (sy - floor(sy))"), (1, "sy - floor(sy)")) for dx, wx in ((0, "1 - (sx - floor(sx))"), (1, "sx - floor(sx)")))


@query(sql(f"select sample_id, y, round(sum((x + 1) * v), 6) as v from (select sample_id, y, x, {_TAPS} as v, sy from (select p.*, y.y, x.x, (y.y - ty) / scale as sy, case when hflip then wv - 1 - (x.x - tx) / scale else (x.x - tx) / scale end as sx from place p cross join (select unnest(range(0, 16)) as y) y cross join (select unnest(range(0, 16)) as x) x)) where floor(sy) between -1 and 15 group by 1, 2", "place"))
def warp_rows_bilinear(c: Catalogue) -> DataFrame:
    out = warp.bilinear(c.placements, td.pixel_rows(c.lines), 16, 16)
    return out.select("sample_id", "y", r6(F.aggregate(F.transform("vals", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, b: a + b), "v"))


@query(sql(f"select sample_id, sum(bit_count(ok))::bigint as n_valid from (select sample_id, {gathered('src_ok')} as ok from (select p.*, y.y, case when round_even((y.y - ty) / scale, 0) between 0 and 15 then (src_id * 40503 + cast(round_even((y.y - ty) / scale, 0) as bigint) * 24593) % 65536 else 0 end as src_ok from place p cross join (select unnest(range(0, 16)) as y) y)) group by 1", "place"))
def warp_validity_gate(c: Catalogue) -> DataFrame:
    return warp.gate_bits(c.placements, c.depth.select("sample_id", "y", "ok"), 16, 16).groupBy("sample_id").agg(F.sum(F.bit_count("ok")).alias("n_valid"))


@query(sql("select p.sample_id, ch, round(sum((case when hflip and ch = 0 then -1 else 1 end) * (x + 1) * (((p.src_id * 31 + x * 13 + ch * 29) % 256) / 255.0::double)), 6) as v from place p cross join (select unnest(range(0, 16)) as x) cross join (select unnest(range(0, 3)) as ch) group by 1, 2", "place"))
def normals_hflip(c: Catalogue) -> DataFrame:
    rows = td.pixel_rows(c.placements.select(F.col("sample_id").alias("t"), F.col("src_id").alias("sample_id"), "hflip", F.lit(0).alias("y")), 3)
    return warp.normals_flip(rows).select(F.col("t").alias("sample_id"), F.col("ch").cast("long"), r6(F.aggregate(F.transform("vals", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, b: a + b), "v"))


# ---- composite


@query(sql("select sample_id, y, paste from paste", "paste"))
def paste_union(c: Catalogue) -> DataFrame:
    return c.paste


@query(sql("select sample_id, y, sum(1::bigint << x)::bigint as mask from depthpix where (src < tgt or tgt_ok = 0) and not pad group by 1, 2", "depthpix"))
def ztest_mask(c: Catalogue) -> DataFrame:
    return c.depth_lines.select("sample_id", "y", composite.effective(F.col("paste"), F.col("src"), F.col("tgt"), F.col("tgt_ok"), F.col("src_pad"), 16).alias("mask")).where("mask <> 0")


@query(sql("select sample_id, y, round(sum((x + 1) * (case when (src < tgt or tgt_ok = 0) and not pad then src else tgt end)), 6) as v from depthpix group by 1, 2", "depthpix"))
def composite_depth(c: Catalogue) -> DataFrame:
    m = c.depth_lines.withColumn("m", composite.effective(F.col("paste"), F.col("src"), F.col("tgt"), F.col("tgt_ok"), F.col("src_pad"), 16))
    out = m.withColumn("out", composite.select_values(F.col("m"), F.col("src"), F.col("tgt"), 16))
    inside = F.transform("out", lambda v, i: F.when(F.call_function("shiftright", F.col("paste"), i).bitwiseAND(F.lit(1).cast("long")) == 1, v * (i + 1)).otherwise(0.0))
    return out.select("sample_id", "y", r6(F.aggregate(inside, F.lit(0.0), lambda a, b: a + b), "v"))


@query(sql("select sample_id, y, ((paste & src_ok & tgt_ok) | (tgt_ok & ~paste)) as ok from (select p.sample_id, p.y, p.paste, (q.src_id * 40503 + p.y * 24593) % 65536 as src_ok, (p.sample_id * 40503 + p.y * 24593) % 65536 as tgt_ok from paste p join pair q using (sample_id))", "paste", "pair"))
def composite_depth_valid(c: Catalogue) -> DataFrame:
    return c.depth_lines.select("sample_id", "y", composite.depth_valid(F.col("paste"), F.col("src_ok"), F.col("tgt_ok")).alias("ok"))


@query(sql("select sample_id, slot, label, before, after from areas", "areas"))
def survivor_area(c: Catalogue) -> DataFrame:
    return c.areas


@query(sql("select sample_id, slot, after >= 0.1::double * before as kept from areas", "areas"))
def drop_occluded(c: Catalogue) -> DataFrame:
    return c.areas.select("sample_id", "slot", (F.col("after") >= F.lit(0.1) * F.col("before")).alias("kept"))


@query(sql("select * from moves", "moves"))
def merge_slots(c: Catalogue) -> DataFrame:
    return c.moves


@query(sql("select sample_id, slot, label, sum(bit_count(bits))::bigint as area from merged group by 1, 2, 3", "merged"))
def merged_instances(c: Catalogue) -> DataFrame:
    return c.merged.groupBy("sample_id", "slot", "label").agg(F.sum(F.bit_count("bits")).alias("area"))


@query(sql("select p.sample_id, p.src_slot as slot, coalesce(t.top, 0) + p.nth as instance_id from pasted p left join (select sample_id, max(slot) as top from inst group by 1) t using (sample_id)", "pasted", "inst"))
def fresh_ids(c: Catalogue) -> DataFrame:
    return composite.fresh_ids(c.instances, c.pasted)


@query(sql("select sample_id, slot, after > 0 and after >= 6 and 1 - after / (before + 1e-8::double) <= 0.99 as keep from areas", "areas"))
def dense_survivor_rule(c: Catalogue) -> DataFrame:
    return composite.survivor_rule(c.areas, 6).select("sample_id", "slot", "keep")


@query(sql("select sample_id, y, class_id, sum(1::bigint << x)::bigint as bits from semafter where class_id is not null group by 1, 2, 3", "semafter"))
def composite_semantic(c: Catalogue) -> DataFrame:
    return c.semantic_after


@query(sql("select sample_id, class_id, area from histb", "histb"))
def class_histogram(c: Catalogue) -> DataFrame:
    return c.histogram_before


@query(sql("select * from gone", "gone"))
def stuff_collapse(c: Catalogue) -> DataFrame:
    return composite.shrunk(c.histograms, c.stuff, 0.5).drop("under")


@query(sql("select p.sample_id, count(*) as area from pastepix p join sempix s using (sample_id, y, x) join gone g on g.sample_id = s.sample_id and g.class_id = s.class_id group by 1", "pastepix", "sempix", "gone"))
def stuff_revert_area(c: Catalogue) -> DataFrame:
    return composite.shrunk(c.histograms, c.stuff, 0.5).where("under > 0").groupBy("sample_id").agg(F.sum("under").alias("area"))


# ---- harmonising


def _rgb(c: Catalogue) -> DataFrame:
    """Pixels of each target beside its source's, unmoved, with the paste mask: one row a pixel, channels as columns."""
    line = c.placements.select("sample_id", "src_id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("y")).join(c.paste, ["sample_id", "y"], "left").withColumn("paste", F.coalesce("paste", F.lit(0).cast("long")))
    p = line.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(15))))
    val = lambda who, ch: td.value(ch, F.col(who), F.col("y"), F.col("x"))
    s, t = harmonize.to_lab(*[val("src_id", i) for i in range(3)]), harmonize.to_lab(*[val("sample_id", i) for i in range(3)])
    inside = F.call_function("shiftright", F.col("paste"), F.col("x")).bitwiseAND(F.lit(1).cast("long")) == 1
    return p.select("sample_id", "y", "x", inside.alias("inside"), *[v.alias("s" + n) for n, v in zip("lab", s)], *[v.alias("t" + n) for n, v in zip("lab", t)])


def _rgb_sql() -> str:
    val = lambda who, ch: f"((({who}) * 31 + y * 7 + x * 13 + {ch * 29}) % 256) / 255.0::double"
    out = []
    for side, who in (("s", "src_id"), ("t", "sample_id")):
        logs = [f"log10(greatest({a}::double * {val(who, 0)} + {b}::double * {val(who, 1)} + {d}::double * {val(who, 2)}, 1e-6::double))" for a, b, d in harmonize.RGB_LMS]
        for n, row, k in zip("lab", harmonize.LMS_LAB, harmonize.LAB_SCALE):
            out.append(f"({' + '.join(f'{w}::double * {x}' for w, x in zip(row, logs))}) * {k!r}::double as {side}{n}")
    return f"(select sample_id, y, x, inside, {', '.join(out)} from (select p.sample_id, p.src_id, y.y, x.x, coalesce((q.paste >> x.x) & 1, 0) = 1 as inside from place p cross join (select unnest(range(0, 16)) as y) y cross join (select unnest(range(0, 16)) as x) x left join paste q on q.sample_id = p.sample_id and q.y = y.y))"


def _stats_sql() -> str:
    out = ["sample_id"]
    for side, want in (("s", "inside"), ("t", "not inside")):
        n = f"greatest(count(*) filter ({want}), 1)"
        for c in "lab":
            m = f"coalesce(sum({side}{c}) filter ({want}), 0) / {n}"
            out += [f"{m} as {side}{c}_mean", f"sqrt(greatest(coalesce(sum({side}{c} * {side}{c}) filter ({want}), 0) / {n} - ({m}) * ({m}), 1e-12::double)) as {side}{c}_std"]
    return f"(select {', '.join(out)} from {_rgb_sql()} group by 1)"


@query(sql(f"select sample_id, {', '.join(f'round({s}{c}_mean, 6) as {s}{c}_mean, round({s}{c}_std, 5) as {s}{c}_std' for s in 'st' for c in 'lab')} from {_stats_sql()}", "place", "paste"))
def reinhard_stats(c: Catalogue) -> DataFrame:
    s = harmonize.reinhard_stats(_rgb(c))
    return s.select("sample_id", *[x for side in "st" for ch in "lab" for x in (r6(f"{side}{ch}_mean", f"{side}{ch}_mean"), F.round(f"{side}{ch}_std", 5).alias(f"{side}{ch}_std"))])


def _apply_sql() -> str:
    import numpy as np

    lab = {c: f"(s{c} * (t{c}_std / s{c}_std) + (t{c}_mean - t{c}_std / s{c}_std * s{c}_mean)) * {k!r}::double" for c, k in zip("lab", harmonize.LAB_SCALE)}
    lms = [f"pow(10.0::double, {' + '.join(f'{w}::double * {lab[c]}' for w, c in zip(row, 'lab'))})" for row in np.array(harmonize.LMS_LAB).T.tolist()]
    rgb = [f"least(1.0::double, greatest(0.0::double, {' + '.join(f'{w!r}::double * {x}' for w, x in zip(row, lms))}))" for row in np.linalg.inv(np.array(harmonize.RGB_LMS)).tolist()]
    return f"select sample_id, {', '.join(f'round(sum({v}), 3) as {n}' for n, v in zip('rgb', rgb))} from {_rgb_sql()} p join {_stats_sql()} s using (sample_id) where inside group by 1"


@query(sql(_apply_sql(), "place", "paste"))
def reinhard_apply(c: Catalogue) -> DataFrame:
    px = _rgb(c)
    out = harmonize.reinhard(px, harmonize.reinhard_stats(px)).where("inside")
    return out.groupBy("sample_id").agg(*[F.round(F.sum(n), 3).alias(n) for n in "rgb"])


@query(sql(f"select sample_id, {u('harmonize0')} < 0.3 as harmonized from samp", "samp"))
def harmonize_gate(c: Catalogue) -> DataFrame:
    return c.ids.select("sample_id", harmonize.gate(0.3, "sample_id").alias("harmonized"))


def _blend_lines(c: Catalogue) -> DataFrame:
    line = c.placements.select("sample_id", "src_id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("y")).join(c.paste, ["sample_id", "y"], "left")
    vals = lambda who: F.array(*[td.value(0, F.col(who), F.col("y"), F.lit(x)) for x in range(16)])
    return line.select("sample_id", F.lit(0).alias("ch"), "y", vals("src_id").alias("src"), vals("sample_id").alias("tgt"), F.coalesce("paste", F.lit(0).cast("long")).alias("mask"))


def _blend(c: Catalogue, mode: str) -> DataFrame:
    return harmonize.blended(_blend_lines(c), mode, 16).select("sample_id", "y", F.round(F.aggregate("vals", F.lit(0.0), lambda a, b: a + b), 6).alias("v"))


@query()
def multiband(c: Catalogue) -> DataFrame:
    return _blend(c, "multiband")


@query()
def poisson(c: Catalogue) -> DataFrame:
    return _blend(c, "poisson")


# ---- bank


def _bank(c: Catalogue) -> DataFrame:
    return c.table("embeddings").select(F.col("vec_id").alias("idx"), F.col("label").cast("long").alias("class_id"))


_FREQ = "(select c.class_id, count(b.idx) as n from (select unnest(range(0, 12)) as class_id) c left join bank b using (class_id) group by 1)"
_WEIGHT = f"(select class_id, n, case when n > 0 then greatest(1.0::double, sqrt(0.2::double / (n / (sum(n) over ())::double))) else 0 end as weight from {_FREQ})"


@query(sql(f"select class_id, n from {_FREQ}", "bank"))
def class_frequencies(c: Catalogue) -> DataFrame:
    return sampling.class_frequencies(_bank(c), 12)


@query(sql(f"select class_id, n, round(weight, 9) as weight from {_WEIGHT}", "bank"))
def repeat_factor_weights(c: Catalogue) -> DataFrame:
    return sampling.repeat_factors(sampling.class_frequencies(_bank(c), 12), 0.2).select("class_id", "n", F.round("weight", 9).alias("weight"))


_CDF = f"(select class_id, n, sum(n * weight) over (order by class_id) / sum(n * weight) over () as hi, (sum(n * weight) over (order by class_id) - n * weight) / sum(n * weight) over () as lo from {_WEIGHT} where n > 0)"
_DRAWS = f"(select d.i, c.class_id, b.idx from (select i, {u('class|12648430|0|0', 'i')} as u, {u('index|12648430|0|0', 'i')} as v from (select unnest(range(0, 4096)) as i)) d join lateral (select class_id, n from {_CDF} where hi > d.u order by hi limit 1) c on true join (select *, row_number() over (partition by class_id order by idx) - 1 as nth from bank) b on b.class_id = c.class_id and b.nth = cast(floor(d.v * c.n) as bigint))"


@query(sql(f"select i, class_id, idx from {_DRAWS}", "bank"))
def bank_draws(c: Catalogue) -> DataFrame:
    return sampling.draws(c.spark, _bank(c), 12, 4096, 0.2)


@query(sql(f"select c.class_id, count(d.i) as n from (select unnest(range(0, 12)) as class_id) c left join {_DRAWS} d using (class_id) group by 1", "bank"))
def bank_draw_histogram(c: Catalogue) -> DataFrame:
    return sampling.histogram(sampling.draws(c.spark, _bank(c), 12, 4096, 0.2).select("class_id"), 12)


@query(sql("select b.idx, coalesce((select arg_min(g.idx, ((g.idx - b.idx) % n + n) % n) from bank g where g.class_id = 3 and ((g.idx - b.idx) % n + n) % n <= 8), (b.idx + 8) % n) as found from bank b, (select count(*) as n from bank)", "bank"))
def predicate_walk(c: Catalogue) -> DataFrame:
    bank = _bank(c)
    return sampling.predicate_walk(bank, bank.count(), F.col("class_id") == 3)


@query(sql(f"select i // 96 as batch, (i % 96) // 12 as pos, i % 12 as slot, class_id, idx from {_DRAWS} where i // 96 < 4096 // 96", "bank"))
def stage_bank_batches(c: Catalogue) -> DataFrame:
    bank = _bank(c)
    return sampling.stage(sampling.draws(c.spark, bank, 12, 4096, 0.2), bank, 8, 12)


@query("select o_orderkey as sample_id, cast(cast('0x' || substr(sha256('7|' || o_orderkey || '|1'), 1, 16) as ubigint) & 9223372036854775807::ubigint as bigint) as seed from orders")
def derive_seed(c: Catalogue) -> DataFrame:
    return c.ids.select("sample_id", rng.step_seed(7, F.col("sample_id"), 1).alias("seed"))


# ---- invariants

_ID = "(select o_orderkey as sample_id from orders)"


def _report(name: str, bad: str) -> str:
    return f"select i.sample_id, '{name}' as name, coalesce(b.n_bad, 0) = 0 as ok, coalesce(b.n_bad, 0)::bigint as n_bad from {_ID} i left join ({bad}) b using (sample_id)"


@query(sql(_report("instance.identity_preserved", "select sample_id, count(*) as n_bad from (select a.sample_id, a.slot, bool_or(a.label = b.label) as same from (select sample_id, slot, label, list((y, bits)) as ys from merged group by 1, 2, 3) a join (select sample_id, slot, label from inst) b on a.sample_id = b.sample_id where not exists (select 1 from merged m left join mrows r on r.sample_id = m.sample_id and r.slot = b.slot and r.y = m.y where m.sample_id = a.sample_id and m.slot = a.slot and m.bits & ~coalesce(r.bits, 0) <> 0) group by 1, 2) where not same group by 1"), "merged", "mrows", "inst"))
def check_identity(c: Catalogue) -> DataFrame:
    return checks.identity(c.ids, c.rows, c.merged)


@query(sql(_report("instance.target_masks_subtract_paste_union", "select sample_id, count(*) as n_bad from (select m.sample_id, m.slot from mrows m left join paste p using (sample_id, y) group by 1, 2 having bool_or(m.bits & coalesce(p.paste, 0) <> 0) and bool_or(m.bits & ~coalesce(p.paste, 0) <> 0)) group by 1"), "mrows", "paste"))
def check_subtract(c: Catalogue) -> DataFrame:
    return checks.subtracts_union(c.ids, c.rows, c.paste)


@query(sql(_report("instance.bbox_recomputed_from_mask", "select sample_id, count(*) as n_bad from (select i.sample_id from inst i join (select sample_id, slot, min(x) as a, min(y) as b, max(x) as d, max(y) as e from (select *, unnest(range(0, 16)) as x from rest) where (rest >> x) & 1 = 1 group by 1, 2) t using (sample_id, slot) where abs(x1 - a) > 1 + 1e-5 * a or abs(y1 - b) > 1 + 1e-5 * b or abs(x2 - d) > 1 + 1e-5 * d or abs(y2 - e) > 1 + 1e-5 * e) group by 1"), "inst", "rest"))
def check_boxes(c: Catalogue) -> DataFrame:
    return checks.boxes_fit(c.ids, c.instances, composite.survivors(c.rows, c.paste))


@query(sql(_report("instance.small_area_dropped", "select sample_id, count(*) as n_bad from areas where after < 4 group by 1"), "areas"))
def check_small(c: Catalogue) -> DataFrame:
    return checks.no_small(c.ids, c.areas.withColumnRenamed("after", "area"), 4)


@query(sql(_report("instance.no_same_class_overlap", "select sample_id, count(*) as n_bad from (select sample_id, label, y from mrows group by 1, 2, 3 having sum(bit_count(bits)) > bit_count(bit_or(bits))) group by 1"), "mrows"))
def check_overlap(c: Catalogue) -> DataFrame:
    return checks.no_overlap(c.ids, c.rows)


@query(sql(_report("panoptic.thing_stuff_consistent", "select s.sample_id, count(*) as n_bad from sempix s left join (select distinct sample_id, y, x from pixels where label < 14) p using (sample_id, y, x) where s.class_id <> 255 and (s.class_id < 14) <> (p.x is not null) group by 1"), "sempix", "pixels"))
def check_thing_stuff(c: Catalogue) -> DataFrame:
    z = c.rows.where(F.col("label") < td.THINGS).groupBy("sample_id", "y").agg(F.bit_or("bits").alias("z"))
    return checks.thing_stuff(c.ids, c.semantic, z, F.col("class_id") < td.THINGS)


@query(sql(_report("panoptic.pixel_bijection", "select sample_id, sum(twice) as n_bad from (select sample_id, y, max((n > 1)::int) as twice from (select sample_id, y, x, count(*) as n from pixels group by 1, 2, 3) group by 1, 2) group by 1"), "pixels"))
def check_bijection(c: Catalogue) -> DataFrame:
    z = c.rows.groupBy("sample_id", "y").agg(F.bit_or("bits").alias("z"))
    return checks.bijection(c.ids, z, c.rows)


@query(sql(_report("panoptic.fresh_instance_ids", "select m.sample_id, count(distinct m.instance_id) as n_bad from merged m join (select sample_id, max(slot) as top from inst group by 1) t using (sample_id) where m.instance_id <> 0 and m.instance_id <= t.top and not exists (select 1 from inst i where i.sample_id = m.sample_id and i.slot = m.instance_id) group by 1"), "merged", "inst"))
def check_fresh(c: Catalogue) -> DataFrame:
    return checks.fresh_ids(c.ids, c.instances, c.merged)


@query(sql(_report("panoptic.stuff_area_threshold", "select b.sample_id, count(*) as n_bad from histb b left join hista a using (sample_id, class_id) where b.class_id between 14 and 19 and ((coalesce(a.area, 0) = 0 and b.area > 8) or coalesce(a.area, 0) between 1 and 8) group by 1"), "histb", "hista"))
def check_stuff_area(c: Catalogue) -> DataFrame:
    return checks.stuff_areas(c.ids, c.histograms, c.stuff, 8)


@query(sql(_report("semantic.single_class_per_pixel", "select sample_id, sum(n - 1) as n_bad from (select sample_id, y, x, count(*) as n from semafter where class_id is not null group by 1, 2, 3) group by 1"), "semafter"))
def check_single_class(c: Catalogue) -> DataFrame:
    return checks.single_class(c.ids, c.semantic_after)


@query(sql(_report("semantic.ignore_preserved", "select b.sample_id, count(*) as n_bad from sempix b left join semafter a using (sample_id, y, x) where b.class_id = 255 and a.class_id is distinct from 255 group by 1"), "sempix", "semafter"))
def check_ignore(c: Catalogue) -> DataFrame:
    return checks.ignore_kept(c.ids, c.semantic, c.semantic_after)


def _depth_out(c: Catalogue) -> DataFrame:
    m = c.depth_lines.withColumn("mask", composite.effective(F.col("paste"), F.col("src"), F.col("tgt"), F.col("tgt_ok"), F.col("src_pad"), 16))
    return m.withColumn("out", composite.select_values(F.col("mask"), F.col("src"), F.col("tgt"), 16)).withColumn("out_ok", composite.depth_valid(F.col("paste"), F.col("src_ok"), F.col("tgt_ok")))


@query(sql(_report("depth.monotonicity", "select sample_id, count(*) as n_bad from depthpix where tgt_ok = 0 and not pad and src > tgt group by 1"), "depthpix"))
def check_depth_monotone(c: Catalogue) -> DataFrame:
    return checks.depth_monotone(c.ids, _depth_out(c), 16)


@query(sql(_report("depth.validity_join", "select sample_id, count(*) as n_bad from depthpix where not ((src < tgt or tgt_ok = 0) and not pad) and src_ok = 0 and tgt_ok = 1 group by 1"), "depthpix"))
def check_depth_join(c: Catalogue) -> DataFrame:
    return checks.depth_join(c.ids, _depth_out(c))


@query(sql(_report("depth.metric_intrinsics_rescale", "select sample_id, count(*) as n_bad from (select p.sample_id, 1 + p.sample_id % 7 as d, 100.0::double + t.o_custkey as ft, 100.0::double + s.o_custkey as fs from pair p join samp t on t.sample_id = p.sample_id join samp s on s.sample_id = p.src_id) where abs(d - d * sqrt(ft * ft) / sqrt(fs * fs)) > 1e-5 + 1e-5 * abs(d * sqrt(ft * ft) / sqrt(fs * fs)) group by 1"), "pair", "samp"))
def check_metric(c: Catalogue) -> DataFrame:
    f = c.samples.select("sample_id", (F.lit(100.0) + F.col("o_custkey")).alias("f"))
    j = c.placements.select("sample_id", "src_id").join(f.withColumnRenamed("f", "ft"), "sample_id").join(f.select(F.col("sample_id").alias("src_id"), F.col("f").alias("fs")), "src_id")
    d = (1 + F.col("sample_id") % 7).cast("double")
    return checks.metric_rescaled(c.ids, j.select("sample_id", d.alias("d"), d.alias("out"), F.col("ft").alias("fxt"), F.col("ft").alias("fyt"), F.col("fs").alias("fxs"), F.col("fs").alias("fys")))


@query(sql(_report("normals.unit_norm_on_valid", "select sample_id, count(*) as n_bad from lines where (y + sample_id) % 3 = 0 and y % 4 <> 0 group by 1"), "lines"))
def check_unit_normals(c: Catalogue) -> DataFrame:
    k = F.when((F.col("y") + F.col("sample_id")) % 3 == 0, F.lit(1.5)).otherwise(F.lit(1.0))
    return checks.unit_normals(c.ids, c.lines.select("sample_id", (k * 0.6).alias("nx"), (k * 0.0).alias("ny"), (k * 0.8).alias("nz"), (F.col("y") % 4 != 0).alias("valid")))


@query(sql(_report("normals.camera_frame_convention", "select sample_id, (sample_id % 9 = 0)::int as n_bad from samp"), "samp"))
def check_frame(c: Catalogue) -> DataFrame:
    rows = td.pixel_rows(c.lines, 3).where((F.col("sample_id") % 9 != 0) | (F.col("ch") < 2))
    return checks.camera_frame(c.ids, rows, 16, 16)


_SUMMARY = ("check_subtract", "check_small", "check_overlap", "check_single_class", "check_stuff_area", "check_depth_join")


@query("select name, count(*) as n, sum(ok::int)::bigint as n_ok, sum(n_bad)::bigint as n_bad from (" + " union all ".join(f"select * from ({ORACLES[n]})" for n in _SUMMARY) + ") group by 1")
def invariant_summary(c: Catalogue) -> DataFrame:
    return checks.summary(*[globals()[n](c) for n in _SUMMARY])


@query("with l as (select o_orderkey as sample_id, o_orderkey % 7 <> 0 as i, o_orderkey % 3 = 0 as p, o_orderkey % 2 = 0 as s, o_orderkey % 5 = 0 as n from orders) select sample_id, (i::int + s::int + n::int + (i and p)::int)::bigint as n_checks from (select sample_id, i, p, s, n from l) where i or s or n")
def checks_per_sample(c: Catalogue) -> DataFrame:
    """How many of four of the checks apply to each sample by its layers."""
    names = ["semantic.single_class_per_pixel", "instance.no_same_class_overlap", "panoptic.pixel_bijection", "normals.unit_norm_on_valid"]
    reports = c.ids.select("sample_id", F.explode(F.array(*[F.lit(n) for n in names])).alias("name"))
    return checks.per_sample(reports, model.active_layers(c.ids, present()).select("sample_id", "layers"), False).groupBy("sample_id").agg(F.count("*").alias("n_checks"))


# ---- statistics


@query(sql("select p.sample_id, coalesce(n.n_pasted, 0) as n_pasted, round(p.area / 256.0::double, 6) as paste_area_frac from (select sample_id, sum(bit_count(paste)) as area from paste group by 1) p left join (select sample_id, count(distinct instance_id) as n_pasted from merged m where not exists (select 1 from inst i where i.sample_id = m.sample_id and i.slot = m.instance_id) group by 1) n using (sample_id)", "paste", "merged", "inst"))
def paste_stats(c: Catalogue) -> DataFrame:
    s = stats.paste_stats(c.instances, c.merged, c.paste, 256)
    return s.select("sample_id", "n_pasted", r6("paste_area_frac", "paste_area_frac"))


@query(sql("select round(max(abs(fa - fb)), 9) as ks from (select v, sum(na) over (order by v) / (sum(na) over ())::double as fa, sum(nb) over (order by v) / (sum(nb) over ())::double as fb from (select v, sum(a) as na, sum(1 - a) as nb from (select before as v, 1 as a from areas union all select after, 0 from areas) group by 1))", "areas"))
def ks_distance(c: Catalogue) -> DataFrame:
    a = c.areas
    return stats.ks_distance(a.select(F.col("before").alias("v")), a.select(F.col("after").alias("v")), "v").select(F.round("ks", 9).alias("ks"))


@query(sql("select label, count(*) as n, sum(bits)::bigint as area from (select sample_id, slot, label, sum(bit_count(bits)) as bits from warped group by 1, 2, 3) group by 1", "warped"))
def paste_histogram(c: Catalogue) -> DataFrame:
    one = c.warped.groupBy("sample_id", "slot", "label").agg(F.sum(F.bit_count("bits")).alias("bits"))
    return one.groupBy("label").agg(F.count("*").alias("n"), F.sum("bits").alias("area"))


def _times(c: Catalogue) -> DataFrame:
    return c.table("events").select("event_type", "user_id", "value")


_Q = "(select event_type, count(value) as n, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as q3 from {0} group by 1)"


@query("select event_type, n, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3, round(q3 - q1, 6) as iqr from " + _Q.format("events where value is not null"))
def bench_quartiles(c: Catalogue) -> DataFrame:
    return stats.quartiles(_times(c).where("value is not null"), "value", "event_type").select("event_type", "n", *[r6(x, x) for x in ("q1", "median", "q3", "iqr")])


@query("select event_type, round(b.median / a.median, 6) as ratio, case when a.median is null or b.median is null then 2 when b.median / a.median > 1.05 then 1 else 0 end as code, coalesce(a.median / b.median >= 2, false) as fast from " + _Q.format("events where user_id % 2 = 0 and event_type <> 'error'") + " a full join " + _Q.format("events where user_id % 2 = 1") + " b using (event_type)")
def regression_gate(c: Catalogue) -> DataFrame:
    t = _times(c)
    a = stats.quartiles(t.where("user_id % 2 = 0 and event_type <> 'error'"), "value", "event_type")
    b = stats.quartiles(t.where("user_id % 2 = 1"), "value", "event_type")
    return stats.regression_gate(a, b, "event_type").select("event_type", r6("ratio", "ratio"), "code", "fast")


@query("with m as (select event_type, 8 as batch, quantile_cont(value, 0.5) as ms from events group by 1), r as (select event_type as impl, batch / (ms / 1000) as images_s, 1 / (ms / 1000) as batches_s, batch * 3.0::double / (ms / 1000) as pasted_s from m) select impl, round(images_s, 6) as images_s, round(batches_s, 6) as batches_s, round(pasted_s, 6) as pasted_s, row_number() over (order by images_s desc, impl) as rank, round(images_s / max(case when impl = 'click' then images_s end) over (), 6) as speedup from r")
def throughput_rank(c: Catalogue) -> DataFrame:
    m = stats.quartiles(_times(c), "value", "event_type").select(F.col("event_type").alias("impl"), F.lit(8).alias("batch"), F.lit(1).alias("k_lo"), F.lit(5).alias("k_hi"), F.col("median").alias("median_ms"))
    return stats.ranked(stats.throughput(m), "click").select("impl", r6("images_s", "images_s"), r6("batches_s", "batches_s"), r6("pasted_s", "pasted_s"), "rank", r6("speedup", "speedup"))


@query("select g.batch, g.size, g.k_hi, count(r.value) as n, round(quantile_cont(r.value, 0.5), 6) as median from (select b.batch, s.size, k.k_hi from (select unnest([2, 8, 32]) as batch) b cross join (select unnest([256, 512, 1024]) as size) s cross join (select unnest([5, 20]) as k_hi) k) g left join (select [2, 8, 32][user_id % 3 + 1] as batch, [256, 512][event_id % 2 + 1] as size, case when event_type = 'click' then 5 else 20 end as k_hi, value from events) r using (batch, size, k_hi) group by 1, 2, 3")
def sweep_grid(c: Catalogue) -> DataFrame:
    """Measured values by the cells of a sweep; one size was never run."""
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    runs = c.table("events").select(pick([2, 8, 32], F.col("user_id") % 3).alias("batch"), pick([256, 512], F.col("event_id") % 2).alias("size"), F.when(F.col("event_type") == "click", 5).otherwise(20).alias("k_hi"), "value")
    return stats.sweep(runs, "value", batch=[2, 8, 32], size=[256, 512, 1024], k_hi=[5, 20]).withColumn("median", F.round("median", 6))


# ---- sources, exchange and whole pipelines


def _annotations(c: Catalogue) -> tuple[DataFrame, DataFrame]:
    """Orders as images and lines as annotations, in the form of the annotation files."""
    images = c.samples.select(F.col("sample_id").alias("id"), F.lit(16).alias("height"), F.lit(16).alias("width"), F.format_string("%d.png", "sample_id").alias("file_name"))
    i = c.instances
    ann = i.select((F.col("sample_id") * 100 + F.col("slot")).alias("id"), F.col("sample_id").alias("image_id"), F.col("label").alias("category_id"), F.array(*[F.col(v).cast("double") for v in ("x1", "y1")], (F.col("x2") - F.col("x1")).cast("double"), (F.col("y2") - F.col("y1")).cast("double")).alias("bbox"), (F.col("label") == 19).cast("int").alias("iscrowd"))
    return images, ann


@query(sql("select sample_id, slot, label, slot as instance_id, x1::double as x1, y1::double as y1, x2::double as x2, y2::double as y2 from inst", "inst"))
def coco_detection(c: Catalogue) -> DataFrame:
    from ..sources import coco

    return coco.detection(*_annotations(c))[1].withColumn("instance_id", F.col("instance_id").cast("long"))


@query("select o_orderkey as sample_id from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def coco_annotated_images(c: Catalogue) -> DataFrame:
    from ..sources import coco

    return coco.detection(*_annotations(c))[0].select("sample_id")


@query(sql("select sample_id * 100 + slot as ann_id, label as class_id, greatest(0, (4 - least(4, x2 - x1)) // 2) as dst_x, ((x2 - x1) - least(4, x2 - x1)) // 2 as src_x, least(4, y2 - y1) as take_y from inst where label <> 19 and (x2 - x1) * (y2 - y1) >= 9", "inst"))
def crop_plan_bank(c: Catalogue) -> DataFrame:
    from ..sources import coco

    return coco.crop_plan(*_annotations(c), (4, 4), 9).select("ann_id", "class_id", "dst_x", "src_x", "take_y")


@query(sql("select sample_id, sample_id * 100 + slot as seg_id, label, label < 14 as is_thing, case when label < 14 then sum((label < 14)::int) over (partition by sample_id order by slot) else 0 end::bigint as instance_id from inst", "inst"))
def coco_panoptic_segments(c: Catalogue) -> DataFrame:
    from ..sources import coco

    seg = F.struct((F.col("sample_id") * 100 + F.col("slot")).alias("id"), F.col("label").alias("category_id"), F.col("slot"))
    one = c.instances.groupBy(F.col("sample_id").alias("image_id")).agg(F.array_sort(F.collect_list(seg)).alias("segments_info"))
    cats = c.spark.range(20).select("id", (F.col("id") < td.THINGS).cast("int").alias("isthing"))
    return coco.segments(one, cats)


@query(sql("select sample_id, slot, sum(bit_count(bits))::bigint as area, count(*) as n_rows, bit_xor(bits * (y + 1)) as mix from mrows group by 1, 2", "mrows"))
def rle_decode(c: Catalogue) -> DataFrame:
    """Rectangles to column-major counts and back to scanlines."""
    from ..functions import rle

    i = c.instances.where("x2 > x1 and y2 > y1")
    h, size = F.lit(16), F.col("y2") - F.col("y1")
    runs = F.flatten(F.transform(F.sequence(F.col("x1"), F.col("x2") - 1), lambda x: F.array(F.when(x == F.col("x1"), x * 16 + F.col("y1")).otherwise(h - size), size)))
    out = rle.decode(i.select("sample_id", "slot", F.lit(16).cast("long").alias("h"), runs.alias("counts")))
    return out.groupBy("sample_id", "slot").agg(F.sum(F.bit_count("bits")).alias("area"), F.count("*").alias("n_rows"), F.bit_xor(F.col("bits") * (F.col("y") + 1)).alias("mix"))


@query(sql("select sample_id, slot, (x2 - x1) * (y2 - y1) as area from inst", "inst"))
def polygon_area(c: Catalogue) -> DataFrame:
    from ..functions import rle

    i = c.instances
    poly = F.array(*[F.col(v).cast("double") for v in ("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2")])
    p = rle.polygons(i.select((F.col("sample_id") * 100 + F.col("slot")).alias("id"), F.lit(16).alias("h"), F.lit(16).alias("w"), F.array(poly).alias("polygons")))
    return p.groupBy("id").agg(F.sum(F.bit_count("bits")).alias("area")).select(F.floor(F.col("id") / 100).alias("sample_id"), (F.col("id") % 100).alias("slot"), "area")


@query("select d.doc_id, d.source from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id)")
def subset_semi(c: Catalogue) -> DataFrame:
    return c.table("documents").select("doc_id", "source").join(c.table("labels").select("doc_id"), "doc_id", "left_semi")


@query("select d.doc_id as image_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def subset_missing_anti(c: Catalogue) -> DataFrame:
    from ..sources import coco

    return coco.missing(c.table("documents").select(F.col("doc_id").alias("image_id")), c.table("labels").select(F.col("doc_id").alias("id")))


_SUBSET = f"(select image_id from (select distinct o_custkey as image_id from orders) order by {u('subset9', 'image_id')}, image_id limit 100)"


@query(f"select image_id from {_SUBSET}")
def subset_sample(c: Catalogue) -> DataFrame:
    from ..sources import coco

    return coco.subset(c.table("orders").select(F.col("o_custkey").alias("image_id")), 100, 9)


@query(f"select substr(sha256(string_agg(image_id::varchar, ',' order by image_id)), 1, 16) as fingerprint from {_SUBSET}")
def subset_fingerprint(c: Catalogue) -> DataFrame:
    from ..sources import coco

    return coco.fingerprint(coco.subset(c.table("orders").select(F.col("o_custkey").alias("image_id")), 100, 9))


@query("select vec_id as idx, vec_id // 4096 as shard_id, lpad(vec_id::varchar, 8, '0') as member_name, label::bigint as class_id from embeddings")
def bank_shard_index(c: Catalogue) -> DataFrame:
    from ..sources import bank

    return bank.shard_index(_bank(c)).withColumn("shard_id", F.col("shard_id").cast("long"))


def _records(c: Catalogue) -> DataFrame:
    byte = lambda k: F.unhex(F.lpad(F.hex(k % 256), 2, "0"))
    plane = lambda n: F.concat(*[byte(F.col("idx") + i) for i in range(n)])
    return _bank(c).select("idx", "class_id", plane(12).alias("image"), plane(4).alias("alpha"), F.lit(None).cast("binary").alias("embedding_raw"))


@query("select vec_id as idx, label::bigint as class_id, 24 as size, list_sum(list_transform(range(0, 12), lambda i: (vec_id + i) % 256))::bigint as image_sum from embeddings")
def record_pack_unpack(c: Catalogue) -> DataFrame:
    from ..sources import bank

    packed = bank.pack(_records(c))
    out = bank.unpack(packed.withColumnRenamed("record", "record"), 2, 2).join(packed.select("idx", F.octet_length("record").alias("size")), "idx")
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.conv(F.hex(F.substring("image", i, F.lit(1))), 16, 10).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return out.select("idx", "class_id", "size", total.alias("image_sum"))


@query("select vec_id as idx, 'record_length' as rule from embeddings where vec_id % 10 = 0")
def record_violations(c: Catalogue) -> DataFrame:
    from ..sources import bank

    short = bank.pack(_records(c)).withColumn("record", F.when(F.col("idx") % 10 == 0, F.expr("substring(record, 1, 20)")).otherwise(F.col("record")))
    return bank.record_violations(short, 2, 2)


@query(sql("select sample_id, slot, label, x1 / 14.0::double as x, round((least(x2, 14) - x1) / 14.0::double, 6) as width from inst where x1 < 14", "inst").replace("x1 / 14.0::double as x", "round(x1 / 14.0::double, 6) as x"))
def viewer_detections(c: Catalogue) -> DataFrame:
    from ..sources import export

    return export.detections(c.instances, 14, 16).select("sample_id", "slot", "label", r6("x", "x"), r6("width", "width"))


@query(sql("select s.sample_id, s.class_id, count(*) as area from sempix s where not exists (select 1 from pixels p where p.sample_id = s.sample_id and p.y = s.y and p.x = s.x and p.label < 14) group by 1, 2", "sempix", "pixels"))
def stuff_segmentation(c: Catalogue) -> DataFrame:
    from ..sources import export

    z = c.rows.where(F.col("label") < td.THINGS).groupBy("sample_id", "y").agg(F.bit_or("bits").alias("z"))
    return composite.histogram(export.stuff_only(c.semantic, z))


@query(sql("select sample_id, label as semantic, case when label < 14 then slot + 1 else 0 end as panoptic, count(*) as area from (select sample_id, y, x, arg_max(label, slot) as label, max(slot) as slot from pixels group by 1, 2, 3) group by 1, 2, 3", "pixels"))
def hf_last_wins(c: Catalogue) -> DataFrame:
    from ..sources import export

    return export.last_wins(c.rows, F.col("label") < td.THINGS).groupBy("sample_id", "semantic", "panoptic").agg(F.sum(F.bit_count("bits")).alias("area"))


@query(sql("select sample_id, string_agg(label::varchar, ',' order by slot) as labels from inst where slot < 20 group by 1", "inst"))
def hf_batch(c: Catalogue) -> DataFrame:
    from ..sources import export

    b = export.model_batch(containers.padded(c.samples, c.instances.select("sample_id", "slot", "label"), 20))
    return b.select("sample_id", F.array_join("class_labels", ",").alias("labels"))


@query("select o_orderkey as path from (select o_orderkey, 'data/' || o_orderkey || case when o_orderkey % 3 = 0 then '.PT' else '.txt' end as p from orders) where lower(p) like '%.pt' and p not like 'data/1%'")
def binary_guard(c: Catalogue) -> DataFrame:
    from ..sources import export

    p = c.ids.select("sample_id", F.concat(F.lit("data/"), F.col("sample_id").cast("string"), F.when(F.col("sample_id") % 3 == 0, ".PT").otherwise(".txt")).alias("path"))
    return export.forbidden_files(p, [".pt", ".bin"], ["data/1"]).select(F.col("sample_id").alias("path"))


@query(f"select k as sample_id, i as slot, i + 1 as label, i * 32 + cast(floor((cast('0x' || substr(sha256('x' || i || '|' || (k + 5)), 1, 13) as bigint) / 4503599627370496::double) * 17) as bigint) as x1, cast(floor((cast('0x' || substr(sha256('y' || i || '|' || (k + 5)), 1, 13) as bigint) / 4503599627370496::double) * 49) as bigint) as y1 from (select o_orderkey as k from orders), (select unnest(range(0, 2)) as i)")
def synthetic_squares(c: Catalogue) -> DataFrame:
    from ..sources import synthetic

    return synthetic.squares(c.ids, 5)[1].select("sample_id", "slot", "label", "x1", "y1")


@query(sql("select sample_id, slot, label, sum(bit_count(bits))::bigint as area from merged group by 1, 2, 3", "merged"))
def e2e_instance_preset(c: Catalogue) -> DataFrame:
    from . import pipeline, presets

    config = presets.Paste(placement.Placement(k_range=(1, 3)), min_residual_area_frac=0.1, slots=24)
    out = pipeline.augment(c.samples, c.instances, c.rows, config, 16, 16)
    return out.instances.groupBy("sample_id", "slot", "label").agg(F.sum(F.bit_count("bits")).alias("area"))


@query(sql("select a.sample_id, case when g.class_id is not null and p.x is not null then b.class_id else a.class_id end as class_id, count(*) as area from semafter a join sempix b using (sample_id, y, x) left join pastepix p using (sample_id, y, x) left join gone g on g.sample_id = b.sample_id and g.class_id = b.class_id where (case when g.class_id is not null and p.x is not null then b.class_id else a.class_id end) is not null group by 1, 2", "semafter", "sempix", "pastepix", "gone"))
def e2e_panoptic_preset(c: Catalogue) -> DataFrame:
    from . import pipeline, presets

    config = presets.Paste(placement.Placement(k_range=(1, 3)), tau_stuff_frac=0.5, slots=24)
    out = pipeline.augment(c.samples, c.instances, c.rows, config, 16, 16, c.semantic, c.stuff)
    return composite.histogram(out.semantic)


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(avg(value), 6) as mean from events group by 1, 2")
def step_counts(c: Catalogue) -> DataFrame:
    from ..streaming import steps

    return steps.step_counts(c.table("events")).select("start", "event_type", "n", r6("mean", "mean"))


from . import files, wide  # noqa: E402, F401  (files adds its queries to those of wide)

QUERIES |= wide.QUERIES
ORACLES |= wide.ORACLES
