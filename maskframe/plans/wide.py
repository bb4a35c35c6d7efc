"""Queries over wide canvases: masks of 512 by 512 pixels, and every layer through the whole augmentation at 75 by 50."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rle
from ..operators import composite, dense, evaluate, layers, placement, resample, tiles, warp
from ..sources import testdata as td
from ..workers import reach
from . import pipeline, presets
from .oracle import u

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Wide:
    """Lazily built relations of one canvas size."""

    def __init__(self, spark: SparkSession, sf_dir: str, w: int, h: int, config: placement.Placement | None = None):
        self.spark, self.dir, self.w, self.h = reach(spark), sf_dir, w, h
        self.samples, self.instances = td.wide_samples(spark, sf_dir, w, h), td.wide_instances(spark, sf_dir, w, h)
        self.rows = td.wide_rows(self.instances)
        self.placed, self.slots = placement.place(self.samples, self.instances, config or placement.Placement(k_range=(1, 5)))
        self.warped = warp.masks(self.slots, self.rows, h, w)

    def layers(self, *keep: str, config: presets.Paste | None = None, sums: bool = True, audit: bool = False, masks: bool = True, **paste) -> DataFrame:
        config = config or presets.Paste(placement.Placement(k_range=(1, 5)), slots=24, **paste)
        return pipeline.whole(td.wide_boxes(self.samples, self.instances), self.placed, self.slots, config, stuff=frozenset(range(td.THINGS, 20)), load=td.draw_layers, keep=keep, sums=sums, audit=audit, masks=masks)


def tables(w: int, h: int, k: int = 5, paste: float = 1.0, things: int | None = None) -> dict[str, tuple[str, str]]:
    """DuckDB table expressions of the same relations; 1 to ``k`` pastes, with the probability ``paste``, of labels below ``things``."""
    bw, bh = f"(8 + c_custkey * 13 % {w // 4})", f"(6 + c_custkey * 7 % {h // 4})"
    x1, y1 = f"(c_custkey * 37 % ({w} - {bw}))", f"(c_custkey * 53 % ({h} - {bh}))"
    near = "round_even({0}, 0)"
    # Depth, a double on small canvases and a float on others.
    real = "(1 + (({0} * 17 + {1} * 3 + {2} * 5) % 97)::" + ("double" if w * h < 10_000 else "real") + " / 10)::" + ("double" if w * h < 10_000 else "real") + "::double"
    grid = f"(select unnest(range(0, {h})) as y) y cross join (select unnest(range(0, {w})) as x) x"
    run = lambda a, n, rest: f"(repeat('0', ({a})::int) || repeat('1', ({n})::int) || repeat('0', ({rest})::int))::bit"
    return {
        "samp": ("", f"select s_suppkey::bigint as sample_id, s_suppkey // 8 as batch_id, row_number() over (partition by s_suppkey // 8 order by s_suppkey) - 1 as pos, count(*) over (partition by s_suppkey // 8) as n, {h} - s_suppkey % 3 as hv, {w} - s_suppkey % 2 as wv from supplier"),
        "inst": ("", f"select c_custkey // 15 as sample_id, c_custkey % 15 as slot, c_custkey % 20 as label, {x1} as x1, {y1} as y1, {x1} + {bw} as x2, {y1} + {bh} as y2 from customer"),
        "drawn": ("samp", f"select s.*, (s.pos + 1 + cast(floor({u('src0')} * (n - 1)) as bigint)) % n as src_pos, 0.5::double + {u('scale0')} * 1.5::double as scale, {u('flip0')} < 0.5 as hflip, 1 + cast(floor({u('k0')} * {k}) as bigint) as kmax, {u('paste0')} < {paste} as do_paste from samp s where n > 1"),
        "pair": ("drawn samp", "select d.sample_id, d.scale, d.hflip, d.kmax, d.do_paste, s.sample_id as src_id, s.hv, s.wv from drawn d join samp s on s.batch_id = d.batch_id and s.pos = d.src_pos"),
        "edges": ("pair inst", "select p.*, i.slot, i.label, i.x1, i.y1, i.x2, i.y2, case when hflip then wv - 1 - x1 else x2 end as \"right\" from pair p join inst i on i.sample_id = p.src_id"),
        "bound": ("edges", f"select sample_id, greatest(0.0::double, {h} - max(y2 * scale)) as ry, greatest(0.0::double, {w} - max(\"right\" * scale)) as rx from edges group by 1"),
        "place": ("edges bound", f"select distinct e.sample_id, e.src_id, e.scale, e.hflip, e.hv, e.wv, e.kmax, {u('ty0', 'e.sample_id')} * ry as ty, {u('tx0', 'e.sample_id')} * rx as tx from edges e join bound b using (sample_id)"),
        "slots": ("edges place", f"select *, gate and sum(gate::int) over (partition by sample_id order by slot) <= kmax as paste_valid from (select e.*, p.ty, p.tx, (y2 * e.scale + ty <= {h} and \"right\" * e.scale + tx <= {w} and y2 <= e.hv and x2 <= e.wv and do_paste{'' if things is None else f' and label < {things}'}) as gate from edges e join place p using (sample_id))"),
        # A rectangle's warp is a rectangle: the rows and the columns whose nearest source lies in it.
        "spans": ("slots", f"select sample_id, slot, label, list_filter(range(0, {h}), lambda y: {near.format('(y - ty) / scale')} between y1 and y2 - 1) as ys, list_filter(range(0, {w}), lambda x: {near.format('case when hflip then wv - 1 - (x - tx) / scale else (x - tx) / scale end')} between x1 and x2 - 1) as xs from slots where paste_valid"),
        "lines": ("spans", f"select sample_id, y, bit_or({run('xs[1]', 'len(xs)', f'{w} - xs[1] - len(xs)')}) as paste from (select sample_id, xs, unnest(ys) as y from spans where len(xs) > 0) group by 1, 2"),
        "rest": ("inst lines", f"select sample_id, slot, label, bit_count(b)::bigint as before, bit_count(case when paste is null then b else b & ~paste end)::bigint as after from (select sample_id, slot, label, unnest(range(y1, y2)) as y, {run('x1', 'x2 - x1', f'{w} - x2')} as b from inst) left join lines using (sample_id, y)"),
        "areas": ("rest", "select sample_id, slot, label, sum(before)::bigint as before, sum(after)::bigint as after from rest group by 1, 2, 3"),
        # The same areas where depth is tested: only pixels that are nearer than the target, or where its depth is unknown, cover it.
        "inner": ("raw place", f"select sample_id, y, x from (select r.sample_id, r.y, r.x, src_id, hv, wv, (r.y - ty) / scale as sy, case when hflip then wv - 1 - (r.x - tx) / scale else (r.x - tx) / scale end as sx from raw r join place p using (sample_id)) where round_even(sy, 0) < hv and round_even(sx, 0) < wv and ((sample_id + y * 3 + x * 7) % 11 = 0 or {taps(w, h, real.format('src_id', 'Y', 'X'))} < {real.format('sample_id', 'y', 'x')})"),
        "eareas": ("inst inner", "select i.sample_id, i.slot, i.label, (x2 - x1) * (y2 - y1) as before, (x2 - x1) * (y2 - y1) - coalesce(n, 0) as after from inst i left join (select i.sample_id, i.slot, count(*) as n from inst i join inner p on p.sample_id = i.sample_id and p.y between y1 and y2 - 1 and p.x between x1 and x2 - 1 group by 1, 2) using (sample_id, slot)".replace("join inner p", "join \"inner\" p")),
        "ekept": ("eareas", "select * from eareas where after >= 0.1::double * before"),
        "efree": ("samp ekept", "select sample_id, slot, row_number() over (partition by sample_id order by slot) as nth from (select sample_id, unnest(range(0, 24)) as slot from samp) f where not exists (select 1 from ekept k where k.sample_id = f.sample_id and k.slot = f.slot)"),
        "kept": ("areas", "select * from areas where after >= 0.1::double * before"),
        "pasted": ("spans", "select sample_id, slot as src_slot, label, len(ys) * len(xs) as area, row_number() over (partition by sample_id order by slot) as nth from spans where len(ys) > 0 and len(xs) > 0"),
        "free": ("samp kept", "select sample_id, slot, row_number() over (partition by sample_id order by slot) as nth from (select sample_id, unnest(range(0, 24)) as slot from samp) f where not exists (select 1 from kept k where k.sample_id = f.sample_id and k.slot = f.slot)"),
        # Pixels.
        "top": ("inst", "select sample_id, y, x, arg_max(label, slot) as label, max(slot) as slot from (select *, unnest(range(x1, x2)) as x from (select *, unnest(range(y1, y2)) as y from inst)) group by 1, 2, 3"),
        "px": ("samp top", f"select s.sample_id, y.y, x.x, t.label as top, coalesce(t.label, s.sample_id % 6 + 14) as sem, case when t.label < 14 then t.slot + 1 else 0 end as pan, 1 + (s.sample_id * 17 + y.y * 3 + x.x * 5) % 97 / 10.0::double as depth, (s.sample_id + y.y * 3 + x.x * 7) % 11 <> 0 as ok, y.y >= s.hv or x.x >= s.wv as pad from samp s cross join {grid} left join top t on t.sample_id = s.sample_id and t.y = y.y and t.x = x.x"),
        "spot": ("place", f"select p.sample_id, p.src_id, p.hflip, p.hv, p.wv, y.y, x.x, (y.y - ty) / scale as sy, case when hflip then wv - 1 - (x.x - tx) / scale else (x.x - tx) / scale end as sx from place p cross join {grid}"),
        "raw": ("spans", "select distinct sample_id, y, x from (select sample_id, y, unnest(xs) as x from (select sample_id, xs, unnest(ys) as y from spans))"),
        "sides": ("px spot raw", f"select t.sample_id, t.y, t.x, t.sem, t.pan, t.depth, t.ok, a.src_id, a.hflip, a.sy, a.sx, r.x is not null as paste, s.sem as ssem, s.pan as span, coalesce(s.ok, false) as sok, coalesce(not s.pad, false) as live, {taps(w, h, '1 + (a.src_id * 17 + Y * 3 + X * 5) % 97 / 10.0::double', 'a.')} as sdepth from px t join spot a using (sample_id, y, x) left join raw r using (sample_id, y, x) left join px s on s.sample_id = a.src_id and s.y = round_even(a.sy, 0) and s.x = round_even(a.sx, 0)"),
        "eff": ("sides", "select *, paste and (sdepth < depth or not ok) and live as inside, 1 + (y * 3 + x) % 7 as weight from sides"),
        # Background classes of which less than a tenth would be left are given back where they were pasted over.
        "hists": ("eff", "select sample_id, c, sum(b)::bigint as before, sum(a)::bigint as after from (select sample_id, sem as c, 1 as b, 0 as a from eff union all select sample_id, case when inside then ssem else sem end, 0, 1 from eff) group by 1, 2"),
        "gone": ("hists", "select sample_id, c from hists where c >= 14 and before > 0 and after < 0.1::double * before"),
        "fin": ("eff gone", "select e.*, g.c is not null and paste as back, case when g.c is not null and paste then sem when inside then ssem else sem end as final from eff e left join gone g on g.sample_id = e.sample_id and g.c = e.sem"),
        "pareas": ("inst fin", "select i.sample_id, i.slot, i.label, (x2 - x1) * (y2 - y1) as before, (x2 - x1) * (y2 - y1) - coalesce(n, 0) as after from inst i left join (select i.sample_id, i.slot, count(*) as n from inst i join fin p on p.sample_id = i.sample_id and p.y between y1 and y2 - 1 and p.x between x1 and x2 - 1 where inside and not back group by 1, 2) using (sample_id, slot)"),
        "ppasted": ("spans fin", "select s.sample_id, s.slot, s.label, count(*) as area from (select sample_id, slot, label, y, unnest(xs) as x from (select sample_id, slot, label, xs, unnest(ys) as y from spans)) s join fin f on f.sample_id = s.sample_id and f.y = s.y and f.x = s.x where not back group by 1, 2, 3"),
    }


def taps(w: int, h: int, value: str, a: str = "") -> str:
    """The bilinear sample of ``value`` (of Y and X) at sy, sx; zero outside the source."""
    out = []
    for dy in (0, 1):
        for dx in (0, 1):
            y, x = f"cast(floor({a}sy) + {dy} as bigint)", f"cast(floor({a}sx) + {dx} as bigint)"
            wy, wx = (f"({a}{c} - floor({a}{c}))" if d else f"(1 - ({a}{c} - floor({a}{c})))" for c, d in (("sy", dy), ("sx", dx)))
            out.append(f"{wy} * {wx} * (case when {y} between 0 and {h - 1} and {x} between 0 and {w - 1} then {value.replace('Y', y).replace('X', x)} else 0 end)")
    return "(" + " + ".join(out) + ")"


def sql(select: str, w: int, h: int, *needs: str, **config) -> str:
    every, order = tables(w, h, **config), []

    def add(name: str) -> None:
        if name not in order:
            for n in every[name][0].split():
                add(n)
            order.append(name)

    for n in needs:
        add(n)
    return ("with " + ", ".join(f'"{n}" as materialized ({every[n][1]})' for n in order) + " " if order else "") + select  # a select that starts with a comma has tables of its own


def query(w: int, h: int, select: str | None = None, *needs: str, **config):
    def put(f: Callable[[Wide], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Wide(spark, sf_dir, w, h))
        if select:
            ORACLES[f.__name__] = sql(select, w, h, *needs, **config)
        return f

    return put


def pixel_sums(rows: DataFrame, *by: str) -> DataFrame:
    """(by, area, sx, sy): pixels of the masks and the sums of their columns and rows, found from stretches."""
    from .. import bits

    r = bits.keyed(rows).select(*by, "y", "k", F.explode(bits.runs(F.col("bits"))).alias("r"))
    n, first = F.col("r.b") - F.col("r.a") + 1, F.col("k") * bits.WORD + F.col("r.a")
    return r.groupBy(*by).agg(F.sum(n).cast("long").alias("area"), F.sum((first * n + n * (n - 1) / 2).cast("long")).alias("sx"), F.sum(F.col("y") * n).cast("long").alias("sy"))


_BOX = "select sample_id, slot, (x2 - x1) * (y2 - y1) as area, (y2 - y1) * (x1 + x2 - 1) * (x2 - x1) // 2 as sx, (x2 - x1) * (y1 + y2 - 1) * (y2 - y1) // 2 as sy from inst"


def _counts(c: Wide) -> DataFrame:
    """Column-major counts of the rectangles."""
    size = F.col("y2") - F.col("y1")
    runs = F.flatten(F.transform(F.sequence(F.col("x1"), F.col("x2") - 1), lambda x: F.array(F.when(x == F.col("x1"), x * c.h + F.col("y1")).otherwise(c.h - size), size)))
    return c.instances.select("sample_id", "slot", F.lit(c.h).cast("long").alias("h"), runs.alias("counts"))


@query(512, 512, _BOX, "inst")
def rle_decode_wide(c: Wide) -> DataFrame:
    return pixel_sums(rle.decode(_counts(c)), "sample_id", "slot")


@query(512, 512, _BOX, "inst")
def rle_compressed_wide(c: Wide) -> DataFrame:
    """Counts to compressed strings and back, then to scanlines."""
    return pixel_sums(rle.decode(rle.uncompressed(rle.compressed(_counts(c)))), "sample_id", "slot")


@query(75, 50, _BOX, "inst")
def polygon_area_wide(c: Wide) -> DataFrame:
    poly = F.array(*[F.col(v).cast("double") for v in ("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2")])
    p = rle.polygons(c.instances.select((F.col("sample_id") * 100 + F.col("slot")).alias("id"), F.lit(c.h).alias("h"), F.lit(c.w).alias("w"), F.array(poly).alias("polygons")))
    return pixel_sums(p, "id").select(F.floor(F.col("id") / 100).alias("sample_id"), (F.col("id") % 100).alias("slot"), "area", "sx", "sy")


@query(512, 512, "select sample_id, slot, label, len(ys) * len(xs) as area, (len(ys) * list_sum(xs))::bigint as sx, (len(xs) * list_sum(ys))::bigint as sy from spans where len(xs) > 0 and len(ys) > 0", "spans")
def warp_wide(c: Wide) -> DataFrame:
    return pixel_sums(c.warped, "sample_id", "slot", "label")


@query(512, 512, "select sample_id, slot, label, before, after from areas", "areas")
def survivor_wide(c: Wide) -> DataFrame:
    return composite.survivor_area(c.rows, composite.union(c.warped))


_MERGED = "select sample_id, slot, label, after as area from kept union all select p.sample_id, f.slot, p.label, p.area from pasted p join free f using (sample_id, nth)"


@query(512, 512, _MERGED, "kept", "pasted", "free")
def e2e_wide_masks(c: Wide) -> DataFrame:
    """The instance paste at 512 by 512 as relations: scanline words from the boxes to the merged slots."""
    config = presets.Paste(placement.Placement(k_range=(1, 5)), min_residual_area_frac=0.1, slots=24)
    out = pipeline.augment(c.samples, c.instances, c.rows, config, c.h, c.w)
    return out.instances.groupBy("sample_id", "slot", "label").agg(F.sum(F.bit_count("bits")).alias("area"))


@query(512, 512, _MERGED.replace("from kept", "from ekept").replace("join free", "join efree"), "ekept", "pasted", "efree")
def e2e_wide_layers(c: Wide) -> DataFrame:
    """The same paste of whole samples with all their layers, depth tested: one group a batch."""
    out = c.layers(min_residual_area_frac=0.1, sums=False, masks=False).select("sample_id", F.explode("instances").alias("i"))
    return out.select("sample_id", "i.slot", "i.label", F.col("i.after").alias("area"))


def _layer(select: str) -> tuple:
    return 75, 50, select, "eff"


def _totals(c: Wide, *names: str) -> DataFrame:
    out = layers.digests(c.layers(min_residual_area_frac=0.1)).where(F.col("layer").isin(*names))
    return out.select("sample_id", "layer", F.round("total", 3).alias("total"))


def _sum(name: str, value: str) -> str:
    return f"select sample_id, '{name}' as layer, round(sum(weight * ({value})), 3)::double as total from eff group by 1"


_IMAGE = " + ".join(f"{c + 1} * (case when inside then round_even({taps(75, 50, f'((src_id * 31 + Y * 7 + X * 13 + {29 * c}) % 256)')}, 0) else (sample_id * 31 + y * 7 + x * 13 + {29 * c}) % 256 end)" for c in range(3))


@query(*_layer(_sum("image", _IMAGE)))
def layer_image(c: Wide) -> DataFrame:
    return _totals(c, "image")


@query(*_layer(_sum("semantic", "case when inside then ssem else sem end")))
def layer_semantic(c: Wide) -> DataFrame:
    return _totals(c, "semantic")


@query(*_layer(_sum("panoptic", "case when inside then span else pan end")))
def layer_panoptic(c: Wide) -> DataFrame:
    return _totals(c, "panoptic")


@query(*_layer(_sum("depth", "case when inside then sdepth else depth end") + " union all " + _sum("depth_ok", "(case when paste then sok and ok else ok end)::int") + " union all " + _sum("paste", "inside::int")))
def layer_depth(c: Wide) -> DataFrame:
    return _totals(c, "depth", "depth_ok", "paste")


_SIGN = taps(75, 50, "(case when (src_id + Y) % 2 = 0 then 1.0::double else -1.0::double end)")
_ONE = taps(75, 50, "1.0::double")


@query(*_layer(_sum("normals", f"case when inside then (case when hflip then -1 else 1 end) * 0.6::double * {_SIGN} + 3 * 0.8::double * {_ONE} else 0.6::double * (case when (sample_id + y) % 2 = 0 then 1 else -1 end) + 3 * 0.8::double end")))
def layer_normals(c: Wide) -> DataFrame:
    return _totals(c, "normals")


@query(512, 512, "select s.sample_id, count(k.slot) as n_kept, sum(k.after)::bigint as area from samp s join kept k using (sample_id) group by 1".replace("kept k", "ekept k"), "samp", "ekept")
def residual_wide(c: Wide) -> DataFrame:
    """Targets that keep a tenth of their area, from whole samples."""
    out = c.layers(min_residual_area_frac=0.1).select("sample_id", F.explode("instances").alias("i")).where("not i.pasted")
    return out.groupBy("sample_id").agg(F.count("*").alias("n_kept"), F.sum("i.after").alias("area"))


#: Test labels as published ids: fourteen things, then six kinds of background.
PUBLISHED = (*presets.THINGS[: td.THINGS], *presets.STUFF[: 20 - td.THINGS])


def published(label) -> F.Column:
    return F.element_at(F.array(*[F.lit(i) for i in PUBLISHED]), (label + 1).cast("int")).cast("long")


def draw_published(r: dict) -> dict:
    """Layers with published ids; the boxes of the row have them already."""
    back = {c: i for i, c in enumerate(PUBLISHED)}
    out = td.draw_layers(r | {"boxes": [b | {"label": back[b["label"]]} for b in r["boxes"] or []]})
    sem = np.array(PUBLISHED, "<i2")[np.frombuffer(out["semantic"], "<i2")]
    return out | {"semantic": sem.tobytes(), "instances": [i | {"label": PUBLISHED[i["label"]]} for i in out["instances"]]}


def preset(c: Wide, config: presets.Paste, **options) -> DataFrame:
    """Merged outcomes of a preset over all samples, with published ids."""
    inst = c.instances.withColumn("label", published(F.col("label")))
    return pipeline.from_preset(c.samples, inst, td.wide_boxes(c.samples, inst), config, draw_published, **options)


_KEPT = "select sample_id, count(*) as n, sum(after)::bigint as area from (select sample_id, after from {0} where after >= 0.1::double * before union all select sample_id, area from {1}) group by 1"


def _instances(out: DataFrame) -> DataFrame:
    """Samples with instances: how many there are after merging, and their pixels."""
    return out.where(F.size("instances") > 0).withColumn("n", F.size("instances").cast("long")).withColumn("area", F.aggregate("instances", F.lit(0).cast("long"), lambda a, i: a + i["after"]))


@query(512, 512, _KEPT.format("eareas", "pasted"), "eareas", "pasted", k=32)
def preset_instance_512(c: Wide) -> DataFrame:
    """The named instance preset over whole samples: instances after dropping and merging, and their pixels."""
    return _instances(preset(c, presets.get("coco-instance"), sums=False)).select("sample_id", "n", "area")


_IDS = "[" + ", ".join(map(str, PUBLISHED)) + "]"


@query(75, 50, f"select k.sample_id, k.n, k.area, f.semantic from ({_KEPT.format('pareas', 'ppasted')}) k join (select sample_id, sum(weight * {_IDS}[final + 1])::double as semantic from fin group by 1) f using (sample_id)", "pareas", "ppasted", "fin", k=20, paste=0.5, things=14)
def preset_panoptic(c: Wide) -> DataFrame:
    """The named panoptic preset: things alone are pasted, background that would vanish is given back; instances and class layer."""
    out = _instances(preset(c, presets.get("coco-panoptic")))
    return out.select("sample_id", "n", "area", F.element_at("totals", F.lit("semantic")).alias("semantic"))


@query(75, 50)
def preset_panoptic_harmonized(c: Wide) -> DataFrame:
    """The named panoptic preset with every paste blended by multiple bands, on canvases of whole patches."""
    out = preset(c, replace(presets.get("coco-panoptic"), harmonize=presets.Harmonize(prob=1.0, levels=4)), pad_to=16)
    return out.select("sample_id", "h", "w", F.size("instances").alias("n"), F.round(F.element_at("totals", F.lit("image")), 0).alias("image"), F.element_at("totals", F.lit("semantic")).alias("semantic"))


@query(75, 50)
def preset_invariants(c: Wide) -> DataFrame:
    """Every check that applies, over the outcomes of both presets: how many samples pass it. One scan of the outcomes each."""
    out = None
    for name in presets.names():
        p = presets.get(name)
        r = evaluate.evaluated(preset(c, p, sums=False, audit=True), pipeline.rules(p))
        n = r.groupBy("name").agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("long")).alias("n_ok"), F.sum("n_bad").alias("n_bad")).withColumn("preset", F.lit(name))
        out = n if out is None else out.unionByName(n)
    return out


@query(75, 50)
def fault_injection(c: Wide) -> DataFrame:
    """Outcomes of the panoptic preset, spoiled in every way: how many faults were found by the check for it, and by no other."""
    p = presets.get("coco-panoptic")
    found = evaluate.injected(preset(c, p, sums=False, audit=True), pipeline.rules(p))
    return found.groupBy("fault", "expected").agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("long")).alias("n_ok"))


@query(75, 50, "select sample_id, src_id, hflip, scale, area::bigint as area, paste::bigint as paste, n from (select sample_id, any_value(src_id) as src_id, any_value(hflip) as hflip, sum(paste::int) as area, sum(inside::int) as paste from eff group by 1) join (select sample_id, scale from place) using (sample_id) left join (select sample_id, count(*) as n from inst group by 1) using (sample_id)", "eff", "place", "inst")
def audit_records(c: Wide) -> DataFrame:
    """What was there before: placements, the union of the masks before and after the depth test, the target's instances."""
    out = c.layers("paste", sums=False, audit=True)
    some = out.where("audit.src_id is not null").select("sample_id", "audit.src_id", "audit.hflip", "audit.scale", F.col("audit.union").alias("area"), "paste", F.size("audit.before.instances").cast("long").alias("n"))
    return layers.bit_sums(some, "area", "paste")


_CROP = 8


def _crops(c: Wide) -> DataFrame:
    """Crops of eight by eight pixels, one a vector; image and alpha are patterns of the index."""
    byte = lambda v: F.lpad(F.hex(v), 2, "0")
    idx = F.col("idx")
    e = c.spark.read.parquet(f"{c.dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("idx"), F.col("label").cast("long").alias("class_id"))
    image = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3 * _CROP * _CROP - 1)), lambda i: byte((idx * 5 + i * 3) % 256)), ""))
    alpha = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(_CROP * _CROP - 1)), lambda i: F.when((idx + i) % 4 != 0, "FF").otherwise("00")), ""))
    return e.select("idx", "class_id", image.alias("image"), alpha.alias("alpha"))


_BANK_AT = f"select s.sample_id, b.vec_id as idx, b.label as class_id, hflip, scale, {u('ty0', 's.sample_id')} * greatest(0, 50 - 8 * scale) as ty, {u('tx0', 's.sample_id')} * greatest(0, 75 - 8 * scale) as tx from (select *, 0.5::double + {u('scale0')} * 1.5::double as scale, {u('flip0')} < 0.5 as hflip, cast(floor({u('bank0')} * (select count(*) from embeddings)) as bigint) as pick from samp) s join embeddings b on b.vec_id = s.pick"


@query(75, 50, f"select sample_id, idx, class_id, count(*) as area, sum(x)::bigint as sx, sum(y)::bigint as sy from (select *, cast(round_even((y - ty) / scale, 0) as bigint) as ny, cast(round_even(case when hflip then 7 - (x - tx) / scale else (x - tx) / scale end, 0) as bigint) as nx from ({_BANK_AT}) cross join (select unnest(range(0, 50)) as y) cross join (select unnest(range(0, 75)) as x)) where ny between 0 and 7 and nx between 0 and 7 and (idx + ny * 8 + nx) % 4 <> 0 group by 1, 2, 3", "samp")
def bank_paste(c: Wide) -> DataFrame:
    """Crops of a bank pasted onto whole samples: where the pasted instance lies."""
    return _pasted_pixels(_sourced(c, presets.FromBank()), c.w)


def _sourced(c: Wide, source: presets.FromBatch | presets.FromBank) -> DataFrame:
    """Samples with what was pasted onto them from the configured source: class, crop and mask."""
    crops, config = _crops(c), presets.Paste(placement.Placement(k_range=(1, 5)) if source.kind == "intra_batch" or source.share < 1 else placement.Placement(), slots=64, source=source)
    at, slots, sources = pipeline.sourced(c.samples, c.instances, config, crops, crops.count(), (_CROP, _CROP))
    boxes = "array<struct<slot:long,label:long,x1:long,y1:long,x2:long,y2:long>>"
    sources = sources.withColumn("boxes", F.lit(None).cast(boxes)) if sources is not None else None
    out = pipeline.whole(td.wide_boxes(c.samples, c.instances), at, slots, config, sources, load=draw_targets, keep=(), sums=False).select("sample_id", "h", "w", F.explode("instances").alias("i")).where("i.pasted")
    return out.join(at.select("sample_id", "src_id"), "sample_id").select("sample_id", "h", "w", F.when(F.col("src_id") < 0, pipeline.crop_id(F.col("src_id"))).alias("idx"), F.col("i.label").alias("class_id"), F.col("i.mask").alias("mask"))


def _pasted_pixels(rows: DataFrame, w: int) -> DataFrame:
    """(sample_id, idx, class_id, area, sx, sy) of packed masks, summed where they are unpacked."""

    def run(batches):
        for b in batches:
            found = [np.nonzero(layers.unpacked(m, h, w)) for m, h in zip(b.column("mask").to_pylist(), b.column("h").to_pylist())]
            sums = [pa.array([int(v) for v in x], pa.int64()) for x in zip(*((len(y), x.sum(), y.sum()) for y, x in found))] if found else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("sample_id", "idx", "class_id")), *sums], names=["sample_id", "idx", "class_id", "area", "sx", "sy"])

    one = rows.select("sample_id", "idx", "class_id", "h", "mask").mapInArrow(run, "sample_id long, idx long, class_id long, area long, sx long, sy long")
    return one.groupBy("sample_id", "idx", "class_id").agg(*[F.sum(v).alias(v) for v in ("area", "sx", "sy")])


_BANK_PIXELS = f"select sample_id, idx, class_id, count(*) as area, sum(x)::bigint as sx, sum(y)::bigint as sy from (select *, cast(round_even((y - ty) / scale, 0) as bigint) as ny, cast(round_even(case when hflip then 7 - (x - tx) / scale else (x - tx) / scale end, 0) as bigint) as nx from ({_BANK_AT}) cross join (select unnest(range(0, 50)) as y) cross join (select unnest(range(0, 75)) as x)) where ny between 0 and 7 and nx between 0 and 7 and (idx + ny * 8 + nx) % 4 <> 0 group by 1, 2, 3"
_OWN_PIXELS = "select sample_id, -1 as idx, label as class_id, sum(len(xs) * len(ys))::bigint as area, sum(len(ys) * list_sum(xs))::bigint as sx, sum(len(xs) * list_sum(ys))::bigint as sy from spans where len(xs) > 0 and len(ys) > 0 group by 1, 2, 3"


@query(75, 50, f"select * from ({_BANK_PIXELS}) where {u('source0')} < 0.4 union all select * from ({_OWN_PIXELS}) where {u('source0')} >= 0.4", "samp", "spans")
def source_mixture(c: Wide) -> DataFrame:
    """Two targets in five take a crop of the bank, the others instances of their batch: what was pasted, in one exchange."""
    return _pasted_pixels(_sourced(c, presets.FromBank(share=0.4)), c.w).withColumn("idx", F.coalesce("idx", F.lit(-1).cast("long")))


def draw_targets(r: dict) -> dict:
    """Layers of targets; crops bring their own."""
    if not r["target"]:
        return r | {n: r.get(n) for n in (*layers.LAYERS, *layers.BITS)}
    return td.draw_layers(r)


def _tiled(c: Wide, size: int) -> DataFrame:
    parts = tiles.drawn(td.wide_boxes(c.samples, c.instances).drop("batch_id"), size, td.draw_layers)
    return tiles.pasted(parts, c.placed, c.slots, size)


@query(512, 512, "select sample_id, slot, false as pasted, label, before, after from eareas union all select sample_id, src_slot, true, label, area, area from pasted", "eareas", "pasted")
def tiles_512(c: Wide) -> DataFrame:
    """Areas of both sides' instances, composed in tiles of 128 pixels: the same as of whole canvases."""
    return tiles.areas(_tiled(c, 128))


@query(75, 50, " union all ".join([_sum("semantic", "case when inside then ssem else sem end"), _sum("depth", "case when inside then sdepth else depth end"), _sum("paste", "inside::int"), _sum("image", _IMAGE)]), "eff")
def tiles_layers(c: Wide) -> DataFrame:
    """Layers composed in tiles of 16 pixels."""
    out = tiles.totals(_tiled(c, 16), 16).where(F.col("layer").isin("semantic", "depth", "paste", "image"))
    return out.select("sample_id", "layer", F.round("total", 3).alias("total"))


# ---- the per-sample kernel, and jitter of pixels

_NEXT = "(select s.sample_id, t.sample_id as src_id from samp s join samp t on t.batch_id = s.batch_id and t.pos = (s.pos + 1) % s.n where s.n > 1)"
_DENSE_PIXELS = f"select n.sample_id, t.y, t.x from {_NEXT} n join px t on t.sample_id = n.sample_id join px s on s.sample_id = n.src_id and s.y = t.y and s.x = t.x where s.top is not null and not s.pad and (s.depth < t.depth or not t.ok)"


def with_mask(r: dict) -> dict:
    """A drawn sample with the union of its masks, as which it is pasted."""
    out = td.draw_layers(r)
    union = np.zeros((r["h"], r["w"]), bool)
    for i in out["instances"]:
        union |= layers.unpacked(i["mask"], r["h"], r["w"])
    return out | {"mask": layers.packed(union)}


@query(75, 50, f", hit as materialized ({_DENSE_PIXELS}), own as materialized (select i.sample_id, i.slot, i.label, p.y, p.x, h.x is not null as gone from inst i join {_NEXT} n on n.sample_id = i.sample_id join (select y.y, x.x from (select unnest(range(0, 50)) as y) y cross join (select unnest(range(0, 75)) as x) x) p on p.y between y1 and y2 - 1 and p.x between x1 and x2 - 1 left join hit h on h.sample_id = i.sample_id and h.y = p.y and h.x = p.x) select sample_id, slot as instance_id, label, false as pasted, min(x) filter (not gone) as x1, min(y) filter (not gone) as y1, max(x) filter (not gone) as x2, max(y) filter (not gone) as y2, count(*) filter (not gone) as area from own group by 1, 2, 3 having count(*) filter (not gone) >= 50 and 1 - count(*) filter (not gone) / (count(*) + 1e-8::double) <= 0.99 union all select n.sample_id, coalesce(m.top, -1) + row_number() over (partition by n.sample_id order by s.slot) as instance_id, s.label, true, x1, y1, x2 - 1, y2 - 1, (x2 - x1) * (y2 - y1) from {_NEXT} n join inst s on s.sample_id = n.src_id left join (select sample_id, max(slot) as top from inst group by 1) m on m.sample_id = n.sample_id", "samp", "inst", "px")
def dense_composite(c: Wide) -> DataFrame:
    """Every sample under the masks of the next one of its batch, by the per-sample kernel: instances, ids, boxes and areas."""
    placed = placement.cyclic(c.samples).where("src_pos is not null").select("sample_id", "batch_id", "src_pos").join(c.samples.select("batch_id", F.col("pos").alias("src_pos"), F.col("sample_id").alias("src_id")), ["batch_id", "src_pos"]).select("sample_id", "src_id")
    out = dense.composed(dense.paired(td.wide_boxes(c.samples, c.instances), placed), load=with_mask)
    i = out.select("sample_id", F.explode("instances").alias("i"))
    return i.select("sample_id", "i.instance_id", "i.label", "i.pasted", *[F.col(f"i.{v}").cast("long").alias(v) for v in ("x1", "y1", "x2", "y2", "area")])


_TH, _TW = 48, 64
_SIZED = f"(select sample_id, mirror, cast(round_even(50 * k, 0) as bigint) as nh, cast(round_even(75 * k, 0) as bigint) as nw from (select sample_id, {u('mirror0')} < 0.5 as mirror, least({_TH} * s / 50, {_TW} * s / 75) as k from (select sample_id, 0.5::double + {u('resize0')} * 1.0::double as s from samp)))"
_CUT = f"(select *, least({_TH}, nh) as ch, least({_TW}, nw) as cw, cast(floor({u('cropy0')} * (greatest(0, nh - {_TH}) + 1)) as bigint) as top, cast(floor({u('cropx0')} * (greatest(0, nw - {_TW}) + 1)) as bigint) as lft from {_SIZED})"


def _taps(n: int, m: str, count: str, first: str, name: str) -> str:
    """(sample_id, o, i, wt): normalised weights of the triangle along one axis."""
    centre, wide = f"(({first} + o + 0.5::double) * ({n} / {m}::double))", f"greatest({n} / {m}::double, 1.0::double)"
    raw = f"select sample_id, o, unnest(range(greatest(cast(floor({centre} - {wide} + 0.5::double) as bigint), 0), least(cast(floor({centre} + {wide} + 0.5::double) as bigint), {n}))) as i, {centre} as centre, {wide} as wide from (select *, unnest(range(0, {count})) as o from cut)"
    return f"{name} as materialized (select sample_id, o, i, wt / sum(wt) over (partition by sample_id, o) as wt from (select sample_id, o, i, greatest(1 - abs(i + 0.5::double - centre) / wide, 0) as wt from ({raw})))"


_JITTER = f""", cut as materialized {_CUT}, {_taps(50, 'nh', 'ch', 'top', 'wy')}, {_taps(75, 'nw', 'cw', 'lft', 'wx')},
image as (select sample_id, 'image' as layer, sum((1 + (y * 3 + x) % 7) * (c + 1) * floor(v + 0.5::double + 1e-9::double)) as total from (select a.sample_id, a.o as y, b.o as x, c.c, sum(a.wt * b.wt * ((a.sample_id * 31 + a.i * 7 + (case when t.mirror then 74 - b.i else b.i end) * 13 + c.c * 29) % 256)) as v from wy a join wx b using (sample_id) join cut t using (sample_id) cross join (select unnest(range(0, 3)) as c) c group by 1, 2, 3, 4) group by 1),
spot as materialized (select t.sample_id, y.y, x.x, cast(floor((t.top + y.y) * (50 / t.nh::double)) as bigint) as sy, case when mirror then 74 - least(74, cast(floor((t.lft + x.x) * (75 / t.nw::double)) as bigint)) else least(74, cast(floor((t.lft + x.x) * (75 / t.nw::double)) as bigint)) end as sx from cut t, (select unnest(range(0, {_TH})) as y) y, (select unnest(range(0, {_TW})) as x) x where y.y < ch and x.x < cw),
got as (select s.sample_id, s.y, s.x, p.sem, p.pad from spot s join px p on p.sample_id = s.sample_id and p.y = least(49, s.sy) and p.x = s.sx)
select sample_id, layer, round(total, 3)::double as total from image union all
select sample_id, 'semantic', (sum((1 + (y * 3 + x) % 7) * coalesce(sem, 255)))::double from (select s.sample_id, y.y, x.x, g.sem from samp s, (select unnest(range(0, {_TH})) as y) y, (select unnest(range(0, {_TW})) as x) x left join got g on g.sample_id = s.sample_id and g.y = y.y and g.x = x.x) group by 1 union all
select sample_id, 'padding', (sum((1 + (y * 3 + x) % 7) * coalesce(pad, true)::int))::double from (select s.sample_id, y.y, x.x, g.pad from samp s, (select unnest(range(0, {_TH})) as y) y, (select unnest(range(0, {_TW})) as x) x left join got g on g.sample_id = s.sample_id and g.y = y.y and g.x = x.x) group by 1"""


@query(75, 50, _JITTER, "samp", "px")
def jitter_layers(c: Wide) -> DataFrame:
    """Large-scale jitter of whole samples to 48 by 64: images antialiased, labels nearest, what isn't filled as each layer says."""
    out = resample.jittered(td.wide_boxes(c.samples, c.instances), (_TH, _TW), 0.5, 1.5, hflip=0.5, load=td.draw_layers)

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                t = [(n, v) for n, v in layers.totals(r | {"paste": None}) if n in ("image", "semantic", "padding")]
                yield pa.RecordBatch.from_arrays([pa.array([r["sample_id"]] * len(t), pa.int64()), pa.array([n for n, _ in t]), pa.array([v for _, v in t])], names=["sample_id", "layer", "total"])

    return out.select("sample_id", "h", "w", *layers.LAYERS, *layers.BITS).mapInArrow(run, "sample_id long, layer string, total double").withColumn("total", F.round("total", 3))


@query(75, 50, f"select s.sample_id, s.slot, s.label, min(t.x) as x1, min(t.y) as y1, max(t.x) as x2, max(t.y) as y2, count(*) as area from inst s join (select t.sample_id, y.y, x.x, least(49, cast(floor((t.top + y.y) * (50 / t.nh::double)) as bigint)) as sy, case when mirror then 74 - least(74, cast(floor((t.lft + x.x) * (75 / t.nw::double)) as bigint)) else least(74, cast(floor((t.lft + x.x) * (75 / t.nw::double)) as bigint)) end as sx from {_CUT} t, (select unnest(range(0, {_TH})) as y) y, (select unnest(range(0, {_TW})) as x) x where y.y < ch and x.x < cw) t on t.sample_id = s.sample_id and t.sy between s.y1 and s.y2 - 1 and t.sx between s.x1 and s.x2 - 1 group by 1, 2, 3 having count(*) >= 10", "samp", "inst")
def jitter_instances(c: Wide) -> DataFrame:
    """The instances after the same jitter: tight boxes and areas, specks left out."""
    out = resample.jittered(td.wide_boxes(c.samples, c.instances), (_TH, _TW), 0.5, 1.5, hflip=0.5, load=td.draw_layers)
    i = out.select("sample_id", F.explode("instances").alias("i"))
    return i.select("sample_id", "i.slot", "i.label", *[F.col(f"i.{v}").cast("long").alias(v) for v in ("x1", "y1", "x2", "y2", "area")])
