"""Whole samples: tiles, audits, invariants in one pass against the relational checks, faults, presets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskframe import bits
from maskframe.functions import rle
from maskframe.operators import checks, evaluate, layers, placement, tiles
from maskframe.plans import pipeline, presets, wide
from maskframe.sources import testdata as td

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    return wide.Wide(spark, DATA, 75, 50)


def rounded(df, *by):
    return sorted((*(r[c] for c in by), round(r["total"], 3)) for r in df.collect())


@pytest.mark.parametrize("size", [16, 33, 64, 128])
def test_tiles_of_any_size_give_the_same(small, size):
    whole = layers.pasted(*_rows(small), load=td.draw_layers)
    want = rounded(layers.digests(whole), "sample_id", "layer")
    parts = tiles.drawn(td.wide_boxes(small.samples, small.instances).drop("batch_id"), size, td.draw_layers)
    out = tiles.pasted(parts, small.placed, small.slots, size).cache()
    assert rounded(tiles.totals(out, size), "sample_id", "layer") == want
    i = whole.select("sample_id", F.explode("instances").alias("i")).select("sample_id", "i.slot", "i.pasted", "i.label", "i.before", "i.after")
    assert sorted(map(tuple, tiles.areas(out).collect())) == sorted(map(tuple, i.collect()))
    # What is whole and drawn is cut into the same tiles.
    loaded = [td.draw_layers(r.asDict(recursive=True)) for r in td.wide_boxes(small.samples, small.instances).collect()]
    cut = [b.to_pylist()[0] for r in loaded for b in tiles.pieces(r, size)]
    key = lambda r: (r["sample_id"], r["ti"], r["tj"], bytes(r["image"]), bytes(r["depth_ok"]), [(i["slot"], bytes(i["mask"])) for i in r["instances"]])
    assert sorted(map(key, cut)) == sorted(map(key, parts.collect()))


def _rows(c):
    """The rows that :func:`pipeline.whole` makes, without dropping and merging after it."""
    chosen = c.slots.where("paste_valid").groupBy("sample_id").agg(F.array_sort(F.collect_list(F.col("slot").cast("long"))).alias("pasted"))
    where = c.placed.join(chosen, "sample_id", "left").select("sample_id", "src_id", "scale", "hflip", "ty", "tx", F.col("wv").cast("int").alias("wv"), "pasted", F.lit(False).alias("harmonized"))
    return (td.wide_boxes(c.samples, c.instances).join(where, "sample_id", "left").withColumn("target", F.lit(True)),)


def test_tiles_of_a_large_canvas(spark):
    """4096 by 4096 pixels: a whole sample would hold about 240 MB of planes, a group of tiles holds some MB."""
    c = wide.Wide(spark, DATA, 4096, 4096)
    ids = [r["sample_id"] for r in c.placed.orderBy("sample_id").limit(2).collect()]
    some = c.placed.where(F.col("sample_id").isin(ids))
    need = [r["src_id"] for r in some.collect()] + ids
    parts = tiles.drawn(td.wide_boxes(c.samples.where(F.col("sample_id").isin(need)), c.instances).drop("batch_id"), 512, td.draw_layers)
    out = tiles.pasted(parts, some, c.slots.where(F.col("sample_id").isin(ids)), 512).where(F.col("sample_id").isin(ids))
    got = {(r["sample_id"], r["slot"]): r["after"] for r in tiles.areas(out).where("pasted").collect()}
    # A rectangle's warp is a rectangle, whose rows and columns are those with their nearest source in it.
    for s in c.slots.where(F.col("sample_id").isin(ids) & F.col("paste_valid")).collect():
        y, x = np.rint((np.arange(4096) - s["ty"]) / s["scale"]), (np.arange(4096) - s["tx"]) / s["scale"]
        x = np.rint(s["wv"] - 1 - x if s["hflip"] else x)
        n = int(((y >= s["y1"]) & (y < s["y2"])).sum() * ((x >= s["x1"]) & (x < s["x2"])).sum())
        assert got.get((s["sample_id"], s["slot"]), 0) == n


def test_a_tile_group_is_small(small):
    """No group has more than the tiles that a scale of a half asks for."""
    asked = tiles.pasted(tiles.drawn(td.wide_boxes(small.samples, small.instances).drop("batch_id"), 16, td.draw_layers), small.placed, small.slots, 16)
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and asked.count() == small.samples.count() * 20


# ---- invariants


@pytest.fixture(scope="module", params=["coco-instance", "coco-panoptic"])
def outcome(request, small):
    p = presets.get(request.param)
    return p, wide.preset(small, p, audit=True).cache()


def words(out, mask, *keep):
    """Scanline words of packed masks (a column of structs ``i``)."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for r in b.to_pylist():
                y, k, w = rle.mask_words(layers.unpacked(r["m"], r["h"], r["w"]))
                yield pa.RecordBatch.from_pydict({**{c: pa.array([r[c]] * len(y), pa.int64()) for c in keep}, "y": pa.array(y, pa.int32()), "k": pa.array(k, pa.int32()), "bits": pa.array(w, pa.int64())})

    return out.select("h", "w", *keep, mask.alias("m")).where("m is not null").mapInArrow(run, ", ".join([*(f"{c} long" for c in keep), "y int, k int, bits long"]))


def class_words(out, side, name, column):
    """Words of every value of an integer plane."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for r in b.to_pylist():
                p = layers.plane(r["p"], name, r["h"], r["w"])[0]
                for c in np.unique(p).tolist():
                    y, k, w = rle.mask_words(p == c)
                    yield pa.RecordBatch.from_pydict({"sample_id": pa.array([r["sample_id"]] * len(y), pa.int64()), column: pa.array([c] * len(y), pa.int64()), "y": pa.array(y, pa.int32()), "k": pa.array(k, pa.int32()), "bits": pa.array(w, pa.int64())})

    return out.select("sample_id", "h", "w", F.col(f"{side}{name}").alias("p")).mapInArrow(run, f"sample_id long, {column} long, y int, k int, bits long")


def test_one_pass_equals_the_relational_checks(outcome):
    p, out = outcome
    got = {(r["sample_id"], r["name"]): (r["ok"], r["n_bad"]) for r in evaluate.evaluated(out, pipeline.rules(p)).collect()}
    ids = out.select("sample_id")
    each = lambda column: out.select("sample_id", "h", "w", "paste", F.explode(column).alias("i"))
    cols = lambda df: df.select("sample_id", "h", "w", F.col("i.slot").alias("slot"), F.col("i.label").alias("label"), F.col("i.mask").alias("mask"))
    after = words(cols(each("instances")), F.col("mask"), "sample_id", "slot", "label").cache()
    before = words(cols(each("audit.before.instances")), F.col("mask"), "sample_id", "slot", "label").cache()
    paste = words(out, F.col("paste"), "sample_id").withColumnRenamed("bits", "paste")
    sem = {side: class_words(out, path, "semantic", "class_id").cache() for side, path in (("before", "audit.before."), ("after", ""))}
    pan = {side: class_words(out, path, "panoptic", "instance_id").cache() for side, path in (("before", "audit.before."), ("after", ""))}
    things = pan["after"].where("instance_id <> 0").groupBy(*bits.LINE).agg(F.bit_or("bits").alias("z"))
    reports = [
        checks.single_class(ids, sem["after"]),
        checks.ignore_kept(ids, sem["before"], sem["after"]),
        checks.no_overlap(ids, after),
        checks.identity(ids, before, after),
        checks.subtracts_union(ids, after, paste),
        checks.bijection(ids, things, after),
        checks.fresh_ids(ids, pan["before"].select("sample_id", "instance_id").distinct(), pan["after"].select("sample_id", "instance_id").distinct()),
    ]
    if p.things:
        area = lambda df: df.groupBy("sample_id", "class_id").agg(F.sum(F.bit_count("bits")).alias("area"))
        reports += [checks.thing_stuff(ids, sem["after"], things, F.col("class_id").isin(*p.things)), checks.stuff_area(ids, area(sem["before"]), area(sem["after"]), F.col("class_id").isin(*p.stuff), int(p.tau_stuff_frac * 75 * 50))]
    seen = 0
    for r in [x for df in reports for x in df.collect()]:
        ok, n = got[(r["sample_id"], r["name"])]
        # The relations count lines of crowded pixels, the one pass the pixels themselves.
        assert ok == r["ok"] and (r["name"] == "panoptic.pixel_bijection" or n == r["n_bad"]), r
        seen += 1
    assert seen == len(reports) * out.count()
    plan = evaluate.evaluated(out, pipeline.rules(p))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan.split("InMemoryRelation")[0]


def test_every_fault_is_found_by_its_check_alone(outcome):
    p, out = outcome
    rows = evaluate.injected(out, pipeline.rules(p)).collect()
    assert all(r["ok"] for r in rows), [r for r in rows if not r["ok"]][:3]
    if p.things:
        assert {r["fault"] for r in rows} >= set(evaluate.FAULTS) - {"straddle"}
    again = evaluate.injected(out, pipeline.rules(p), ["relabel"], seed=0).collect()
    assert sorted(again) == sorted(r for r in rows if r["fault"] == "relabel")


def test_audits_change_no_outcome_and_can_be_selected(small):
    p = presets.get("coco-instance")
    plain, audited = wide.preset(small, p), wide.preset(small, p, audit=True)
    assert sorted(map(str, plain.drop("totals").collect())) == sorted(map(str, audited.select(*plain.drop("totals").columns).collect()))
    one = audited.where("sample_id = 5").select("audit.*").first()
    drawn = td.draw_layers({"sample_id": 5, "h": 50, "w": 75, "valid": {"hv": 50 - 5 % 3, "wv": 75 - 5 % 2}, "boxes": []})
    assert bytes(one["before"]["image"]) == drawn["image"] and one["src_id"] is not None
    union = np.zeros((50, 75), bool)
    for w in one["warped"]:
        union |= layers.unpacked(w["mask"], 50, 75)
    assert layers.packed(union) == bytes(one["union"])
    # Samples alone in their batch have an audit without a source.
    alone = layers.alone({"sample_id": 1, "h": 2, "w": 2, **dict.fromkeys((*layers.LAYERS, *layers.BITS)), "instances": None, **dict.fromkeys(("scale", "hflip", "ty", "tx", "harmonized"))}, True)
    assert alone["audit"]["src_id"] is None and alone["audit"]["warped"] == []


def test_presets_decide_everything(small):
    assert (len(presets.THINGS), len(presets.STUFF)) == (80, 53) and presets.THINGS[-1] == 90 and presets.STUFF[-1] == 200
    assert presets.taxonomy(small.spark).where("kind = 'thing'").count() == 80
    p = presets.get("coco-panoptic")
    out = wide.preset(small, p).select(F.explode("instances").alias("i")).where("i.pasted")
    assert {r["label"] for r in out.select("i.label").distinct().collect()} <= set(presets.THINGS)
    padded = wide.preset(small, p, pad_to=32).first()
    assert (padded["h"], padded["w"]) == (64, 96) and layers.unpacked(padded["padding"], 64, 96)[:, 75:].all()


def test_levels_of_blends_matter():
    r = np.random.default_rng(0)
    src, tgt, mask = r.random((3, 40, 40)), r.random((3, 40, 40)), np.zeros((40, 40), bool)
    mask[10:30, 10:30] = True
    one, five = layers.blended("multiband", src, tgt, mask, 1), layers.blended("multiband", src, tgt, mask, 5)
    assert np.allclose(one, np.where(mask, src, tgt)) and not np.allclose(one, five)


def test_eligibility_names_classes(small):
    inst = small.instances
    _, slots = placement.place(small.samples, inst, placement.Placement(), pipeline.eligible(presets.Paste(things=(3, 5))))
    assert {r["label"] for r in slots.where("gate").select("label").distinct().collect()} <= {3, 5}


def test_presets_are_described_and_signed_off(outcome):
    p, out = outcome
    name = next(n for n in presets.names() if presets.get(n) == p)
    reports = evaluate.evaluated(out, pipeline.rules(p))
    signed = presets.signed(presets.described(name), reports, "1", "2026-01-01")
    every = reports.groupBy("name").agg(F.bool_and("ok").alias("ok")).collect()
    assert (signed.sign_off.dispatched, signed.sign_off.passed, signed.sign_off.sample_count) == (len(every), sum(r["ok"] for r in every), out.count())
    assert presets.described(name).sign_off is None and presets.described(name).description
    with pytest.raises(ValueError):
        presets.SignOff("1", 1, "2026-01-01", 1, 2)
    with pytest.raises(ValueError):
        presets.register(name, p)


def test_taps_are_weighed_in_the_order_of_the_sql():
    """Depths are compared, so equal ones must come out equal to the last bit."""
    rng = np.random.default_rng(5)
    h, w = 9, 11
    src = 1 + rng.integers(0, 97, (1, h, w)) / 10
    for k in range(20):
        m = layers.Map({"ty": rng.uniform(-3, 3), "tx": rng.uniform(-3, 3), "scale": rng.uniform(0.5, 2), "hflip": k % 2 == 1, "wv": w}, h, w, h, w)
        got = m.bilinear(src)[0]
        for i, sy in enumerate(m.y):
            for j, sx in enumerate(m.x):
                y, x, want = np.floor(sy), np.floor(sx), None
                for dy, wy in ((0, 1 - (sy - y)), (1, sy - y)):
                    for dx, wx in ((0, 1 - (sx - x)), (1, sx - x)):
                        inside = 0 <= y + dy < h and 0 <= x + dx < w
                        part = wy * wx * (src[0, int(y + dy), int(x + dx)] if inside else 0)
                        want = part if want is None else want + part
                assert got[i, j] == want


def test_tiles_beside_the_source_ask_for_none(spark):
    """Source rows 50 and more of 50 aren't there, though they would lie in the tile of row 49."""
    df = spark.createDataFrame([(3, -2.0, 1.0), (3, 0.0, 1.0)], "at int, ty double, scale double")
    i = df.select(tiles.spans(F.col("at"), F.col("ty"), F.lit(64), 16, F.lit(False), None).alias("i"), tiles.spans(F.col("at"), F.lit(-16.0) + F.col("ty"), F.lit(64), 16, F.lit(False), None).alias("j")).collect()
    assert i[0]["j"]["a"] > i[0]["j"]["b"] and i[1]["j"]["a"] > i[1]["j"]["b"] and (i[1]["i"]["a"], i[1]["i"]["b"]) == (3, 3)
    edge = df.select(tiles.spans(F.lit(3), F.lit(-2.0), F.lit(50), 16, F.lit(False), None).alias("i")).first()["i"]
    assert edge["a"] > edge["b"]
