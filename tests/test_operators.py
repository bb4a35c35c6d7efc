"""Hand-made cases."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskframe import bits, model, rng
from maskframe.functions import rle
from maskframe.operators import checks, composite, harmonize, placement, prep, sampling, stats, warp
from maskframe.plans import presets
from maskframe.sources import bank, coco, synthetic


def mask(spark, *rects, sample=1):
    """Rows of (slot, label, x1, y1, x2, y2), ends not included."""
    out = [(sample, s, lab, y, ((1 << (x2 - x1)) - 1) << x1) for s, lab, x1, y1, x2, y2 in rects for y in range(y1, y2)]
    return spark.createDataFrame(out, "sample_id long, slot long, label long, y int, bits long")


def test_bits(spark):
    r = spark.createDataFrame([(0b101100,), (0,), (1 << 61,)], "b long").select(bits.first(F.col("b")), bits.last(F.col("b")), bits.area(F.col("b"))).collect()
    assert [tuple(x) for x in r] == [(2, 5, 3), (None, None, 0), (61, 61, 1)]


def test_uniform_is_the_hash(spark):
    import hashlib

    (u,) = spark.range(1).select(rng.uniform("a", "id")).first()
    assert u == int(hashlib.sha256(b"a|0").hexdigest()[:13], 16) / 2**52
    (s,) = spark.range(1).select(rng.step_seed(12648430, 0, 0)).first()
    assert s == int.from_bytes(hashlib.sha256(b"12648430|0|0").digest()[:8], "big") & 0x7FFFFFFFFFFFFFFF


def test_slots_are_merged_behind_survivors(spark):
    kept = spark.createDataFrame([(1, 0), (1, 2)], "sample_id long, slot long")
    pasted = spark.createDataFrame([(1, 5), (1, 3), (1, 7), (2, 0)], "sample_id long, slot long")
    got = {(r["sample_id"], r["src_slot"]): r["slot"] for r in composite.merge_slots(kept, pasted, 4).collect()}
    assert got == {(1, 3): 1, (1, 5): 3, (2, 0): 0}  # the third paste of sample 1 has no slot left


def test_residual_gate(spark):
    areas = spark.createDataFrame([(1, 0, 1, 100, 5), (1, 1, 1, 100, 10), (1, 2, 1, 100, 100)], "sample_id long, slot long, label long, before long, after long")
    assert [r["slot"] for r in composite.kept_targets(areas, 0.1).orderBy("slot").collect()] == [1, 2]
    assert composite.kept_targets(areas, 0.0).count() == 3


def test_background_that_collapses_is_given_back(spark):
    labels = spark.createDataFrame([(1, y, 7, (1 << 32) - 1) for y in range(32)], "sample_id long, y int, class_id long, bits long")
    paste = spark.createDataFrame([(1, y, (1 << 32) - 1) for y in range(20)], "sample_id long, y int, paste long")
    after = composite.select_labels(labels, labels.limit(0), paste)
    gone = composite.collapsed(composite.histogram(labels), composite.histogram(after), F.col("class_id") == 7, 0.5)
    assert [tuple(r) for r in gone.collect()] == [(1, 7, 1024, 384)]
    assert composite.revert_rows(labels, gone, paste).agg(F.sum(F.bit_count("revert"))).first()[0] == 640


def place_one(spark, **values):
    row = {"sample_id": 1, "src_id": 2, "slot": 0, "label": 4, "instance_id": 0, "x1": 4, "y1": 3, "x2": 8, "y2": 6, "scale": 1.0, "hflip": False, "ty": 0.0, "tx": 0.0, "h": 16, "w": 16, "hv": 16, "wv": 16, "paste_valid": True} | values
    return spark.createDataFrame([tuple(row.values())], "sample_id long, src_id long, slot long, label long, instance_id long, x1 long, y1 long, x2 long, y2 long, scale double, hflip boolean, ty double, tx double, h int, w int, hv int, wv int, paste_valid boolean")


@pytest.mark.parametrize("values, box", [({}, (4, 3, 7, 5)), ({"ty": 2.0, "tx": 3.0}, (7, 5, 10, 7)), ({"hflip": True}, (8, 3, 11, 5)), ({"hflip": True, "wv": 12}, (4, 3, 7, 5)), ({"ty": 14.0}, None)])
def test_warps(spark, values, box):
    got = composite.tight_boxes(warp.masks(place_one(spark, **values), mask(spark, (0, 4, 4, 3, 8, 6), sample=2), 16, 16), "sample_id").collect()
    assert [tuple(r)[1:5] for r in got] == ([box] if box else [])


def test_depth_test(spark):
    row = spark.createDataFrame([(0b1111, [1.0, 3.0, 3.0, 1.0], [2.0, 2.0, 2.0, 2.0], 0b1011, 0b1000)], "p long, s array<double>, t array<double>, ok long, pad long")
    m = composite.effective(F.col("p"), F.col("s"), F.col("t"), F.col("ok"), F.col("pad"), 4)
    assert row.select(m).first()[0] == 0b0101  # nearer; farther; farther on an invalid target; source padding


def test_off_diagonal(spark):
    s = spark.createDataFrame([(b, i, n, b * 100 + i) for b, n in ((0, 5), (1, 1), (2, 2)) for i in range(n)], "batch_id long, pos long, n long, sample_id long")
    for r in placement.offdiagonal(s).collect():
        assert r["src_pos"] is None if r["n"] == 1 else r["src_pos"] != r["pos"] and 0 <= r["src_pos"] < r["n"]


def test_placement_refuses_nonsense():
    for bad in ({"scale": (2.0, 1.0)}, {"hflip": 2.0}, {"k_range": (3, 1)}, {"unknown": 1}):
        with pytest.raises((ValueError, TypeError)):
            placement.Placement(**bad)
    with pytest.raises(ValueError):
        placement.aligned_grid(placement.Placement(scale=(0.1, 0.2), patch=16), 16, 16)


def test_repeat_factors(spark):
    counts = [10_000, 1000, 100, 10, 1, 0]
    w = {r["class_id"]: r["weight"] for r in sampling.repeat_factors(spark.createDataFrame(list(enumerate(counts)), "class_id long, n long"), 1e-3).collect()}
    total = sum(counts)
    assert all(abs(w[i] - (max(1.0, math.sqrt(1e-3 / (c / total))) if c else 0)) < 1e-9 for i, c in enumerate(counts))


def test_draws_are_nearer_to_uniform_than_the_bank(spark):
    crops = spark.createDataFrame([(i, 0 if i < 900 else 1 if i < 990 else 2) for i in range(1000)], "idx long, class_id long")
    n = [r["n"] for r in sampling.histogram(sampling.draws(spark, crops, 3, 4096, 0.5).select("class_id"), 3).orderBy("class_id").collect()]
    assert sum(n) == 4096
    far = lambda c: sum(abs(x / sum(c) - 1 / 3) for x in c)
    assert far(n) < far([900, 90, 10])


def test_padding(spark):
    p = prep.pad_plan(spark.createDataFrame([(1, 10, 16), (2, 8, 8)], "sample_id long, h int, w int"), 8).orderBy("sample_id").collect()
    assert [(r["pad_h"], r["pad_w"], r["changed"]) for r in p] == [(6, 0, True), (0, 0, False)]
    with pytest.raises(ValueError):
        prep.pad_plan(spark.range(1), 0)
    v = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>")
    assert v.select(prep.pad_values(F.col("v"), 3, 2)).first()[0] == [1, 2, 3, 2, 1]
    assert v.select(prep.pad_values(F.col("v"), 3, 3)).first()[0] == [1, 2, 3, 0, 0, 0]


def test_segmentations(spark):
    df = spark.createDataFrame([(1, 10, [50, 4, 46])], "id long, h long, counts array<long>")
    assert rle.areas(df).first()["area"] == 4
    rows = rle.decode(df).orderBy("y").collect()
    assert [(r["y"], r["bits"]) for r in rows] == [(0, 32), (1, 32), (2, 32), (3, 32)]
    assert rle.mask_of({"size": [10, 10], "counts": [50, 4, 46]}, 10, 10).sum() == 4
    assert rle.mask_of([[10, 10, 40, 10, 40, 40, 10, 40]], 50, 75).sum() == 900
    with pytest.raises(ValueError):
        rle.mask_of("nothing", 2, 2)


def test_checks_fire(spark):
    ids = spark.createDataFrame([(1,), (2,)], "sample_id long")
    over = mask(spark, (0, 4, 0, 0, 4, 4), (1, 4, 2, 2, 6, 6)).unionByName(mask(spark, (0, 4, 0, 0, 4, 4), sample=2))
    got = {r["sample_id"]: r["ok"] for r in checks.no_overlap(ids, over).collect()}
    assert got == {1: False, 2: True}
    got = {r["sample_id"]: r["ok"] for r in checks.identity(ids, over, mask(spark, (0, 9, 1, 1, 2, 2)).unionByName(mask(spark, (0, 4, 1, 1, 2, 2), sample=2))).collect()}
    assert got == {1: False, 2: True}


def test_checks_apply_by_layer():
    every = {"image", "instance", "panoptic", "semantic", "depth", "normals"}
    assert len(checks.applicable(every, True)) == 15 and len(checks.applicable(every, False)) == 7
    assert checks.applicable({"image"}, True) == []


def test_sources_are_named_once(spark):
    assert coco.source_of("here", None) == ("local", "here")
    for bad in ((None, None), ("a", "b")):
        with pytest.raises(ValueError):
            coco.source_of(*bad)
    with pytest.raises(ValueError):
        coco.enough(spark.range(2).withColumnRenamed("id", "sample_id"), 3)


def test_ks(spark):
    a, b = spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "v int"), spark.createDataFrame([(x,) for x in (3, 4, 5, 6)], "v int")
    assert stats.ks_distance(a, b, "v").first()[0] == 0.5


def test_blends():
    r = np.random.default_rng(0)
    src, tgt, one = r.random((16, 16)), r.random((16, 16)), np.ones((16, 16))
    s = harmonize.sine_matrix(9)
    assert np.allclose(s @ s, np.eye(9))
    assert np.allclose(harmonize.multiband(src, tgt, 0 * one), tgt, atol=1e-9) and np.allclose(harmonize.multiband(src, tgt, one), src, atol=0.5)
    assert np.allclose(harmonize.poisson(src, tgt, one), src) and np.allclose(harmonize.poisson(src, tgt, 0 * one), tgt)
    assert harmonize.levels_for(16, 16) == 3 and harmonize.levels_for(2, 2) == 1


def test_bank_round_trip(spark, tmp_path):
    crops = spark.createDataFrame([(i, bytes([i] * 12), bytes([1] * 4), i % 3 - 1, None) for i in range(9)], "idx long, image binary, alpha binary, class_id long, embedding_raw binary")
    for layout in ("parquet", "shards"):
        meta = bank.build(crops, f"{tmp_path}/{layout}", 2, 2, 3, layout=layout)
        got, again = bank.open_bank(spark, f"{tmp_path}/{layout}")
        assert again == json.loads(json.dumps(meta)) and bank.version(meta).startswith(f"{layout}@")
        assert {(r["idx"], bytes(r["image"]), r["class_id"]) for r in got.collect()} == {(i, bytes([i] * 12), i % 3 - 1) for i in range(9)}
    with pytest.raises(ValueError):
        bank.opened(meta | {"num_crops": 1})
    for bad in ({"layout": "other"}, {"embedded": True}):
        with pytest.raises(ValueError):
            bank.build(crops, f"{tmp_path}/x", 2, 2, 3, **bad)
    with pytest.raises(ValueError):
        bank.build(crops.limit(0), f"{tmp_path}/x", 2, 2, 3)
    assert bank.record_size(2, 2, True) == 12 + 4 + 8 + 512


def test_annotation_file(spark, tmp_path):
    doc = {"images": [{"id": i, "file_name": f"{i}.jpg", "height": 50, "width": 75} for i in (3, 1, 2)], "annotations": [{"id": 5, "image_id": 1, "category_id": 2, "bbox": [10, 10, 30, 30], "iscrowd": 0}, {"id": 4, "image_id": 1, "category_id": 1, "bbox": [0.5, 1.5, 2, 2], "iscrowd": 0}, {"id": 9, "image_id": 2, "category_id": 1, "bbox": [60, 40, 30, 30], "iscrowd": 0}], "categories": [{"id": 1, "name": "a"}, {"id": 2, "name": "b"}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    d = coco.read(spark, f"{tmp_path}/a.json")
    samples, inst = coco.detection(coco.listed(d, "images"), coco.listed(d, "annotations"))
    assert sorted(r["sample_id"] for r in samples.collect()) == [1, 2]
    assert sorted((r["sample_id"], r["slot"], r["label"], r["x2"]) for r in inst.collect()) == [(1, 0, 1, 2.5), (1, 1, 2, 40.0), (2, 0, 1, 90.0)]
    plan = {r["ann_id"]: r for r in coco.crop_plan(coco.listed(d, "images"), coco.listed(d, "annotations"), (20, 20)).collect()}
    assert set(plan) == {5, 9} and (plan[9]["x2"], plan[9]["y2"]) == (75, 50) and plan[5]["src_x"] == 5 and plan[9]["dst_x"] == 2


def test_synthetic_and_presets(spark):
    s, inst = synthetic.make(spark, 3, 4)
    assert s.count() == 4 and {(r["x2"] - r["x1"], r["y2"] - r["y1"]) for r in inst.collect()} == {(16, 16)}
    with pytest.raises(ValueError):
        synthetic.make(spark, 0, 0)
    assert presets.names() == ["coco-instance", "coco-panoptic"]
    with pytest.raises(ValueError):
        presets.register("coco-instance", presets.Paste())
    with pytest.raises(KeyError):
        presets.get("none")


def test_strict(spark):
    df = spark.createDataFrame([(1, True), (2, None)], "sample_id long, ok boolean")
    with pytest.raises(ValueError):
        model.strict(df, model.violations(df, {"must": F.col("ok")}, "sample_id"))


def test_stream_of_samples(spark, tmp_path):
    from maskframe.streaming import steps

    spark.range(40).write.parquet(f"{tmp_path}/in")
    q = steps.augmented(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), lambda df: df.withColumn("twice", F.col("id") * 2), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.sum("twice")).first()[0] == 2 * sum(range(40))


@pytest.mark.parametrize("name", ["unpad_roundtrip", "hf_batch", "check_identity", "check_single_class", "check_stuff_area", "composite_semantic", "merged_instances", "paste_stats", "stuff_collapse", "stuff_revert_area", "composite_depth", "composite_depth_valid", "check_depth_join", "check_depth_monotone"])
def test_scanlines_and_slots_stay_with_their_sample(spark, name):
    """Only whole samples travel: no exchange is by scanline or by slot."""
    import re

    from maskframe.plans.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"hashpartitioning\([^)]*\b(?:y|sy|slot)#", plan)
