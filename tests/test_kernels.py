"""The per-sample kernel, jitter of pixels, and sources by configuration."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskframe.operators import dense, layers, placement, resample
from maskframe.plans import pipeline, presets, wide
from maskframe.sources import testdata as td

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    return wide.Wide(spark, DATA, 75, 50)


def sample(i, h=12, w=16, boxes=(), **own):
    m = lambda b: layers.packed(np.array([[b[1] <= y < b[3] and b[0] <= x < b[2] for x in range(w)] for y in range(h)]))
    inst = [{"slot": k, "label": k + 1, "instance_id": k, "mask": m(b)} for k, b in enumerate(boxes)]
    return {"sample_id": i, "h": h, "w": w, **dict.fromkeys((*layers.LAYERS, *layers.BITS)), "image": np.full((3, h, w), i, np.uint8).tobytes(), "instances": inst} | own


def bits(h=12, w=16, **where):
    m = np.zeros((h, w), bool)
    m[where["y1"] : where["y2"], where["x1"] : where["x2"]] = True
    return layers.packed(m)


def test_kernel_keeps_ids_and_numbers_pastes_on():
    t, s = sample(1, boxes=[(0, 0, 8, 8), (8, 0, 16, 8)]), sample(2, boxes=[(0, 0, 4, 4)])
    out = dense.compose(t, s, bits(x1=0, y1=0, x2=4, y2=4), least=10)
    assert [(i["instance_id"], i["pasted"], i["area"]) for i in out["instances"]] == [(0, False, 48), (1, False, 64), (2, True, 16)]
    assert [tuple(i[k] for k in ("x1", "y1", "x2", "y2")) for i in out["instances"]] == [(0, 0, 7, 7), (8, 0, 15, 7), (0, 0, 3, 3)]
    image = np.frombuffer(out["image"], np.uint8).reshape(3, 12, 16)
    assert (image[:, :4, :4] == 2).all() and (image[:, 4:] == 1).all()


def test_kernel_drops_what_is_small_or_gone():
    t, s = sample(1, boxes=[(0, 0, 8, 8), (8, 0, 16, 8)]), sample(2, boxes=[(0, 0, 8, 8)])
    # Of the first nothing is left; of the second everything, and its number is not given out again.
    out = dense.compose(t, s, bits(x1=0, y1=0, x2=8, y2=8), least=1)
    assert [(i["instance_id"], i["pasted"]) for i in out["instances"]] == [(1, False), (2, True)]
    assert not [i for i in dense.compose(t, s, bits(x1=0, y1=0, x2=8, y2=8), least=65)["instances"] if not i["pasted"]]
    assert dense.survives(1000, 11, 1, 0.99) and not dense.survives(1000, 9, 1, 0.99) and not dense.survives(10, 0, 0, 1.0)


def test_kernel_tests_depth_and_padding():
    d = lambda v: np.full((1, 12, 16), v, "<f4").tobytes()
    known = layers.packed(np.ones((12, 16), bool))
    far, near = ({"depth": d(v), "depth_ok": known} for v in (9.0, 1.0))
    whole = bits(x1=0, y1=0, x2=16, y2=12)
    t, s = sample(1, boxes=[(0, 0, 8, 8)], **near), sample(2, boxes=[(0, 0, 4, 4)], **far)
    out = dense.compose(t, s, whole, least=1)
    assert (np.frombuffer(out["image"], np.uint8) == 1).all() and out["instances"][0]["area"] == 64
    unknown = t | {"depth_ok": layers.packed(np.zeros((12, 16), bool))}
    assert (np.frombuffer(dense.compose(unknown, s, whole)["image"], np.uint8) == 2).all()
    padded = sample(2, **near, padding=bits(x1=8, y1=0, x2=16, y2=12))
    image = np.frombuffer(dense.compose(sample(1, **far), padded, whole)["image"], np.uint8).reshape(3, 12, 16)
    assert (image[:, :, :8] == 2).all() and (image[:, :, 8:] == 1).all()


def test_kernel_refuses_one_sided_layers():
    sem = {"semantic": np.zeros((1, 12, 16), "<i2").tobytes()}
    whole = bits(x1=0, y1=0, x2=16, y2=12)
    for t, s, mask in ((sample(1, **sem), sample(2), whole), (sample(1), sample(2, **sem), whole), (sample(1), sample(2, h=10), whole), (sample(1), sample(2), b"x")):
        with pytest.raises(ValueError):
            dense.compose(t, s, mask)
    assert dense.compose(sample(1), sample(2), whole)["instances"] == []


# ---- jitter


def test_weights_are_those_of_averages_and_copies():
    at, w = resample.weights(8, 8)
    assert np.allclose((w * (at == np.arange(8)[:, None])).sum(1), 1)
    at, w = resample.weights(8, 4)
    assert np.allclose(w.sum(1), 1) and np.allclose(w[1][:4], [1 / 8, 3 / 8, 3 / 8, 1 / 8])
    at, w = resample.weights(2, 4)
    assert np.allclose((w * at).sum(1), [0, 0.25, 0.75, 1])
    whole, part = resample.weights(50, 33), resample.weights(50, 33, 7, 20)
    for i in range(13):
        assert dict(zip(*(x[i][part[1][i] > 0] for x in part))) == dict(zip(*(x[7 + i][whole[1][7 + i] > 0] for x in whole)))


def test_resampling_keeps_flat_pictures_and_means():
    r = {"sample_id": 1, "h": 40, "w": 60, "nh": 20, "nw": 30, "top": 0, "left": 0, "hflip": False, "instances": [], **dict.fromkeys((*layers.LAYERS, *layers.BITS))}
    flat = resample.jitter_one(r | {"image": np.full((3, 40, 60), 77, np.uint8).tobytes()}, 20, 30, 1)
    assert set(flat["image"]) == {77}
    noise = np.random.default_rng(2).integers(0, 256, (3, 40, 60)).astype(np.uint8)
    out = np.frombuffer(resample.jitter_one(r | {"image": noise.tobytes()}, 20, 30, 1)["image"], np.uint8)
    # Smoothed, not picked: half the size leaves about half the spread.
    assert abs(out.mean() - noise.mean()) < 2 and out.std() < 0.6 * noise.std()


def test_crops_are_filled_by_layer():
    h = w = 10
    r = {"sample_id": 1, "h": h, "w": w, "nh": 10, "nw": 10, "top": 0, "left": 0, "hflip": True, **dict.fromkeys((*layers.LAYERS, *layers.BITS))}
    m = np.zeros((h, w), bool)
    m[2:6, 0:4] = True
    r |= {"semantic": np.full((1, h, w), 3, "<i2").tobytes(), "panoptic": np.ones((1, h, w), "<i4").tobytes(), "padding": layers.packed(np.zeros((h, w), bool)), "instances": [{"slot": 0, "label": 3, "instance_id": 0, "mask": layers.packed(m)}, {"slot": 1, "label": 3, "instance_id": 1, "mask": layers.packed(np.zeros((h, w), bool))}]}
    out = resample.jitter_one(r, 12, 14, 0)
    sem, pad = np.frombuffer(out["semantic"], "<i2").reshape(12, 14), layers.unpacked(out["padding"], 12, 14)
    assert (sem[:10, :10] == 3).all() and (sem[10:] == 255).all() and (sem[:, 10:] == 255).all()
    assert not pad[:10, :10].any() and pad[10:].all() and pad[:, 10:].all()
    assert [tuple(i[k] for k in ("x1", "y1", "x2", "y2", "area")) for i in out["instances"]] == [(6, 2, 9, 5, 16)]


def test_jitter_of_a_table(small):
    out = resample.jittered(td.wide_boxes(small.samples, small.instances), (32, 32), 0.1, 2.0, load=td.draw_layers)
    for r in out.collect():
        assert (r["h"], r["w"]) == (32, 32) and len(r["image"]) == 3 * 32 * 32 and all(i["area"] >= 10 for i in r["instances"])


# ---- sources


def test_sources_by_configuration():
    assert presets.source({}) == presets.FromBatch() and presets.source({"kind": "bank"}) == presets.FromBank()
    own = placement.Placement((0.5, 0.6))
    assert presets.source({"kind": "bank", "placement": own}).placement == own
    for bad in ({"kind": "other"}, {"kind": "intra_batch", "placement": own}, {"kind": "bank", "share": 2.0}, {"kind": "bank", "more": 1}):
        with pytest.raises(ValueError):
            presets.source(bad)


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_shares_of_bank_and_batch(small, share):
    crops = wide._crops(small)
    p = placement.Placement((1.0, 1.0))
    placed, slots, bank = pipeline.sourced(small.samples, small.instances, presets.Paste(source=presets.FromBank(placement=p, share=share)), crops, crops.count(), (8, 8))
    rows = placed.collect()
    from_bank = [r for r in rows if r["src_id"] < 0]
    assert len(rows) == small.samples.count() and all(r["scale"] == 1.0 for r in from_bank)
    assert {0.0: not from_bank, 1.0: len(from_bank) == len(rows), 0.5: 0 < len(from_bank) < len(rows)}[share]
    assert {r["sample_id"] for r in bank.collect()} == {r["src_id"] for r in from_bank}
    assert slots.where("paste_valid").count() > 0
    with pytest.raises(ValueError):
        pipeline.sourced(small.samples, small.instances, presets.Paste(source=presets.FromBank()))
    assert pipeline.sourced(small.samples, small.instances, presets.Paste())[2] is None


def test_alpha_becomes_the_mask(small):
    crops = wide._crops(small)
    targets = small.samples.select("batch_id", (F.col("sample_id") % 3).alias("idx"))
    want = {-1 - r["idx"]: layers.packed(np.frombuffer(bytes(r["alpha"]), np.uint8) > 0) for r in crops.collect()}
    for r in pipeline.bank_sources(targets, crops, 8, 8).collect():
        assert bytes(r["instances"][0]["mask"]) == want[r["sample_id"]]


# ---- exchange with models, galleries


def test_model_format_round_trip(spark):
    from maskframe.sources import export

    rows = [sample(1, boxes=[(0, 0, 8, 8), (4, 4, 12, 12), (0, 0, 0, 0)], panoptic=b"x"), sample(2, panoptic=b"x")]
    schema = "sample_id long, h int, w int, image binary, panoptic binary, instances array<struct<slot:long,label:long,instance_id:long,mask:binary>>"
    cols = ["sample_id", "h", "w", "image", "panoptic"]
    df = spark.createDataFrame([tuple(r[c] for c in cols) + ([tuple(i[k] for k in ("slot", "label", "instance_id", "mask")) for i in reversed(r["instances"])],) for r in rows], schema)
    m = {r["sample_id"]: r for r in export.to_model(df).collect()}
    assert m[1]["class_labels"] == [1, 2, 3] and [bytes(x) for x in m[1]["mask_labels"]] == [i["mask"] for i in rows[0]["instances"]]
    assert set(np.frombuffer(bytes(m[2]["pixel_values"]), "<f4")) == {2.0} and m[2]["class_labels"] == []
    back = {r["sample_id"]: r for r in export.from_model(export.to_model(df), frozenset({2})).collect()}
    sem, pan = (np.frombuffer(bytes(back[1][n]), k).reshape(12, 16) for n, k in (("semantic", "<i2"), ("panoptic", "<i4")))
    assert sem[0, 0] == 1 and sem[5, 5] == 2 and sem[11, 15] == 255 and pan[0, 0] == 0 and pan[5, 5] == 2
    # The empty mask keeps its number.
    assert [i["instance_id"] for i in back[1]["instances"]] == [1, 2, 3] and bytes(back[1]["image"]) == rows[0]["image"]
    with pytest.raises(Exception, match="panoptic"):
        export.to_model(df.withColumn("panoptic", F.lit(None).cast("binary"))).collect()
    with pytest.raises(Exception, match="classes"):
        export.from_model(export.to_model(df).withColumn("class_labels", F.array(F.lit(1).cast("long"))), frozenset()).collect()


def test_gallery_is_written_once_and_whole(small, tmp_path):
    import hashlib
    import json

    from maskframe.operators import evaluate
    from maskframe.sources import export, images

    p = presets.get("coco-panoptic")
    out = wide.preset(small, p, sums=False, audit=True).cache()
    m = export.gallery(out, evaluate.evaluated(out, pipeline.rules(p)), f"file://{tmp_path}/g").first()
    n = small.samples.count()
    assert m["n"] == n and images.manifest(f"file://{tmp_path}/g/pictures")["pictures"] == 2 * n
    shown = {r["name"]: hashlib.sha256(bytes(r["image"])).hexdigest() for r in images.decoded(images.scan(small.spark, images.folder(f"file://{tmp_path}/g/pictures"))).collect()}
    listed = {r["sample_id"]: r["sha256"] for r in small.spark.read.json(f"file://{tmp_path}/g/dataset").collect()}
    assert {k: shown[f"{k:08d}_before.png"] for k in listed} == listed and len(listed) == n
    after = {r["sample_id"]: hashlib.sha256(bytes(r["image"])).hexdigest() for r in out.collect()}
    assert all(shown[f"{k:08d}_after.png"] == v for k, v in after.items())
    assert json.loads(small.spark.read.text(f"file://{tmp_path}/g/run").first()[0])["n"] == n


def test_sweeps_have_every_cell(spark):
    from maskframe.operators import stats

    runs = spark.createDataFrame([(1, 5, 2.0), (1, 5, 4.0), (9, 5, 1.0)], "a int, b int, v double")
    assert sorted(map(tuple, stats.sweep(runs, "v", a=[1, 2], b=[5]).collect())) == [(1, 5, 2, 3.0), (2, 5, 0, None)]
