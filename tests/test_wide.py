"""Canvases wider than a word, and whole samples with all their layers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskframe import bits
from maskframe.functions import rle
from maskframe.numbering import ranked
from maskframe.operators import composite, harmonize, layers, prep, warp
from maskframe.sources import coco

from .test_operators import place_one


def words(spark, masks, sample=1):
    """(sample, slot, label, y, k, bits) of masks as arrays."""
    out = []
    for slot, m in enumerate(masks):
        for y, x in zip(*np.nonzero(m)):
            out.append((sample, slot, 1, int(y), int(x) // bits.WORD, 1 << (int(x) % bits.WORD)))
    df = spark.createDataFrame(out, "sample_id long, slot long, label long, y int, k int, bits long")
    return df.groupBy("sample_id", "slot", "label", "y", "k").agg(F.bit_or("bits").alias("bits"))


def image(rows, h, w):
    out = np.zeros((h, w), bool)
    for r in rows:
        for x in range(bits.WORD):
            if r["bits"] >> x & 1:
                out[r["y"], r["k"] * bits.WORD + x] = True
    return out


def test_every_pixel_of_a_full_mask(spark):
    df = spark.createDataFrame([(1, 100, [0, 10_000])], "id long, h long, counts array<long>")
    assert rle.decode(df).agg(F.sum(F.bit_count("bits"))).first()[0] == 10_000
    df = spark.createDataFrame([(1, 50, 75, [[[10.0, 10.0, 70.0, 10.0, 70.0, 40.0, 10.0, 40.0]]])], "id long, h int, w int, polygons array<array<array<double>>>").select("id", "h", "w", F.col("polygons")[0].alias("polygons"))
    assert rle.polygons(df).agg(F.sum(F.bit_count("bits"))).first()[0] == 1800


def test_counts_of_random_masks(spark):
    r = np.random.default_rng(3)
    rows, want = [], {}
    for i in range(12):
        h, w = int(r.integers(1, 90)), int(r.integers(1, 150))
        m = r.random((h, w)) < r.random()
        flat = m.T.ravel()
        edges = np.flatnonzero(np.diff(np.r_[0, flat.astype(int)])) if len(flat) else []
        counts = np.diff(np.r_[0, edges, len(flat)]).astype(int).tolist()
        rows.append((i, h, counts)), want.update({i: m})
    df = spark.createDataFrame(rows, "id long, h long, counts array<long>")
    short = rle.compressed(df)
    assert [rle.uncompress(x["counts"]) for x in short.orderBy("id").collect()] == [x[2] for x in rows]
    for decoded in (rle.decode(df), rle.decode(rle.uncompressed(short))):
        got = {}
        for x in decoded.collect():
            got.setdefault(x["id"], []).append(x)
        for i, m in want.items():
            assert (image(got.get(i, []), *m.shape) == m).all()


@pytest.mark.parametrize("values", [{}, {"scale": 0.37}, {"scale": 1.9, "hflip": True, "wv": 140}, {"scale": 0.5, "tx": -3.5, "ty": 7.25}, {"scale": 2.0, "hflip": True, "tx": 11.5}])
def test_warps_of_random_masks(spark, values):
    h, w = 40, 150
    m = np.random.default_rng(5).random((h, w)) < 0.4
    spot = {"h": h, "w": w, "hv": h, "wv": w, "y1": 0, "y2": h, "x1": 0, "x2": w, "label": 1} | values
    at = place_one(spark, **spot)
    got = image(warp.masks(at, words(spark, [m], sample=2), h, w).collect(), h, w)
    r = at.first().asDict()
    assert (got == layers.Map(r, h, w, h, w).nearest(m)).all()
    want = np.zeros((h, w), bool)
    for y in range(h):
        for x in range(w):
            sy, sx = (y - r["ty"]) / r["scale"], (x - r["tx"]) / r["scale"]
            sx = r["wv"] - 1 - sx if r["hflip"] else sx
            sy, sx = round(sy), round(sx)
            want[y, x] = 0 <= sy < h and 0 <= sx < w and m[sy, sx]
    assert (got == want).all()


def test_crops_and_boxes_across_words(spark):
    m = np.random.default_rng(6).random((20, 130)) < 0.3
    plan = spark.createDataFrame([(1, 3, 61)], "sample_id long, top long, left long")
    rows = words(spark, [m])
    assert (image(prep.crop_masks(rows, plan, 60, 12).collect(), 12, 60) == m[3:15, 61:121]).all()
    (b,) = composite.tight_boxes(rows, "sample_id").collect()
    y, x = np.nonzero(m)
    assert (b["x1"], b["y1"], b["x2"], b["y2"], b["area"]) == (x.min(), y.min(), x.max(), y.max(), m.sum())


def test_ranks_by_stretches(spark):
    r = np.random.default_rng(1)
    ids = r.choice(10_000, 500, replace=False).tolist()
    df = spark.createDataFrame([(i, i % 3) for i in ids], "i long, g long")
    assert [x["rank"] for x in ranked(df, "i", F.floor(F.col("i") / 100)).orderBy("i").collect()] == list(range(500))
    for x in ranked(df, "i", F.floor(F.col("i") / 100), "g").collect():
        assert x["rank"] == sum(j < x["i"] for j in ids if j % 3 == x["g"])
    b = coco.batched(df.withColumnRenamed("i", "sample_id"), 8).orderBy("sample_id").collect()
    assert [(x["batch_id"], x["pos"]) for x in b] == [(i // 8, i % 8) for i in range(500)]


def sample(k, h=12, w=16, **more):
    r = np.random.default_rng(k)
    masks = r.random((3, h, w)) < 0.2
    return {"batch_id": 0, "sample_id": k, "h": h, "w": w, "image": r.integers(0, 256, (3, h, w)).astype(np.uint8).tobytes(), "semantic": r.integers(0, 5, (h, w)).astype("<i2").tobytes(), "panoptic": r.integers(0, 4, (h, w)).astype("<i4").tobytes(), "depth": r.random((h, w)).astype("<f4").tobytes(), "normals": r.random((3, h, w)).astype("<f4").tobytes(), "depth_ok": layers.packed(r.random((h, w)) < 0.8), "padding": layers.packed(np.zeros((h, w), bool)), "instances": [{"slot": i, "label": i, "instance_id": i, "mask": layers.packed(m)} for i, m in enumerate(masks)], "src_id": None, "scale": 1.0, "hflip": False, "ty": 0.0, "tx": 0.0, "wv": w, "pasted": [0, 2], "harmonized": False, "target": True} | more


def test_identity_paste_by_plain_loops():
    t, s = sample(1, src_id=2), sample(2)
    got = layers.paste_one(t, s, frozenset(), None, "multiband")
    h, w = 12, 16
    at = lambda r, n: layers.plane(r[n], n, h, w)
    ok = lambda r, n: layers.unpacked(r[n], h, w)
    union = layers.unpacked(s["instances"][0]["mask"], h, w) | layers.unpacked(s["instances"][2]["mask"], h, w)
    # What the depth test keeps back is not pasted, and target masks keep it.
    effective = np.zeros((h, w), bool)
    for y in range(h):
        for x in range(w):
            inside = effective[y, x] = union[y, x] and (at(s, "depth")[0, y, x] < at(t, "depth")[0, y, x] or not ok(t, "depth_ok")[y, x])
            for n in layers.LAYERS:
                assert np.allclose(at(got, n)[:, y, x], at(s if inside else t, n)[:, y, x])
            assert ok(got, "depth_ok")[y, x] == (ok(t, "depth_ok")[y, x] and (ok(s, "depth_ok")[y, x] or not union[y, x]))
    assert [(i["slot"], i["pasted"]) for i in got["instances"]] == [(0, False), (1, False), (2, False), (0, True), (2, True)]
    for i, old in zip(got["instances"], t["instances"]):
        assert (layers.unpacked(i["mask"], h, w) == (layers.unpacked(old["mask"], h, w) & ~effective)).all()
    assert (ok(got, "paste") == effective).all() and effective.sum() < union.sum()


def test_collapsed_background_is_given_back():
    h, w = 12, 16
    t = sample(1, src_id=2, semantic=np.full((h, w), 3, "<i2").tobytes(), depth=None, depth_ok=None)
    s = sample(2, semantic=np.full((h, w), 1, "<i2").tobytes(), depth=None, depth_ok=None, instances=[{"slot": 0, "label": 1, "instance_id": 0, "mask": layers.packed(np.ones((h, w), bool))}])
    got = layers.paste_one(t, s, frozenset({3}), 0.5, "multiband")
    assert got["semantic"] == t["semantic"] and got["image"] == t["image"] and not layers.unpacked(got["paste"], h, w).any()
    assert [i["pasted"] for i in got["instances"]] == [False] * 3
    kept = layers.paste_one(t, s, frozenset(), 0.5, "multiband")
    assert layers.unpacked(kept["paste"], h, w).all() and kept["semantic"] == s["semantic"]


def test_padding_fills_by_layer():
    r = layers.grown(sample(1), 8, 255)
    assert (r["h"], r["w"]) == (16, 16)
    old, new = (layers.plane(x["image"], "image", x["h"], 16) for x in (sample(1), r))
    assert (new[:, :12] == old).all() and (new[:, 12] == old[:, 10]).all()
    assert (layers.plane(r["semantic"], "semantic", 16, 16)[0, 12:] == 255).all() and (layers.plane(r["depth"], "depth", 16, 16)[0, 12:] == 0).all()
    assert layers.unpacked(r["padding"], 16, 16)[12:].all() and not layers.unpacked(r["padding"], 16, 16)[:12].any()
    same = sample(2)
    assert layers.grown(same, 4, 255) is same


def test_whole_rows_merge_in_one_expression(spark):
    one = lambda slot, pasted, before, after: (slot, 1, slot, pasted, before, after, b"")
    rows = [(1, [one(0, False, 100, 5), one(1, False, 100, 50), one(4, True, 9, 9), one(2, True, 9, 9), one(3, True, 9, 9)])]
    df = spark.createDataFrame(rows, "sample_id long, instances array<struct<slot:long,label:long,instance_id:long,pasted:boolean,before:long,after:long,mask:binary>>")
    got = layers.merged(df, 3, 0.1).first()["instances"]
    assert [(i["slot"], i["instance_id"]) for i in got] == [(1, 1), (0, 2), (2, 3)]  # dropped slot 0 is free again; the third paste has none


def test_sources_that_disagree_are_told(spark):
    rows = spark.createDataFrame([(0, 1, 4, 4, b"x", None, 2, True), (0, 2, 4, 5, b"x", b"y", None, True), (0, 3, 4, 5, None, b"y", 9, True)], "batch_id long, sample_id long, h int, w int, image binary, depth binary, src_id long, target boolean")
    assert sorted((r["sample_id"], r["rule"]) for r in layers.disagreements(rows).collect() if r["sample_id"] == 1) == [(1, "one_size")]
    assert (3, "source_in_batch") in {(r["sample_id"], r["rule"]) for r in layers.disagreements(rows).collect()}


def test_multiband_by_plain_loops():
    """Pyramids written out pixel by pixel."""
    r = np.random.default_rng(0)
    src, tgt, mask = r.random((9, 12)), r.random((9, 12)), (r.random((9, 12)) < 0.5).astype(float)
    k = np.array([1, 4, 6, 4, 1]) / 16

    def down(x):
        h, w = x.shape
        out = np.zeros((-(-h // 2), -(-w // 2)))
        for i in range(out.shape[0]):
            for j in range(out.shape[1]):
                out[i, j] = sum(k[a] * k[b] * x[2 * i + a - 2, 2 * j + b - 2] for a in range(5) for b in range(5) if 0 <= 2 * i + a - 2 < h and 0 <= 2 * j + b - 2 < w)
        return out

    def up(x, shape):
        out = np.zeros(shape)
        for i in range(shape[0]):
            for j in range(shape[1]):
                y, z = (min(max((p + 0.5) * n / m - 0.5, 0), n - 1) for p, n, m in ((i, x.shape[0], shape[0]), (j, x.shape[1], shape[1])))
                a, b = int(y), int(z)
                c, d = min(a + 1, x.shape[0] - 1), min(b + 1, x.shape[1] - 1)
                out[i, j] = (1 - y + a) * ((1 - z + b) * x[a, b] + (z - b) * x[a, d]) + (y - a) * ((1 - z + b) * x[c, b] + (z - b) * x[c, d])
        return out

    n = harmonize.levels_for(9, 12)
    pyramids = [[x] for x in (src, tgt, mask)]
    for p in pyramids:
        for _ in range(n - 1):
            p.append(down(p[-1]))
    s, t, m = pyramids
    out = m[-1] * s[-1] + (1 - m[-1]) * t[-1]
    for i in range(n - 2, -1, -1):
        out = up(out, s[i].shape) + m[i] * (s[i] - up(s[i + 1], s[i].shape)) + (1 - m[i]) * (t[i] - up(t[i + 1], t[i].shape))
    assert np.allclose(harmonize.multiband(src, tgt, mask), np.clip(out, 0, 1))


def test_public_names():
    import maskframe

    assert sorted(maskframe.__all__) == maskframe.__all__ and all(hasattr(maskframe, n) for n in maskframe.__all__)


def test_banks_by_index_and_without_a_hash(spark):
    from maskframe.sources import bank

    crops = spark.createDataFrame([(0, b"a"), (3, b"b")], "idx long, image binary")
    assert bytes(bank.crop_at(crops, 3)["image"]) == b"b"
    with pytest.raises(IndexError):
        bank.crop_at(crops, 1)
    meta = {"format": "parquet", "format_version": bank.FORMAT_VERSION}
    assert bank.opened(meta) == meta and bank.opened(bank.stamped(meta))
    for bad in (bank.stamped(meta) | {"num_crops": 1}, meta | {"format_version": 9}):
        with pytest.raises(ValueError):
            bank.opened(bad)
    with pytest.raises(ValueError):
        bank.opened(meta, "shards")


def test_loader_needs_whole_batches(spark):
    from maskframe.operators import sampling

    crops = spark.createDataFrame([(i, i % 3, bytes([0, 51, 255]), bytes([0, 7, 255])) for i in range(40)], "idx long, class_id long, image binary, alpha binary")
    with pytest.raises(ValueError):
        sampling.loader(spark, crops, 3, 4, 5, 19, 2)
    got = sampling.staged_pixels(sampling.loader(spark, crops.select("idx", "class_id"), 3, 4, 5, 20, 2), crops).collect()
    assert sorted({(r["batch"], r["pos"], r["slot"]) for r in got}) == [(b, p, k) for b in range(2) for p in range(4) for k in range(5)]
    assert all(r["image"] == [0, 51 / 255, 1] and r["alpha"] == [0, 1, 1] for r in got)
