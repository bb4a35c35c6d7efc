"""Pictures and shards in files: encoding, decoding, scanning, committing, and reading by place."""

import hashlib
import io
import json
import os
import tarfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringContains

from maskframe import bits
from maskframe.functions import png
from maskframe.sources import coco, images, shards, storage


def filtered(rows, kinds, bpp):
    """The encoder's side of the five filters, byte by byte."""
    out, n = [], rows.shape[1]
    for y, kind in enumerate(kinds):
        line = [kind]
        for i in range(n):
            a = int(rows[y, i - bpp]) if i >= bpp else 0
            b = int(rows[y - 1, i]) if y else 0
            c = int(rows[y - 1, i - bpp]) if y and i >= bpp else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((int(rows[y, i]) - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        out.append(line)
    return np.array(out, np.uint8)


def picture(value, depth, kind, kinds, interlaced=False, palette=None):
    """A PNG file of values (h, w, ch)."""
    h, w, ch = value.shape

    def lines(v):
        hh, ww = v.shape[:2]
        flat = v.reshape(hh, ww * ch)
        if depth == 16:
            rows = flat.astype(">u2").view(np.uint8).reshape(hh, -1)
        elif depth == 8:
            rows = flat.astype(np.uint8)
        else:
            rows = np.packbits((flat[..., None] >> np.arange(depth - 1, -1, -1) & 1).reshape(hh, -1).astype(np.uint8), axis=1)
        return filtered(rows, [kinds[i % len(kinds)] for i in range(hh)], max(1, ch * depth // 8)).tobytes()

    raw = b"".join(lines(value[y::dy, x::dx]) for y, x, dy, dx in png.PASSES if value[y::dy, x::dx].size) if interlaced else lines(value)
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([depth, kind, 0, 0, int(interlaced)])
    body = zlib.compress(raw)
    extra = png.chunk(b"PLTE", palette.tobytes()) if palette is not None else b""
    return png.SIGNATURE + png.chunk(b"IHDR", head) + extra + png.chunk(b"tEXt", b"a\0b") + png.chunk(b"IDAT", body[:7]) + png.chunk(b"IDAT", body[7:]) + png.chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize("kind,depth", [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 4), (3, 8), (4, 8), (4, 16), (6, 8), (6, 16)])
def test_every_kind_of_picture(kind, depth, interlaced):
    r = np.random.default_rng(kind * 20 + depth)
    for h, w in ((1, 1), (3, 5), (9, 17), (2, 70)):
        v = r.integers(0, 1 << depth, (h, w, png.CHANNELS[kind]))
        palette = r.integers(0, 256, (1 << min(depth, 8), 3)).astype(np.uint8) if kind == 3 else None
        got = png.decode(picture(v, depth, kind, [0, 1, 2, 3, 4, 4, 3], interlaced, palette))
        full = (1 << depth) - 1
        want = palette[v[..., 0]] if kind == 3 else (v >> 8 if depth == 16 else v * 255 // full)[..., [0, 1, 2] if kind in (2, 6) else [0, 0, 0]]
        assert (got == want.transpose(2, 0, 1)).all()


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 4, 5), (3, 61, 130), (1, 7, 3)])
def test_encoding_round_trip(shape):
    p = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    assert (png.decode(png.encode(p)) == p).all() and png.encode(p) == png.encode(p)


def test_damaged_pictures_are_errors():
    good = png.encode(np.zeros((3, 4, 4), np.uint8))
    for bad in (b"", b"GIF89a", good[:-1], good[:40], good[:45] + b"x" + good[46:], good[:-12]):
        with pytest.raises(ValueError):
            png.decode(bad)


def made(spark, n, h=6, w=9):
    rows = [(f"{i}.png", h, w, np.random.default_rng(i).integers(0, 256, (3, h, w)).astype(np.uint8).tobytes()) for i in range(n)]
    return rows, spark.createDataFrame(rows, images.PICTURE)


def test_pictures_written_and_scanned(spark, tmp_path):
    rows, df = made(spark, 30)
    m = images.write(df.repartition(3), f"file://{tmp_path}/p")
    where = images.folder(f"file://{tmp_path}/p")
    assert m["pictures"] == 30 and images.listing(spark, where).count() == 30
    back = images.decoded(images.scan(spark, where)).collect()
    assert sorted(tuple(r) for r in back) == sorted(rows)
    # Spark's own decoder reads the same pixels.
    assert sorted(tuple(r) for r in images.photographs(spark, where).collect()) == sorted(rows)


def test_wanted_pictures_alone_are_read(spark, tmp_path, monkeypatch):
    _, df = made(spark, 20)
    images.write(df, f"file://{tmp_path}/p")
    where = images.folder(f"file://{tmp_path}/p")
    wanted = spark.createDataFrame([("3.png",), ("5.png",), ("5.png",), ("none.png",)], "name string")
    some = images.scan(spark, where, wanted)
    assert sorted(r["name"] for r in some.collect()) == ["3.png", "5.png"]
    assert some.rdd.getNumPartitions() <= 2
    os.remove(os.path.join(where.removeprefix("file://"), "7.png"))
    with open(os.path.join(where.removeprefix("file://"), "7.png"), "wb") as f:
        f.write(b"no picture")
    assert images.decoded(images.scan(spark, where, wanted)).count() == 2
    monkeypatch.setattr(images, "NAMED", 1)
    assert sorted(r["name"] for r in images.scan(spark, where, wanted).collect()) == ["3.png", "5.png"]


def test_a_failed_run_leaves_no_pictures(spark, tmp_path):
    _, df = made(spark, 4)
    bad = df.unionByName(spark.createDataFrame([("bad.png", 6, 9, b"short")], images.PICTURE))
    with pytest.raises(Exception):
        images.write(bad.coalesce(1), f"file://{tmp_path}/p")
    with pytest.raises(FileNotFoundError):
        images.manifest(f"file://{tmp_path}/p")
    assert not [f for _, _, files in os.walk(tmp_path) for f in files if f.endswith(".png")]


def test_colour_coded_segments(spark, tmp_path):
    r = np.random.default_rng(4)
    h, w = 13, 130
    ids = r.choice([0, 7, 300, 70_000], (h, w)).astype(np.int64)
    p = np.stack([ids & 255, ids >> 8 & 255, ids >> 16]).astype(np.uint8)
    images.write(spark.createDataFrame([("1.png", h, w, p.tobytes())], images.PICTURE), f"file://{tmp_path}/p")
    rows = images.segment_words(images.scan(spark, images.folder(f"file://{tmp_path}/p")))
    got = np.full((h, w), -1)
    for x in rows.collect():
        for i in range(bits.WORD):
            if x["bits"] >> i & 1:
                assert got[x["y"], x["k"] * bits.WORD + i] == -1
                got[x["y"], x["k"] * bits.WORD + i] = x["seg_id"]
    assert (got == ids).all()
    segs = spark.createDataFrame([(1, 7, 3, True, 1), (1, 300, 120, False, 0), (1, 70_000, 3, True, 2), (1, 9, 4, True, 3)], "sample_id long, seg_id long, label long, is_thing boolean, instance_id long")
    area = images.panoptic(rows.withColumn("sample_id", F.lit(1).cast("long")), segs).groupBy("semantic", "panoptic").agg(F.sum(F.bit_count("bits")).alias("n"))
    assert {tuple(x) for x in area.collect()} == {(3, 1, (ids == 7).sum()), (120, 0, (ids == 300).sum()), (3, 2, (ids == 70_000).sum()), (255, 0, (ids == 0).sum())}


def test_crops_cut_at_read(spark, tmp_path):
    rows, df = made(spark, 2, 20, 30)
    images.write(df, f"file://{tmp_path}/p")
    ims = spark.createDataFrame([(i, f"{i}.png", 20, 30) for i in range(2)], "id long, file_name string, height int, width int")
    boxes = [(1, 0, [2.4, 3.6, 10.4, 5.3], None), (2, 0, [-3.0, -2.0, 9.0, 40.0], None), (3, 1, [25.0, 0.5, 12.0, 3.0], "[[25.0,0.0,30.0,0.0,30.0,2.0,25.0,2.0]]"), (4, 1, [0.0, 0.0, 30.0, 20.0], json.dumps({"size": [20, 30], "counts": [5, 20, 575]}))]
    ann = spark.createDataFrame([(i, im, 7, b, 0, s) for i, im, b, s in boxes], "id long, image_id long, category_id long, bbox array<double>, iscrowd int, segmentation string")
    plan = coco.crop_plan(ims, ann, (6, 8), 1).join(ann.select(F.col("id").alias("ann_id"), "segmentation"), "ann_id").withColumn("name", F.format_string("%d.png", "image_id"))
    got = {x["ann_id"]: x for x in images.crops(images.scan(spark, images.folder(f"file://{tmp_path}/p")), plan, (6, 8)).collect()}
    for i, im, (x, y, bw, bh), seg in boxes:
        p = np.frombuffer(rows[im][3], np.uint8).reshape(3, 20, 30)
        x, y, bw, bh = (int(np.rint(v)) for v in (x, y, bw, bh))
        x2, y2, x, y = min(x + bw, 30), min(y + bh, 20), max(x, 0), max(y, 0)
        mask = np.ones((20, 30), bool)
        if i == 3:
            mask[:] = False
            mask[:2, 25:] = True
        if i == 4:
            mask = (np.arange(600).reshape(30, 20).T >= 5) & (np.arange(600).reshape(30, 20).T < 25)
        a, m = p[:, y:y2, x:x2], mask[y:y2, x:x2]
        sh, sw = min(a.shape[1], 6), min(a.shape[2], 8)
        sy, sx, dy, dx = (a.shape[1] - sh) // 2, (a.shape[2] - sw) // 2, (6 - sh) // 2, (8 - sw) // 2
        image, alpha = np.zeros((3, 6, 8), np.uint8), np.zeros((6, 8), np.uint8)
        image[:, dy : dy + sh, dx : dx + sw] = a[:, sy : sy + sh, sx : sx + sw]
        alpha[dy : dy + sh, dx : dx + sw] = m[sy : sy + sh, sx : sx + sw]
        assert got[i]["image"] == image.tobytes() and got[i]["alpha"] == alpha.tobytes() and got[i]["class_id"] == 7


# ---- shards


def crops(spark, n, h=3, w=5, embedded=False):
    byte = lambda size, salt: [(i, i % 4, bytes((i * salt + j) % 256 for j in range(3 * h * w)), bytes((i + j) % 2 for j in range(h * w)), bytes((i + j) % 256 for j in range(512)) if embedded else None) for i in range(size)]
    rows = byte(n, 3)
    return rows, spark.createDataFrame(rows, shards.SCHEMA)


def digests(path):
    return {f: hashlib.sha256(open(os.path.join(path, f), "rb").read()).hexdigest() for f in sorted(os.listdir(path)) if f.startswith("shard-")}


@pytest.mark.parametrize("kind,embedded", [("tar", False), ("tar", True), ("flat", False), ("flat", True)])
def test_shards_round_trip_and_repeat(spark, tmp_path, kind, embedded):
    rows, df = crops(spark, 103, embedded=embedded)
    df = df if embedded else df.drop("embedding_raw")
    meta = shards.write(df.repartition(5), f"{tmp_path}/a", 3, 5, 4, kind, 10)
    shards.write(df.orderBy(F.desc("idx")), f"{tmp_path}/b", 3, 5, 4, kind, 10)
    assert digests(f"{tmp_path}/a") == digests(f"{tmp_path}/b") and len(digests(f"{tmp_path}/a")) == 11
    assert (meta["num_crops"], meta["num_shards"], meta["crop_size"]) == (103, 11, [3, 5])
    plain = lambda rs: sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in rs)
    assert plain(shards.read(spark, f"{tmp_path}/a").collect()) == rows
    assert shards.index(spark, f"{tmp_path}/a").where("class_id = 1").count() == 26
    if kind == "tar":
        with tarfile.open(f"{tmp_path}/a/shard-000003.tar") as t:
            assert t.getnames() == [f"crop_{i:08d}.bin" for i in range(30, 40)]
            assert t.extractfile("crop_00000031.bin").read()[:45] == rows[31][2]


@pytest.mark.parametrize("kind", ["tar", "flat"])
def test_conditions_read_only_their_records(spark, tmp_path, kind):
    rows, df = crops(spark, 100)
    shards.write(df.drop("embedding_raw"), f"{tmp_path}/a", 3, 5, 4, kind, 16)
    reader = shards.ShardReader(f"{tmp_path}/a")
    left = list(reader.pushFilters([In(("idx",), (5, 6, 7, 15, 16, 90, 500)), LessThanOrEqual(("idx",), 90), GreaterThan(("idx",), 5), StringContains(("class_id",), "x")]))
    assert left == [StringContains(("class_id",), "x")]
    runs = [r for p in reader.partitions() for r in p.runs]
    assert runs == [(0, 6, 8), (0, 15, 16), (1, 16, 17), (5, 90, 91)]
    got = [b for p in reader.partitions() for b in reader.read(p)]
    assert [i for b in got for i in b.column("idx").to_pylist()] == [6, 7, 15, 16, 90]
    some = shards.read(spark, f"{tmp_path}/a").where("idx in (3, 50, 99) and class_id = 3")
    assert sorted(r["idx"] for r in some.collect()) == [3, 99]
    assert [r["idx"] for r in shards.read(spark, f"{tmp_path}/a").where("idx >= 98").orderBy("idx").collect()] == [98, 99]
    reader = shards.ShardReader(f"{tmp_path}/a")
    assert not list(reader.pushFilters([EqualTo(("idx",), 42)])) and sum(b - a for p in reader.partitions() for _, a, b in p.runs) == 1


def test_batches_of_draws(spark, tmp_path):
    _, df = crops(spark, 50)
    shards.write(df.drop("embedding_raw"), f"{tmp_path}/a", 3, 5, 4, "flat", 16)
    assert sorted(r["idx"] for r in shards.taken(spark, f"{tmp_path}/a", [4, 4, 49, 0]).collect()) == [0, 4, 49]
    assert shards.taken(spark, f"{tmp_path}/a", []).count() == 0
    for bad in ([50], [-1], [3, 1000]):
        with pytest.raises(IndexError):
            shards.taken(spark, f"{tmp_path}/a", bad)


def test_unfinished_and_damaged_banks_are_refused(spark, tmp_path):
    _, df = crops(spark, 20)
    df = df.drop("embedding_raw")
    with pytest.raises(Exception, match="gaps|belongs"):
        shards.write(df.where("idx <> 7"), f"{tmp_path}/a", 3, 5, 4, "tar", 8)
    with pytest.raises(FileNotFoundError):
        shards.metadata(f"{tmp_path}/a")
    with pytest.raises(ValueError):
        shards.write(df, f"{tmp_path}/a", 3, 5, 4, "zip")
    with pytest.raises(Exception, match="size"):
        shards.write(df, f"{tmp_path}/a", 3, 4, 4, "tar", 8)
    shards.write(df, f"{tmp_path}/a", 3, 5, 4, "tar", 8)
    with open(f"{tmp_path}/a/shard-000001.tar", "r+b") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="belongs"):
        shards.read(spark, f"{tmp_path}/a").collect()
    with open(f"{tmp_path}/a/meta.json", "r+b") as f:
        meta = json.load(io.TextIOWrapper(f))
    meta["num_crops"] = 3
    with open(f"{tmp_path}/a/meta.json", "w") as f:
        json.dump(meta, f)
    with pytest.raises(ValueError):
        shards.metadata(f"{tmp_path}/a")


def test_whole_files_at_once(tmp_path):
    system, path = storage.at(f"file://{tmp_path}")
    storage.put(system, f"{path}/x", b"one")
    storage.put(system, f"{path}/x", b"two")
    assert storage.get(system, f"{path}/x") == b"two" and os.listdir(tmp_path) == ["x"]


def test_a_bank_built_by_command(spark, tmp_path, capsys):
    from maskframe.sources import build

    rows, df = made(spark, 3, 20, 30)
    images.write(df, f"file://{tmp_path}/p")
    doc = {"images": [{"id": i, "file_name": f"{i}.png", "height": 20, "width": 30} for i in range(3)], "categories": [{"id": 7, "name": "a", "isthing": 1}], "annotations": [{"id": 10 * i + j, "image_id": i, "category_id": 7, "bbox": [j, j, 8, 6], "iscrowd": 0, "area": 48.0, "segmentation": json.dumps([[j, j, j + 8, j, j + 8, j + 6, j, j + 6]])} for i in (2, 0) for j in (1, 0)]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    args = ["--annotations", f"{tmp_path}/a.json", "--pictures", images.folder(f"file://{tmp_path}/p"), "--height", "6", "--width", "8", "--least-area", "1", "--per-shard", "3"]
    build.main([*args, "--out", f"{tmp_path}/one"])
    build.main([*args, "--out", f"{tmp_path}/two"])
    assert digests(f"{tmp_path}/one") == digests(f"{tmp_path}/two") and len(digests(f"{tmp_path}/one")) == 2
    got = shards.read(spark, f"{tmp_path}/one").orderBy("idx").collect()
    # By picture, then by annotation; the picture without any isn't needed.
    for r, (i, j) in zip(got, [(0, 0), (0, 1), (2, 0), (2, 1)], strict=True):
        p = np.frombuffer(rows[i][3], np.uint8).reshape(3, 20, 30)
        assert bytes(r["image"]) == p[:, j : j + 6, j : j + 8].tobytes() and r["class_id"] == 7 and set(bytes(r["alpha"])) == {1}
    facts = json.loads((tmp_path / "one" / "provenance.json").read_text())
    assert facts["num_crops"] == 4 and facts["sha256"] == shards.metadata(f"{tmp_path}/one")["sha256"]
