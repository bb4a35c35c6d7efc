"""Queries over files: pictures written as PNG and scanned back, crops cut from them, and banks in shards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rng
from ..functions import rle
from ..operators import evaluate
from ..sources import build, coco, export, images, shards, storage
from ..sources import testdata as td
from . import pipeline, presets
from .oracle import u
from .wide import _CROP, Wide, _crops, preset, query

W, H, CUT = 75, 50, 12


def drawn(c: Wide, draw: Callable[[dict], np.ndarray]) -> DataFrame:
    """:data:`images.PICTURE` rows of all suppliers' samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([f"{r['sample_id']}.png" for r in rows], pa.string()), pa.array([r["h"] for r in rows], pa.int32()), pa.array([r["w"] for r in rows], pa.int32()), pa.array([np.ascontiguousarray(draw(r), np.uint8).tobytes() for r in rows], pa.binary())], names=["name", "h", "w", "image"])

    return td.wide_boxes(c.samples, c.instances).mapInArrow(run, images.PICTURE)


def photo(r: dict) -> np.ndarray:
    y, x = np.arange(r["h"])[None, :, None], np.arange(r["w"])[None, None, :]
    return (r["sample_id"] * 31 + y * 7 + x * 13 + np.arange(3)[:, None, None] * 29) % 256


def colour_code(slot):
    """The id of an instance's segment; it takes all three channels."""
    return 1 + slot * 70_001


def coded(r: dict) -> np.ndarray:
    """Segments of the boxes, later ones on top, in colours that stand for their ids; what has no box is void."""
    ids = np.zeros((r["h"], r["w"]), np.int64)
    for b in r["boxes"] or []:
        ids[b["y1"] : b["y2"], b["x1"] : b["x2"]] = colour_code(b["slot"])
    return np.stack([ids & 255, ids >> 8 & 255, ids >> 16])


def on_disk(c: Wide, draw: Callable[[dict], np.ndarray]) -> str:
    """The folder of all samples' pictures, written as PNG into the shared folder."""
    path = storage.shared(c.spark, "pictures")
    images.write(drawn(c, draw), path)
    return images.folder(path)


def sample_of(name: str = "name") -> F.Column:
    return F.regexp_extract(name, r"^(\d+)\.png$", 1).cast("long")


def byte_sums(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with each of the binary columns as the sum of its bytes."""
    keep = [f for f in df.schema.fields if f.name not in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [pa.array([int(np.frombuffer(v, np.uint8).sum()) for v in b.column(c).to_pylist()], pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), *sums], names=[*(f.name for f in keep), *columns])

    return df.select(*[f.name for f in keep], *columns).mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in keep), *(f"{c} long" for c in columns)]))


@query(W, H, f"select sample_id, {H}::int as h, {W}::int as w, sum((sample_id * 31 + y * 7 + x * 13 + ch * 29) % 256)::bigint as total from samp cross join (select unnest(range(0, {H})) as y) cross join (select unnest(range(0, {W})) as x) cross join (select unnest(range(0, 3)) as ch) group by 1", "samp")
def image_scan(c: Wide) -> DataFrame:
    """Every sample's picture, written as PNG and decoded from its file."""
    back = images.decoded(images.scan(c.spark, on_disk(c, photo)))
    return byte_sums(back.withColumnRenamed("image", "total"), "total").select(sample_of().alias("sample_id"), "h", "w", "total")


_SEGS = "select sample_id, slot, label, case when label < 14 then sum((label < 14)::int) over (partition by sample_id order by slot) else 0 end::bigint as nth from inst"
_SEEN = f"select t.sample_id, s.label::bigint as semantic, s.nth as panoptic, count(*) as area from top t join samp using (sample_id) join ({_SEGS}) s on s.sample_id = t.sample_id and s.slot = t.slot group by t.sample_id, s.slot, s.label, s.nth"


@query(W, H, f"select sample_id, semantic, panoptic, sum(area)::bigint as area from ({_SEEN}) group by 1, 2, 3 union all select sample_id, 255, 0, {W * H} - coalesce(sum(area), 0)::bigint from samp left join ({_SEEN}) using (sample_id) group by 1 having {W * H} > coalesce(sum(area), 0)", "samp", "inst", "top")
def panoptic_scan(c: Wide) -> DataFrame:
    """Colour-coded panoptic pictures from files, joined with their segments: areas of every class and instance."""
    words = images.segment_words(images.scan(c.spark, on_disk(c, coded))).withColumn("sample_id", sample_of())
    listed = c.instances.groupBy(F.col("sample_id").alias("image_id")).agg(F.array_sort(F.collect_list(F.struct("slot", colour_code(F.col("slot")).alias("id"), F.col("label").alias("category_id")))).alias("segments_info"))
    kinds = c.spark.range(20).select("id", (F.col("id") < td.THINGS).cast("int").alias("isthing"))
    p = images.panoptic(words, coco.segments(listed, kinds))
    return p.groupBy("sample_id", "semantic", "panoptic").agg(F.sum(F.bit_count("bits")).cast("long").alias("area"))


_TAKE = {a: f"least({CUT}, {a}2 - {a}1)" for a in "xy"}


_CROPS = f"select i.sample_id * 100 + i.slot as ann_id, i.label::bigint as class_id, sum((i.sample_id * 31 + (y1 + (y2 - y1 - {_TAKE['y']}) // 2 + dy) * 7 + (x1 + (x2 - x1 - {_TAKE['x']}) // 2 + dx) * 13 + ch * 29) % 256)::bigint as image, count(distinct dy * {CUT} + dx) as alpha from inst i join samp using (sample_id) cross join (select unnest(range(0, {CUT})) as dy) cross join (select unnest(range(0, {CUT})) as dx) cross join (select unnest(range(0, 3)) as ch) where dy < {_TAKE['y']} and dx < {_TAKE['x']} group by 1, 2"


def _annotated(c: Wide) -> tuple[DataFrame, DataFrame]:
    """Samples and their boxes in the form of annotation files."""
    ims = c.samples.select(F.col("sample_id").alias("id"), F.format_string("%d.png", "sample_id").alias("file_name"), F.col("h").alias("height"), F.col("w").alias("width"))
    size = lambda a: (F.col(f"{a}2") - F.col(f"{a}1")).cast("double")
    return ims, c.instances.select((F.col("sample_id") * 100 + F.col("slot")).alias("id"), F.col("sample_id").alias("image_id"), F.col("label").alias("category_id"), F.array(F.col("x1").cast("double"), F.col("y1").cast("double"), size("x"), size("y")).alias("bbox"), F.lit(0).alias("iscrowd"), F.to_json(F.array(F.array(*[F.col(v) for v in ("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2")]))).alias("segmentation"))


@query(W, H, _CROPS, "inst", "samp")
def bank_crops_cut(c: Wide) -> DataFrame:
    """A bank's crops cut from the files of their pictures: sums of their pixels and of their masks."""
    where = on_disk(c, photo)
    ims, ann = _annotated(c)
    plan = coco.crop_plan(ims, ann, (CUT, CUT), 1).join(ann.select(F.col("id").alias("ann_id"), "segmentation"), "ann_id").withColumn("name", F.format_string("%d.png", "image_id"))
    return byte_sums(images.crops(images.scan(c.spark, where), plan, (CUT, CUT)), "image", "alpha")


@query(W, H, f"select row_number() over (order by ann_id) - 1 as idx, class_id, image, alpha from ({_CROPS})", "inst", "samp")
def bank_built(c: Wide) -> DataFrame:
    """A bank built from pictures and annotations, and read back from its tar shards."""
    ims, ann = _annotated(c)
    out = storage.shared(c.spark, "built")
    build.build(ims, ann, on_disk(c, photo), out, (CUT, CUT), 20, 1, per_shard=256)
    return byte_sums(shards.read(c.spark, out).select("idx", "class_id", "image", "alpha"), "image", "alpha")


_SUMS = f"list_sum(list_transform(range(0, {3 * _CROP * _CROP}), lambda i: (vec_id * 5 + i * 3) % 256))::bigint as image, (255 * len(list_filter(range(0, {_CROP * _CROP}), lambda i: (vec_id + i) % 4 <> 0)))::bigint as alpha"


def banked(c: Wide, kind: str) -> str:
    path = storage.shared(c.spark, "bank")
    shards.write(_crops(c), path, _CROP, _CROP, 10, kind, per_shard=64)
    return path


@query(W, H, f"select vec_id::bigint as idx, label::bigint as class_id, (vec_id // 64)::int as shard_id, {_SUMS} from embeddings")
def bank_tar_shards(c: Wide) -> DataFrame:
    """All crops through tar shards and back, with the shard that their index names."""
    path = banked(c, "tar")
    back = byte_sums(shards.read(c.spark, path).select("idx", "class_id", "image", "alpha"), "image", "alpha")
    return back.join(shards.index(c.spark, path).select("idx", "shard_id"), "idx")


@query(W, H, f"select vec_id::bigint as idx, label::bigint as class_id, {_SUMS} from (select *, row_number() over (partition by label order by {u('record0', 'vec_id')}, vec_id) as nth from embeddings) where nth = 1")
def bank_record_draws(c: Wide) -> DataFrame:
    """One crop of each class, drawn by a seeded hash, read from flat shards by its place; no other record is touched."""
    path = banked(c, "flat")
    first = shards.index(c.spark, path).groupBy("class_id").agg(F.min_by("idx", F.struct(rng.uniform("record0", "idx"), "idx")).alias("idx"))
    some = [r["idx"] for r in first.collect()]  # one a class
    return byte_sums(shards.taken(c.spark, path, some).select("idx", "class_id", "image", "alpha"), "image", "alpha")


@query(W, H, "select sample_id, slot, (x2 - x1) * (y2 - y1) as area from inst", "inst")
def segmentation_files(c: Wide) -> DataFrame:
    """Compressed counts, as annotation files hold them, to areas without drawing a pixel."""
    size = F.col("y2") - F.col("y1")
    runs = F.flatten(F.transform(F.sequence(F.col("x1"), F.col("x2") - 1), lambda x: F.array(F.when(x == F.col("x1"), x * c.h + F.col("y1")).otherwise(c.h - size), size)))
    short = rle.compressed(c.instances.select("sample_id", "slot", runs.alias("counts")))
    return rle.areas(rle.uncompressed(short)).select("sample_id", "slot", "area")


@query(W, H, f"select sample_id, semantic, panoptic, sum(area)::bigint as area from (select t.sample_id, t.label::bigint as semantic, case when t.label < 14 then t.slot + 1 else 0 end as panoptic, 1 as area from top t join samp using (sample_id)) group by 1, 2, 3 union all select sample_id, 255, 0, {W * H} - coalesce(m, 0) from samp left join (select sample_id, count(*) as m from top group by 1) using (sample_id) where {W * H} > coalesce(m, 0)", "samp", "top")
def model_format(c: Wide) -> DataFrame:
    """Samples in the form that models take, and layers made from it again: areas of every class and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                d = td.draw_layers(r)
                yield pa.RecordBatch.from_pylist([{k: d[k] for k in _SAMPLE.names}], schema=_SAMPLE)

    whole = td.wide_boxes(c.samples, c.instances).mapInArrow(run, "sample_id long, h int, w int, image binary, panoptic binary, instances array<struct<slot:long,label:long,instance_id:long,mask:binary>>")
    back = export.from_model(export.to_model(whole), frozenset(range(td.THINGS)))

    def areas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, sem, pan in zip(*(b.column(n).to_pylist() for n in ("sample_id", "semantic", "panoptic"))):
                pair, n = np.unique(np.frombuffer(sem, "<i2").astype(np.int64) << 32 | np.frombuffer(pan, "<i4").astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(n), pa.int64()), pa.array(pair >> 32), pa.array(pair & 0xFFFFFFFF), pa.array(n.astype(np.int64))], names=["sample_id", "semantic", "panoptic", "area"])

    return back.select("sample_id", "semantic", "panoptic").mapInArrow(areas, "sample_id long, semantic long, panoptic long, area long")


_SAMPLE = pa.schema([("sample_id", pa.int64()), ("h", pa.int32()), ("w", pa.int32()), ("image", pa.binary()), ("panoptic", pa.binary()), ("instances", pa.list_(pa.struct([("slot", pa.int64()), ("label", pa.int64()), ("instance_id", pa.int64()), ("mask", pa.binary())])))])


@query(W, H, f"select sample_id, 'before' as side, sum((sample_id * 31 + y * 7 + x * 13 + ch * 29) % 256)::bigint as total from samp cross join (select unnest(range(0, {H})) as y) cross join (select unnest(range(0, {W})) as x) cross join (select unnest(range(0, 3)) as ch) group by 1", "samp")
def gallery(c: Wide) -> DataFrame:
    """A gallery of the panoptic preset's outcomes, written once; its pictures from before, decoded from their files."""
    p = presets.get("coco-panoptic")
    out = preset(c, p, sums=False, audit=True, keep=("image", "semantic", "panoptic", "depth", "normals", "depth_ok", "paste"))
    path = storage.shared(c.spark, "gallery")
    out.write.parquet(f"{path}/outcomes")  # composed once for pictures, hashes and reports
    out = c.spark.read.parquet(f"{path}/outcomes")
    export.gallery(out, evaluate.evaluated(out, pipeline.rules(p)), path)
    back = images.decoded(images.scan(c.spark, images.folder(f"{path}/pictures"))).where(F.col("name").endswith("_before.png"))
    return byte_sums(back.withColumnRenamed("image", "total"), "total").select(F.regexp_extract("name", r"^(\d+)_", 1).cast("long").alias("sample_id"), F.lit("before").alias("side"), "total")
