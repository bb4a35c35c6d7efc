"""Pictures in files: a sink that encodes them, a scan that finds and decodes them, and what is read off their pixels.

Files come by Spark's own readers, so they can lie in any store that Spark opens; decoding runs on Arrow batches. A picture is
planes of bytes, (3, h, w). JPEG files are decoded by Spark's ``image`` source, PNG files here, by numpy.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .. import bits
from ..functions import png, rle
from ..workers import reach
from . import storage

#: Names that may be pushed into the listing of files; more are met by a join.
NAMED = 10_000
PICTURE = "name string, h int, w int, image binary"


class Done(WriterCommitMessage):
    def __init__(self, n: int, size: int):
        self.n, self.size = n, size


class Pictures(DataSource):
    """The sink ``maskframe_pictures``: rows (name, h, w, image) become PNG files below ``path``, seen once all are there.

    Files go into a folder of the run's own, each replaced as a whole, so that a task can be repeated; the manifest, written
    last, names the folder. A failed run leaves no pictures and no manifest.
    """

    @classmethod
    def name(cls) -> str:
        return "maskframe_pictures"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return PictureWriter(self.options["path"], self.options["run"])


class PictureWriter(DataSourceArrowWriter):
    def __init__(self, path: str, run: str):
        self.path, self.run = path, run

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        system, path = storage.at(self.path)
        n = size = 0
        system.create_dir(f"{path}/{self.run}", recursive=True)
        for b in iterator:
            for name, h, w, image in zip(*(b.column(c).to_pylist() for c in ("name", "h", "w", "image"))):
                raw = png.encode(np.frombuffer(image, np.uint8).reshape(-1, h, w))
                storage.put(system, f"{path}/{self.run}/{name}", raw)
                n, size = n + 1, size + len(raw)
        return Done(n, size)

    def commit(self, messages: list[Done | None]) -> None:
        system, path = storage.at(self.path)
        done = [m for m in messages if m is not None]
        system.create_dir(f"{path}/{self.run}", recursive=True)
        storage.put(system, f"{path}/manifest.json", json.dumps({"folder": self.run, "pictures": sum(m.n for m in done), "bytes": sum(m.size for m in done)}, sort_keys=True).encode())

    def abort(self, messages: list[Done | None]) -> None:
        system, path = storage.at(self.path)
        if storage.exists(system, f"{path}/{self.run}"):
            system.delete_dir(f"{path}/{self.run}")


def write(pictures: DataFrame, path: str) -> dict:
    """Encodes :data:`PICTURE` rows as PNG files below ``path``; returns the manifest. Names end in ``.png`` and are distinct."""
    spark = reach(pictures.sparkSession)
    spark.dataSource.register(Pictures)
    run = storage.shared(spark, "run").rsplit("/", 1)[1]
    pictures.select("name", "h", "w", "image").write.format("maskframe_pictures").option("path", path).option("run", run).mode("append").save()
    return manifest(path)


def manifest(path: str) -> dict:
    system, p = storage.at(path)
    if not storage.exists(system, f"{p}/manifest.json"):
        raise FileNotFoundError(f"no finished pictures in {path}")
    return json.loads(storage.get(system, f"{p}/manifest.json"))


def folder(path: str) -> str:
    """Where the finished pictures of a sink's path lie."""
    return f"{path}/{manifest(path)['folder']}"


def listing(spark: SparkSession, where: str) -> DataFrame:
    """(name, size) of the PNG files of a folder and those below it; no content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(where).select(F.col("_metadata.file_name").alias("name"), F.col("length").alias("size"))


def scan(spark: SparkSession, where: str, wanted: DataFrame | None = None) -> DataFrame:
    """(name, content) of the PNG files of a folder, of ``wanted`` names (a column ``name``) if given.

    Up to :data:`NAMED` names are pushed into the listing, so that no other file is opened; more are met by a join.
    """
    files = reach(spark).read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(where)
    name = F.col("_metadata.file_name")
    if wanted is None:
        return files.select(name.alias("name"), "content")
    names = wanted.select("name").distinct()
    some = [r["name"] for r in names.limit(NAMED + 1).collect()]
    if len(some) <= NAMED:
        return files.where(name.isin(some)).select(name.alias("name"), "content")
    return files.select(name.alias("name"), "content").join(names, "name", "left_semi")


def decoded(files: DataFrame) -> DataFrame:
    """:data:`PICTURE` rows of (name, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # A picture at a time: decoded ones are much larger than their files.
            for name, raw in zip(b.column("name").to_pylist(), b.column("content")):
                p = png.decode(raw.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([p.shape[1]], pa.int32()), pa.array([p.shape[2]], pa.int32()), pa.array([p.tobytes()], pa.binary())], names=["name", "h", "w", "image"])

    return files.select("name", "content").mapInArrow(run, PICTURE)


def photographs(spark: SparkSession, where: str) -> DataFrame:
    """:data:`PICTURE` rows of all files that Spark's ``image`` source decodes (JPEG and others), files that it can't left out.

    The source gives interleaved bytes, blue first; they are put into planes here. Grey pictures fill all planes.
    """
    rows = reach(spark).read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(where)
    flat = rows.select(F.element_at(F.split("image.origin", "/"), -1).alias("name"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("ch"), F.col("image.data").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, w, ch, raw in zip(*(b.column(c).to_pylist() for c in ("h", "w", "ch", "data"))):
                p = np.frombuffer(raw, np.uint8).reshape(h, w, ch)
                out.append(np.ascontiguousarray((p[..., 2::-1] if ch >= 3 else p[..., [0, 0, 0]]).transpose(2, 0, 1)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("name"), b.column("h"), b.column("w"), pa.array(out, pa.binary())], names=["name", "h", "w", "image"])

    return flat.mapInArrow(run, PICTURE)


def colour_words(p: np.ndarray) -> tuple[np.ndarray, ...]:
    """(id, y, k, bits) of the colour-coded segments of a picture: scanline words straight from stretches of one colour."""
    ids = p[0].astype(np.int64) + 256 * p[1].astype(np.int64) + 65536 * p[2].astype(np.int64)
    h, w = ids.shape
    new = np.ones((h, w), bool)
    new[:, 1:] = ids[:, 1:] != ids[:, :-1]
    new[:, :: bits.WORD] = True
    at = np.flatnonzero(new)
    size = np.diff(np.r_[at, h * w])
    y, x = at // w, at % w
    k, seg, word = x // bits.WORD, ids.ravel()[at], ((np.int64(1) << size) - 1) << (x % bits.WORD)
    # Stretches of one segment in one word don't overlap, so their sum is their union.
    order = np.lexsort((k, y, seg))
    seg, y, k, word = seg[order], y[order], k[order], word[order]
    first = np.flatnonzero(np.r_[True, (np.diff(seg) != 0) | (np.diff(y) != 0) | (np.diff(k) != 0)])
    return seg[first], y[first], k[first], np.add.reduceat(word, first)


def segment_words(files: DataFrame) -> DataFrame:
    """(name, seg_id, y, k, bits) of colour-coded panoptic pictures (name, content): no pixel becomes a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column("name").to_pylist(), b.column("content")):
                seg, y, k, word = colour_words(png.decode(raw.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(seg), pa.string()), pa.array(seg), pa.array(y, pa.int32()), pa.array(k, pa.int32()), pa.array(word)], names=["name", "seg_id", "y", "k", "bits"])

    return files.select("name", "content").mapInArrow(run, "name string, seg_id long, y int, k int, bits long")


def panoptic(words: DataFrame, segments: DataFrame, ignore: int = 255) -> DataFrame:
    """(sample_id, seg_id, semantic, panoptic, y, k, bits) of ``sample_id, seg_id, y, k, bits`` and the segments of
    :func:`coco.segments`; words of no listed segment are ignored ones, instance 0."""
    j = words.join(segments, ["sample_id", "seg_id"], "left")
    return j.select("sample_id", "seg_id", F.coalesce("label", F.lit(ignore).cast("long")).alias("semantic"), F.coalesce("instance_id", F.lit(0).cast("long")).alias("panoptic"), "y", "k", "bits")


def crops(files: DataFrame, plan: DataFrame, crop: tuple[int, int]) -> DataFrame:
    """(ann_id, class_id, image, alpha): the crops of a plan, cut where their picture is decoded.

    ``files`` has (name, content); ``plan`` the columns of :func:`coco.crop_plan` with ``name`` and ``segmentation``, JSON of
    polygons or counts (null: the whole box). A picture is decoded once for all its crops; what shuffles is files and plan.
    """
    ch, cw = crop
    cols = ["ann_id", "class_id", "x1", "y1", "x2", "y2", "src_x", "dst_x", "take_x", "src_y", "dst_y", "take_y", "segmentation"]
    per = plan.groupBy("name").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("plan"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw, todo in zip(b.column("content"), b.column("plan")):
                p = png.decode(raw.as_py())
                out = [cut(p, r, ch, cw) for r in todo.as_py()]
                yield pa.RecordBatch.from_arrays([todo.values.field("ann_id"), todo.values.field("class_id"), pa.array([i for i, _ in out], pa.binary()), pa.array([a for _, a in out], pa.binary())], names=["ann_id", "class_id", "image", "alpha"])

    return files.join(per, "name").select("content", "plan").mapInArrow(run, "ann_id long, class_id long, image binary, alpha binary")


def cut(p: np.ndarray, r: dict, ch: int, cw: int) -> tuple[bytes, bytes]:
    """One crop's planes: its box centred, what is larger cut at the centre, the rest zero."""
    h, w = p.shape[1:]
    box = slice(r["y1"], r["y2"]), slice(r["x1"], r["x2"])
    mask = rle.mask_of(json.loads(r["segmentation"]), h, w)[box] if r["segmentation"] is not None else np.ones((r["y2"] - r["y1"], r["x2"] - r["x1"]), bool)
    part = slice(r["src_y"], r["src_y"] + r["take_y"]), slice(r["src_x"], r["src_x"] + r["take_x"])
    to = slice(r["dst_y"], r["dst_y"] + r["take_y"]), slice(r["dst_x"], r["dst_x"] + r["take_x"])
    image, alpha = np.zeros((3, ch, cw), np.uint8), np.zeros((ch, cw), np.uint8)
    image[(slice(None), *to)] = p[(slice(None), *box)][(slice(None), *part)]
    alpha[to] = mask[part]
    return image.tobytes(), alpha.tobytes()

