"""Sinks and exchange formats: manifests, detections for viewers, and model batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import bits
from . import images


def manifest(outcomes: DataFrame) -> DataFrame:
    """One row: how many samples there were and passed, and whether all did."""
    return outcomes.agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("long")).alias("n_ok"), F.coalesce(F.bool_and("ok"), F.lit(True)).alias("all_ok"))


def write_gallery(reports: DataFrame, images: DataFrame, out: str) -> DataFrame:
    """Reports and image hashes as JSON under ``out``; returns the manifest."""
    reports.write.mode("overwrite").json(f"{out}/invariants")
    images.select("sample_id", F.sha2("image", 256).alias("sha256")).write.mode("overwrite").json(f"{out}/dataset")
    m = manifest(reports.groupBy("sample_id").agg(F.bool_and("ok").alias("ok")))
    m.coalesce(1).write.mode("overwrite").json(f"{out}/run")
    return m


def gallery(outcomes: DataFrame, reports: DataFrame, out: str) -> DataFrame:
    """Pictures of all outcomes before and after the paste, encoded in executors, with their reports; returns the manifest.

    ``outcomes`` has ``sample_id, h, w, image`` and the audit; ``reports`` those of the checks. Pictures are seen once all of them
    are there (:func:`images.write`), and hashes are those of the planes from before. A failed run leaves no picture.
    """
    both = F.array(F.struct(F.lit("before").alias("side"), F.col("audit.before.image").alias("image")), F.struct(F.lit("after").alias("side"), F.col("image").alias("image")))
    some = outcomes.select("sample_id", "h", "w", F.explode(both).alias("p")).where("p.image is not null")
    images.write(some.select(F.format_string("%08d_%s.png", "sample_id", "p.side").alias("name"), "h", "w", "p.image"), f"{out}/pictures")
    return write_gallery(reports, outcomes.select("sample_id", F.col("audit.before.image").alias("image")), out)


def detections(inst: DataFrame, w: Column | int, h: Column | int) -> DataFrame:
    """Boxes clamped to the canvas as shares of it (x, y, width, height); those without an extent are left out."""
    w, h = (F.lit(float(v)) if isinstance(v, int) else v for v in (w, h))
    clamp = lambda c, hi: F.greatest(F.lit(0.0), F.least(F.col(c).cast("double"), hi))
    b = inst.select("sample_id", "slot", "label", clamp("x1", w).alias("a"), clamp("y1", h).alias("b"), clamp("x2", w).alias("c"), clamp("y2", h).alias("d"))
    b = b.where((F.col("c") > F.col("a")) & (F.col("d") > F.col("b")))
    return b.select("sample_id", "slot", "label", (F.col("a") / w).alias("x"), (F.col("b") / h).alias("y"), ((F.col("c") - F.col("a")) / w).alias("width"), ((F.col("d") - F.col("b")) / h).alias("height"))


def stuff_only(semantic: DataFrame, things: DataFrame) -> DataFrame:
    """Class bitmaps of the pixels without an instance."""
    j = bits.keyed(semantic).join(bits.keyed(things), bits.LINE, "left")
    return j.select(*bits.LINE, "class_id", bits.without(F.col("bits"), F.coalesce("z", F.lit(0).cast("long"))).alias("bits")).where("bits <> 0")


def last_wins(masks: DataFrame, is_thing: Column) -> DataFrame:
    """Class bitmaps and instance bitmaps of stacked masks: later ones overwrite, a thing's number is its slot plus one.

    Empty masks paint nothing but keep their number.
    """
    from ..operators.composite import visible

    v = visible(masks).where("bits <> 0")
    return v.select(*bits.LINE, F.col("label").alias("semantic"), F.when(is_thing, F.col("slot") + 1).otherwise(0).alias("panoptic"), "bits").groupBy(*bits.LINE, "semantic", "panoptic").agg(F.bit_or("bits").alias("bits"))


def model_batch(pad: DataFrame) -> DataFrame:
    """Per sample the labels of its valid slots, in slot order."""
    s = pad.where("valid").groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("slot", "label"))).alias("s"))
    return s.select("sample_id", F.transform("s", lambda r: r["slot"]).alias("slots"), F.transform("s", lambda r: r["label"]).alias("class_labels"))


#: What segmentation models take: a mask and a class an instance, in slot order, and the picture as floats.
MODEL = "sample_id long, h int, w int, mask_labels array<binary>, class_labels array<long>, pixel_values binary"


def to_model(samples: DataFrame) -> DataFrame:
    """:data:`MODEL` of whole samples (``sample_id, h, w, image, panoptic, instances``); samples without a panoptic layer are errors."""
    need = F.when(F.col("panoptic").isNull() | F.col("instances").isNull(), F.raise_error(F.lit("instances and a panoptic layer are needed")).cast("binary")).otherwise(F.col("image"))
    i = F.array_sort("instances", lambda a, b: F.when(a["slot"] < b["slot"], -1).otherwise(1))
    rows = samples.select("sample_id", "h", "w", F.transform(i, lambda x: x["mask"]).alias("mask_labels"), F.transform(i, lambda x: x["label"]).alias("class_labels"), need.alias("pixel_values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = pa.array([None if v is None else np.frombuffer(v, np.uint8).astype("<f4").tobytes() for v in b.column("pixel_values").to_pylist()], pa.binary())
            yield b.set_column(b.schema.get_field_index("pixel_values"), "pixel_values", values)

    return rows.mapInArrow(run, MODEL)


def from_model(rows: DataFrame, things: frozenset[int], ignore: int = 255) -> DataFrame:
    """(sample_id, h, w, image, semantic, panoptic, instances) of :data:`MODEL`: later masks paint over earlier ones.

    The n-th mask has the number n, from 1 on, which things also have in the panoptic layer; empty masks paint nothing but keep
    their number. As many classes as masks are needed.
    """
    from ..operators.layers import packed, unpacked

    kinds = list(things)

    def one(r: dict) -> dict:
        masks, labels, h, w = r["mask_labels"], r["class_labels"], r["h"], r["w"]
        if len(masks) != len(labels):
            raise ValueError("as many classes as masks are needed")
        sem, pan = np.full((h, w), ignore, "<i2"), np.zeros((h, w), "<i4")
        for n, (m, c) in enumerate(zip(masks, labels)):
            at = unpacked(m, h, w)
            sem[at], pan[at] = c, n + 1 if c in kinds else 0
        image = np.rint(np.frombuffer(r["pixel_values"], "<f4")).astype(np.uint8).tobytes()
        every = [{"slot": n, "label": c, "instance_id": n + 1, "mask": packed(unpacked(m, h, w))} for n, (m, c) in enumerate(zip(masks, labels))]
        return {"sample_id": r["sample_id"], "h": h, "w": w, "image": image, "semantic": sem.tobytes(), "panoptic": pan.tobytes(), "instances": every}

    inst = pa.list_(pa.struct([("slot", pa.int64()), ("label", pa.int64()), ("instance_id", pa.int64()), ("mask", pa.binary())]))
    schema = pa.schema([("sample_id", pa.int64()), ("h", pa.int32()), ("w", pa.int32()), ("image", pa.binary()), ("semantic", pa.binary()), ("panoptic", pa.binary()), ("instances", inst)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield pa.RecordBatch.from_pylist([one(b.slice(i, 1).to_pylist()[0])], schema=schema)

    return rows.mapInArrow(run, "sample_id long, h int, w int, image binary, semantic binary, panoptic binary, instances array<struct<slot:long,label:long,instance_id:long,mask:binary>>")


def forbidden_files(files: DataFrame, suffixes: list[str], allowed: list[str]) -> DataFrame:
    """Paths with a forbidden suffix outside the allowed prefixes."""
    bad = F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")
    ok = F.lit(False)
    for p in allowed:
        ok = ok | F.col("path").startswith(p)
    return files.where(bad & ~ok)
