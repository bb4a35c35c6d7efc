"""COCO-style annotation files: detection, panoptic, and crops for an instance bank.

A file is one JSON document; Spark reads it as a row and explodes its lists, everything after that is relational. So one task
parses a whole file: annotation files beyond a few GB should be converted to JSON lines once (:func:`read_lines`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..numbering import ranked

#: Ids that are numbered together.
SPAN = 100_000

#: The fields of the annotation format that are read.
DETECTION = "images array<struct<id:long,file_name:string,height:int,width:int>>, annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>,iscrowd:int,area:double,segmentation:string>>, categories array<struct<id:long,name:string,isthing:int>>"
PANOPTIC = "images array<struct<id:long,file_name:string,height:int,width:int>>, annotations array<struct<image_id:long,file_name:string,segments_info:array<struct<id:long,category_id:long,iscrowd:int,area:long>>>>, categories array<struct<id:long,name:string,isthing:int>>"


def read(spark: SparkSession, path: str, schema: str = DETECTION) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_lines(spark: SparkSession, path: str, name: str, schema: str = DETECTION) -> DataFrame:
    """One list of an annotation file (``images``, ``annotations``, ``categories``) from JSON lines, split among tasks."""
    one = spark.createDataFrame([], schema).schema[name].dataType.elementType
    return spark.read.schema(one).json(path)


def listed(doc: DataFrame, name: str) -> DataFrame:
    return doc.select(F.explode(name).alias("r")).select("r.*")


def detection(images: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, instances): images that have an annotation, by id; boxes as corners; labels are category ids.

    Instance ids number an image's annotations from 0 in the order of their ids.
    """
    some = images.join(annotations, images["id"] == annotations["image_id"], "left_semi")
    samples = some.select(F.col("id").alias("sample_id"), F.col("height").alias("h"), F.col("width").alias("w"), "file_name", F.lit(False).alias("padded"))
    n = F.row_number().over(Window.partitionBy("image_id").orderBy("id")) - 1
    x, y, w, h = (F.col("bbox")[i] for i in range(4))
    inst = annotations.select(F.col("image_id").alias("sample_id"), n.cast("long").alias("slot"), F.col("category_id").alias("label"), n.cast("int").alias("instance_id"), x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))
    return samples, inst


def batched(samples: DataFrame, batch: int) -> DataFrame:
    """Samples in id order, ``batch`` of them together; nothing is shuffled into another order."""
    n = F.col("_rank")
    some = ranked(samples, "sample_id", F.floor(F.col("sample_id") / SPAN), name="_rank")
    return some.withColumn("batch_id", F.floor(n / batch).cast("long")).withColumn("pos", (n % batch).cast("long")).drop("_rank")


def segments(annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """(sample_id, seg_id, label, is_thing, instance_id): things number from 1 in the order they are listed, stuff is 0."""
    s = annotations.select(F.col("image_id").alias("sample_id"), F.posexplode("segments_info").alias("i", "s")).select("sample_id", "i", F.col("s.id").alias("seg_id"), F.col("s.category_id").alias("label"))
    s = s.join(categories.select(F.col("id").alias("label"), (F.col("isthing") == 1).alias("is_thing")), "label")
    nth = F.sum(F.col("is_thing").cast("long")).over(Window.partitionBy("sample_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return s.select("sample_id", "seg_id", "label", "is_thing", F.when(F.col("is_thing"), nth).otherwise(0).alias("instance_id"))


def panoptic_pixels(pixels: DataFrame, segs: DataFrame, ignore: int = 255) -> DataFrame:
    """(sample_id, y, x, semantic, panoptic) of ``sample_id, y, x, r, g, b``; pixels of no segment are ignored, instance 0."""
    from ..functions.rle import segment_id

    p = pixels.withColumn("seg_id", segment_id(F.col("r"), F.col("g"), F.col("b")).cast("long"))
    j = p.join(segs, ["sample_id", "seg_id"], "left")
    return j.select("sample_id", "y", "x", F.coalesce("label", F.lit(ignore).cast("long")).alias("semantic"), F.coalesce("instance_id", F.lit(0).cast("long")).alias("panoptic"))


def panoptic_boxes(pan: DataFrame) -> DataFrame:
    return pan.where("panoptic > 0").groupBy("sample_id", "panoptic").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"), F.first("semantic").alias("label"))


def crop_plan(images: DataFrame, annotations: DataFrame, crop: tuple[int, int], least: float = 256) -> DataFrame:
    """Where each annotation's crop is cut and put, in the order of image and annotation.

    Crowds and boxes of less than ``least`` are left out; near edges and sizes round half to even, and edges are clipped to the
    image after the far ones are found from the unclipped near ones; empty crops go. A smaller crop is centred, a larger one cut at its centre.
    """
    ch, cw = crop
    a = annotations.where(F.coalesce(F.col("iscrowd"), F.lit(0)) == 0).join(images.select(F.col("id").alias("image_id"), "height", "width"), "image_id")
    x, y, w, h = (F.col("bbox")[i] for i in range(4))
    a = a.where(w * h >= least).withColumn("rx", F.rint(x)).withColumn("ry", F.rint(y)).withColumn("rx2", F.rint(x) + F.rint(w)).withColumn("ry2", F.rint(y) + F.rint(h))
    clip = lambda v, hi: F.greatest(F.lit(0), F.least(v, F.col(hi))).cast("long")
    a = a.select("image_id", F.col("id").alias("ann_id"), F.col("category_id").alias("class_id"), clip(F.col("rx"), "width").alias("x1"), clip(F.col("ry"), "height").alias("y1"), clip(F.col("rx2"), "width").alias("x2"), clip(F.col("ry2"), "height").alias("y2"))
    a = a.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))

    def centred(size: Column, want: int, name: str) -> list[Column]:
        take = F.least(size, F.lit(want))
        return [F.floor((size - take) / 2).alias(f"src_{name}"), F.floor((F.lit(want) - take) / 2).alias(f"dst_{name}"), take.alias(f"take_{name}")]

    return a.select("*", *centred(F.col("x2") - F.col("x1"), cw, "x"), *centred(F.col("y2") - F.col("y1"), ch, "y"))


def subset(annotations: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` annotated image ids, chosen by a seeded hash."""
    from ..rng import uniform

    return annotations.select("image_id").distinct().orderBy(uniform(f"subset{seed}", "image_id"), "image_id").limit(n)


def missing(wanted: DataFrame, images: DataFrame) -> DataFrame:
    return wanted.join(images.select(F.col("id").alias("image_id")), "image_id", "left_anti")


def fingerprint(ids: DataFrame, column: str = "image_id") -> DataFrame:
    """The first 16 digits of the SHA-256 of the sorted ids, comma-joined: one row. Meant for a chosen subset, not a corpus."""
    return ids.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_set(column)), ","), 256), 1, 16).alias("fingerprint"))


def source_of(local: str | None, repository: str | None) -> tuple[str, str]:
    """Exactly one of a local folder and a repository name; downloading the latter is left to the caller."""
    if (local is None) == (repository is None):
        raise ValueError("name either a local folder or a repository")
    return ("local", local) if local is not None else ("repository", repository)


def enough(samples: DataFrame, n: int) -> DataFrame:
    """The first ``n`` samples by id; fewer are an error."""
    if samples.limit(n).count() < n:
        raise ValueError(f"fewer than {n} samples")
    return samples.orderBy("sample_id").limit(n)
