"""Building an instance bank from annotated pictures: plan, cut, number, write, and say where it came from. Also a command.

    python -m maskframe.sources.build --annotations a.json --pictures folder --out bank --height 256 --width 256
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..numbering import ranked
from . import coco, images, shards, storage

#: Images that are numbered together.
SPAN = 1000


def numbered(cut: DataFrame, plan: DataFrame) -> DataFrame:
    """``cut`` with ``idx`` from 0 on, in the order of image and annotation, whatever the partitioning."""
    order = ranked(plan.select("image_id", "ann_id"), ["image_id", "ann_id"], F.floor(F.col("image_id") / SPAN), name="idx")
    return cut.join(order.select("ann_id", F.col("idx").cast("long").alias("idx")), "ann_id")


def build(pictures: DataFrame, annotations: DataFrame, where: str, out: str, crop: tuple[int, int], classes: int, least: float = 256, kind: str = "tar", per_shard: int = 4096, seed: int = 0) -> dict:
    """Cuts the crops of all ``annotations`` from the PNG files below ``where`` and writes them as a bank; returns its metadata.

    ``pictures`` has ``id, file_name, height, width`` and ``annotations`` the fields of :data:`coco.DETECTION`. Pictures without an
    annotation that is large enough aren't opened. The same input gives the same bytes.
    """
    spark = annotations.sparkSession
    plan = coco.crop_plan(pictures, annotations, crop, least).join(annotations.select(F.col("id").alias("ann_id"), "segmentation"), "ann_id").join(pictures.select(F.col("id").alias("image_id"), F.col("file_name").alias("name")), "image_id")
    cut = images.crops(images.scan(spark, where, plan.select("name")), plan, crop)
    meta = shards.write(numbered(cut, plan).select("idx", "class_id", "image", "alpha"), out, *crop, classes, kind, per_shard, seed)
    provenance(out, {"pictures": where, "crop_size": list(crop), "least_area": least, "num_crops": meta["num_crops"], "seed": seed, "sha256": meta["sha256"]})
    return meta


def provenance(out: str, facts: dict) -> None:
    """What a bank was made of, as JSON with sorted keys beside it."""
    system, path = storage.at(out)
    storage.put(system, f"{path}/provenance.json", json.dumps(facts, sort_keys=True).encode())


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="build an instance bank")
    for name in ("annotations", "pictures", "out"):
        p.add_argument(f"--{name}", required=True)
    for name, kind, value in (("height", int, 256), ("width", int, 256), ("least-area", float, 256.0), ("per-shard", int, 4096), ("seed", int, 0)):
        p.add_argument(f"--{name}", type=kind, default=value)
    p.add_argument("--layout", choices=["tar", "flat"], default="tar")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    doc = coco.read(spark, a.annotations)
    pictures, annotations, kinds = (coco.listed(doc, n) for n in ("images", "annotations", "categories"))
    classes = (kinds.agg(F.max("id")).first()[0] or 0) + 1
    print(json.dumps(build(pictures, annotations, a.pictures, a.out, (a.height, a.width), classes, a.least_area, a.layout, a.per_shard, a.seed), sort_keys=True))


if __name__ == "__main__":
    main()
