"""The instance bank: packed records, their metadata, and Parquet and shard layouts of the same relation."""

from __future__ import annotations

import hashlib
import json
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import violations

FORMAT_VERSION, EMBEDDING, PER_SHARD = 1, 256, 4096


def record_size(h: int, w: int, embedded: bool) -> int:
    """Three colour planes, one alpha plane, eight bytes of class, and 256 half floats if there is an embedding."""
    return 3 * h * w + h * w + 8 + (2 * EMBEDDING if embedded else 0)


def unpack(records: DataFrame, h: int, w: int, embedded: bool = False, column: str = "record") -> DataFrame:
    """``idx, image, alpha, class_id, embedding_raw`` of packed records, natively; see :func:`record_violations` for lengths."""
    n = h * w
    rec = F.col(column)
    little = F.reverse(F.split(F.regexp_replace(F.hex(F.substring(rec, 4 * n + 1, 8)), "(..)", "$1 "), " "))
    value = F.conv(F.array_join(little, ""), 16, -10).cast("long")
    raw = F.substring(rec, 4 * n + 9, 2 * EMBEDDING) if embedded else F.lit(None).cast("binary")
    return records.select("idx", F.substring(rec, 1, 3 * n).alias("image"), F.substring(rec, 3 * n + 1, n).alias("alpha"), value.alias("class_id"), raw.alias("embedding_raw"))


def pack(bank: DataFrame) -> DataFrame:
    """(idx, record): image, alpha, class as eight little-endian bytes, embedding if any."""
    big = F.lpad(F.hex("class_id"), 16, "0")
    little = F.array_join(F.reverse(F.split(F.regexp_replace(big, "(..)", "$1 "), " ")), "")
    return bank.select("idx", F.concat("image", "alpha", F.unhex(little), F.coalesce(F.col("embedding_raw"), F.lit(b""))).alias("record"))


def record_violations(records: DataFrame, h: int, w: int, embedded: bool = False, column: str = "record") -> DataFrame:
    return violations(records, {"record_length": F.octet_length(column) == record_size(h, w, embedded)}, "idx")


def crop_violations(bank: DataFrame, h: int, w: int, embedded: bool) -> DataFrame:
    rules = {"image_shape": F.octet_length("image") == 3 * h * w, "alpha_shape": F.octet_length("alpha") == h * w, "embedding": F.col("embedding_raw").isNotNull() == F.lit(embedded)}
    return violations(bank, rules, "idx")


def build(bank: DataFrame, path: str, h: int, w: int, classes: int, seed: int = 0, embedded: bool = False, layout: str = "parquet", version: str = "0") -> dict:
    """Writes a bank with its metadata; refuses wrong shapes, mixed embeddings, an empty bank and unknown layouts."""
    if layout not in ("parquet", "shards"):
        raise ValueError(f"unknown layout {layout!r}")
    bad = crop_violations(bank, h, w, embedded).take(3)
    if bad:
        raise ValueError(f"violations: {[r.asDict() for r in bad]}")
    n = bank.count()
    if not n:
        raise ValueError("an empty bank")
    if layout == "parquet":
        bank.write.mode("overwrite").partitionBy("class_id").parquet(f"{path}/crops")
    else:
        shard_index(bank).write.mode("overwrite").parquet(f"{path}/index")
        pack(bank).withColumn("shard_id", F.floor(F.col("idx") / PER_SHARD)).write.mode("overwrite").partitionBy("shard_id").parquet(f"{path}/records")
    meta = stamped({"format": layout, "format_version": FORMAT_VERSION, "num_crops": n, "num_classes": classes, "crop_size": [h, w], "has_embeddings": embedded, "base_seed": seed, "engine_version": version})
    spark = bank.sparkSession
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return meta


def shard_index(bank: DataFrame) -> DataFrame:
    """(idx, shard_id, member_name, class_id): contiguous shards."""
    return bank.select("idx", F.floor(F.col("idx") / PER_SHARD).cast("int").alias("shard_id"), F.format_string("%08d", "idx").alias("member_name"), "class_id")


def digest(meta: dict) -> str:
    """SHA-256 of the metadata as JSON with sorted keys, its own hash left out."""
    return hashlib.sha256(json.dumps({k: v for k, v in meta.items() if k != "sha256"}, sort_keys=True).encode()).hexdigest()


def stamped(meta: dict) -> dict:
    return meta | {"sha256": digest(meta)}


def opened(meta: dict, layout: str | None = None) -> dict:
    """The metadata, if it breaks no rule; a bank that carries no hash can't be told from a changed one and is taken."""
    rules = {"layout": layout is None or meta.get("format") == layout, "version": meta.get("format_version") == FORMAT_VERSION, "hash": "sha256" not in meta or meta["sha256"] == digest(meta)}
    broken = [name for name, kept in rules.items() if not kept]
    if broken:
        raise ValueError(f"the bank's metadata breaks: {', '.join(broken)}")
    return meta


def crop_at(bank: DataFrame, idx: int) -> dict:
    """One crop by its index; an index without a crop is an error."""
    found = bank.where(F.col("idx") == idx).limit(1).collect()
    if not found:
        raise IndexError(f"no crop {idx}")
    return found[0].asDict()


def version(meta: dict) -> str:
    return f"{meta['format']}@{meta.get('sha256', digest(meta))[:12]}"


def open_bank(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The crops and the metadata of a bank written by :func:`build`."""
    meta = opened(json.loads(spark.read.text(f"{path}/meta").first()[0]))
    h, w = meta["crop_size"]
    if meta["format"] == "parquet":
        crops = spark.read.parquet(f"{path}/crops").withColumn("class_id", F.col("class_id").cast("long"))
    else:
        crops = unpack(spark.read.parquet(f"{path}/records"), h, w, meta["has_embeddings"])
    return crops, meta


def half_floats(raw: bytes) -> list[float]:
    return list(struct.unpack(f"<{len(raw) // 2}e", raw))
