"""A sample catalogue derived from the order tables: orders are samples, their lines are instances.

The tables hold no images; geometry, labels, pixels and depth are whole-number functions of the keys, so that every
operator meets real joins and aggregates whose results can be told exactly. Canvas 16 by 16.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import bits

SIZE, BATCH, THINGS = 16, 8, 14
#: Columns that order the lines of an order; with the order's key they are unique.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches are spans of the key, so numbering within one is a window over a handful of rows."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), F.floor(F.col("o_orderkey") / BATCH).cast("long").alias("batch_id"), "o_custkey")
    w = Window.partitionBy("batch_id")
    return o.select("batch_id", (F.row_number().over(w.orderBy("sample_id")) - 1).cast("long").alias("pos"), F.count("*").over(w).alias("n"), "sample_id", F.lit(SIZE).alias("h"), F.lit(SIZE).alias("w"), (SIZE - F.col("sample_id") % 3).cast("int").alias("hv"), (SIZE - F.col("sample_id") % 2).cast("int").alias("wv"), "o_custkey")


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    x1, y1 = F.col("l_suppkey") % 12, F.col("l_partkey") % 11
    # Named before they are numbered: what follows by sample then needs no other exchange.
    slot = F.row_number().over(Window.partitionBy("sample_id").orderBy(*LINE_ORDER)) - 1
    one = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), *LINE_ORDER).select("sample_id", slot.cast("long").alias("slot"), (F.col("l_partkey") % 20).alias("label"), x1.alias("x1"), y1.alias("y1"), (x1 + 2 + F.col("l_quantity").cast("long") % 4).alias("x2"), (y1 + 2 + (F.col("l_linenumber") + F.col("l_partkey")) % 4).alias("y2"))
    return one.withColumn("instance_id", F.col("slot"))


def mask_rows(inst: DataFrame, *keep: str) -> DataFrame:
    """The instances' rectangles as scanlines; bounds go into the sequence, nothing is exploded to be filtered."""
    return inst.where("y2 > y1 and x2 > x1").select("sample_id", "slot", "label", *keep, F.explode(F.sequence(F.col("y1").cast("int"), (F.col("y2") - 1).cast("int"))).alias("y"), bits.run(F.col("x1"), F.col("x2")).alias("bits"))


def scanlines(samp: DataFrame, *keep: str) -> DataFrame:
    return samp.select("sample_id", *keep, F.explode(F.sequence(F.lit(0), F.lit(SIZE - 1))).alias("y"))


def value(ch: Column | int, sample: Column, y: Column, x: Column) -> Column:
    """The image: a fixed pattern in [0, 1]."""
    c = F.lit(ch) if isinstance(ch, int) else ch
    return ((sample * 31 + y * 7 + x * 13 + c * 29) % 256) / F.lit(255.0)


def pixel_rows(rows: DataFrame, channels: int = 1) -> DataFrame:
    """``rows`` (sample_id, y, ...) with one row a channel and its values."""
    ch = rows.withColumn("ch", F.explode(F.sequence(F.lit(0), F.lit(channels - 1)))) if channels > 1 else rows.withColumn("ch", F.lit(0))
    vals = F.array(*[value(F.col("ch"), F.col("sample_id"), F.col("y"), F.lit(x)) for x in range(SIZE)])
    return ch.withColumn("vals", vals)


def depth_rows(rows: DataFrame) -> DataFrame:
    """``rows`` with depths and their validity bitmap."""
    return rows.withColumn("depth", depth_values("sample_id")).withColumn("ok", depth_ok("sample_id"))


def depth_values(who: str) -> Column:
    """A scanline's depths of the sample that a column names."""
    return F.array(*[1 + ((F.col(who) * 17 + F.col("y") * 3 + x * 5) % 97) / F.lit(10.0) for x in range(SIZE)])


def depth_ok(who: str) -> Column:
    return ((F.col(who) * 40503 + F.col("y") * 24593) % 65536).cast("long")


def padding_bits(hv: Column, wv: Column, y: Column) -> Column:
    """Pixels of a scanline that are padding: all below the valid rows, else those beyond the valid columns."""
    return F.when(y >= hv, bits.full(SIZE)).otherwise(bits.without(bits.full(SIZE), bits.full(wv)))


# ---- wide canvases: suppliers are samples, their customers (fifteen each) instances

PER_WIDE = 15


def wide_samples(spark: SparkSession, sf_dir: str, w: int, h: int) -> DataFrame:
    o = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("sample_id"), F.floor(F.col("s_suppkey") / BATCH).cast("long").alias("batch_id"))
    win = Window.partitionBy("batch_id")
    k = F.col("sample_id")
    return o.select("batch_id", (F.row_number().over(win.orderBy("sample_id")) - 1).cast("long").alias("pos"), F.count("*").over(win).alias("n"), "sample_id", F.lit(h).alias("h"), F.lit(w).alias("w"), (h - k % 3).cast("int").alias("hv"), (w - k % 2).cast("int").alias("wv"))


def wide_instances(spark: SparkSession, sf_dir: str, w: int, h: int) -> DataFrame:
    c = F.col("c_custkey").cast("long")
    bw, bh = 8 + c * 13 % (w // 4), 6 + c * 7 % (h // 4)
    one = table(spark, sf_dir, "customer").select(F.floor(c / PER_WIDE).alias("sample_id"), (c % PER_WIDE).alias("slot"), (c % 20).alias("label"), (c * 37 % (w - bw)).alias("x1"), (c * 53 % (h - bh)).alias("y1"), bw.alias("bw"), bh.alias("bh"))
    return one.select("sample_id", "slot", "label", "x1", "y1", (F.col("x1") + F.col("bw")).alias("x2"), (F.col("y1") + F.col("bh")).alias("y2"), F.col("slot").alias("instance_id"))


def wide_rows(inst: DataFrame) -> DataFrame:
    """Scanline words of the rectangles."""
    line = inst.select("sample_id", "slot", "label", "x1", "x2", F.explode(F.sequence(F.col("y1").cast("int"), (F.col("y2") - 1).cast("int"))).alias("y"))
    return bits.spread(line, F.col("x1"), F.col("x2"), "sample_id", "slot", "label", "y")


def wide_boxes(samp: DataFrame, inst: DataFrame) -> DataFrame:
    """Samples with their boxes: what :func:`draw_layers` needs of each."""
    boxes = inst.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("slot", "label", "x1", "y1", "x2", "y2"))).alias("boxes"))
    return samp.select("batch_id", "sample_id", "h", "w", F.struct("hv", "wv").alias("valid")).join(boxes, "sample_id", "left")


def draw_layers(r: dict, rows: slice | None = None, cols: slice | None = None) -> dict:
    """A row of :func:`wide_boxes` with all its layers and packed masks, each a whole-number pattern of the keys; of a window if named.

    Depth and normals are doubles on small canvases, where SQL compares them, else floats.
    """
    from ..operators import layers

    k, h, w, real = r["sample_id"], r["h"], r["w"], "<f8" if r["h"] * r["w"] < 10_000 else "<f4"
    rows, cols = rows or slice(0, h), cols or slice(0, w)
    y, x = np.arange(rows.start, rows.stop, dtype=np.int32)[:, None], np.arange(cols.start, cols.stop, dtype=np.int32)[None, :]
    h, w = len(y), x.shape[1]
    sem, pan, every = np.full((h, w), k % 6 + THINGS, np.int16), np.zeros((h, w), np.int32), []
    within = lambda a, b, s: slice(max(a, s.start) - s.start, max(min(b, s.stop) - s.start, 0))
    for b in r["boxes"] or []:
        part = within(b["y1"], b["y2"], rows), within(b["x1"], b["x2"], cols)
        sem[part], pan[part] = b["label"], b["slot"] + 1 if b["label"] < THINGS else 0
        m = np.zeros((h, w), bool)
        m[part] = True
        every.append({"slot": b["slot"], "label": b["label"], "instance_id": b["slot"], "mask": layers.packed(m)})
    sign = np.where((k + y) % 2 == 0, 1.0, -1.0).astype(real)
    normals = np.zeros((3, h, w), real)
    normals[0], normals[2] = sign * 0.6, 0.8
    # Bytes wrap around by themselves.
    byte = lambda v: np.asarray(v % 256, np.uint8)
    image = byte(k * 31) + byte(y * 7) + byte(x * 13) + byte(np.arange(3) * 29)[:, None, None]
    own = {"image": image, "semantic": sem, "panoptic": pan, "depth": 1 + ((k * 17 + y * 3 + x * 5) % 97).astype(real) / 10, "normals": normals}
    return r | {n: v.tobytes() for n, v in own.items()} | {"depth_ok": layers.packed((k + y * 3 + x * 7) % 11 != 0), "padding": layers.packed((y >= r["valid"]["hv"]) | (x >= r["valid"]["wv"])), "instances": every}
