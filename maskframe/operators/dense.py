"""The per-sample kernel: one target and one source of the same size, composed under a given mask, in one pass over rows.

Unlike the batch augmentation it takes the mask as it is, keeps or drops targets by area and by what they lost, numbers pastes on from
the largest id of the target, and refits all boxes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .layers import BITS, LAYERS, PLANES, flat, packed, plane, unpacked

_INSTANCE = "struct<slot:long,label:long,instance_id:long,pasted:boolean,x1:int,y1:int,x2:int,y2:int,area:long,mask:binary>"
OUT = f"sample_id long, h int, w int, {PLANES}, instances array<{_INSTANCE}>"
_INST = [("slot", pa.int64()), ("label", pa.int64()), ("instance_id", pa.int64()), ("pasted", pa.bool_()), ("x1", pa.int32()), ("y1", pa.int32()), ("x2", pa.int32()), ("y2", pa.int32()), ("area", pa.int64()), ("mask", pa.binary())]
OUT_ARROW = pa.schema([("sample_id", pa.int64()), ("h", pa.int32()), ("w", pa.int32()), *((n, pa.binary()) for n in (*LAYERS, *BITS)), ("instances", pa.list_(pa.struct(_INST)))])


def survives(before: int, after: int, least: int, most_gone: float) -> bool:
    """Some area, at least ``least``, and no more than ``most_gone`` of it lost."""
    return 0 < after >= least and 1 - after / (before + 1e-8) <= most_gone


def compose(t: dict, s: dict, mask: bytes, least: int = 50, most_gone: float = 0.99) -> dict:
    """One target after the paste. A layer that only one side has is an error, but for the image's companions padding and instances."""
    h, w = t["h"], t["w"]
    if (s["h"], s["w"]) != (h, w):
        raise ValueError("both sides must have one size")
    if mask is None or len(mask) != -(-h * w // 8):
        raise ValueError("the mask must have the canvas's size")
    for name in ("image", "semantic", "panoptic", "depth", "normals", "depth_ok"):
        if (t[name] is None) != (s[name] is None):
            raise ValueError(f"{name} must be on both sides or on neither")
    paste = unpacked(mask, h, w)
    inside = paste
    if t["depth"] is not None:
        inside = inside & ((plane(s["depth"], "depth", h, w) < plane(t["depth"], "depth", h, w))[0] | ~unpacked(t["depth_ok"], h, w))
    if s["padding"] is not None:
        inside = inside & ~unpacked(s["padding"], h, w)
    out = {n: None if t[n] is None else np.where(inside, plane(s[n], n, h, w), plane(t[n], n, h, w)) for n in LAYERS}
    out["depth_ok"] = None if t["depth_ok"] is None else unpacked(t["depth_ok"], h, w) & (unpacked(s["depth_ok"], h, w) | ~paste)
    out["padding"] = t["padding"]
    every = []
    for i in t["instances"] or []:
        old = unpacked(i["mask"], h, w)
        new = old & ~inside
        if survives(int(old.sum()), int(new.sum()), least, most_gone):
            every.append(entry(i, i["instance_id"], False, new))
    first = 1 + max((i["instance_id"] for i in t["instances"] or []), default=-1)
    every += [entry(i, first + n, True, unpacked(i["mask"], h, w)) for n, i in enumerate(s["instances"] or [])]
    return {"sample_id": t["sample_id"], "h": h, "w": w, **flat(out), "instances": every}


def entry(i: dict, number: int, pasted: bool, mask: np.ndarray) -> dict:
    """An instance with its tight box, bounds included; an empty mask has none."""
    ys, xs = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    box = dict(zip(("x1", "y1", "x2", "y2"), (int(xs[0]), int(ys[0]), int(xs[-1]), int(ys[-1])) if len(ys) else (None,) * 4))
    return {"slot": i["slot"], "label": i["label"], "instance_id": number, "pasted": pasted, **box, "area": int(mask.sum()), "mask": packed(mask)}


def composed(rows: DataFrame, least: int = 50, most_gone: float = 0.99, load=None) -> DataFrame:
    """:data:`OUT` of rows with the structs ``target`` and ``source`` (sample_id, h, w, layers, instances) and the packed ``mask``.

    ``load`` fills in a side's layers where it is composed; it may also give the ``mask`` (of the source) if rows have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                (r,) = b.slice(i, 1).to_pylist()
                t, s = (load(r[k]) if load else r[k] for k in ("target", "source"))
                yield pa.RecordBatch.from_pylist([compose(t, s, r.get("mask") or s.get("mask"), least, most_gone)], schema=OUT_ARROW)

    return rows.mapInArrow(run, OUT)


def paired(samples: DataFrame, placed: DataFrame) -> DataFrame:
    """``target`` and ``source`` of every placement (sample_id, src_id), one join by the source's id."""
    one = lambda name: F.struct(*samples.columns).alias(name)
    return placed.join(samples.select(F.col("sample_id"), one("target")), "sample_id").join(samples.select(F.col("sample_id").alias("src_id"), one("source")), "src_id").select("target", "source")
