"""Large-scale jitter of pixels: every layer of a sample resized and cropped in one pass, by the plan that :mod:`.prep` makes.

Images are resampled with a triangle that widens when they shrink, along one axis after the other; labels, masks and measured layers
keep their values, each pixel taking that of the source pixel it lies in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rng
from . import prep
from .layers import BITS, LAYERS, PLANES, flat, packed, plane, unpacked

HALF = 0.5 + 1e-9
_INSTANCE = "struct<slot:long,label:long,instance_id:long,x1:int,y1:int,x2:int,y2:int,area:long,mask:binary>"
OUT = f"sample_id long, h int, w int, {PLANES}, instances array<{_INSTANCE}>"
_INST = [("slot", pa.int64()), ("label", pa.int64()), ("instance_id", pa.int64()), ("x1", pa.int32()), ("y1", pa.int32()), ("x2", pa.int32()), ("y2", pa.int32()), ("area", pa.int64()), ("mask", pa.binary())]
OUT_ARROW = pa.schema([("sample_id", pa.int64()), ("h", pa.int32()), ("w", pa.int32()), *((n, pa.binary()) for n in (*LAYERS, *BITS)), ("instances", pa.list_(pa.struct(_INST)))])


def weights(n: int, m: int, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(source places, weights), a row each for the pixels from ``first`` up to ``last`` of ``m`` that ``n`` are resampled to."""
    scale = n / m
    wide = max(scale, 1.0)
    centre = (np.arange(first, m if last is None else last) + 0.5) * scale
    low, high = np.maximum((centre - wide + 0.5).astype(int), 0), np.minimum((centre + wide + 0.5).astype(int), n)
    at = low[:, None] + np.arange(max(1, int((high - low).max(initial=1))))
    w = np.where(at < high[:, None], np.maximum(1 - np.abs(at + 0.5 - centre[:, None]) / wide, 0), 0.0)
    return np.minimum(at, n - 1), w / w.sum(1, keepdims=True)


def smooth(p: np.ndarray, axis: int, at: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One axis resampled, a tap at a time."""
    shape = [1] * p.ndim
    shape[axis] = len(at)
    return sum(np.take(p, at[:, k], axis=axis) * w[:, k].reshape(shape) for k in range(at.shape[1]))


def nearest(n: int, m: int, first: int, last: int) -> np.ndarray:
    """The source pixels that the pixels from ``first`` up to ``last`` lie in."""
    return np.minimum((np.arange(first, last) * (n / m)).astype(int), n - 1)


def jitter_one(r: dict, th: int, tw: int, least: int) -> dict:
    """A sample resized to ``nh`` by ``nw`` (mirrored before, if asked), of which the crop at ``top``, ``left`` fills a canvas."""
    h, w, nh, nw, top, left = (r[k] for k in ("h", "w", "nh", "nw", "top", "left"))
    ch, cw = min(th, nh), min(tw, nw)
    ny, nx = nearest(h, nh, top, top + ch), nearest(w, nw, left, left + cw)
    flip = (lambda p: p[..., ::-1]) if r["hflip"] else (lambda p: p)
    fill = prep.CROP_FILL | {"depth": 0, "normals": 0, "depth_ok": 0}

    def put(p: np.ndarray, name: str) -> np.ndarray:
        out = np.full((*p.shape[:-2], th, tw), fill[name], p.dtype)
        out[..., :ch, :cw] = p
        return out

    some = lambda p: flip(p).take(ny, axis=-2).take(nx, axis=-1)
    out: dict = dict.fromkeys((*LAYERS, *BITS))
    for name in LAYERS:
        if r.get(name) is not None:
            p = plane(r[name], name, h, w)
            if name == "image":
                p = smooth(flip(p).astype(float), -1, *weights(w, nw, left, left + cw))
                # Halves go up, also those that the sums of weights miss by a hair.
                p = np.floor(np.clip(smooth(p, -2, *weights(h, nh, top, top + ch)), 0, 255) + HALF).astype(np.uint8)
            else:
                p = some(p)
                if name == "normals" and r["hflip"]:
                    p = p.copy()
                    p[0] = -p[0]
            out[name] = put(p, name)
    for name in BITS:
        if r.get(name) is not None:
            out[name] = put(some(unpacked(r[name], h, w)), name)
    every = []
    for i in r["instances"] or []:
        m = put(some(unpacked(i["mask"], h, w)), "instance")
        if m.sum() >= max(least, 1):
            ys, xs = np.flatnonzero(m.any(1)), np.flatnonzero(m.any(0))
            every.append({"slot": i["slot"], "label": i["label"], "instance_id": i["instance_id"], "x1": int(xs[0]), "y1": int(ys[0]), "x2": int(xs[-1]), "y2": int(ys[-1]), "area": int(m.sum()), "mask": packed(m)})
    return {"sample_id": r["sample_id"], "h": th, "w": tw, **flat(out), "instances": every}


def jittered(rows: DataFrame, size: tuple[int, int], low: float = 0.1, high: float = 2.0, hflip: float = 0.0, least: int = 10, seed: int = 0, load: Callable[[dict], dict] | None = None) -> DataFrame:
    """:data:`OUT` of samples (``sample_id, h, w``, layers, instances): scale and crop drawn by :func:`prep.large_scale_jitter`.

    Canvases become ``size`` (height, width); what the crop doesn't fill is filled by layer; instances of fewer than ``least``
    pixels go. Layers may be absent; padding, where there is none, is made. ``load`` fills in layers where they are resampled.
    """
    th, tw = size
    plan = prep.large_scale_jitter(rows, size, low, high, seed).withColumn("hflip", flipped(hflip, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                (r,) = b.slice(i, 1).to_pylist()
                r = load(r) | {k: r[k] for k in ("nh", "nw", "top", "left", "hflip")} if load else r
                if r.get("padding") is None:
                    r = r | {"padding": packed(np.zeros((r["h"], r["w"]), bool))}
                yield pa.RecordBatch.from_pylist([jitter_one(r, th, tw, least)], schema=OUT_ARROW)

    return plan.mapInArrow(run, OUT)


def flipped(probability: float, seed: int = 0) -> Column:
    return rng.uniform(f"mirror{seed}", "sample_id") < F.lit(probability)
