"""Run-length and polygon masks as scanlines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import bits


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all values of an array column one after another, where each row's end)."""
    ends = np.cumsum(np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), ends


def listed(values: np.ndarray, ends: np.ndarray, valid: pa.Array) -> pa.Array:
    """The inverse of :func:`lists`; rows that aren't valid are null."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(values, pa.int64()), mask=pc.invert(valid))


def by_batches(df: DataFrame, column: str, kind: str, make: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """``df`` with one column made anew, a batch at a time; the others travel as they are."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([make(c) if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    schema = ", ".join(f"`{f.name}` {kind if f.name == column else f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, schema)


def mask_words(column: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, k, bits) of a mask's scanline words that have pixels."""
    h, w = column.shape
    n = bits.n_words(w)
    wide = np.zeros((h, n * bits.WORD), bool)
    wide[:, :w] = column
    value = np.zeros((h, n, 8), np.uint8)
    value[..., : bits.WORD // 8] = np.packbits(wide.reshape(h, n, bits.WORD), axis=-1, bitorder="little")
    value = value.view("<i8")[..., 0]
    y, k = np.nonzero(value)
    return y, k, value[y, k]


def words_of(counts: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, k, bits) of a mask's column-major counts, those with pixels. Only columns between the first and the last pixel are drawn."""
    none = np.zeros(0, np.int64)
    if len(counts) and counts.min() < 0:
        raise ValueError("a count is negative")
    stop = np.cumsum(counts)
    start, stop = (stop - counts)[1::2], stop[1::2]
    start, stop = start[stop > start], stop[stop > start]
    if not len(start):
        return none, none, none
    k0, k1 = int(start[0]) // h // bits.WORD, (int(stop[-1]) - 1) // h // bits.WORD + 1
    first, cells = k0 * bits.WORD * h, (k1 - k0) * bits.WORD * h
    edge = np.zeros(cells + 1, np.int8)
    edge[start - first] += 1
    edge[stop - first] -= 1
    y, k, word = mask_words(np.cumsum(edge[:-1], dtype=np.int8).reshape(-1, h).T.astype(bool))
    return y, k + k0, word


def decode(df: DataFrame, h: str = "h", counts: str = "counts") -> DataFrame:
    """(keys, y, k, bits): scanline words of uncompressed column-major counts, which begin with clear pixels; masks without pixels give none."""
    keys = [c for c in df.columns if c != counts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, ends = lists(b.column(counts))
            parts = [words_of(values[i:j], n) for i, j, n in zip([0, *ends], ends, b.column(h).to_pylist())]
            at = pa.array(np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts]))
            y, k, word = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in keys), pa.array(y, pa.int32()), pa.array(k, pa.int32()), pa.array(word, pa.int64())], names=[*keys, "y", "k", "bits"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != counts)
    return df.select(*keys, counts).mapInArrow(run, f"{schema}, y int, k int, bits long")


def uncompressed(df: DataFrame, text: str = "counts") -> DataFrame:
    """``df`` with its compressed string as an array of counts; whole batches at once, see :func:`uncompress` for one string."""

    def make(column: pa.Array) -> pa.Array:
        some = pc.fill_null(column, "").cast(pa.large_binary())
        size = pc.binary_length(some).to_numpy().astype(np.int64)
        c = np.frombuffer(b"".join(some.to_pylist()), np.uint8).astype(np.int64) - 48
        # Groups of five bits, the last of a number without the sixth; its fifth bit is the sign.
        last = np.flatnonzero(c & 32 == 0)
        first = np.r_[0, last[:-1] + 1]
        if len(c) and (c.min() < 0 or c.max() > 63 or (last[-1] if len(last) else -1) != len(c) - 1):
            raise ValueError("no compressed counts")
        place = np.arange(len(c)) - np.repeat(first, last - first + 1)
        value = np.add.reduceat((c & 31) << (5 * place), first) if len(last) else np.zeros(0, np.int64)
        value -= np.where(c[last] & 16 != 0, np.int64(1) << (5 * (last - first + 1)), 0)
        # From the fourth number on each is the difference to the one before the last: sums along every other number of a row.
        row = np.repeat(np.arange(len(size)), size)[last]
        ends = np.searchsorted(row, np.arange(len(size)), "right")
        n = np.arange(len(row)) - np.repeat(np.r_[0, ends[:-1]], np.diff(np.r_[0, ends]))
        order = np.lexsort((n, n % 2, row))
        restart = (n < 3)[order]
        total = np.cumsum(value[order])
        base = (total - value[order])[restart]
        out = np.empty_like(value)
        out[order] = total - np.repeat(base, np.diff(np.r_[np.flatnonzero(restart), len(n)]))
        return listed(out, ends, column.is_valid())

    return by_batches(df, text, "array<long>", make)


def compressed(df: DataFrame, counts: str = "counts") -> DataFrame:
    """``df`` with its counts as a compressed string: the fourth and later as differences, in groups of five bits from character 48 on."""

    def make(column: pa.Array) -> pa.Array:
        value, ends = lists(column)
        n = np.arange(len(value)) - np.repeat(np.r_[0, ends[:-1]], np.diff(np.r_[0, ends]))
        x = value.copy()
        late = np.flatnonzero(n > 2)
        x[late] -= value[late - 2]
        # How many groups each takes: until only the sign is left, which the last group must show.
        groups, rest = np.zeros(len(x), np.int64), x.copy()
        todo = np.ones(len(x), bool)
        while todo.any():
            groups[todo] += 1
            sign = rest & 16 != 0
            rest >>= 5
            todo &= rest != np.where(sign, -1, 0)
        upto = np.cumsum(groups)
        place = np.arange(upto[-1] if len(x) else 0) - np.repeat(upto - groups, groups)
        c = (np.repeat(x, groups) >> (5 * place) & 31) + np.where(place < np.repeat(groups, groups) - 1, 32, 0) + 48
        at = np.r_[0, upto][np.r_[0, ends]]
        whole = pa.Array.from_buffers(pa.string(), len(ends), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(c.astype(np.uint8))])
        return pc.if_else(column.is_valid(), whole, None)

    return by_batches(df, counts, "string", make)


def areas(df: DataFrame, counts: str = "counts") -> DataFrame:
    """Adds ``area``: the sum of every other count; no scanlines are needed for it."""
    return df.withColumn("area", F.aggregate(F.transform(counts, lambda v, i: F.when(i % 2 == 1, v).otherwise(0)), F.lit(0).cast("long"), lambda a, b: a + b))


def uncompress(text: str) -> list[int]:
    """Counts of a compressed string: groups of five bits from the character 48 on, the third and later as differences."""
    out: list[int] = []
    value, shift = 0, 0
    for ch in text:
        c = ord(ch) - 48
        value |= (c & 0x1F) << shift
        shift += 5
        if not c & 0x20:
            if c & 0x10:
                value -= 1 << shift
            if len(out) > 2:
                value += out[-2]
            out.append(value)
            value, shift = 0, 0
    return out


def fill(points: list[float], h: int, w: int) -> np.ndarray:
    """A polygon's pixels: those whose centre lies inside by the even-odd rule."""
    xy = np.asarray(points, float).reshape(-1, 2)
    x1, y1 = xy.T
    x2, y2 = np.roll(xy, -1, axis=0).T
    out = np.zeros((h, w), bool)
    if len(xy) < 3:
        return out
    # Where the edges cross each row's middle; a crossing turns all pixels whose centres lie behind it.
    lines = np.arange(h)[:, None] + 0.5
    y, e = np.nonzero((y1 <= lines) != (y2 <= lines))
    at = x1[e] + (y + 0.5 - y1[e]) * (x2[e] - x1[e]) / (y2[e] - y1[e])
    turns = np.zeros((h, w + 1), np.int64)
    np.add.at(turns, (y, np.clip(np.floor(at + 0.5), 0, w).astype(int)), 1)
    out[:] = np.cumsum(turns[:, :w], axis=1) % 2
    return out


def mask_of(seg: dict | list, h: int, w: int) -> np.ndarray:
    """The mask of a segmentation: compressed or plain counts, or polygons, merged; anything else is an error."""
    if isinstance(seg, list):
        return np.logical_or.reduce([fill(p, h, w) for p in seg]) if seg else np.zeros((h, w), bool)
    if isinstance(seg, dict) and "counts" in seg:
        counts = uncompress(seg["counts"]) if isinstance(seg["counts"], str) else list(seg["counts"])
        hh, ww = seg.get("size", (h, w))
        flat = np.repeat(np.arange(len(counts)) % 2 == 1, counts)
        if len(flat) != hh * ww:
            raise ValueError("counts don't add up to the size")
        return flat.reshape(ww, hh).T
    raise ValueError(f"no segmentation: {type(seg).__name__}")


def polygons(df: DataFrame) -> DataFrame:
    """(id, y, k, bits) of ``id, h, w, polygons`` (arrays of flat coordinates), by batches of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            parts = [mask_words(mask_of(r["polygons"] or [], r["h"], r["w"])) for r in rows]
            ids = np.repeat(np.array([r["id"] for r in rows], np.int64), [len(p[0]) for p in parts])
            y, k, word = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(y, pa.int32()), pa.array(k, pa.int32()), pa.array(word, pa.int64())], names=["id", "y", "k", "bits"])

    return df.select("id", "h", "w", "polygons").mapInArrow(run, "id long, y int, k int, bits long")


def segment_id(r, g, b):
    """The id that a panoptic image's colour stands for."""
    return r + F.lit(256) * g + F.lit(65536) * b
