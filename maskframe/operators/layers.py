"""The pixels of a whole paste: every label layer of a target and its source, whole images in numpy, one group a batch.

Pairing, placing, gates and ranks are relations; so are dropping and merging afterwards. Here only pixels move. A batch is one group
because sources are members of their target's batch: each image travels once. Layers are binary columns, absent ones null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import harmonize

#: Layer to (type, channels); what ends in ``_ok`` and padding are packed bits. Scanlines follow each other, channels outermost.
LAYERS = {"image": ("u1", 3), "semantic": ("<i2", 1), "panoptic": ("<i4", 1), "depth": ("<f4", 1), "normals": ("<f4", 3)}
BITS = ("depth_ok", "padding")
PLANES = ", ".join(f"{n} binary" for n in (*LAYERS, *BITS))
INSTANCE = "struct<slot:long,label:long,instance_id:long,mask:binary>"
#: A sample with its layers and instances; targets also have their placement: source, where it goes, and the slots to paste.
ROWS = f"batch_id long, sample_id long, h int, w int, {PLANES}, instances array<{INSTANCE}>, src_id long, scale double, hflip boolean, ty double, tx double, wv int, pasted array<long>, harmonized boolean, target boolean"
OUT = f"sample_id long, h int, w int, {PLANES}, paste binary, instances array<struct<slot:long,label:long,instance_id:long,pasted:boolean,before:long,after:long,mask:binary>>, totals map<string,double>"


_INST = [("slot", pa.int64()), ("label", pa.int64()), ("instance_id", pa.int64()), ("pasted", pa.bool_()), ("before", pa.int64()), ("after", pa.int64()), ("mask", pa.binary())]
OUT_ARROW = pa.schema([("sample_id", pa.int64()), ("h", pa.int32()), ("w", pa.int32()), *((n, pa.binary()) for n in (*LAYERS, *BITS, "paste")), ("instances", pa.list_(pa.struct(_INST))), ("totals", pa.map_(pa.string(), pa.float64()))])


def plane(raw: bytes, name: str, h: int, w: int) -> np.ndarray:
    """A layer's values; real ones are floats or doubles, whichever their bytes are."""
    kind, ch = LAYERS[name]
    return np.frombuffer(raw, "<f8" if kind == "<f4" and len(raw) == 8 * ch * h * w else kind).reshape(ch, h, w)


def unpacked(raw: bytes, h: int, w: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=h * w).reshape(h, w).view(bool)


def packed(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def disagreements(rows: DataFrame) -> DataFrame:
    """(sample_id, rule): targets whose source has another size, or lacks a layer that the target has. ``rows`` as for :func:`pasted`."""
    from ..model import violations

    names = [n for n in (*LAYERS, *BITS) if n in rows.columns]
    src = rows.select("batch_id", F.col("sample_id").alias("src_id"), F.struct("h", "w", *[F.col(n).isNotNull().alias(n) for n in names]).alias("s"))
    j = rows.where("target and src_id is not null").join(src, ["batch_id", "src_id"], "left")
    rules = {"source_in_batch": F.col("s").isNotNull(), "one_size": (F.col("h") == F.col("s.h")) & (F.col("w") == F.col("s.w"))}
    return violations(j, rules | {f"source_has_{n}": F.col(n).isNull() | F.col(f"s.{n}") for n in names}, "sample_id")


class Map:
    """The inverse map of one placement onto a window of the canvas: source rows and columns of the target's, which are separable.

    ``rows`` and ``cols`` are the window (the whole canvas by default), ``origin`` the source pixel that the planes given to
    :meth:`nearest` and :meth:`bilinear` start with. A window's values are those of the same pixels of the whole canvas.
    """

    def __init__(self, r: dict, h: int, w: int, sh: int, sw: int, rows: slice | None = None, cols: slice | None = None, origin: tuple[int, int] = (0, 0)):
        rows, cols = rows or slice(0, h), cols or slice(0, w)
        self.y, x = (np.arange(rows.start, rows.stop) - r["ty"]) / r["scale"], (np.arange(cols.start, cols.stop) - r["tx"]) / r["scale"]
        self.x = r["wv"] - 1 - x if r["hflip"] else x
        self.shape, self.flip, self.origin = (sh, sw), r["hflip"], origin
        ny, nx = np.rint(self.y).astype(int), np.rint(self.x).astype(int)
        inside = [np.flatnonzero((i >= 0) & (i < n)) for i, n in ((ny, sh), (nx, sw))]
        # Both are stretches, since the map is monotone.
        self.ys, self.xs = (slice(i[0], i[-1] + 1) if len(i) else slice(0, 0) for i in inside)
        self.ny, self.nx, self.size = ny[self.ys], nx[self.xs], (len(ny), len(nx))

    def needs(self) -> tuple[slice, slice] | None:
        """Source rows and columns that the window's values are made of, the neighbours that bilinear taps reach included."""
        out = []
        for at, n in ((self.y, self.shape[0]), (self.x, self.shape[1])):
            low, high = max(0, int(np.floor(at.min()))), min(n, int(np.floor(at.max())) + 2)
            if low >= high:
                return None
            out.append(slice(low, high))
        return out[0], out[1]

    def nearest(self, src: np.ndarray) -> np.ndarray:
        """Zero outside the source."""
        out = np.zeros((*src.shape[:-2], *self.size), src.dtype)
        out[..., self.ys, self.xs] = src.take(self.ny - self.origin[0], axis=-2, mode="clip").take(self.nx - self.origin[1], axis=-1, mode="clip")
        return out

    def bilinear(self, src: np.ndarray, ys: slice = slice(None), xs: slice = slice(None)) -> np.ndarray:
        """Four taps, each zero outside the source, for a stretch of the target's rows and columns.

        Each tap is weighed by the product of its two weights, row by row: another order of rounding would tell depths that are equal
        from each other.
        """
        at_y, at_x = self.y[ys], self.x[xs]
        if not len(at_y) or not len(at_x):
            return np.zeros((*src.shape[:-2], len(at_y), len(at_x)))

        def taps(at: np.ndarray, n: int, first: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            low = np.floor(at).astype(int)
            f = at - low
            return [(tap - first, weight, (tap >= 0) & (tap < n)) for tap, weight in ((low, 1 - f), (low + 1, f))]

        total = None
        for row, wy, in_y in taps(at_y, self.shape[0], self.origin[0]):
            lines = np.take(src, row, axis=-2, mode="clip")
            for col, wx, in_x in taps(at_x, self.shape[1], self.origin[1]):
                weight = np.where(in_y, wy, 0.0)[:, None] * np.where(in_x, wx, 0.0)
                part = np.take(lines, col, axis=-1, mode="clip") * weight
                if total is None:
                    total = part
                else:
                    total += part
        return total


def reinhard(src: np.ndarray, tgt: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Source with the statistics of the target outside the mask, in the published colour space."""
    to, back = np.array(harmonize.RGB_LMS), np.linalg.inv(np.array(harmonize.RGB_LMS))
    lab, scale = np.array(harmonize.LMS_LAB), np.array(harmonize.LAB_SCALE)[:, None, None]
    turn = lambda m, x: np.einsum("ij,jhw->ihw", m, x)
    s, t = (turn(lab, np.log10(np.maximum(turn(to, x), harmonize.LEAST))) * scale for x in (src, tgt))

    def moments(x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = max(m.sum(), 1)
        mean = (x * m).sum((1, 2)) / n
        return mean[:, None, None], np.sqrt(np.maximum((x * x * m).sum((1, 2)) / n - mean**2, harmonize.FLOOR))[:, None, None]

    (ms, ds), (mt, dt) = moments(s, mask), moments(t, ~mask)
    out = ((s - ms) * (dt / ds) + mt) * scale
    return np.clip(turn(back, 10 ** turn(lab.T, out)), 0, 1)


def blended(mode: str, src: np.ndarray, tgt: np.ndarray, mask: np.ndarray, levels: int = 5) -> np.ndarray:
    if mode == "reinhard":
        return reinhard(src, tgt, mask)
    if mode == "poisson":
        return np.stack([harmonize.poisson(s, t, mask) for s, t in zip(src, tgt)])
    return np.stack([harmonize.multiband(s, t, mask, levels) for s, t in zip(src, tgt)])


def paste_one(t: dict, s: dict, stuff: frozenset[int], tau: float | None, mode: str, audit: bool = False, levels: int = 5) -> dict:
    """A target after its source was pasted: layers, the effective union of the pastes, and both sides' instances with their areas."""
    h, w, sh, sw = t["h"], t["w"], s["h"], s["w"]
    m = Map(t, h, w, sh, sw)
    warped = warped_masks(t, s, m)
    union = np.zeros((h, w), bool)
    for x in warped.values():
        union |= x
    both = lambda name: t[name] is not None and s[name] is not None
    image = None
    if both("image") and t["harmonized"] and union.any():
        # A blend needs all of its source.
        src, tgt = m.bilinear(plane(s["image"], "image", sh, sw)) / 255, plane(t["image"], "image", h, w) / 255
        image = blended(mode, src, tgt, union, levels)
    out, inside = composed(t, s, m, union, image)
    masks = {i["slot"]: unpacked(i["mask"], h, w) for i in t["instances"] or []}
    if tau is not None and both("semantic"):
        before, after = plane(t["semantic"], "semantic", h, w)[0], out["semantic"][0]
        old, new = (np.bincount(x.ravel(), minlength=256) for x in (before, after))
        gone = [c for c in np.flatnonzero(old) if c in stuff and new[c] < tau * old[c]]
        back = np.isin(before, gone) & union
        if back.any():  # what collapsed is given back where it was pasted over; depth and normals are not
            for name in ("image", "semantic", "panoptic"):
                if both(name):
                    out[name] = np.where(back, plane(t[name], name, h, w), out[name])
            inside &= ~back
            warped = {k: x & ~back for k, x in warped.items()}
    one = lambda i, pasted, mask, before: {"slot": i["slot"], "label": i["label"], "instance_id": i["instance_id"], "pasted": pasted, "before": int(before), "after": int(np.count_nonzero(mask)), "mask": packed(mask)}
    # What the depth test keeps back leaves the target's masks whole.
    every = [one(i, False, masks[i["slot"]] & ~inside, np.count_nonzero(masks[i["slot"]])) for i in t["instances"] or []]
    every += [one(i, True, warped[i["slot"]], np.count_nonzero(warped[i["slot"]])) for i in s["instances"] or [] if i["slot"] in warped and warped[i["slot"]].any()]
    row = {"sample_id": t["sample_id"], "h": h, "w": w, **flat(out), "paste": packed(inside), "instances": every}
    if audit:
        known = {}
        if both("depth"):
            known = {"depth": m.bilinear(plane(s["depth"], "depth", sh, sw)).tobytes(), "depth_ok": packed(m.nearest(unpacked(s["depth_ok"], sh, sw)))}
        row["audit"] = record(t, s["sample_id"], packed(union), [{"slot": k, "mask": packed(x)} for k, x in sorted(warped.items())], known)
    return row


def warped_masks(t: dict, s: dict, m: Map) -> dict[int, np.ndarray]:
    """Masks of the slots to paste, by slot, in the window of the map."""
    wanted, size = set(t["pasted"] or []), (s.get("window_h") or s["h"], s.get("window_w") or s["w"])
    return {i["slot"]: m.nearest(unpacked(i["mask"], *size)) for i in s["instances"] or [] if i["slot"] in wanted}


def composed(t: dict, s: dict, m: Map, union: np.ndarray, image: np.ndarray | None = None) -> tuple[dict, np.ndarray]:
    """(layers, effective mask) of a window: ``t`` has its planes, ``s`` those of the source's part that the map starts with;
    ``image`` is a source that was already warped and blended."""
    (h, w), (sh, sw) = union.shape, (s.get("window_h") or s["h"], s.get("window_w") or s["w"])
    both = lambda name: t[name] is not None and s[name] is not None
    # Only the rows and columns of the paste are sampled.
    some = lambda axis: (lambda i: slice(i[0], i[-1] + 1) if len(i) else slice(0, 0))(np.flatnonzero(union.any(axis)))
    ys, xs = some(1), some(0)

    def selected(name: str, src: np.ndarray) -> np.ndarray:
        new = plane(t[name], name, h, w).copy()
        part = new[:, ys, xs]
        np.copyto(part, src, where=inside[ys, xs])
        return new

    # The effective mask: nearer than the target or where its depth is unknown, never from padding.
    inside = union.copy()
    if both("depth"):
        depth, known = m.bilinear(plane(s["depth"], "depth", sh, sw), ys, xs), unpacked(t["depth_ok"], h, w)
        inside[ys, xs] &= (depth[0] < plane(t["depth"], "depth", h, w)[0, ys, xs]) | ~known[ys, xs]
    if s["padding"] is not None:
        inside &= m.nearest(~unpacked(s["padding"], sh, sw))
    out = {n: t[n] for n in (*LAYERS, *BITS)}
    if both("image"):
        src = m.bilinear(plane(s["image"], "image", sh, sw), ys, xs) / 255 if image is None else image[:, ys, xs]
        out["image"] = selected("image", np.rint(np.clip(src, 0, 1) * 255).astype(np.uint8))
    for name in ("semantic", "panoptic"):
        if both(name):
            out[name] = np.where(inside, m.nearest(plane(s[name], name, sh, sw)), plane(t[name], name, h, w))
    if both("normals"):
        n = m.bilinear(plane(s["normals"], "normals", sh, sw), ys, xs)
        if m.flip:
            n[0] = -n[0]
        out["normals"] = selected("normals", n)
    if both("depth"):
        out["depth"] = selected("depth", depth)
        out["depth_ok"] = np.where(union, m.nearest(unpacked(s["depth_ok"], sh, sw)) & known, known)
    return out, inside


def flat(out: dict) -> dict:
    """Layers as bytes."""
    return {n: x if x is None or isinstance(x, bytes) else packed(x) if n in BITS else np.ascontiguousarray(x, x.dtype if x.dtype.kind == "f" else LAYERS[n][0]).tobytes() for n, x in out.items()}


#: What was there before the composite, for whoever checks it: the target, its placement, the warped masks and depth of the source,
#: and the union of the masks before the depth test (``paste`` of the outcome is the one after it).
_BEFORE = [*((n, pa.binary()) for n in (*LAYERS, *BITS)), ("instances", pa.list_(pa.struct([("slot", pa.int64()), ("label", pa.int64()), ("instance_id", pa.int64()), ("mask", pa.binary())])))]
AUDIT_ARROW = pa.struct([("src_id", pa.int64()), ("scale", pa.float64()), ("hflip", pa.bool_()), ("ty", pa.float64()), ("tx", pa.float64()), ("harmonized", pa.bool_()), ("union", pa.binary()), ("warped", pa.list_(pa.struct([("slot", pa.int64()), ("mask", pa.binary())]))), ("depth", pa.binary()), ("depth_ok", pa.binary()), ("before", pa.struct(_BEFORE))])
AUDIT = f"struct<src_id:long,scale:double,hflip:boolean,ty:double,tx:double,harmonized:boolean,union:binary,warped:array<struct<slot:long,mask:binary>>,depth:binary,depth_ok:binary,before:struct<{','.join(f'{n}:binary' for n in (*LAYERS, *BITS))},instances:array<{INSTANCE}>>>"


def record(t: dict, src_id: int | None, union: bytes, warped: list[dict], known: dict) -> dict:
    before = {n: t[n] for n in (*LAYERS, *BITS)} | {"instances": [{k: i[k] for k in ("slot", "label", "instance_id", "mask")} for i in t["instances"] or []]}
    return {"src_id": src_id, **{k: t[k] for k in ("scale", "hflip", "ty", "tx", "harmonized")}, "union": union, "warped": warped, "depth": known.get("depth"), "depth_ok": known.get("depth_ok"), "before": before}


def alone(t: dict, audit: bool = False) -> dict:
    """A target without a source, as it was."""
    h, w = t["h"], t["w"]
    area = [int(np.count_nonzero(unpacked(i["mask"], h, w))) for i in t["instances"] or []]
    none = packed(np.zeros((h, w), bool))
    row = {"sample_id": t["sample_id"], "h": h, "w": w, **{n: t[n] for n in (*LAYERS, *BITS)}, "paste": none, "instances": [i | {"pasted": False, "before": a, "after": a} for i, a in zip(t["instances"] or [], area)]}
    return row | ({"audit": record(t, None, none, [], {})} if audit else {})


def pasted(rows: DataFrame, stuff: frozenset[int] = frozenset(), tau: float | None = None, mode: str = "multiband", load: Callable[[dict], dict] | None = None, keep: tuple[str, ...] = (*LAYERS, *BITS, "paste"), sums: bool = True, audit: bool = False, levels: int = 5, masks: bool = True) -> DataFrame:
    """:data:`OUT` for every target among :data:`ROWS`; rows that are no targets only serve as sources.

    ``load`` fills in a row's layers and masks where its batch is composed, so that pixels are never shuffled: rows then hold
    what it needs, a path or keys. Layers that aren't kept are composed but come out null, as do masks without ``masks`` (their areas
    stay); ``sums`` adds the layers' :func:`totals`. A
    row whose source is missing in its batch stays as it is. With ``audit``, rows also have what was there before (:data:`AUDIT`).
    """
    arrow = OUT_ARROW.append(pa.field("audit", AUDIT_ARROW)) if audit else OUT_ARROW

    def batch(t: pa.Table) -> pa.Table:
        every = t.to_pylist()
        if load is not None:
            every = [load(r) for r in every]
        by = {r["sample_id"]: r for r in every}
        out = [paste_one(r, by[r["src_id"]], stuff, tau, mode, audit, levels) if r["src_id"] in by else alone(r, audit) for r in every if r["target"]]
        for r in out:
            r["totals"] = totals(r) if sums else None
            r.update(dict.fromkeys(n for n in (*LAYERS, *BITS, "paste") if n not in keep))
            if not masks:
                r["instances"] = [i | {"mask": None} for i in r["instances"]]
        return pa.Table.from_pylist(out, schema=arrow)

    if load is not None:
        # Rows of keys are few bytes, but their batches are much work: many small tasks, not as few as the bytes ask for.
        rows = rows.repartition(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "batch_id")
    return rows.groupBy("batch_id").applyInArrow(batch, f"{OUT}, audit {AUDIT}" if audit else OUT)


def totals(r: dict) -> list[tuple[str, float]]:
    """Sums of each layer's values, weighted by place: to compare outcomes by."""
    h, w = r["h"], r["w"]
    weight = (1 + (np.arange(h)[:, None] * 3 + np.arange(w)[None, :]) % 7).astype(float)
    out = []
    for name in (*LAYERS, *BITS, "paste"):
        if r[name] is not None:
            x = plane(r[name], name, h, w) if name in LAYERS else unpacked(r[name], h, w)[None]
            out.append((name, math.fsum(float(np.einsum("ij,ij->", c, weight)) * (k + 1) for k, c in enumerate(x.astype(float, copy=False)))))
    return out


def padded(rows: DataFrame, p: int, ignore: int = 255) -> DataFrame:
    """Every canvas brought to multiples of ``p`` at the bottom and right, each layer with its own fill; the image reflects if it can."""
    if p <= 0:
        raise ValueError("the multiple must be positive")
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [grown(r, p, ignore) for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist(out, schema=b.schema)

    return rows.select(*names).mapInArrow(run, rows.schema)


def grown(r: dict, p: int, ignore: int) -> dict:
    h, w = r["h"], r["w"]
    more = ((0, -h % p), (0, -w % p))
    if not any(b for _, b in more) and r.get("padding") is not None:
        return r
    out = dict(r, h=h + more[0][1], w=w + more[1][1])
    fills = {"semantic": ignore, "panoptic": ignore, "depth": 0, "normals": 0}
    for name in LAYERS:
        if r.get(name) is not None:
            x = plane(r[name], name, h, w)
            reflect = name == "image" and more[0][1] < h and more[1][1] < w
            out[name] = (np.pad(x, ((0, 0), *more), mode="reflect") if reflect else np.pad(x, ((0, 0), *more), constant_values=fills.get(name, 0))).tobytes()
    if r.get("depth_ok") is not None:
        out["depth_ok"] = packed(np.pad(unpacked(r["depth_ok"], h, w), more))
    pad = unpacked(r["padding"], h, w) if r.get("padding") is not None else np.zeros((h, w), bool)
    out["padding"] = packed(np.pad(pad, more, constant_values=True))
    out["instances"] = [i | {"mask": packed(np.pad(unpacked(i["mask"], h, w), more))} for i in r["instances"] or []]
    return out


def merged(out: DataFrame, slots: int, residual: float = 0.0) -> DataFrame:
    """``out`` with its instances after dropping and merging, as one expression a row: a target stays if ``residual`` of its area is
    left; the n-th paste takes the n-th slot that is free then, surplus pastes go."""
    old = F.filter("instances", lambda i: ~i["pasted"] & ((F.lit(residual) <= 0) | (i["after"] >= F.lit(residual) * i["before"])))
    new = F.array_sort(F.filter("instances", lambda i: i["pasted"]), lambda a, b: F.when(a["slot"] < b["slot"], -1).otherwise(1))
    free = F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long")), F.transform(F.col("_old"), lambda i: i["slot"]))
    one = lambda i, slot: F.struct(slot.alias("slot"), i["label"].alias("label"), i["instance_id"].alias("instance_id"), i["pasted"].alias("pasted"), i["before"].alias("before"), i["after"].alias("after"), i["mask"].alias("mask"))
    put = F.transform(F.slice(F.col("_new"), 1, F.size("_free")), lambda i, n: one(i, F.get(F.col("_free"), n)))
    some = out.withColumn("_old", old).withColumn("_new", new).withColumn("_free", free)
    return some.withColumn("instances", F.concat("_old", put)).drop("_old", "_new", "_free")


def mask_words(instances: DataFrame) -> DataFrame:
    """(sample_id, slot, label, instance_id, y, k, bits) of merged samples: packed masks as scanline words, natively.

    Pixels are packed most significant bit first, scanline after scanline; canvases whose width is a multiple of eight.
    """
    from .. import bits

    i = instances.select("sample_id", "h", "w", F.explode("instances").alias("i")).select("sample_id", "h", "w", "i.*")
    line = i.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("w") / bits.WORD).cast("int") - 1)))
    step = bits.WORD // 8
    first = F.col("y") * F.col("w") / 8 + F.col("k") * step
    size = F.least(F.lit(step), F.col("w") / 8 - F.col("k") * step).cast("int")
    flipped = F.reverse(F.lpad(F.conv(F.hex(F.substring(F.col("mask"), first.cast("int") + 1, size)), 16, 2), size * 8, "0"))
    return line.withColumn("bits", F.conv(flipped, 2, 10).cast("long")).where("bits <> 0").select("sample_id", "slot", "label", "instance_id", "y", "k", "bits")


def bit_sums(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with each of the packed masks as the number of its pixels."""
    schema = ", ".join(f"`{f.name}` {'long' if f.name in columns else f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count = lambda c: pa.array([None if v is None else int(np.unpackbits(np.frombuffer(v, np.uint8)).sum()) for v in c.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([count(c) if n in columns else c for n, c in zip(b.schema.names, b.columns)], names=b.schema.names)

    return df.mapInArrow(run, schema)


def digests(out: DataFrame) -> DataFrame:
    """(sample_id, layer, total) of :func:`totals`."""
    return out.select("sample_id", F.explode("totals")).select("sample_id", F.col("key").alias("layer"), F.col("value").alias("total"))
