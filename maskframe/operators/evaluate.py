"""All invariants of a sample in one pass: each outcome is read once, with its audit, and gives a report for every check that applies.

The relational checks of :mod:`.checks` look at one relation each and suit relations that are there anyway; whole samples carry all
layers in a row, so that here nothing is joined. Both give the same verdicts (tests compare them).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import layers
from .checks import GATES
from .layers import BITS, LAYERS, packed, plane, unpacked

REPORTS = "sample_id long, name string, ok boolean, n_bad long"


@dataclass(frozen=True)
class Rules:
    """Thresholds and taxonomy that the outcomes were made under; without things, panoptic checks that need a taxonomy are left out."""

    residual: float = 0.0
    tau_stuff: float | None = None
    things: frozenset[int] | None = None
    stuff: frozenset[int] = frozenset()
    ignore: int = 255
    atol: float = 1e-5


class Sample:
    """One outcome with what was there before, as arrays."""

    def __init__(self, r: dict):
        self.h, self.w, self.audit = r["h"], r["w"], r.get("audit")
        self.after, self.before = r, (self.audit or {}).get("before") or {}
        self.masks = [(i, unpacked(i["mask"], self.h, self.w)) for i in r["instances"] or []]
        self.old = [(i, unpacked(i["mask"], self.h, self.w)) for i in self.before.get("instances") or []]
        self.paste = unpacked(r["paste"], self.h, self.w)

    def layer(self, side: dict, name: str) -> np.ndarray:
        return plane(side[name], name, self.h, self.w)

    def flags(self, raw: bytes) -> np.ndarray:
        return unpacked(raw, self.h, self.w)

    def active(self) -> set[str]:
        """Layers that both sides have; instances always are."""
        return {n for n in LAYERS if self.after[n] is not None and self.before.get(n) is not None} | {"instance"}


def box(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    ys, xs = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    return (xs[0], ys[0], xs[-1], ys[-1]) if len(ys) else None


def single_class(s: Sample, rules: Rules) -> int:
    return int(len(s.after["semantic"]) != s.h * s.w * np.dtype(LAYERS["semantic"][0]).itemsize)


def ignore_kept(s: Sample, rules: Rules) -> int:
    return int(((s.layer(s.before, "semantic") == rules.ignore) & (s.layer(s.after, "semantic") != rules.ignore)).sum())


def no_overlap(s: Sample, rules: Rules) -> int:
    """Lines on which masks of a class overlap."""
    total: dict[int, np.ndarray] = {}
    for i, m in s.masks:
        total[i["label"]] = total.get(i["label"], 0) + m.astype(np.int32)
    return sum(int((t > 1).any(1).sum()) for t in total.values())


def identity(s: Sample, rules: Rules) -> int:
    """Masks that lie within masks from before, none of which has their label."""
    bad, old = 0, [(i["label"], np.packbits(m)) for i, m in s.old if m.any()]
    for i, m in s.masks:
        p = np.packbits(m)
        within = {label for label, o in old if not (p & ~o).any()} if m.any() else set()
        bad += bool(within) and i["label"] not in within
    return bad


def boxes_fit(s: Sample, rules: Rules) -> int:
    """Targets whose boxes, which pasting leaves as they were, are no longer those of their masks, to a pixel; pastes bring new boxes."""
    carried = {i["slot"]: box(m) for i, m in s.old}
    bad = 0
    for i, m in s.masks:
        now, then = box(m), None if i["pasted"] else carried.get(i["slot"])
        if now is not None and then is not None:
            bad += any(abs(int(a) - int(b)) > 1 + 1e-5 * abs(int(a)) for a, b in zip(now, then))
    return bad


def subtracts_union(s: Sample, rules: Rules) -> int:
    return sum(bool((m & s.paste).any() and (m & ~s.paste).any()) for _, m in s.masks)


def small(s: Sample, rules: Rules) -> int | None:
    """Masks below the share that has to be left of the smallest one there was."""
    if not s.old:
        return None
    tau = int(rules.residual * float(min(m.sum() for _, m in s.old)))
    return sum(bool(m.sum() < tau) for _, m in s.masks)


def bijection(s: Sample, rules: Rules) -> int:
    """Pixels with an instance that lie in no mask or in several."""
    if not s.masks:
        return 0
    covered = np.sum([m for _, m in s.masks], axis=0)
    return int(((s.layer(s.after, "panoptic")[0] != 0) & (covered != 1)).sum())


def fresh_ids(s: Sample, rules: Rules) -> int:
    old, new = (np.unique(s.layer(side, "panoptic")) for side in (s.before, s.after))
    return int((np.setdiff1d(new[new != 0], old) <= old.max(initial=0)).sum())


def thing_stuff(s: Sample, rules: Rules) -> int | None:
    if rules.things is None:
        return None
    sem, pan = s.layer(s.after, "semantic"), s.layer(s.after, "panoptic")
    return int(((sem != rules.ignore) & (np.isin(sem, list(rules.things)) == (pan == 0))).sum())


def stuff_area(s: Sample, rules: Rules) -> int | None:
    """Background classes that vanished from above the threshold, or live on with no more than it."""
    if rules.tau_stuff is None or rules.things is None:
        return None
    tau, bad = int(rules.tau_stuff * s.h * s.w), 0
    old, new = (np.bincount(s.layer(side, "semantic").ravel(), minlength=512) for side in (s.before, s.after))
    for c in rules.stuff:
        bad += bool(old[c] and (new[c] == 0 and old[c] > tau or 0 < new[c] <= tau))
    return bad


def depth_monotone(s: Sample, rules: Rules) -> int | None:
    if s.audit["depth"] is None:
        return None
    src = np.frombuffer(s.audit["depth"], "<f8").reshape(1, s.h, s.w)
    old, new = s.layer(s.before, "depth"), s.layer(s.after, "depth")
    return int(((new != np.minimum(src.astype(old.dtype), old)) & s.paste).sum())


def depth_join(s: Sample, rules: Rules) -> int | None:
    if s.audit["depth_ok"] is None:
        return None
    src, old, new = (s.flags(x) for x in (s.audit["depth_ok"], s.before["depth_ok"], s.after["depth_ok"]))
    return int((new != np.where(s.paste, src & old, old)).sum())


def camera_frame(s: Sample, rules: Rules) -> int:
    return int(len(s.after["normals"]) not in (12 * s.h * s.w, 24 * s.h * s.w))


def unit_normals(s: Sample, rules: Rules) -> int | None:
    if camera_frame(s, rules):
        return None
    n = s.layer(s.after, "normals")
    ok = s.flags(s.after["depth_ok"]) if s.after["depth_ok"] is not None else np.ones((s.h, s.w), bool)
    # Floats are as near to one as floats can be.
    return int((ok & (np.abs(np.sqrt((n * n).sum(0)) - 1) > rules.atol)).sum())


#: The checks by name; which of them apply is said by :data:`checks.GATES`. None: it has nothing to look at.
CHECKS = {
    "semantic.single_class_per_pixel": single_class,
    "semantic.ignore_preserved": ignore_kept,
    "instance.no_same_class_overlap": no_overlap,
    "instance.identity_preserved": identity,
    "instance.bbox_recomputed_from_mask": boxes_fit,
    "instance.target_masks_subtract_paste_union": subtracts_union,
    "instance.small_area_dropped": small,
    "panoptic.pixel_bijection": bijection,
    "panoptic.fresh_instance_ids": fresh_ids,
    "panoptic.thing_stuff_consistent": thing_stuff,
    "panoptic.stuff_area_threshold": stuff_area,
    "depth.monotonicity": depth_monotone,
    "depth.validity_join": depth_join,
    "normals.camera_frame_convention": camera_frame,
    "normals.unit_norm_on_valid": unit_normals,
}


def verdicts(r: dict, rules: Rules) -> Iterator[tuple[str, int]]:
    s = Sample(r)
    active = s.active()
    for name, check in CHECKS.items():
        needs, with_audit = GATES[name]
        if needs <= active and (s.audit is not None or not with_audit):
            n = check(s, rules)
            if n is not None:
                yield name, n


def evaluated(out: DataFrame, rules: Rules) -> DataFrame:
    """:data:`REPORTS` of outcomes with audits: rows of :func:`layers.pasted` or what :func:`layers.merged` makes of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                (r,) = b.slice(i, 1).to_pylist()
                yield reported(r["sample_id"], verdicts(r, rules))

    return out.select("sample_id", "h", "w", *LAYERS, *BITS, "paste", "instances", "audit").mapInArrow(run, REPORTS)


def reported(sample_id: int, found: Iterable[tuple[str, int]]) -> pa.RecordBatch:
    names, bad = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array([sample_id] * len(names), pa.int64()), pa.array(names), pa.array([n == 0 for n in bad]), pa.array(bad, pa.int64())], names=["sample_id", "name", "ok", "n_bad"])


def verdict(reports: DataFrame) -> DataFrame:
    """(sample_id, ok, failed): whether a sample passed everything, and the names of what it failed."""
    return reports.groupBy("sample_id").agg(F.bool_and("ok").alias("ok"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("name")))).alias("failed"))


# ---- faults: outcomes spoiled on purpose, each in the one way that one check looks for


class Spoiler:
    """Changes a copy of an outcome; every method returns whether it found a place for its fault."""

    def __init__(self, r: dict, rules: Rules, rng: np.random.Generator):
        self.s, self.rules, self.rng = Sample(r), rules, rng
        self.row = r | {"instances": [dict(i) for i in r["instances"] or []], "audit": r["audit"] | {"before": dict(r["audit"]["before"])}}
        s = self.s
        self.covered = np.sum([m for _, m in s.masks], axis=0) if s.masks else np.zeros((s.h, s.w), int)
        pan = s.layer(r, "panoptic")[0] if "panoptic" in s.active() else np.zeros((s.h, s.w), int)
        #: Pixels whose number of masks the bijection doesn't ask about, or that break it already.
        self.free = (pan == 0) | (self.covered != 1)
        self.least = int(rules.residual * float(min((m.sum() for _, m in s.old), default=0)))

    def one(self, where: np.ndarray) -> tuple[int, ...] | None:
        """A pixel that may be chosen."""
        at = np.argwhere(where)
        return tuple(at[self.rng.integers(len(at))].tolist()) if len(at) else None

    def any_of(self, items: list):
        return items[self.rng.integers(len(items))] if items else None

    def put(self, side: dict, name: str, where, value) -> None:
        new = self.s.layer(side, name).copy()
        new[where] = value
        side[name] = new.tobytes()

    def mask(self, n: int, mask: np.ndarray) -> None:
        self.row["instances"][n]["mask"] = packed(mask)

    def extra(self, label: int, mask: np.ndarray) -> None:
        slot = 1 + max((i["slot"] for i, _ in [*self.s.masks, *self.s.old]), default=0)
        self.row["instances"].append({"slot": slot, "label": label, "instance_id": slot, "pasted": True, "before": int(mask.sum()), "after": int(mask.sum()), "mask": packed(mask)})

    def same_label(self, label: int) -> np.ndarray:
        return np.any([m for i, m in self.s.masks if i["label"] == label] or [np.zeros((self.s.h, self.s.w), bool)], axis=0)

    def stuff_counts(self) -> tuple[np.ndarray, np.ndarray, int]:
        old, new = (np.bincount(self.s.layer(side, "semantic").ravel(), minlength=512) for side in (self.s.before, self.s.after))
        return old, new, int((self.rules.tau_stuff or 0) * self.s.h * self.s.w)

    def lost_ignore(self) -> bool:
        """A pixel that was ignored before, and isn't now."""
        sem = self.s.layer(self.s.before, "semantic")[0]
        old, _, tau = self.stuff_counts()
        at = self.one((sem != self.rules.ignore) & (old[sem] > tau + 1) & (self.s.layer(self.s.after, "semantic")[0] != self.rules.ignore))
        if at is not None:
            self.put(self.row["audit"]["before"], "semantic", (0, *at), self.rules.ignore)
        return at is not None

    def overlap(self) -> bool:
        """An instance once more, where no pixel asks for one mask alone."""
        n = self.any_of([k for k, (i, m) in enumerate(self.s.masks) if not i["pasted"] and m.sum() >= max(self.least, 1) and self.free[m].all() and not ((m & self.s.paste).any() and (m & ~self.s.paste).any())])
        if n is not None:
            self.extra(self.s.masks[n][0]["label"], self.s.masks[n][1])
        return n is not None

    def straddle(self) -> bool:
        """A mask outside the union that gets a pixel inside it."""
        found = []
        for n, (i, m) in enumerate(self.s.masks):
            if m.any() and not (m & self.s.paste).any():
                x1, y1, x2, y2 = box(m)
                near = np.zeros_like(m)
                near[max(0, y1 - 1) : y2 + 2, max(0, x1 - 1) : x2 + 2] = True
                at = self.one(near & self.s.paste & self.free & ~self.same_label(i["label"]))
                # A box that doesn't fit any more, or does so now, is another check's.
                found += [(n, at)] if at is not None and not boxes_fit(self.s, self.rules) else []
        n = self.any_of(found)
        if n is not None:
            m = self.s.masks[n[0]][1].copy()
            m[n[1]] = True
            self.mask(n[0], m)
        return n is not None

    def relabel(self) -> bool:
        """A target with a label that none of the masks around it had."""
        n = self.any_of([k for k, (i, m) in enumerate(self.s.masks) if not i["pasted"] and m.any() and any(not (m & ~o).any() and i["label"] == j["label"] for j, o in self.s.old)])
        if n is not None:
            self.row["instances"][n]["label"] = 1_000_003
        return n is not None

    def far_pixel(self) -> bool:
        """A target with a pixel far from its box."""
        found = []
        for n, (i, m) in enumerate(self.s.masks):
            then = next((box(o) for j, o in self.s.old if j["slot"] == i["slot"]), None)
            if m.any() and not i["pasted"] and then is not None and max(abs(int(a) - int(b)) for a, b in zip(box(m), then)) <= 1 and not (m & self.s.paste).any():
                x1, y1, x2, y2 = box(m)
                far = np.ones_like(m)
                far[max(0, y1 - 3) : y2 + 4, max(0, x1 - 3) : x2 + 4] = False
                at = self.one(far & ~self.s.paste & self.free & ~self.same_label(i["label"]))
                found += [(n, at)] if at is not None else []
        n = self.any_of(found)
        if n is not None:
            m = self.s.masks[n[0]][1].copy()
            m[n[1]] = True
            self.mask(n[0], m)
        return n is not None

    def speck(self) -> bool:
        """An instance of one pixel, smaller than what may be left of any."""
        held = np.any([m for _, m in self.s.old] or [np.zeros_like(self.s.paste)], axis=0)
        at = self.one(self.free & ~held) if self.least > 1 else None
        if at is not None:
            m = np.zeros_like(self.s.paste)
            m[at] = True
            self.extra(1_000_003, m)
        return at is not None

    def bare_pixel(self) -> bool:
        """A pixel with an instance that its only mask loses, without a change of the mask's box."""
        found = []
        for n, (_, m) in enumerate(self.s.masks):
            at = self.one(m & ~self.free & (m.sum(1, keepdims=True) > 1) & (m.sum(0, keepdims=True) > 1)) if m.sum() > max(self.least, 1) else None
            found += [(n, at)] if at is not None else []
        n = self.any_of(found)
        if n is not None:
            m = self.s.masks[n[0]][1].copy()
            m[n[1]] = False
            # What was no part of a larger mask of another label before mustn't become one.
            self.mask(n[0], m)
        return n is not None

    def stale_id(self) -> bool:
        """A pixel with an instance whose number is new, and yet not above all the old ones."""
        old, new = (np.unique(self.s.layer(side, "panoptic")) for side in (self.s.before, self.s.after))
        ids = np.setdiff1d(np.arange(1, old.max(initial=0)), np.union1d(old, new))
        pan = self.s.layer(self.s.after, "panoptic")[0]
        at = self.one(pan != 0) if len(ids) else None
        if at is not None:
            self.put(self.row, "panoptic", (0, *at), int(ids[self.rng.integers(len(ids))]))
        return at is not None

    def dropped_stuff(self) -> bool:
        """A background class that is gone, in favour of another one."""
        old, new, tau = self.stuff_counts()
        there = [c for c in sorted(self.rules.stuff) if old[c] > tau and new[c] > tau]
        if len(there) < 2 and not (there and any(new[c] == 0 == old[c] for c in self.rules.stuff)):
            return False
        c = self.any_of(there)
        to = self.any_of([d for d in sorted(self.rules.stuff) if d != c and (d in there or new[d] == 0 == old[d])])
        self.put(self.row, "semantic", self.s.layer(self.s.after, "semantic") == c, to)
        return True

    def mixed_kind(self) -> bool:
        """A pixel of the background that is called a thing."""
        sem, pan = self.s.layer(self.s.after, "semantic")[0], self.s.layer(self.s.after, "panoptic")[0]
        _, new, tau = self.stuff_counts()
        at = self.one(np.isin(sem, list(self.rules.stuff)) & (pan == 0) & (new[sem] > tau + 1) & (self.s.layer(self.s.before, "semantic")[0] != self.rules.ignore)) if self.rules.things else None
        if at is not None:
            self.put(self.row, "semantic", (0, *at), min(self.rules.things))
        return at is not None

    def far_depth(self) -> bool:
        """A pasted pixel farther than both sides."""
        if self.s.audit["depth"] is None:
            return False
        old, new = (self.s.layer(side, "depth") for side in (self.s.before, self.s.after))
        src = np.frombuffer(self.s.audit["depth"], "<f8").reshape(old.shape).astype(old.dtype)
        at = self.one(self.s.paste & (new == np.minimum(src, old))[0])
        if at is not None:
            self.put(self.row, "depth", (0, *at), 1e4)
        return at is not None

    def unknown_depth(self) -> bool:
        """A pixel whose depth isn't known any more."""
        ok = self.s.flags(self.s.after["depth_ok"])
        at = self.one(ok)
        if at is not None and self.s.audit["depth_ok"] is not None:
            ok = ok.copy()
            ok[at] = False
            self.row["depth_ok"] = packed(ok)
            return True
        return False

    def short_normals(self) -> bool:
        """Normals that lack a value."""
        self.row["normals"] = self.row["normals"][:-4]
        return True

    def long_normal(self) -> bool:
        """A normal twice as long as it should be."""
        n = self.s.layer(self.s.after, "normals")
        at = self.one(self.s.flags(self.s.after["depth_ok"]) & (np.abs(np.sqrt((n * n).sum(0)) - 1) <= self.rules.atol))
        if at is not None:
            self.put(self.row, "normals", (slice(None), *at), 2 * n[(slice(None), *at)])
        return at is not None


#: Fault to the check that has to find it.
FAULTS = {
    "lost_ignore": "semantic.ignore_preserved",
    "overlap": "instance.no_same_class_overlap",
    "relabel": "instance.identity_preserved",
    "far_pixel": "instance.bbox_recomputed_from_mask",
    "straddle": "instance.target_masks_subtract_paste_union",
    "speck": "instance.small_area_dropped",
    "bare_pixel": "panoptic.pixel_bijection",
    "stale_id": "panoptic.fresh_instance_ids",
    "mixed_kind": "panoptic.thing_stuff_consistent",
    "dropped_stuff": "panoptic.stuff_area_threshold",
    "far_depth": "depth.monotonicity",
    "unknown_depth": "depth.validity_join",
    "short_normals": "normals.camera_frame_convention",
    "long_normal": "normals.unit_norm_on_valid",
}


def spoiled(r: dict, fault: str, rules: Rules, seed: int = 0) -> dict | None:
    """The outcome with one fault, chosen by a seeded hash of its sample; None where there is no place for it."""
    at = Spoiler(r, rules, np.random.default_rng(zlib.crc32(f"{seed}|{r['sample_id']}|{fault}".encode())))
    needs, _ = GATES[FAULTS[fault]]
    return at.row if needs <= at.s.active() and getattr(at, fault)() else None


def injected(out: DataFrame, rules: Rules, faults: Iterable[str] = tuple(FAULTS), seed: int = 0) -> DataFrame:
    """(sample_id, fault, expected, found, ok): each outcome once with every fault that it has a place for, and the checks that find
    more to object to than without it. ``ok``: the expected one alone."""
    faults = tuple(faults)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                (r,) = b.slice(i, 1).to_pylist()
                plain, rows = dict(verdicts(r, rules)), []
                for fault in faults:
                    bad = spoiled(r, fault, rules, seed)
                    if bad is not None:
                        found = sorted(name for name, n in verdicts(bad, rules) if n > plain.get(name, 0))
                        rows.append((r["sample_id"], fault, FAULTS[fault], found, found == [FAULTS[fault]]))
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.list_(pa.string())), pa.array(cols[4], pa.bool_())], names=["sample_id", "fault", "expected", "found", "ok"])

    return out.select("sample_id", "h", "w", *LAYERS, *BITS, "paste", "instances", "audit").mapInArrow(run, "sample_id long, fault string, expected string, found array<string>, ok boolean")
