"""Harmonising a paste with its target: Reinhard in SQL, multi-band and Poisson blends per image in numpy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rng

#: The published RGB to LMS and LMS to l-alpha-beta transforms (Reinhard et al., 2001).
RGB_LMS = ((0.3811, 0.5783, 0.0402), (0.1967, 0.7244, 0.0782), (0.0241, 0.1288, 0.8444))
LAB_SCALE = (1 / math.sqrt(3), 1 / math.sqrt(6), 1 / math.sqrt(2))
LMS_LAB = ((1.0, 1.0, 1.0), (1.0, 1.0, -2.0), (1.0, -1.0, 0.0))
LEAST, FLOOR = 1e-6, 1e-12


def _times(m, v: list[Column]) -> list[Column]:
    return [sum((F.lit(float(a)) * x for a, x in zip(row[1:], v[1:])), F.lit(float(row[0])) * v[0]) for row in m]


def to_lab(r: Column, g: Column, b: Column) -> list[Column]:
    logs = [F.log10(F.greatest(x, F.lit(LEAST))) for x in _times(RGB_LMS, [r, g, b])]
    return [x * F.lit(s) for x, s in zip(_times(LMS_LAB, logs), LAB_SCALE)]


def from_lab(lab: list[Column]) -> list[Column]:
    """Back to RGB, in [0, 1]."""
    scaled = [x * F.lit(s) for x, s in zip(lab, LAB_SCALE)]
    logs = _times(np.array(LMS_LAB).T.tolist(), scaled)
    lms = [F.pow(F.lit(10.0), x) for x in logs]
    return [F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)) for x in _times(np.linalg.inv(np.array(RGB_LMS)).tolist(), lms)]


def reinhard_stats(pixels: DataFrame) -> DataFrame:
    """Per sample and channel mean and deviation of the source inside the mask and of the target outside it.

    ``pixels``: sample_id, inside, and l-alpha-beta of source (sl, sa, sb) and target (tl, ta, tb). Masked sums in one pass.
    """
    aggs = []
    for side, want in (("s", F.col("inside")), ("t", ~F.col("inside"))):
        m = want.cast("double")
        aggs.append(F.greatest(F.sum(m), F.lit(1.0)).alias(f"{side}n"))
        for c in "lab":
            aggs += [F.sum(F.col(side + c) * m).alias(f"{side}{c}1"), F.sum(F.col(side + c) * F.col(side + c) * m).alias(f"{side}{c}2")]
    sums = pixels.groupBy("sample_id").agg(*aggs)
    cols = ["sample_id"]
    for side in "st":
        for c in "lab":
            mean = F.col(f"{side}{c}1") / F.col(f"{side}n")
            var = F.col(f"{side}{c}2") / F.col(f"{side}n") - mean * mean
            cols += [mean.alias(f"{side}{c}_mean"), F.sqrt(F.greatest(var, F.lit(FLOOR))).alias(f"{side}{c}_std")]
    return sums.select(*cols)


def reinhard(pixels: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds ``r, g, b``: the source with the target's statistics."""
    j = pixels.join(stats, "sample_id")
    lab = [F.col("s" + c) * (F.col(f"t{c}_std") / F.col(f"s{c}_std")) + (F.col(f"t{c}_mean") - F.col(f"t{c}_std") / F.col(f"s{c}_std") * F.col(f"s{c}_mean")) for c in "lab"]
    return j.select(*pixels.columns, *[x.alias(n) for x, n in zip(from_lab(lab), "rgb")])


def gate(prob: float, *key: str, seed: int = 0) -> Column:
    """Whether a sample is harmonised at all."""
    return F.lit(False) if prob <= 0 else rng.uniform(f"harmonize{seed}", *key) < prob


# ---- per image, in numpy


def binomial() -> np.ndarray:
    k = np.array([math.comb(4, i) for i in range(5)]) / 16.0
    return np.outer(k, k)


def levels_for(h: int, w: int, most: int = 5) -> int:
    return min(most, max(1, int(math.log2(max(2, min(h, w)))) - 1))


def down(x: np.ndarray) -> np.ndarray:
    """Binomial smoothing and every other pixel; the border is zero."""
    p = np.pad(x, 2)
    k = binomial()
    out = sum(k[i, j] * p[i : i + x.shape[0], j : j + x.shape[1]] for i in range(5) for j in range(5))
    return out[::2, ::2]


def up(x: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Bilinear to a shape, pixel centres aligned."""
    def weights(n: int, m: int) -> np.ndarray:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        lo = np.minimum(np.floor(at).astype(int), n - 1)
        hi, f = np.minimum(lo + 1, n - 1), at - lo
        out = np.zeros((m, n))
        np.add.at(out, (np.arange(m), lo), 1 - f)
        np.add.at(out, (np.arange(m), hi), f)
        return out

    return weights(x.shape[0], shape[0]) @ x @ weights(x.shape[1], shape[1]).T


def multiband(src: np.ndarray, tgt: np.ndarray, mask: np.ndarray, most: int = 5) -> np.ndarray:
    """Laplacian pyramids of both sides, blended by the mask's Gaussian pyramid."""
    n = levels_for(*src.shape, most)
    gs, gt, gm = [src], [tgt], [mask.astype(float)]
    for _ in range(n - 1):
        gs.append(down(gs[-1])), gt.append(down(gt[-1])), gm.append(down(gm[-1]))
    out = gm[-1] * gs[-1] + (1 - gm[-1]) * gt[-1]
    for i in range(n - 2, -1, -1):
        ls, lt = (g[i] - up(g[i + 1], g[i].shape) for g in (gs, gt))
        out = up(out, gs[i].shape) + gm[i] * ls + (1 - gm[i]) * lt
    return np.clip(out, 0, 1)


def sine_matrix(n: int) -> np.ndarray:
    """The orthonormal discrete sine transform of the first kind: its own inverse."""
    k = np.arange(1, n + 1)
    return math.sqrt(2 / (n + 1)) * np.sin(np.pi * np.outer(k, k) / (n + 1))


def laplacian(x: np.ndarray) -> np.ndarray:
    p = np.pad(x, 1)
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * x


def poisson(src: np.ndarray, tgt: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The target plus the solution of a Poisson equation for the difference of Laplacians inside the mask."""
    f = laplacian(src - tgt) * mask
    h, w = f.shape
    sh, sw = sine_matrix(h), sine_matrix(w)
    eig = lambda n: 4 * np.sin(np.pi * np.arange(1, n + 1) / (2 * (n + 1))) ** 2
    u = sh @ ((sh @ f @ sw) / -(eig(h)[:, None] + eig(w)[None, :])) @ sw
    return np.clip(tgt + u, 0, 1)


def blended(lines: DataFrame, mode: str, w: int) -> DataFrame:
    """(sample_id, ch, y, vals): whole images blended, one group an image. ``lines``: sample_id, ch, y, src, tgt, mask (bits)."""
    blend = {"multiband": multiband, "poisson": poisson}[mode]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("y")
        src, tgt = np.stack(pdf["src"]), np.stack(pdf["tgt"])
        mask = (pdf["mask"].to_numpy(np.int64)[:, None] >> np.arange(w)) & 1
        return pd.DataFrame({"sample_id": key[0], "ch": key[1], "y": pdf["y"], "vals": list(blend(src, tgt, mask))})

    return lines.groupBy("sample_id", "ch").applyInPandas(one, "sample_id long, ch int, y int, vals array<double>")
