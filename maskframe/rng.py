"""Randomness from hashes of row keys: results don't depend on how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(name: str, *keys: str | Column) -> Column:
    """A double in [0, 1) from the first 52 bits of SHA-256 of ``name|key|...``; keys are integers."""
    text = F.concat_ws("|", F.lit(name), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def integer(name: str, low: Column | int, high: Column | int, *keys: str | Column) -> Column:
    """A whole number from ``low`` to ``high``, both included."""
    low, high = (F.lit(x) if isinstance(x, int) else x for x in (low, high))
    return (low + F.floor(uniform(name, *keys) * (high - low + 1))).cast("long")


def step_seed(seed: int | Column, epoch: int | Column, rank: int | Column) -> Column:
    """The first 63 bits that SHA-256 gives for ``seed|epoch|rank``, the sign bit cleared."""
    parts = [F.lit(x) if isinstance(x, int) else x for x in (seed, epoch, rank)]
    digest = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 16), 16, -10).cast("long").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
