"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length per source. A source's target is met by whole copies of the source plus a remaining
budget below one copy. Every length gives its proportional share of that budget first, with what rounding leaves carried on to
the next length; the remainder, less than the longest document, is fitted by a bounded-knapsack dynamic programme over the
lengths. Which documents of a length are taken is decided by a seeded hash, with ranks found inside small buckets so that one frequent length never fills a task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, numbered

#: Steps of the dynamic programme between two states that are kept; those between are made anew on the way back.
KEPT_STEPS = 256
#: Documents of one source and length that are ranked together.
BUCKET = 256
#: Rows of the plan (one a source and length) up to this number may be broadcast.
BROADCAST_ROWS = 200_000


def word_count(text: str) -> F.Column:
    """Number of runs of characters other than space and tab to return; null: 0. Native."""
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    t = F.trim(t)
    return F.when(F.length(t) == 0, F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def filled(sizes: np.ndarray, spare: np.ndarray, left: int) -> tuple[np.ndarray, int]:
    """(how many of each size, what is left) of the subset sum nearest to ``left`` from below: a bounded-knapsack dynamic programme."""
    take, items = np.zeros(len(sizes), np.int64), []  # (index, multiplicity) in powers of two: the bounded knapsack as a 0/1 one
    for i in np.flatnonzero((spare > 0) & (sizes <= left)):
        n, k = min(int(spare[i]), left // int(sizes[i])), 1
        while n > 0:
            items.append((int(i), min(k, n)))
            n -= k
            k *= 2
    items.sort(key=lambda x: (-int(sizes[x[0]]) * x[1], x[0]))
    # Sums that can be reached, as bits of one integer, until the budget itself can be.
    mask, reach, used, kept = (1 << (left + 1)) - 1, 1, [], [1]
    step = lambda r, item: (r | r << int(sizes[item[0]]) * item[1]) & mask
    for item in items:
        nxt = step(reach, item)
        if nxt != reach:
            used.append(item)
            reach = nxt
            if len(used) % KEPT_STEPS == 0:
                kept.append(reach)
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    rest = left - at
    for first in range((len(used) - 1) // KEPT_STEPS * KEPT_STEPS, -1, -KEPT_STEPS):
        states = [kept[first // KEPT_STEPS]]
        for item in used[first : first + KEPT_STEPS]:
            states.append(step(states[-1], item))
        for item, before in zip(reversed(used[first : first + KEPT_STEPS]), reversed(states[:-1])):
            if not before >> at & 1:
                take[item[0]] += item[1]
                at -= int(sizes[item[0]]) * item[1]
    return take, rest


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take so that their words come as near to ``budget`` from below as can be.

    ``sizes`` distinct and positive, ``counts`` how many there are. Every size gives its proportional share first, what
    rounding down leaves of it goes on to the next larger size, so that less than the longest document remains, and that is
    fitted exactly. If it can't be met to the word (few lengths), documents that got in by what was carried on are given
    back, the largest first, and a larger remainder is fitted; at last all that the plain shares leave.
    """
    total = int((sizes * counts).sum())
    if budget <= 0 or not total:
        return np.zeros(len(sizes), np.int64)
    if budget >= total:
        return counts.copy()
    # Python's integers: a count times a budget may pass 2**63.
    share = np.array([int(c) * int(budget) // total for c in counts], np.int64)
    take, carry = share.copy(), 0  # the carry in words times ``total``
    for i in np.argsort(sizes, kind="stable").tolist():
        size = int(sizes[i])
        carry += int(counts[i]) * size * int(budget)
        take[i] = min(carry // (size * total), int(counts[i]))
        carry -= int(take[i]) * size * total
    left = int(budget) - int((take * sizes).sum())
    back = [i for i in np.argsort(-sizes, kind="stable").tolist() if take[i] > share[i]]
    wide = left
    while True:
        more, rest = filled(sizes, counts - take, left)
        # A unit that all spare sizes share can't be filled any further than this.
        if not back or rest < int(np.gcd.reduce(sizes[counts > share])):
            return take + more
        wide = max(2 * wide, 1)
        while back and left < wide:
            i = back.pop(0)
            left += int((take[i] - share[i]) * sizes[i])
            take[i] = share[i]


def targets(sizes: list[float], weights: list[float], most: float) -> list[float]:
    """Shares of the total by weight, none above ``most`` times its size, the excess reshared by weight."""
    total, capped = float(sum(sizes)), [False] * len(sizes)
    out = [0.0] * len(sizes)
    while True:
        rest = total - sum(most * s for s, c in zip(sizes, capped) if c)
        weight = sum(w for w, c in zip(weights, capped) if not c)
        over = False
        for i, (s, w) in enumerate(zip(sizes, weights)):
            out[i] = most * s if capped[i] else rest * w / weight
            if not capped[i] and out[i] > most * s:
                capped[i] = over = True
        if not over:
            return [most * s if c else rest * w / weight if weight else 0.0 for s, w, c in zip(sizes, weights, capped)]


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, source_size) to (source, source_size, target), one row a source, by repeated aggregation."""
    ranked = numbered(sizes, "_null", "_order")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(most))))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0  # words a unit of weight; a source is capped where its cap is below level * weight
    while True:
        capped = F.col("_cap") < F.col("_w") * F.lit(level)
        fixed, weight = ranked.agg(F.sum(F.when(capped, F.col("_cap")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("_w")))).first()
        if not weight:
            break
        nxt = (float(total) - fixed) / weight
        if nxt <= level * (1 + 1e-15):
            break
        level = nxt
    return ranked.select("source", "source_size", F.least("_cap", F.col("_w") * F.lit(level)).alias("target"))


def planned(sized: DataFrame, weights: tuple[int, ...], most: int, seed: int) -> DataFrame:
    """The plan: (source, size, source_size, target, base, k, n, last_h, last_id, ties), one row a source and length.

    ``base`` copies go to every document and one more to ``k`` of the ``n``: to those whose (hash, id) comes before
    (``last_h``, ``last_id``), and to ``ties`` of those that have just that. ``sized`` has (doc_id, source, size).
    """
    per_source = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")).select("source", "source_size", F.col("source").isNull().alias("_null"), F.coalesce(F.encode(F.col("source").cast("string"), "UTF-8"), F.lit(b"")).alias("_order")))
    goal = cut(source_targets(per_source, weights, most))
    counts = sized.groupBy("source", "size").agg(F.count("*").alias("n")).alias("c").join(goal.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source"))).select("c.source", "size", "n", "source_size", "target")

    def plan(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("size", kind="stable").reset_index(drop=True)
        size, n = one["size"].to_numpy(np.int64), one["n"].to_numpy(np.int64)
        budget, whole = int(math.floor(one["target"].iloc[0])), int(one["source_size"].iloc[0])
        one["base"] = copies = min(budget // whole, most) if whole else 0
        some = size > 0
        extra_n = np.zeros(len(one), np.int64)
        extra_n[some] = fit(size[some], n[some], budget - copies * whole if copies < most else 0)
        one["k"] = extra_n
        return one[["source", "size", "n", "source_size", "target", "base", "k"]]

    # One row a length and source: as many as there are lengths, whatever the number of documents.
    rows = cut(counts.groupBy("source").applyInPandas(plan, "source string, size long, n long, source_size long, target double, base long, k long"))
    part = rows.where("k > 0 and k < n").select("source", "size", "n", "k")
    on = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.size") == F.col(f"{b}.size"))
    few = F.broadcast(part) if part.count() <= BROADCAST_ROWS else part
    some = sized.alias("d").join(few.alias("p"), on("d", "p")).select("d.doc_id", "d.source", "d.size", "n", "k").withColumn("h", seeded(seed, "doc_id"))
    # Ranks within small stretches of the hash, so that one frequent length never fills a task.
    some = cut(some.withColumn("bucket", F.floor(F.shiftrightunsigned("h", 1) / F.lit(float(1 << 63)) * F.ceil(F.col("n") / BUCKET)).cast("long")))
    keys = ("source", "size", "bucket")
    filled = some.groupBy(*keys).agg(F.count("*").alias("m")).withColumn("upto", F.sum("m").over(Window.partitionBy("source", "size").orderBy("bucket")))
    edge = filled.alias("f").join(few.alias("p"), on("f", "p")).where("upto >= k and upto - m < k").select("f.source", "f.size", "f.bucket", (F.col("k") - F.col("upto") + F.col("m")).alias("need"))
    # Only the stretch in which the k-th document lies is ranked.
    near = some.alias("d").join(edge.alias("e"), on("d", "e") & (F.col("d.bucket") == F.col("e.bucket"))).select("d.source", "d.size", "d.h", "d.doc_id", "need")
    w = Window.partitionBy("source", "size").orderBy(F.shiftrightunsigned("h", 1), "h", F.col("doc_id").asc_nulls_first())
    ranked = near.withColumn("rn", F.row_number().over(w))
    last = ranked.where("rn = need").select("source", "size", F.col("h").alias("last_h"), F.col("doc_id").alias("last_id"), "need")
    ties = ranked.alias("r").join(last.alias("l"), on("r", "l") & (F.col("r.h") == F.col("l.last_h")) & F.col("r.doc_id").eqNullSafe(F.col("l.last_id")) & (F.col("r.rn") <= F.col("l.need"))).groupBy("l.source", "l.size", "last_h", "last_id").agg(F.count("*").alias("ties"))
    return cut(rows.alias("p").join(ties.alias("t"), on("p", "t"), "left").select("p.*", "last_h", "last_id", "ties"))


def seeded(seed: int, key: str) -> F.Column:
    return F.xxhash64(F.lit(seed), F.col(key))


def decided(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """``rows`` (with ``_k``, ``_s``, ``_n``: key, source, size) and ``_copies``. Rows stay where they are if the plan is small;
    only rows of one key that share the last place are told apart by a window."""
    few = F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan
    p = few.select(*[F.col(c).alias(f"_p_{c}") for c in plan.columns])
    h = F.when(F.col("_p_last_h").isNotNull(), seeded(seed, "_k"))
    j = rows.join(p, F.col("_s").eqNullSafe(F.col("_p_source")) & (F.col("_n") == F.col("_p_size"))).withColumn("_h", h)
    before = lambda c: F.shiftrightunsigned(c, 1)
    same_h = F.col("_h") == F.col("_p_last_h")
    earlier_id = F.col("_p_last_id").isNotNull() & (F.col("_k").isNull() | (F.col("_k") < F.col("_p_last_id")))
    earlier = (before("_h") < before("_p_last_h")) | (before("_h") == before("_p_last_h")) & (F.col("_h") < F.col("_p_last_h")) | same_h & earlier_id
    j = j.withColumn("_at", F.col("_p_last_h").isNotNull() & same_h & F.col("_k").eqNullSafe(F.col("_p_last_id")))
    more = F.when(F.col("_p_k") == 0, 0).when(F.col("_p_k") == F.col("_p_n"), 1).when(earlier, 1).otherwise(0)
    at = Window.partitionBy("_s", "_n", "_k").orderBy(F.lit(0))
    sure = j.where(~F.col("_at")).withColumn("_more", more)
    last = j.where("_at").withColumn("_more", (F.row_number().over(at) <= F.col("_p_ties")).cast("int"))
    every = sure.unionByName(last)
    return every.withColumn("_copies", F.when(F.col("_n") > 0, F.col("_p_base") + F.col("_more")).otherwise(F.lit(0)).cast("long"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17) -> DataFrame:
    """One row a document: ``doc_id, size, source, source_size, target, taken, copies``.

    Sources in code point order, null last, weigh ``weights`` in turn. Null and blank texts have size 0 and are never
    taken; an empty table gives none; repeated rows are documents of their own; ties of the seeded hash fall to the
    smaller key. ``taken`` is ``copies`` times ``size`` and at most ``most`` times it. Other columns are ignored.
    """
    sized = cut(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size")))
    plan = planned(sized, weights, most, seed)
    at = decided(sized.select(F.col("doc_id").alias("_k"), F.col("source").alias("_s"), F.col("size").alias("_n")), plan, seed)
    return at.select(F.col("_k").alias("doc_id"), F.col("_s").alias("source"), F.col("_n").alias("size"), F.col("_p_source_size").alias("source_size"), F.col("_p_target").alias("target"), F.col("_copies").alias("copies"), (F.col("_n") * F.col("_copies")).alias("taken"))


def apply_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17) -> DataFrame:
    """``docs`` with every row as often as the mix takes it (not at all for 0), all columns as they were.

    Whole rows are joined with the plan, not shuffled. Of rows that repeat a key and of which only some are taken, it isn't
    said which.
    """
    sized = cut(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size")))
    plan = planned(sized, weights, most, seed)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_k"), F.col(source).alias("_s"), word_count(text).alias("_n"))
    at = decided(rows, plan, seed)
    return at.where("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")
