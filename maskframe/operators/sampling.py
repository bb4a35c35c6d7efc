"""Weighted sampling from an instance bank. A weight is constant within a class, so a draw is a class, then an index in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import rng
from ..numbering import ranked

#: Crops of a class that are numbered together.
SPAN = 65_536


def class_frequencies(bank: DataFrame, classes: int) -> DataFrame:
    """(class_id, n) for every class, those without a crop too."""
    return bank.sparkSession.range(classes).withColumnRenamed("id", "class_id").join(bank.groupBy("class_id").agg(F.count("*").alias("n")), "class_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def repeat_factors(freq: DataFrame, t: float) -> DataFrame:
    """Adds ``weight``: max(1, sqrt(t / share)), 0 for classes without a crop. One row a class, so the total is a window."""
    f = F.col("n") / F.sum("n").over(Window.partitionBy())
    return freq.withColumn("weight", F.when(F.col("n") > 0, F.greatest(F.lit(1.0), F.sqrt(F.lit(t) / f))).otherwise(F.lit(0.0)))


def cumulative(freq: DataFrame, t: float) -> DataFrame:
    """Adds the share of the draws below and up to each class (``lo``, ``hi``), proportional to n times weight."""
    w = repeat_factors(freq, t).withColumn("mass", F.col("n") * F.col("weight"))
    run = Window.orderBy("class_id").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("mass").over(Window.partitionBy())
    hi = F.sum("mass").over(run)
    return w.withColumn("lo", (hi - F.col("mass")) / total).withColumn("hi", hi / total).where("n > 0")


def draws(spark: SparkSession, bank: DataFrame, classes: int, n: int, t: float = 1e-3, seed: int = 0xC0FFEE, epoch: int = 0, rank: int = 0) -> DataFrame:
    """(i, class_id, idx): ``n`` draws with replacement; the same seed, epoch and rank give the same sequence.

    ``bank`` has ``idx`` and ``class_id``. Classes and their bounds are few and go to every task as one array: the cross join
    has that one row on its other side.
    """
    key = f"{seed}|{epoch}|{rank}"
    table = cumulative(class_frequencies(bank, classes), t).agg(F.array_sort(F.collect_list(F.struct("hi", "class_id", "n"))).alias("cdf"))
    # One class may be nearly all of the bank, so it is numbered in stretches of the index.
    numbered = ranked(bank.select("idx", "class_id"), "idx", F.floor(F.col("idx") / SPAN), "class_id", name="nth")
    d = spark.range(n).select(F.col("id").alias("i"), rng.uniform(f"class|{key}", "id").alias("u"), rng.uniform(f"index|{key}", "id").alias("v")).crossJoin(F.broadcast(table))
    pick = F.element_at(F.filter("cdf", lambda c: c["hi"] > F.col("u")), 1)
    pick = F.coalesce(pick, F.element_at("cdf", -1))
    d = d.select("i", pick.alias("c"), "v").select("i", F.col("c.class_id").alias("class_id"), F.floor(F.col("v") * F.col("c.n")).cast("long").alias("nth"))
    return d.join(numbered, ["class_id", "nth"]).select("i", "class_id", "idx")


def histogram(drawn: DataFrame, classes: int) -> DataFrame:
    return class_frequencies(drawn, classes)


def predicate_walk(bank: DataFrame, n: int, ok: Column, retries: int = 8) -> DataFrame:
    """(idx, found): the first crop from ``idx`` on (around the end) that meets the predicate, within ``retries`` steps;
    else the last one tried. ``idx`` runs from 0 to ``n - 1``.

    Each crop that passes answers for itself and those up to ``retries`` places before it: a join by equality, whatever n.
    """
    good = bank.where(ok).select(F.col("idx").alias("found"), F.explode(F.sequence(F.lit(0), F.lit(min(retries, n - 1)))).alias("step")).select("found", "step", F.pmod(F.col("found") - F.col("step"), F.lit(n)).alias("idx"))
    near = good.groupBy("idx").agg(F.min(F.struct("step", "found")).alias("best"))
    last = F.pmod(F.col("idx") + retries, F.lit(n))
    return bank.select("idx").join(near, "idx", "left").select("idx", F.coalesce("best.found", last).alias("found"))


def staged_pixels(staged: DataFrame, bank: DataFrame) -> DataFrame:
    """Staged crops with their pixels as shares of 255, alpha 0 or 1, and the class of each: what a loader hands on.

    ``bank`` has ``idx, image, alpha``; a draw without a crop is an error of the bank and is left out by no row: it stays null.
    """
    value = lambda c, i: F.conv(F.hex(F.substring(c, i + 1, F.lit(1))), 16, 10).cast("int")
    spread = lambda c: F.transform(F.sequence(F.lit(0), F.octet_length(c) - 1), lambda i: value(c, i))
    j = staged.join(bank.select("idx", "image", "alpha"), "idx", "left")
    return j.select("batch", "pos", "slot", "class_id", "idx", F.transform(spread("image"), lambda v: v / 255.0).alias("image"), F.transform(spread("alpha"), lambda v: (v > 0).cast("double")).alias("alpha"))


def loader(spark: SparkSession, bank: DataFrame, classes: int, batch: int, k: int, samples_per_step: int, steps: int, **options) -> DataFrame:
    """Whole batches of a bank; what a step draws must be what a batch holds."""
    if samples_per_step != batch * k:
        raise ValueError(f"{samples_per_step} samples a step aren't {batch} times {k}")
    return stage(draws(spark, bank, classes, samples_per_step * steps, **options), bank, batch, k)


def stage(drawn: DataFrame, bank: DataFrame, batch: int, k: int) -> DataFrame:
    """Draws as whole batches of ``batch`` times ``k`` crops: (batch, pos, slot, class_id, idx); a last part batch is dropped."""
    if batch < 1 or k < 1:
        raise ValueError("batches and slots must be positive")
    per = batch * k
    total = drawn.agg(F.floor(F.count("*") / per).alias("whole"))  # one row, which every task gets
    d = drawn.withColumn("batch", F.floor(F.col("i") / per).cast("long")).crossJoin(F.broadcast(total))
    return d.where("batch < whole").select("batch", F.floor(F.pmod("i", F.lit(per)) / k).cast("long").alias("pos"), F.pmod("i", F.lit(k)).alias("slot"), "class_id", "idx")
