"""Statistics and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Stretches of the range of values in which running shares are found apart.
STRETCHES = 1024


def paste_stats(before: DataFrame, after: DataFrame, paste: DataFrame, pixels: int) -> DataFrame:
    """(sample_id, n_pasted, paste_area_frac): new instance ids, and the share of the canvas that was pasted over."""
    # Ids are sets of a sample, so that both sides meet by it alone.
    ids = lambda df, name: df.groupBy("sample_id").agg(F.collect_set("instance_id").alias(name))
    none = F.array().cast("array<long>")
    new = ids(after, "is").join(ids(before, "was"), "sample_id", "left").select("sample_id", F.size(F.array_except("is", F.coalesce("was", none))).cast("long").alias("n_pasted")).where("n_pasted > 0")
    area = paste.groupBy("sample_id").agg((F.sum(F.bit_count("paste")) / pixels).alias("paste_area_frac"))
    return area.join(new, "sample_id", "full").select("sample_id", F.coalesce("n_pasted", F.lit(0)).alias("n_pasted"), F.coalesce("paste_area_frac", F.lit(0.0)).alias("paste_area_frac"))


def ks_distance(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """The two-sample distance sup |Fa - Fb|, ties included: counts per distinct value, then running shares."""
    both = a.select(F.col(value).alias("v"), F.lit(1).alias("a")).unionByName(b.select(F.col(value).alias("v"), F.lit(0).alias("a")))
    per = both.groupBy("v").agg(F.sum("a").alias("na"), F.sum(1 - F.col("a")).alias("nb"))
    whole = per.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("na").alias("ta"), F.sum("nb").alias("tb"))  # one row
    # Running sums within stretches of the range; before each stretch go the totals of those below it, at most STRETCHES rows.
    step = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (STRETCHES - 1))).otherwise(0).cast("long")
    part = per.crossJoin(F.broadcast(whole)).withColumn("step", step)
    sums = part.groupBy("step").agg(F.sum("na").alias("sa"), F.sum("nb").alias("sb"))
    all_ = sums.agg(F.collect_list(F.struct("step", "sa", "sb")).alias("all"))
    run = Window.partitionBy("step").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    below = lambda c: F.aggregate(F.filter("all", lambda s: s["step"] < F.col("step")), F.lit(0).cast("long"), lambda t, s: t + s[c])
    base = sums.select("step").crossJoin(F.broadcast(all_)).select("step", below("sa").alias("ba"), below("sb").alias("bb"))
    j = part.withColumn("ra", F.sum("na").over(run)).withColumn("rb", F.sum("nb").over(run)).join(F.broadcast(base), "step")
    gap = F.abs((F.col("ra") + F.col("ba")) / F.col("ta") - (F.col("rb") + F.col("bb")) / F.col("tb"))
    return j.select(gap.alias("gap")).agg(F.max("gap").alias("ks"))


def quartiles(times: DataFrame, value: str, *by: str) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return times.groupBy(*by).agg(F.count("*").alias("n"), q.alias("q")).select(*by, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def regression_gate(base: DataFrame, now: DataFrame, *by: str, slack: float = 0.05, speedup: float = 2.0) -> DataFrame:
    """Adds the ratio of medians, 0 (fine), 1 (slower than the slack allows) or 2 (missing on a side), and the speed-up gate."""
    j = base.select(*by, F.col("median").alias("base")).join(now.select(*by, F.col("median").alias("now")), list(by), "full")
    ratio = F.col("now") / F.col("base")
    code = F.when(F.col("base").isNull() | F.col("now").isNull(), 2).when(ratio > 1 + slack, 1).otherwise(0)
    return j.select(*by, ratio.alias("ratio"), code.alias("code"), F.coalesce(F.col("base") / F.col("now") >= speedup, F.lit(False)).alias("fast"))


def throughput(runs: DataFrame) -> DataFrame:
    """Adds images, batches and pasted instances a second to (batch, k_lo, k_hi, median_ms)."""
    s = F.col("median_ms") / 1000.0
    return runs.withColumn("images_s", F.col("batch") / s).withColumn("batches_s", 1 / s).withColumn("pasted_s", F.col("batch") * (F.col("k_lo") + F.col("k_hi")) / 2.0 / s)


def ranked(rates: DataFrame, anchor: str, name: str = "impl", rate: str = "images_s", *by: str) -> DataFrame:
    """Adds each implementation's rank by rate within ``by`` (ties by name) and its speed-up over the anchor."""
    w = Window.partitionBy(*by)
    base = F.max(F.when(F.col(name) == anchor, F.col(rate))).over(w)
    return rates.withColumn("rank", F.row_number().over(w.orderBy(F.desc(rate), name))).withColumn("speedup", F.col(rate) / base)


def grid(**axes: list) -> list[dict]:
    """The product of the axes of a sweep: a handful of settings, made where the jobs are."""
    from itertools import product

    return [dict(zip(axes, values)) for values in product(*axes.values())]


def sweep(runs: DataFrame, value: str, **axes: list) -> DataFrame:
    """(axes, n, median): every cell of a sweep with the runs that were measured in it; cells without any have none."""
    cells = runs.sparkSession.createDataFrame([tuple(g.values()) for g in grid(**axes)], ", ".join(f"{a} int" for a in axes))
    found = runs.groupBy(*axes).agg(F.count(value).alias("n"), F.percentile(value, F.lit(0.5)).alias("median"))
    # Runs outside of the grid are none of its cells'; both sides have a row a cell at most.
    return cells.join(found, list(axes), "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
