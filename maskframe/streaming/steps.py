"""Micro-batches of samples through the batch plan. An extension: the operators themselves know nothing of streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def augmented(stream: DataFrame, augment: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Runs ``augment`` on every micro-batch and appends its rows; batches are those of the stream, so pairs stay within one.

    A batch that is replayed after a failure overwrites its own folder.
    """

    def put(df: DataFrame, n: int) -> None:
        augment(df).write.mode("overwrite").parquet(f"{out}/step={n}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def step_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Steps a window and kind with their mean value; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")
