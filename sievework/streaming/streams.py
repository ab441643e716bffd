"""Structured Streaming forms of the stateful behaviour."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, key: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed them."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, time: str, by: list[str], window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Event-time counts with late data up to ``delay``."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def batch_writer(target: str, batch_column: str = "batch_id") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink whose batches replace themselves: a retried batch is not counted
    twice, since it overwrites the partition of its number."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = batch.withColumn(batch_column, F.lit(batch_id))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch_column).parquet(target)

    return write


def unstored_writer(target: str, key: str, on_new: Callable[[DataFrame], DataFrame] = lambda d: d) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that appends only rows whose key the table does not hold yet."""

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.dropDuplicates([key])
        try:
            fresh = fresh.join(batch.sparkSession.read.parquet(target).where(F.col("batch_id") != batch_id).select(key), key, "left_anti")
        except Exception as e:  # noqa: BLE001  the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        on_new(fresh).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(target)

    return write
