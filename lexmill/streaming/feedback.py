"""Feedback logs and events as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def timed(stream: DataFrame, time: str) -> DataFrame:
    """Event times with a zone, as watermarks need them."""
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def once(stream: DataFrame, keys: list[str], time: str, late: str = "30 days") -> DataFrame:
    """Redelivered rows dropped; state is kept for as long as rows may be late."""
    return timed(stream, time).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, time: str, group: str, value: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, group, n, total by tumbling windows."""
    g = timed(stream, time).withWatermark(time, late).groupBy(F.window(time, size), group).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 6).alias("total"))
    return g.select(F.col("window.start").alias("start"), group, "n", "total")


def sessions(stream: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user, start, stop, n of sessions closed by a gap."""
    g = timed(stream, time).withWatermark(time, late).groupBy(user, F.session_window(time, gap)).agg(F.count(F.lit(1)).alias("n"))
    return g.select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def run_folder(spark: SparkSession, folder: str, schema, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Process what a folder of Parquet files holds so far; run again for more."""
    q = step(spark.readStream.schema(schema).parquet(folder)).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
    q.awaitTermination()


def run_folder_whole(spark: SparkSession, folder: str, schema, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> DataFrame:
    """Aggregates over all that a folder of Parquet files holds so far, open
    windows and late rows included; run again for more.

    Each batch writes the complete result beside the earlier ones, and the last
    is returned.  In complete mode no watermark drops rows or state, hence the
    state has one row for each group.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = step(spark.readStream.schema(schema).parquet(folder)).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    every = spark.read.parquet(out)
    last = every.agg(F.max("batch")).first()[0]
    return every.where(F.col("batch") == F.lit(last)).drop("batch")
