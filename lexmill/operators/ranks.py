"""Positions inside groups that may be very large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordinal(df: DataFrame, group: list[str], order: list[str], block: Column, name: str = "ordinal") -> DataFrame:
    """``df`` with the 0-based position of each row in its group.

    ``block`` must not fall along the order (a prefix or a range of the first
    order column).  Rows are ranked inside (group, block) and shifted by the
    sizes of the blocks before, so that a group with a third of all rows is
    spread over as many tasks as it has blocks.  Groups must not be null.
    """
    rows = df.withColumn("_block", block)
    sizes = rows.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    start = sizes.select(*group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = rows.withColumn("_i", F.row_number().over(W.partitionBy(*group, "_block").orderBy(*order)) - 1)
    return inside.join(start, [*group, "_block"]).withColumn(name, F.col("_start") + F.col("_i")).drop("_block", "_start", "_i")


def running(df: DataFrame, group: list[str], order: str, value: str, block: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` from the beginning of its group up to each row;
    summed inside blocks and shifted by the blocks before, as in ``ordinal``."""
    rows = df.withColumn("_block", block)
    totals = rows.groupBy(*group, "_block").agg(F.sum(value).alias("_n"))
    before = W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    start = totals.select(*group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = rows.withColumn("_i", F.sum(value).over(W.partitionBy(*group, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
    return inside.join(start, [*group, "_block"]).withColumn(name, F.col("_start") + F.col("_i")).drop("_block", "_start", "_i")


def starts(sizes: DataFrame, order: str, size: str, coarse: Column, fine: Column, name: str = "start") -> DataFrame:
    """``sizes`` (one row for each value of ``order``) with the sum of the sizes
    before it.  Summed inside fine blocks, whose totals are summed inside coarse ones,
    whose totals, few as they are, are summed in one task.  Neither block may fall
    along the order."""
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = sizes.select("*", coarse.alias("_a"), fine.alias("_b"), F.col(size).alias("_n"))
    mid = rows.groupBy("_a", "_b").agg(F.sum("_n").alias("_n"))
    top = mid.groupBy("_a").agg(F.sum("_n").alias("_n")).select("_a", earlier(W.orderBy("_a")).alias("_s1"))
    mid = mid.select("_a", "_b", earlier(W.partitionBy("_a").orderBy("_b")).alias("_s2"))
    inside = rows.withColumn("_s3", earlier(W.partitionBy("_a", "_b").orderBy(order)))
    return inside.join(mid, ["_a", "_b"]).join(top, "_a").withColumn(name, F.col("_s1") + F.col("_s2") + F.col("_s3")).drop("_a", "_b", "_n", "_s1", "_s2", "_s3")
