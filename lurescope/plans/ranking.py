"""Ranks and running sums within groups that may each hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def buckets_for(rows: int, per_bucket: int = 100_000) -> int:
    """Number of buckets that keeps a group of ROWS rows at about PER_BUCKET rows a task."""
    return max(1, -(-rows // per_bucket))


def running(df: DataFrame, group: list[str], bucket: Column, order: list[Column], weight: Column, out: str = "before") -> DataFrame:
    """Adds the sum of WEIGHT over the rows of the same GROUP that come earlier in (BUCKET, ORDER).

    BUCKET must never fall along ORDER (or be the first part of the order). A group is never sorted in one task: sums
    per bucket are pre-aggregated, only those are summed up along a group, and rows are sorted within a bucket. With
    a weight of 1 the result is the rank from 0. ORDER must end in a unique column for a defined result.
    """
    rows = df.withColumn("_bucket", bucket).withColumn("_weight", weight)
    keys = [*group, "_bucket"]
    sums = rows.groupBy(*keys).agg(F.sum("_weight").alias("_sum"))
    along = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(starts, keys)
    return joined.withColumn(out, F.col("_start") + F.coalesce(F.sum("_weight").over(inside), F.lit(0))).drop("_bucket", "_weight", "_start")
