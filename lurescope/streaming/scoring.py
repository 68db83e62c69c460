"""The same operators on streams: scoring is a projection, drift a windowed sum with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.operators.fusion import fused, with_scores


def scored_stream(urls: DataFrame, engines: DataFrame, url: str = "url") -> DataFrame:
    """Every URL of a streaming (or static) DataFrame with its report; no state is kept."""
    return fused(with_scores(urls, engines, url))


def drift_stream(rows: DataFrame, at: str, label: str, length: str = "1 day", late: str = "1 hour", baseline: float = 0.5, tolerance: float = 0.15) -> DataFrame:
    """Phishing ratio per time window, final once rows are later than LATE; state is one row per open window."""
    sums = rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, length)).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(label) == 1).alias("phishing"))
    ratio = F.col("phishing") / F.col("rows")
    return sums.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "rows", F.round(ratio, 6).alias("phishing_ratio"), (F.abs(ratio - baseline) > tolerance).alias("drifted"))


def deduplicated_stream(rows: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Rows of a stream without the ones delivered again under the same KEY within the watermark."""
    return rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])
