"""Streaming extension: churn by file over event time, late commits bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def churn_windows(touches: DataFrame, window: str = "14 days", late: str = "2 days") -> DataFrame:
    """Of a stream (file, ts): file, from, until, commits, append-ready once the watermark passes a window."""
    counts = touches.withWatermark("ts", late).groupBy("file", F.window("ts", window)).agg(F.count("*").alias("commits"))
    return counts.select("file", F.col("window.start").alias("from"), F.col("window.end").alias("until"), "commits")
