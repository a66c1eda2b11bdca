"""Streaming twins of the statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rate_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls and time in each window and type; with a watermark if the events stream in."""
    x = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if x.isStreaming:
        x = x.withWatermark("ts", late)
    out = x.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("calls"), F.sum("value").alias("seconds"))
    return out.select(F.col("w.start").alias("start"), "event_type", "calls", "seconds")
