"""Signals from event streams: windowed sums with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_signal(events: DataFrame, series: str = "event_type", time: str = "ts", value: str = "value", step: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """series, start, x: sums per tumbling window; works on streams and on tables."""
    rows = events.select(F.col(series).cast("string").alias("series"), F.col(time).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("x"))
    sums = rows.withWatermark("ts", late).groupBy("series", F.window("ts", step).alias("w")).agg(F.sum("x").alias("x"))
    return sums.select("series", F.col("w.start").alias("start"), "x")
