"""Departures as a stream: counts by window with late data, and gaps between departures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def departures_per_window(calls: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "2 hours", at: str = "departed_at") -> DataFrame:
    """(window_start, window_end, stop_I, n) of a stream or table with a timestamp; rows later than the watermark are dropped from a stream."""
    timed = calls.withWatermark(at, late) if calls.isStreaming else calls
    counted = timed.groupBy(F.window(at, window, slide) if slide else F.window(at, window), "stop_I").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "stop_I", "n")


def service_periods(calls: DataFrame, gap: str = "30 minutes", late: str = "2 hours", at: str = "departed_at") -> DataFrame:
    """(period_start, period_end, stop_I, n): runs of departures of a stop without a longer gap."""
    timed = calls.withWatermark(at, late) if calls.isStreaming else calls
    grouped = timed.groupBy(F.session_window(at, gap).alias("period"), "stop_I").agg(F.count("*").alias("n"))
    return grouped.select(F.col("period.start").alias("period_start"), F.col("period.end").alias("period_end"), "stop_I", "n")
