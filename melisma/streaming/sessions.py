"""Chunks and statistics of running signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_chunks(events: DataFrame, key: str, ts: str, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Runs of events without a gap, closed once the watermark has passed them; the
    state holds one row per open run."""
    w = F.session_window(ts, gap)
    runs = events.withWatermark(ts, late).groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("on"), F.max(ts).alias("off"))
    return runs.select(key, "on", "off", "n")


def window_features(events: DataFrame, key: str, ts: str, value: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Mean, deviation and extremes per key and window."""
    return events.withWatermark(ts, late).groupBy(key, F.window(ts, width).alias("w")).agg(
        F.avg(value).alias("m"), F.stddev_pop(value).alias("sd"), F.max(value).alias("max"), F.min(value).alias("min"), F.count(F.lit(1)).alias("n")
    ).select(key, F.col("w.start").alias("on"), F.col("w.end").alias("off"), "m", "sd", "max", "min", "n")
