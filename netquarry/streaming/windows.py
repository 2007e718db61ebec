"""The time-series operators over streams: watermarks bound the state, late rows are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rates(events: DataFrame, key: list[str], width: str, slide: str | None = None, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Events of each key in tumbling windows, or in sliding ones if ``slide`` is given: key, start, end, events."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    found = events.withWatermark(ts, late).groupBy(*key, window.alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return found.select(*key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def bursts(events: DataFrame, key: list[str], least: int, width: str, slide: str, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Sliding windows in which a key has ``least`` events or more."""
    return rates(events, key, width, slide, late, ts).where(F.col("events") >= least)


def sessions(events: DataFrame, key: list[str], gap: str, failed: Column, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Sessions of each key, which end after a gap without events: start, end, events and failures, as in password guessing."""
    own = events.withWatermark(ts, late).groupBy(*key, F.session_window(ts, gap).alias("w"))
    found = own.agg(F.count(F.lit(1)).alias("events"), F.count(F.when(failed, 1)).alias("failures"))
    return found.select(*key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "failures")
