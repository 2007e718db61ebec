"""Summaries, percentiles by rank, modes, entropy and bins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .timing import micros


def summary(events: DataFrame, host: str, ts: str = "ts") -> DataFrame:
    """One row: packets, hosts, first and last time, and the seconds between, never negative."""
    first, last = F.min(micros(ts)), F.max(micros(ts))
    return events.agg(
        F.count(F.lit(1)).alias("packets"), F.count_distinct(host).alias("hosts"), first.alias("first_micros"), last.alias("last_micros"),
        F.greatest((last - first) / F.lit(1e6), F.lit(0.0)).alias("duration"),
    )


def merged(parts: DataFrame, key: list[str]) -> DataFrame:
    """Per-capture summaries (packets, first_micros, last_micros) as one for each key: what a single pass over all captures gives."""
    return parts.groupBy(*key).agg(F.sum("packets").alias("packets"), F.min("first_micros").alias("first_micros"), F.max("last_micros").alias("last_micros"))


def rank_percentiles(rows: DataFrame, key: str, value: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Percentiles that are values of the group: rank p / 100 * (n - 1) rounded half to even (p50...), and truncated (t50...).

    Equal values are counted before they are sorted, so a group is as many rows
    as it has different values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    order = W.partitionBy(key).orderBy(value)
    placed = counts.withColumn("upto", F.sum("c").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(W.partitionBy(key)))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col(value)))
    rank = lambda p: F.lit(p / 100) * (F.col("n") - 1)
    return placed.groupBy(key).agg(F.max("n").alias("n"), *(at(F.rint(rank(p))).alias(f"p{p}") for p in percents), *(at(F.floor(rank(p))).alias(f"t{p}") for p in percents))


def mode(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """Each key's most frequent value, the least of equals, and how often it has it."""
    counts = rows.select(key, value.alias("v")).where("v IS NOT NULL").groupBy(key, "v").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("less"), "v")).alias("best"))
    return best.select(key, F.col("best.v").alias(name), (-F.col("best.less")).alias("times"))


def gaps(events: DataFrame, key: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Seconds between successive events of each key."""
    gap = (micros(ts) - F.lag(micros(ts)).over(W.partitionBy(key).orderBy(ts, tie))) / F.lit(1e6)
    return events.select(key, gap.alias("gap")).where("gap IS NOT NULL")


def regular(
    events: DataFrame, key: str, least_events: int = 5, shortest: float = 5.0, longest: float = 86_400.0, slack: float = 5.0, share: float = 0.25, ts: str = "ts"
) -> DataFrame:
    """The simple beacon test of each key: positive gaps, their mean and deviation, and whether they are regular enough."""
    found = gaps(events, key, ts).groupBy(key).agg(
        (F.count(F.lit(1)) + 1).alias("events"), F.count(F.when(F.col("gap") > 0, 1)).alias("positive"),
        F.avg(F.when(F.col("gap") > 0, F.col("gap"))).alias("mean_gap"), F.stddev_pop(F.when(F.col("gap") > 0, F.col("gap"))).alias("deviation"),
    )
    steady = (F.col("deviation") <= F.greatest(F.lit(slack), F.lit(share) * F.col("mean_gap"))) & F.col("mean_gap").between(shortest, longest)
    return found.withColumn("regular", F.coalesce(steady & (F.col("events") >= least_events) & (F.col("positive") >= least_events - 1), F.lit(False)))


def _bits(own: str | None) -> float:
    """Shannon entropy of a text's characters in bits; 0 if it is empty or null."""
    if not own:
        return 0.0
    counts = np.unique(np.frombuffer(own.encode("utf-32-le"), "<u4"), return_counts=True)[1]
    shares = counts / counts.sum()
    return abs(float(-(shares * np.log2(shares)).sum()))


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters in bits, 0 if it is empty or null; each row alone, in time by its length."""

    def of_batch(texts: pd.Series) -> pd.Series:
        return texts.map(_bits)

    return F.pandas_udf(of_batch, "double")(text)


def binned(events: DataFrame, bins: int, ts: str = "ts") -> DataFrame:
    """Events in equal bins of the whole time (a second at least), empty bins too: bin, events."""
    span = events.agg(F.min(micros(ts)).alias("first"), F.greatest(F.max(micros(ts)) - F.min(micros(ts)), F.lit(1_000_000)).alias("length"))
    rows = events.select(micros(ts).alias("at")).where("at IS NOT NULL").join(F.broadcast(span))  # span is one row
    counts = rows.groupBy(F.least(F.lit(bins - 1), F.expr(f"(at - first) * {bins} div length")).alias("bin")).agg(F.count(F.lit(1)).alias("events"))
    every = events.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("events", F.lit(0)).alias("events"))


def bucket_peaks(events: DataFrame, key: str, unit: str, ts: str = "ts") -> DataFrame:
    """The most events of each key in one calendar bucket, and the first such bucket."""
    counts = events.groupBy(key, F.date_trunc(unit, ts).cast("timestamp_ntz").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("less"), "bucket")).alias("best"))
    return best.select(key, (-F.col("best.less")).alias("peak"), F.col("best.bucket").alias("bucket"))
