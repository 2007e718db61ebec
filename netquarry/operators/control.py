"""What a control loop's values do: changes, bursts, oscillation, jumps and outliers, over timed values of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .timing import micros


def value_changes(events: DataFrame, key: str, value: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Each change of a key's value: key, tie, at (microseconds), old, new."""
    order = W.partitionBy(key).orderBy(ts, tie)
    rows = events.where(F.col(value).isNotNull()).select(key, tie, micros(ts).alias("at"), F.lag(value).over(order).alias("old"), F.col(value).alias("new"))
    return rows.where("old <> new")


def bursts(changes: DataFrame, key: str, least: int, seconds: float) -> DataFrame:
    """The first start of ``least`` changes or more within so many seconds (both ends count), and how many these are."""
    within = F.count(F.lit(1)).over(W.partitionBy(key).orderBy("at").rangeBetween(0, int(seconds * 1_000_000)))
    rows = changes.select(key, "at", within.alias("n")).where(F.col("n") >= least)
    best = rows.groupBy(key).agg(F.min(F.struct("at", "n")).alias("first"))
    return best.select(key, F.col("first.at").alias("start_micros"), F.col("first.n").alias("changes"))


def oscillations(changes: DataFrame, key: str, seconds: float, tie: str = "event_id") -> DataFrame:
    """The first time that a key's new value is again that of two changes before, within so many seconds; rows (at, old, new) that change nothing don't count."""
    order = W.partitionBy(key).orderBy("at", tie)
    rows = changes.where("old <> new").select(key, "at", "new", F.lag("new", 2).over(order).alias("earlier"), F.lag("at", 2).over(order).alias("earlier_at"))
    hits = rows.where((F.col("new") == F.col("earlier")) & (F.col("at") - F.col("earlier_at")).between(0, int(seconds * 1_000_000)))
    return hits.groupBy(key).agg(F.min("at").alias("at_micros"))


def steps(changes: DataFrame, key: str, tie: str = "event_id") -> DataFrame:
    """Changes with their size, the time since the change before, and the median size of their key's changes."""
    order = W.partitionBy(key).orderBy("at", tie)
    sized = changes.select(key, tie, "at", "old", "new", F.abs(F.col("new") - F.col("old")).alias("step"), (F.col("at") - F.lag("at").over(order)).alias("waited"))
    return sized.join(changes.groupBy(key).agg(F.median(F.abs(F.col("new") - F.col("old"))).alias("usual")), key)


def rapid_changes(changes: DataFrame, key: str, seconds: float, floor: float = 5.0, times: float = 5.0, tie: str = "event_id") -> DataFrame:
    """Changes soon after another that are ``times`` the usual size or more, and ``floor`` at least."""
    soon = F.col("waited").between(0, int(seconds * 1_000_000))
    return steps(changes, key, tie).where(soon & (F.col("step") >= F.greatest(F.lit(floor), times * F.col("usual")))).select(key, tie, "step", "waited")


def large_jumps(changes: DataFrame, key: str, floor: float = 1000.0, times: float = 10.0, tie: str = "event_id") -> DataFrame:
    """Changes of ``times`` the usual size or more, and ``floor`` at least."""
    return steps(changes, key, tie).where(F.col("step") >= F.greatest(F.lit(floor), times * F.col("usual"))).select(key, tie, "old", "new", "step")


def outliers(changes: DataFrame, key: str, times: float = 6.0, tie: str = "event_id") -> DataFrame:
    """Changes to a value more than ``times`` the quartiles' distance away from the median of all old and new values.

    Quartiles are the medians of the lower and the upper half, the middle value
    left out; keys of fewer than four values have none.
    """
    values = changes.select(key, F.explode(F.array("old", "new")).alias("v"))
    ranked = values.select(key, "v", F.row_number().over(W.partitionBy(key).orderBy("v")).alias("r"), F.count(F.lit(1)).over(W.partitionBy(key)).alias("n"))
    half = F.expr("n div 2")

    def middle(of: Column, after: Column) -> Column:
        low, high = F.floor((of + 1) / 2), F.floor((of + 2) / 2)
        return F.avg(F.when((F.col("r") - after == low) | (F.col("r") - after == high), F.col("v")))

    stats = ranked.groupBy(key).agg(
        F.first("n").alias("n"), middle(F.col("n"), F.lit(0)).alias("median"), middle(half, F.lit(0)).alias("q1"), middle(half, F.col("n") - half).alias("q3")
    )
    spread = F.lit(times) * (F.col("q3") - F.col("q1"))
    rows = changes.join(stats.where("n >= 4 AND q3 > q1"), key)
    return rows.where((F.col("new") < F.col("median") - spread) | (F.col("new") > F.col("median") + spread)).select(key, tie, "new", "median")


def regressions(events: DataFrame, key: str, value: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """How often each key's counter falls below what it was before, and the largest fall."""
    before = F.lag(value).over(W.partitionBy(key).orderBy(ts, tie))
    rows = events.select(key, (before - F.col(value)).alias("fall"))
    return rows.where("fall > 0").groupBy(key).agg(F.count(F.lit(1)).alias("regressions"), F.max("fall").alias("largest"))


def intensity(events: DataFrame, key: str, seconds: float, ts: str = "ts") -> DataFrame:
    """Most events in any span of so many seconds, and events a minute over the key's whole time (a minute at least)."""
    at = micros(ts)
    span = W.partitionBy(key).orderBy("at").rangeBetween(-int(seconds * 1_000_000), 0)
    rows = events.select(key, at.alias("at")).where("at IS NOT NULL").withColumn("within", F.count(F.lit(1)).over(span))
    minutes = F.greatest((F.max("at") - F.min("at")) / F.lit(6e7), F.lit(1.0))
    return rows.groupBy(key).agg(F.max("within").alias("peak"), (F.count(F.lit(1)) / minutes).alias("per_minute"))
