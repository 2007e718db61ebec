"""Intervals, bins, failures and sequences over timed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def micros(ts: str) -> Column:
    """Microseconds from the epoch, of timestamps without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})")


def intervals(events: DataFrame, key: list[str], ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Regularity of each key's events: count, mean and deviation of the gaps in seconds, and their ratio (beacons have a small one)."""
    gap = (micros(ts) - F.lag(micros(ts)).over(W.partitionBy(*key).orderBy(ts, tie))) / F.lit(1e6)
    return (
        events.select(*key, gap.alias("gap"))
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("events"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("gap_deviation"))
        .withColumn("variation", F.when(F.col("mean_gap") > 0, F.col("gap_deviation") / F.col("mean_gap")))
    )


def timeline(events: DataFrame, unit: str, kind: str = "event_type", ts: str = "ts") -> DataFrame:
    """Events by kind in bins of a calendar unit."""
    return events.groupBy(F.date_trunc(unit, ts).cast("timestamp_ntz").alias("bin"), kind).agg(F.count(F.lit(1)).alias("events"))


def failures(events: DataFrame, key: str, failed: Column, least: int) -> DataFrame:
    """Keys with ``least`` failures or more, as in password guessing, and their share."""
    n = F.count(F.when(failed, 1))
    return events.groupBy(key).agg(n.alias("failures"), F.count(F.lit(1)).alias("events"), (n / F.count(F.lit(1))).alias("share")).where(F.col("failures") >= least)


def followed_by(events: DataFrame, key: str, kind: str, first: str, then: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Pivots: keys whose event of one kind is next followed by one of another, with how often and the shortest delay."""
    order = W.partitionBy(key).orderBy(ts, tie)
    rows = events.select(key, F.col(kind).alias("kind"), F.lead(kind).over(order).alias("next"), (F.lead(micros(ts)).over(order) - micros(ts)).alias("delay"))
    return rows.where((F.col("kind") == first) & (F.col("next") == then)).groupBy(key).agg(
        F.count(F.lit(1)).alias("pivots"), F.min("delay").alias("shortest_micros")
    )


def beacon_scores(events: DataFrame, key: list[str], size: Column, least_events: int = 5, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """How much each key's events look like a beacon, 0 to 1.

    Half is the regularity of the gaps (median absolute deviation over median), a
    fifth each that of the sizes and the duration up to an hour, a tenth the count
    up to 50. Keys with fewer events are left out.
    """
    gap = (micros(ts) - F.lag(micros(ts)).over(W.partitionBy(*key).orderBy(ts, tie))) / F.lit(1e6)
    rows = events.select(*key, micros(ts).alias("at"), gap.alias("gap"), size.cast("double").alias("size"))
    centres = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("events"), F.median("gap").alias("median_gap"), F.median("size").alias("median_size"), ((F.max("at") - F.min("at")) / F.lit(1e6)).alias("duration")
    )
    spread = rows.join(centres.where(F.col("events") >= least_events), key).groupBy(*key, "events", "median_gap", "median_size", "duration").agg(
        F.median(F.abs(F.col("gap") - F.col("median_gap"))).alias("gap_off"), F.median(F.abs(F.col("size") - F.col("median_size"))).alias("size_off")
    )
    steady = lambda off, middle: F.when(F.col(middle) > 0, 1 - F.least(F.lit(1.0), F.col(off) / F.col(middle))).otherwise(0.0)
    score = (
        0.5 * steady("gap_off", "median_gap")
        + 0.2 * steady("size_off", "median_size")
        + 0.2 * F.least(F.lit(1.0), F.col("duration") / 3600.0)
        + 0.1 * F.least(F.lit(1.0), F.col("events") / 50.0)
    )
    return spread.select(*key, "events", "median_gap", score.alias("score"))


def peaks(events: DataFrame, key: list[str], seconds: float, ts: str = "ts") -> DataFrame:
    """The most events that each key has in any span of so many seconds, ends included, and when the first such span starts."""
    span = W.partitionBy(*key).orderBy("at").rangeBetween(-int(seconds * 1_000_000), 0)
    rows = events.select(*key, micros(ts).alias("at")).where("at IS NOT NULL").withColumn("within", F.count(F.lit(1)).over(span)).withColumn("start", F.min("at").over(span))
    best = F.max(F.struct("within", (-F.col("start")).alias("before")))
    return rows.groupBy(*key).agg(best.alias("best")).select(*key, F.col("best.within").alias("peak"), (-F.col("best.before")).alias("peak_micros"))


def burst_scores(events: DataFrame, key: list[str], bins: int = 24, ts: str = "ts") -> DataFrame:
    """Bursts and pauses of each key over equal bins of its own time span: peak, idle bins and a score of both, 0 to 1."""
    rows = events.select(*key, micros(ts).alias("at")).where("at IS NOT NULL")
    spans = rows.groupBy(*key).agg(F.min("at").alias("first"), F.greatest(F.max("at") - F.min("at"), F.lit(1)).alias("length"))
    place = F.least(F.lit(bins - 1), F.expr(f"(at - first) * {bins} div length"))
    counts = rows.join(spans, key).groupBy(*key, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    found = counts.groupBy(*key).agg(F.sum("n").alias("events"), F.max("n").alias("peak"), (F.lit(bins) - F.count(F.lit(1))).alias("idle"))
    burst = F.least(F.lit(1.0), F.col("peak") * bins / F.col("events") / 4)
    return found.withColumn("score", 0.6 * burst + 0.4 * F.col("idle") / bins)


def changes(events: DataFrame, key: list[str], value: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Events whose value is another than the one before of the same key: key, tie, before, after."""
    before = F.lag(value).over(W.partitionBy(*key).orderBy(ts, tie))
    return events.select(*key, tie, before.alias("before"), F.col(value).alias("after")).where("before <> after")


def paired(events: DataFrame, key: str, kind: str, asked: str, answered: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Requests and answers of a key, first in, first out: an answer is that of the earliest request still open; unanswered ones have a null.

    Answers that come while no request is open have none and are left out. An
    answer's number is how many answers so far found a request: all of them less
    the most by which answers were ahead of the requests before them.
    """
    order = W.partitionBy(key).orderBy(ts, tie)
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    is_answer = (F.col(kind) == answered).cast("int")
    rows = events.where(F.col(kind).isin(asked, answered)).select(
        key, F.col(kind).alias("kind"), F.col(tie).alias("event"), F.col(ts).alias("at"), F.sum(is_answer).over(so_far).alias("answers"), F.sum(1 - is_answer).over(so_far).alias("requests")
    )
    ahead = F.greatest(F.max(F.col("answers") - F.col("requests")).over(W.partitionBy(key).orderBy("at", "event").rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    rows = rows.withColumn("ahead", ahead)
    used = (F.col("kind") == asked) | (F.col("ahead") == F.coalesce(F.lag("ahead").over(W.partitionBy(key).orderBy("at", "event")), F.lit(0)))
    rows = rows.withColumn("used", used).where("used").withColumn("nth", F.when(F.col("kind") == asked, F.col("requests")).otherwise(F.col("answers") - F.col("ahead")))
    pick = lambda which: F.max(F.when(F.col("kind") == which, F.col("event")))
    return rows.groupBy(key, "nth").agg(pick(asked).alias("request"), pick(answered).alias("answer")).where("request IS NOT NULL")


def pivoted_after(events: DataFrame, key: str, kind: str, first: str, then: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """For each key the earliest event of one kind that is strictly later than its first of another."""
    start = F.min(F.when(F.col(kind) == first, micros(ts))).over(W.partitionBy(key))
    later = events.where(F.col(kind).isin(first, then)).select(key, F.col(kind).alias("kind"), F.col(tie).alias("event"), micros(ts).alias("at"), start.alias("start"))
    hits = later.where((F.col("kind") == then) & (F.col("at") > F.col("start")))
    return hits.groupBy(key).agg(F.min(F.struct("at", "event")).alias("hit"), F.first("start").alias("start")).select(
        key, F.col("hit.event").alias("event"), (F.col("hit.at") - F.col("start")).alias("delay_micros")
    )
