"""Sequences of events of a key: steps in order, with time limits, and with events that must not lie between."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .timing import micros


@dataclass(frozen=True)
class Step:
    """An event that a sequence needs: its condition, its greatest distance in seconds from the step before, and what must not lie between the two."""

    when: str
    within: float | None = None
    unless: str | None = None


def spread(events: DataFrame, key: list[str], at: str, reach: int | None, least_span: int = 86_400_000_000) -> tuple[DataFrame, list[str]]:
    """Events with a ``span`` of time, by which a key of very many events is dealt to many tasks, and the columns to partition by.

    What looks back at most ``reach`` microseconds finds all it needs in its own
    span: the end of each span is also put before the next one, where it is not
    ``own``. Without a limit a key stays in one piece.
    """
    if reach is None:
        return events.withColumns({"span": F.lit(0).cast("long"), "own": F.lit(True)}), key
    length = max(4 * reach, least_span)
    span = F.floor(F.col(at) / length)
    next_too = F.col(at) >= (span + 1) * length - reach
    spans = F.when(next_too, F.array(F.struct(span.alias("span"), F.lit(True).alias("own")), F.struct((span + 1).alias("span"), F.lit(False).alias("own"))))
    rows = events.withColumn("in", F.explode(spans.otherwise(F.array(F.struct(span.alias("span"), F.lit(True).alias("own"))))))
    return rows.withColumns({"span": F.col("in.span"), "own": F.col("in.own")}).drop("in"), [*key, "span"]


def _walked(events: DataFrame, key: list[str], steps: list[Step], last: Step, ts: str, tie: str) -> DataFrame:
    """Events with ``reached``: (place, at, start, started) of the latest way through all steps before them, as far as ``last`` allows."""
    limits = [s.within for s in (*steps[1:], last)]
    reach = None if None in limits else sum(round(x * 1_000_000) for x in limits)
    rows = events.withColumn("at", micros(ts)).where(F.col("at").isNotNull())
    rows, parts = spread(rows, key, "at", reach)
    ordered = W.partitionBy(*parts).orderBy("at", tie)
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("place", F.row_number().over(ordered))
    latest = lambda test, value: F.last(F.when(test, value), ignorenulls=True).over(before)
    own = F.struct("place", "at", F.col(tie).alias("start"), F.col("at").alias("started"))
    rows = rows.withColumn("way", F.when(F.expr(steps[0].when), own))
    for n, step in enumerate((*steps[1:], last), 1):
        rows = rows.withColumn("reached", latest(F.col("way").isNotNull(), F.col("way")))
        fits = F.col("reached").isNotNull()
        if step.within is not None:
            fits &= F.col("at") - F.col("reached.at") <= round(step.within * 1_000_000)
        if step.unless is not None:
            rows = rows.withColumn("hindered", latest(F.expr(step.unless), F.col("place")))
            fits &= F.coalesce(F.col("hindered") <= F.col("reached.place"), F.lit(True))
        rows = rows.withColumn("reached", F.when(fits, F.col("reached")))
        if n < len(steps):
            on = F.struct("place", "at", F.col("reached.start").alias("start"), F.col("reached.started").alias("started"))
            rows = rows.withColumn("way", F.when(F.expr(step.when) & F.col("reached").isNotNull(), on))
    return rows.where("own").where(F.expr(last.when))


def sequences(events: DataFrame, key: list[str], steps: list[Step], ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Events that complete a sequence of steps: key, start (event), event, micros (between the two).

    Events are taken in the order of ``ts``, then ``tie``. Of the ways to an
    event the one through the latest earlier events counts: if any meets the
    limits, it does. Events without a time, and rows whose conditions are null, fit no step. One sort; a
    key's events are dealt by spans of time where all steps have limits.
    """
    found = _walked(events, key, steps[:-1], steps[-1], ts, tie).where("reached IS NOT NULL")
    return found.select(*key, F.col("reached.start").alias("start"), F.col(tie).alias("event"), (F.col("at") - F.col("reached.started")).alias("micros"))


def unprepared(events: DataFrame, key: list[str], steps: list[Step], last: Step, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Events that fit ``last`` though no sequence of steps led to them, as an operation that nothing selected: key, event, at (microseconds)."""
    found = _walked(events, key, steps, last, ts, tie).where("reached IS NULL")
    return found.select(*key, F.col(tie).alias("event"), "at")
