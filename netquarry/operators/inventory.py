"""Hosts over time: which name or hardware address an address had when, and what it did under it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Microseconds of a day, by which bindings and packets meet.
DAY = 86_400_000_000


def bindings(observations: DataFrame, lease: int | None = None) -> DataFrame:
    """When an address had which value: address, kind, value, valid_from, valid_to, seen, from observations (address, kind, value, at in microseconds).

    A value holds from its first observation until another one of the same kind
    is seen, and with ``lease`` no longer than so many microseconds after it was
    last seen. Of observations at one time the greatest value counts. ``valid_to`` is
    exclusive, null for what still holds. Nulls tell nothing.
    """
    rows = observations.where("address IS NOT NULL AND value IS NOT NULL AND at IS NOT NULL").groupBy("address", "kind", "at").agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("seen"))
    order = W.partitionBy("address", "kind").orderBy("at")
    fresh = F.lag("value").over(order).isNull() | (F.lag("value").over(order) != F.col("value"))
    if lease is not None:
        fresh |= F.col("at") - F.lag("at").over(order) > lease
    runs = rows.withColumn("run", F.sum(fresh.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    found = runs.groupBy("address", "kind", "run").agg(F.first("value").alias("value"), F.min("at").alias("valid_from"), F.max("at").alias("last"), F.sum("seen").alias("seen"))
    until = F.lead("valid_from").over(W.partitionBy("address", "kind").orderBy("valid_from"))
    if lease is not None:
        until = F.least(F.coalesce(until, F.col("last") + lease + 1), F.col("last") + lease + 1)
    return found.select("address", "kind", "value", "valid_from", until.alias("valid_to"), "seen")


def attributed(packets: DataFrame, held: DataFrame, kinds: tuple[str, ...], address: str = "src", at: str = "at") -> DataFrame:
    """The rows with the values that their address had at their time, a column for each kind; null where none held.

    Bindings are laid out by the days they cover, up to the last row's, and meet
    rows by address and day; so an address of very many rows meets a day's
    bindings alone. Every row is returned once.
    """
    span = packets.agg(F.max(at).alias("latest")).withColumn("latest", F.coalesce("latest", F.lit(0)))
    placed = held.where(F.col("kind").isin(*kinds)).join(F.broadcast(span)).withColumn("valid_to", F.coalesce("valid_to", F.col("latest") + 1))  # span is one row
    days = F.sequence(F.floor(F.col("valid_from") / DAY), F.floor((F.greatest("valid_to", F.col("valid_from") + 1) - 1) / DAY))
    by_day = placed.withColumn("held_day", F.explode(days)).groupBy(F.col("address").alias("held_address"), "held_day").agg(
        F.sort_array(F.collect_list(F.struct("valid_from", "valid_to", "kind", "value"))).alias("held")  # of one address and day
    )
    rows = packets.withColumn("own_day", F.floor(F.col(at) / DAY)).join(by_day, (F.col(address) == F.col("held_address")) & (F.col("own_day") == F.col("held_day")), "left")
    then = lambda kind: F.element_at(F.filter("held", lambda h: (h["kind"] == kind) & (h["valid_from"] <= F.col(at)) & (h["valid_to"] > F.col(at))), -1)["value"]
    some = F.size(F.coalesce("held", F.array().cast("array<struct<valid_from:bigint,valid_to:bigint,kind:string,value:string>>"))) > 0
    pick = lambda kind: F.when(some & F.exists("held", lambda h: (h["kind"] == kind) & (h["valid_from"] <= F.col(at)) & (h["valid_to"] > F.col(at))), then(kind))
    return rows.withColumns({kind: pick(kind) for kind in kinds}).drop("own_day", "held_address", "held_day", "held")


def inventory(packets: DataFrame, held: DataFrame, by: str = "name") -> DataFrame:
    """Hosts by the value of one kind: its addresses, packets sent, first and last time; an address that moves to another host is counted for each in its time."""
    rows = attributed(packets, held, (by,)).where(F.col(by).isNotNull())
    of_address = rows.groupBy(by, "src").agg(F.count(F.lit(1)).alias("packets"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    return of_address.groupBy(by).agg(
        F.count(F.lit(1)).alias("addresses"), F.sum("packets").alias("packets"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")
    )
