"""Conversations, endpoints, fan-out and hierarchy over flow rows.

Every transform is one partial aggregation and one shuffle of its groups; none
collects a group into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.network import size_bucket


def conversations(flows: DataFrame, src: str = "src", dst: str = "dst", size: str = "bytes") -> DataFrame:
    """Both directions as one: a and b in order, packets and bytes of each way."""
    a, b = F.least(src, dst), F.greatest(src, dst)
    forward = F.col(src) <= F.col(dst)
    return flows.groupBy(a.alias("a"), b.alias("b")).agg(
        F.count(F.lit(1)).alias("packets"),
        F.count(F.when(forward, 1)).alias("packets_ab"),
        F.sum(size).alias("bytes"),
        F.coalesce(F.sum(F.when(forward, F.col(size))), F.lit(0)).alias("bytes_ab"),
    )


def endpoints(flows: DataFrame, src: str = "src", dst: str = "dst", size: str = "bytes") -> DataFrame:
    """Packets and bytes that each host sent and received."""
    ways = F.array(F.struct(F.col(src).alias("host"), F.lit(1).alias("out")), F.struct(F.col(dst).alias("host"), F.lit(0).alias("out")))
    rows = flows.select(F.explode(ways).alias("way"), F.col(size).alias("size")).select("way.*", "size")
    return rows.groupBy("host").agg(
        F.sum("out").cast("long").alias("packets_sent"),
        F.sum(1 - F.col("out")).cast("long").alias("packets_received"),
        F.sum(F.col("size") * F.col("out")).alias("bytes_sent"),
        F.sum(F.col("size") * (1 - F.col("out"))).alias("bytes_received"),
    )


def hierarchy(flows: DataFrame, levels: list[str], size: str = "bytes") -> DataFrame:
    """Packets and bytes of each protocol and of those below it; ``total_levels`` tells how many of the last levels are summed up, so totals aren't taken for null levels."""
    found = flows.rollup(*levels).agg(F.count(F.lit(1)).alias("packets"), F.sum(size).alias("bytes"), F.grouping_id().alias("id"))
    return found.withColumn("total_levels", F.bit_count("id").cast("int")).drop("id")


def fan_out(flows: DataFrame, by: list[str], target: str, least: int, name: str = "targets") -> DataFrame:
    """Sources with ``least`` different targets or more: port scans, host sweeps and lateral movement, by the columns chosen."""
    return flows.groupBy(*by).agg(F.count_distinct(target).alias(name), F.count(F.lit(1)).alias("packets")).where(F.col(name) >= least)


def size_histogram(flows: DataFrame, size: str = "bytes") -> DataFrame:
    return flows.groupBy(size_bucket(F.col(size)).alias("bucket")).agg(
        F.count(F.lit(1)).alias("packets"), F.min(size).alias("smallest"), F.max(size).alias("largest")
    )


def repeats(packets: DataFrame, key: list[str]) -> DataFrame:
    """Keys seen more than once, such as retransmitted segments."""
    return packets.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def top(rows: DataFrame, by: str, k: int, *ties: str) -> DataFrame:
    """The k largest rows; ties in the order of further columns."""
    return rows.orderBy(F.desc(by), *ties).limit(k)


def drift(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of two periods that are new, gone, or changed, with both values."""
    joined = before.select(key, F.col(value).alias("value_before")).join(after.select(key, F.col(value).alias("value_after")), key, "full_outer")
    status = F.when(F.col("value_before").isNull(), "new").when(F.col("value_after").isNull(), "gone").otherwise("changed")
    return joined.where(~F.col("value_before").eqNullSafe(F.col("value_after"))).withColumn("status", status)
