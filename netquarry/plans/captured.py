"""Queries that read captures back, which were written from the driver tables, each with the SQL of what they were written from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bpf import column
from ..sources.captures import read_captures
from ..sources.pcap_source import register, seconds, write_captures, write_index
from ..sources.shared import shared_path
from .catalogue import _table


def _user_address(user: Column) -> Column:
    """The address of a user: 10.0.0.1 to 10.0.0.250, then 10.0.1.1 and so on; behind 10.255.255.250 the first octet rises too, up to 4.1 billion users."""
    net = F.floor(user / 250)
    return F.concat_ws(".", (F.floor(net / 65_536) + 10) % 256, F.floor(net / 256) % 256, net % 256, user % 250 + 1)


def _user_name(address: Column) -> Column:
    """The name of such an address, whose third part counts on where an octet ends: 10.0.256.1 for 10.1.0.1."""
    octet = lambda n: F.split_part(address, F.lit("."), F.lit(n)).cast("long")
    net = F.pmod(octet(1) - 10, F.lit(256)) * 65_536 + octet(2) * 256 + octet(3)
    return F.concat_ws(".", F.lit("10"), F.lit("0"), net, octet(4))


def _written(spark: SparkSession, sf_dir: str) -> str:
    """Events as packets from a user's address to one of 200 servers; ports and protocols by kind, the properties as payload."""
    port = F.when(F.col("event_type") == "view", 80).when(F.col("event_type") == "click", 443).when(F.col("event_type") == "error", 53).otherwise(8_080)
    packets = _table(spark, sf_dir, "events").select(
        seconds("ts").alias("ts"),
        _user_address(F.col("user_id")).alias("src"),
        F.concat_ws(".", F.lit("192.0.2"), F.col("event_id") % 200 + 1).alias("dst"),
        (40_000 + F.col("user_id") % 1_000).cast("int").alias("sport"), port.alias("dport"), F.when(F.col("event_type") == "error", "UDP").otherwise("TCP").alias("transport"),
        F.col("props").cast("binary").alias("payload"), (F.col("event_id") * 7 % 4_294_967_296).alias("tcp_seq"), F.lit(24).alias("tcp_flags"),
    )
    folder = shared_path(spark, "captures")
    write_captures(packets, folder).write.parquet(shared_path(spark, "capture-list"))
    return folder


def _pushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of one week's web traffic: times and ports reach the source, which an index lets leave out whole ranges."""
    folder = _written(spark, sf_dir)
    register(spark)
    packets = spark.read.format("pcap").option("index", write_index(spark, folder, range_bytes=64 << 10)).load(folder)
    week = packets.where("ts >= 1704585600 AND ts < 1705190400 AND transport = 'TCP' AND dport IN (80, 443)")
    found = week.groupBy("src", "dport").agg(F.count(F.lit(1)).alias("packets"), F.sum(F.octet_length("payload")).alias("bytes"), F.count_distinct("dst").alias("servers"))
    return found.withColumn("src", _user_name(F.col("src")))


def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets by server that a capture filter leaves, taken in the source, and how many the same filter leaves as a predicate of columns."""
    folder, expression = _written(spark, sf_dir), "(tcp port 80 or udp dst port 53) and net 10.0.0.0/27 and not dst host 192.0.2.7 and greater 40"
    register(spark)
    own = lambda df, name: df.groupBy("dst").agg(F.count(F.lit(1)).alias(name))
    taken = own(spark.read.format("pcap").option("bpf", expression).load(folder), "packets")
    return taken.join(own(read_captures(spark, folder).where(column(expression)), "packets_by_column"), "dst", "full")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"captured_web_week": _pushed, "capture_filter": _filtered}

ORACLE_SQL: dict[str, str] = {
    "captured_web_week": """
        SELECT '10.0.' || (user_id // 250) || '.' || (user_id % 250 + 1) AS src, CASE event_type WHEN 'view' THEN 80 ELSE 443 END AS dport, count(*) AS packets,
               sum(octet_length(encode(props)))::BIGINT AS bytes, count(DISTINCT event_id % 200) AS servers
        FROM events WHERE event_type IN ('view', 'click') AND ts >= TIMESTAMP '2024-01-07 00:00:00' AND ts < TIMESTAMP '2024-01-14 00:00:00' GROUP BY 1, 2""",
    "capture_filter": """
        SELECT '192.0.2.' || (event_id % 200 + 1) AS dst, count(*) AS packets, count(*) AS packets_by_column
        FROM events WHERE event_type IN ('view', 'error') AND user_id < 31 AND event_id % 200 <> 6 GROUP BY 1""",
}
