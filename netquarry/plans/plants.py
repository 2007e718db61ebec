"""Queries of control networks: the driver tables are sent as DNP3 and S7 messages in streams cut anywhere; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.patterns import Step, unprepared
from ..sources import control
from .catalogue import _table
from .intel import _made
from .streams import _blocks


def made_frame(event_id: int, user_id: int, kind: str) -> bytes:
    """An event as a message between master 1 and the user's outstation."""
    code = {"view": 1, "signup": 3, "purchase": 4, "click": 5, "error": 129}[kind]
    rest = b"\0\0" if kind == "error" else b""
    user = bytes([0xC0 | event_id & 63, 0xC0 | event_id & 15, code]) + rest + bytes([12 if code in (3, 4, 5) else 60, 1, 0x28]) + bytes(event_id % 40)
    station = user_id % 60_000 + 10
    return control.written_dnp3(kind != "error", *((station, 1) if kind != "error" else (1, station)), user)


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _made(_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), made_frame, "event_id", "user_id", "event_type")
    told = F.col("event_type") == "error"
    end = lambda mine, its: F.when(told, its).otherwise(mine)
    station, port = F.concat(F.lit("10.2.0."), F.col("user_id")), (30_000 + F.col("user_id") % 30_000).cast("int")
    return control.dnp3(_blocks(rows.select(
        F.lit("made").alias("capture"), end(F.lit("master"), station).alias("src"), end(port, F.lit(20_000)).alias("sport"), end(station, F.lit("master")).alias("dst"), end(F.lit(20_000), port).alias("dport"),
        F.col("event_id").alias("nth"), F.hex("data").alias("hex"),
    ), 97))


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).groupBy("outstation", "function").agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("group_number").alias("groups"), F.sum("sequence").alias("sequences"))


def _unselected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations that no selection of the same host came before since the last operation, by outstation; a number may belong to stations at several hosts."""
    sent = _frames(spark, sf_dir).where("from_master").withColumn("at", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, offset)"))
    found = unprepared(sent, ["dst", "outstation"], [Step("function = 'select'")], Step("function = 'operate'", unless="function = 'operate'"), ts="at", tie="offset")
    return found.groupBy("outstation").agg(F.count(F.lit(1)).alias("operations"))


def made_job(number: int, status: str, size: int) -> bytes:
    """An order as a job."""
    return control.written_s7(1, number % 65_536, bytes([{"O": 0x04, "F": 0x05, "P": 0x29}[status]]) + bytes(size % 30))


def made_answer(number: int, status: str, size: int) -> bytes:
    """The answer to an order's job; every ninth one is an error."""
    return control.written_s7(3, number % 65_536, bytes([{"O": 0x04, "F": 0x05, "P": 0x29}[status]]), 0x8104 if number % 9 == 0 else 0)


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' jobs by function, with those that were answered and refused; every fourth has no answer."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("int").alias("size"))
    columns = ("o_orderkey", "o_orderstatus", "size")
    host, port = F.concat(F.lit("c"), F.col("o_custkey")), (1_024 + F.col("o_custkey") % 60_000).cast("int")
    asked = _made(rows, made_job, *columns).select(F.lit("made").alias("capture"), host.alias("src"), port.alias("sport"), F.lit("plc").alias("dst"), F.lit(102).alias("dport"), F.col("o_orderkey").alias("nth"), F.hex("data").alias("hex"))
    told = _made(rows.where("o_orderkey % 4 <> 1"), made_answer, *columns)
    told = told.select(F.lit("made").alias("capture"), F.lit("plc").alias("src"), F.lit(102).alias("sport"), host.alias("dst"), port.alias("dport"), F.col("o_orderkey").alias("nth"), F.hex("data").alias("hex"))
    found = control.s7(_blocks(asked.unionByName(told), 83))
    client = F.when(F.col("kind") == "job", F.col("src")).otherwise(F.col("dst"))
    # A reference that comes again is another job: the n-th answer of a reference belongs to its n-th answered job, so counts by function are enough here.
    return found.groupBy(client.alias("client"), "function").agg(
        F.count(F.when(F.col("kind") == "job", 1)).alias("jobs"), F.count(F.when(F.col("kind") == "ack_data", 1)).alias("answers"), F.count(F.when(F.col("error") != 0, 1)).alias("refused"), F.sum("reference").alias("references")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"dnp3_functions": _functions, "dnp3_unselected_operations": _unselected, "s7_jobs": _jobs}

ORACLE_SQL: dict[str, str] = {
    "dnp3_functions": """
        SELECT (user_id % 60000 + 10)::INTEGER AS outstation, CASE event_type WHEN 'view' THEN 'read' WHEN 'signup' THEN 'select' WHEN 'purchase' THEN 'operate' WHEN 'click' THEN 'direct_operate' ELSE 'response' END AS function,
               count(*) AS messages, 1::BIGINT AS groups, sum(event_id % 16)::BIGINT AS sequences FROM events GROUP BY 1, 2""",
    "dnp3_unselected_operations": """
        WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events WHERE event_type IN ('signup', 'purchase'))
        SELECT (user_id % 60000 + 10)::INTEGER AS outstation, count(*) AS operations FROM e WHERE event_type = 'purchase' AND coalesce(before, 'purchase') = 'purchase' GROUP BY 1""",
    "s7_jobs": """
        SELECT 'c' || o_custkey AS client, CASE o_orderstatus WHEN 'O' THEN 'read' WHEN 'F' THEN 'write' ELSE 'stop' END AS function, count(*) AS jobs, count(CASE WHEN o_orderkey % 4 <> 1 THEN 1 END) AS answers,
               count(CASE WHEN o_orderkey % 4 <> 1 AND o_orderkey % 9 = 0 THEN 1 END) AS refused, sum(o_orderkey % 65536 * CASE WHEN o_orderkey % 4 <> 1 THEN 2 ELSE 1 END)::BIGINT AS references
        FROM orders GROUP BY 1, 2""",
}
