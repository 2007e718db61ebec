"""Records of an intrusion detection system, a JSON object a line whose shape changes with its type, as variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Severities of alerts by number.
SEVERITIES = {"1": "critical", "2": "high", "3": "warning", "4": "info"}
#: What names the records of a type, in the order of preference.
NAMES = {"dns": ("rrname", "query"), "http": ("hostname",), "tls": ("sni",), "fileinfo": ("filename", "magic"), "anomaly": ("type", "event")}


def read_eve(spark: SparkSession, path: str) -> DataFrame:
    """Records: event (a variant; null for a line that is no JSON object), event_type (lower case), line. Empty lines are left out; no schema is inferred."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")
    rows = lines.select(F.when(F.col("line").startswith("{"), F.try_parse_json("line")).alias("event"), "line")
    return rows.withColumn("event_type", F.lower(F.coalesce(field("event_type"), F.lit(""))))


def field(path: str, kind: str = "string", of: str = "event") -> Column:
    """A field of a record by its path; null if it isn't there or of another kind."""
    return F.try_variant_get(of, f"$.{path}", kind)


def alerts(events: DataFrame, only: tuple[str, ...] = (), suppressed: tuple[str, ...] = ()) -> DataFrame:
    """Alerts: sid, signature, category, severity, src, dst, proto, action; of signature numbers ``only``, if any are given, without those ``suppressed``."""
    sid = F.trim(F.coalesce(field("alert.signature_id"), F.lit("")))
    is_object = F.coalesce(F.schema_of_variant(field("alert", "variant")).startswith("OBJECT"), F.lit(False))
    rows = events.where((F.col("event_type") == "alert") & is_object).withColumn("sid", sid)
    if only:
        rows = rows.where(F.col("sid").isin(*only))
    if suppressed:
        rows = rows.where(~F.col("sid").isin(*suppressed))
    given = F.lower(F.trim(F.coalesce(field("alert.severity"), F.lit("info"))))
    level = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in SEVERITIES.items() for x in pair)), given), F.when(given.isin(*SEVERITIES.values()), given), F.lit("info"))
    text = lambda path: F.trim(F.coalesce(field(path), F.lit("")))
    return rows.select(
        "sid", F.when(text("alert.signature") == "", "alert").otherwise(text("alert.signature")).alias("signature"), text("alert.category").alias("category"), level.alias("severity"),
        text("src_ip").alias("src"), text("dest_ip").alias("dst"), text("proto").alias("proto"), text("alert.action").alias("action"),
    )


def alert_counts(found: DataFrame) -> DataFrame:
    """Signatures with their alerts, sources, destinations and worst severity; counted by ends first, so that a frequent signature spreads."""
    rank = F.element_at(F.create_map(*(x for n, s in enumerate(SEVERITIES.values()) for x in (F.lit(s), F.lit(n)))), F.col("severity"))
    ends = found.groupBy("signature", "src", "dst").agg(F.count(F.lit(1)).alias("n"), F.min("sid").alias("sid"), F.min(F.struct(rank.alias("rank"), "severity")).alias("worst"))
    some = lambda c: F.count_distinct(F.when(F.col(c) != "", F.col(c)))
    return ends.groupBy("signature").agg(
        F.min("sid").alias("sid"), F.sum("n").alias("alerts"), some("src").alias("sources"), some("dst").alias("destinations"), F.min("worst").alias("worst")
    ).withColumn("severity", F.col("worst.severity")).drop("worst")


def named_records(events: DataFrame) -> DataFrame:
    """DNS, HTTP, TLS, file and anomaly records by what they name, with their number: event_type, name, records."""
    name = F.lit(None).cast("string")
    for kind, fields in NAMES.items():
        told = F.coalesce(*(F.when(F.trim(field(f"{kind}.{f}")) != "", F.trim(field(f"{kind}.{f}"))) for f in fields))
        told = told if kind == "fileinfo" else F.lower(told)
        name = F.when(F.col("event_type") == kind, F.coalesce(told, F.lit("anomaly")) if kind == "anomaly" else told).otherwise(name)
    rows = events.select("event_type", name.alias("name")).where("name IS NOT NULL")
    return rows.groupBy("event_type", "name").agg(F.count(F.lit(1)).alias("records"))


def damaged_lines(events: DataFrame) -> DataFrame:
    """Lines that are no JSON object."""
    return events.where("event IS NULL").select("line")
