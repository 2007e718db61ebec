"""Queries of what is stored and read again: records of an intrusion detection system, and baselines; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import baselines
from ..operators.curation import Words, curated, united
from ..sources import eve
from ..sources.shared import shared_path
from .catalogue import _flows, _table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records: errors as alerts, views as web requests, clicks as DNS queries, sign-ups as files, the rest as lines cut short; written and read."""
    n = F.col("event_id")
    common = (F.lit(" ").alias("timestamp"), F.concat(F.lit("10.0.0."), F.col("user_id") % 200).alias("src_ip"), F.concat(F.lit("192.0.2."), n % 90).alias("dest_ip"), F.lit("TCP").alias("proto"))
    alert = F.struct(F.lit("alert").alias("event_type"), *common, F.struct(
        (2_000 + n % 25).alias("signature_id"), F.when(n % 25 == 7, " ").otherwise(F.concat(F.lit("Rule "), n % 25)).alias("signature"), F.lit("cat").alias("category"), (n % 3 + 1).alias("severity"),
    ).alias("alert"))
    web = F.struct(F.lit("HTTP").alias("event_type"), *common, F.struct(F.concat(F.lit("Host"), n % 40, F.lit(".Example ")).alias("hostname"), F.array(n).alias("sizes")).alias("http"))
    asked = F.struct(F.lit("dns").alias("event_type"), *common, F.struct(F.when(n % 2 == 0, F.concat(F.lit("A"), n % 30)).alias("rrname"), F.concat(F.lit("B"), n % 30).alias("query")).alias("dns"))
    file = F.struct(F.lit("fileinfo").alias("event_type"), *common, F.struct(F.concat(F.lit("F"), n % 20).alias("filename")).alias("fileinfo"))
    kind = F.col("event_type")
    line = F.when(kind == "error", F.to_json(alert)).when(kind == "view", F.to_json(web)).when(kind == "click", F.to_json(asked)).when(kind == "signup", F.to_json(file)).otherwise(F.concat(F.lit("{\"cut "), n))
    path = shared_path(spark, "eve")
    _table(spark, sf_dir, "events").select(line).write.text(path)
    return eve.read_eve(spark, path)


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eve.alert_counts(eve.alerts(_records(spark, sf_dir), suppressed=("2003", "2004")))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eve.named_records(_records(spark, sf_dir))


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows' baselines stored by year, the first three years merged against the rest; hosts' states and packets, which are exact, beside estimates of peers."""
    flows = _flows(spark, sf_dir).withColumn("year", F.year("ts"))
    path = shared_path(spark, "baselines")
    baselines.baseline(flows, "src", "dst", "bytes", "year").write.partitionBy("capture").parquet(path)
    stored = spark.read.parquet(path)
    found = baselines.drift(baselines.merged(stored.where("capture <= 1997")), baselines.merged(stored.where("capture > 1997")), least=15.0, share=1.0)
    return found.select("host", "state", "packets_before", "packets_now", F.round("peers_before").cast("bigint").alias("peers_before"), F.round("peers_now").cast("bigint").alias("peers_now"), "median_size_before", "median_size_now")


#: Words of the query curated_findings.
WORDS = Words(valued=("credential",), doubtful=("maybe",), recon=("sweep",), noisy=("Noise seen",))


def _curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as findings of two detectors, of five kinds, with their properties as evidence and in their details; united and curated."""
    n = F.col("event_id")
    events = _table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kinds = F.create_map(*(F.lit(x) for pair in {"view": "Host sweep", "click": "Maybe a beacon", "error": "Noise seen", "purchase": "Credential in use", "signup": "Odd service"}.items() for x in pair))
    level = F.create_map(*(F.lit(x) for pair in {"view": "warning", "click": " Warning", "error": "HIGH", "purchase": "warning", "signup": "info"}.items() for x in pair))
    shown = events.select(
        (F.lit("a")).alias("source"), level[F.col("event_type")].alias("severity"), kinds[F.col("event_type")].alias("summary"), F.concat(F.lit("of "), F.col("k") % 25, F.lit(" hosts")).alias("details"),
        F.when(n % 3 == 0, F.array(F.concat(F.lit("e"), n % 4), F.lit(" "))).alias("evidence"), n.alias("first_event"),
    )
    talked = events.where("event_type IN ('view', 'purchase')").select(
        F.lit("b").alias("source"), F.lit("critical").alias("severity"), kinds[F.col("event_type")].alias("summary"), F.lit("").alias("details"),
        F.array(F.struct(F.concat(F.lit("p"), F.col("user_id") % 5).alias("peer"), F.lit(2).cast("long").alias("count"))).alias("peers"),
    )
    found = curated(united({"shown": shown, "talked": talked}), WORDS)
    listed = F.array_join(F.transform("peers", lambda p: F.concat(p["peer"], F.lit(":"), p["count"])), " ")
    return found.select("source", "severity", "summary", "details", "findings", F.array_join("evidence", " ").alias("evidence"), listed.alias("peers"), F.col("signal").cast("int").alias("signal"), "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"detection_alerts": _alerts, "detection_records": _named, "stored_baseline_drift": _drift, "curated_findings": _curated}

#: What sketches estimate can't be told in SQL; tests hold it against exact figures.
ORACLE_SQL: dict[str, str] = {
    "detection_alerts": """
        SELECT CASE WHEN event_id % 25 = 7 THEN 'alert' ELSE 'Rule ' || event_id % 25 END AS signature, (2000 + event_id % 25)::VARCHAR AS sid, count(*) AS alerts, count(DISTINCT user_id % 200) AS sources,
               count(DISTINCT event_id % 90) AS destinations, CASE min(event_id % 3) WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'warning' END AS severity
        FROM events WHERE event_type = 'error' AND event_id % 25 NOT IN (3, 4) GROUP BY event_id % 25""",
    "detection_records": """
        SELECT 'http' AS event_type, 'host' || event_id % 40 || '.example' AS name, count(*) AS records FROM events WHERE event_type = 'view' GROUP BY event_id % 40
        UNION ALL SELECT 'dns', CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END || event_id % 30, count(*) FROM events WHERE event_type = 'click' GROUP BY event_id % 2, event_id % 30
        UNION ALL SELECT 'fileinfo', 'F' || event_id % 20, count(*) FROM events WHERE event_type = 'signup' GROUP BY event_id % 20""",
    "curated_findings": """
        WITH e AS (SELECT event_id, user_id, event_type, (props->>'$.k')::INTEGER % 25 AS n, CASE WHEN event_id % 3 = 0 THEN 'e' || event_id % 4 END AS proof FROM events),
        a AS (
            SELECT 'a' AS source, CASE event_type WHEN 'error' THEN 'high' ELSE 'warning' END AS severity,
                   CASE event_type WHEN 'view' THEN 'Host sweep' WHEN 'click' THEN 'Maybe a beacon' WHEN 'error' THEN 'Noise seen' ELSE 'Credential in use' END AS summary, 'of ' || n || ' hosts' AS details, n, proof,
                   -- a warning of one piece of evidence has 2, and a point each for a number of 5 and for its value; wide sweeps have one more
                   2 + (n >= 5)::INT + (event_type = 'purchase')::INT + (event_type = 'view' AND n >= 10)::INT - (event_type = 'click')::INT - (proof IS NULL AND n < 5)::INT AS own,
                   CASE WHEN event_type = 'purchase' OR (event_type = 'view' AND n >= 10) THEN 3 ELSE 4 END + (event_type = 'click')::INT + (proof IS NULL)::INT AS least
            FROM e WHERE event_type <> 'signup'),
        k AS (SELECT source, severity, summary, details, n, count(*) AS findings, coalesce(array_to_string(list_sort(list_distinct(list(proof))), ' '), '') AS evidence, count(DISTINCT proof) AS proofs
              FROM a WHERE severity = 'high' OR own >= least GROUP BY ALL),
        s AS (SELECT source, severity, summary, details, findings, evidence, '' AS peers,
                     CASE severity WHEN 'high' THEN 4 - 2 ELSE 2 END + (proofs >= 2)::INT + (n >= 5)::INT + (summary = 'Credential in use')::INT + (summary = 'Host sweep' AND n >= 10)::INT
                     - (summary = 'Maybe a beacon' AND proofs <= 1)::INT - (severity = 'warning' AND proofs = 0 AND n < 5)::INT AS signal FROM k
              UNION ALL
              SELECT 'b', 'critical', summary, '', sum(c), '', string_agg(peer || ':' || 2 * c, ' ' ORDER BY peer), 5 + (max(2 * c) >= 3)::INT + (summary = 'Credential in use')::INT + (summary = 'Host sweep' AND max(2 * c) >= 5)::INT
              FROM (SELECT CASE event_type WHEN 'view' THEN 'Host sweep' ELSE 'Credential in use' END AS summary, 'p' || user_id % 5 AS peer, count(*) AS c FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1, 2) GROUP BY summary)
        SELECT source, severity, summary, details, findings::BIGINT AS findings, evidence, peers, signal::INTEGER AS signal,
               (row_number() OVER (PARTITION BY severity ORDER BY signal DESC, source, summary, details))::INTEGER AS rank FROM s""",
}
