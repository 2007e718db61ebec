"""Queries of the network operators, bound to the driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.network import cadence_family, csv_safe
from ..functions.rules import rule_hits
from ..operators import content, flows, timing


#: Order lines that a task of ``_flows`` holds, about.
TASK_LINES = 500_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as flows: customer to supplier, the part as a wide port, whole quantities as bytes."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("src"))
    lines = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_suppkey").alias("dst"), F.col("l_partkey").alias("dport"), F.col("l_quantity").cast("long").alias("bytes"),
        F.col("l_returnflag").alias("transport"), F.col("l_linestatus").alias("app"), F.col("l_shipdate").alias("ts"),
    )
    # Given numbers of partitions, which Spark doesn't lower: a task sorts and groups about ``TASK_LINES`` lines, however many there are.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // TASK_LINES))
    return lines.repartition(parts, "l_orderkey").join(orders.repartition(parts, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


_FLOWS = """WITH flows AS (SELECT o_custkey AS src, l_suppkey AS dst, l_partkey AS dport, CAST(trunc(l_quantity) AS BIGINT) AS bytes,
    l_returnflag AS transport, l_linestatus AS app, l_shipdate AS ts, l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) """


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").withColumn("odd", F.col("event_id") % 2)
    half = lambda n: events.where(F.col("odd") == n).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return flows.drift(half(0), half(1), "user_id", "n")


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timing.intervals(_table(spark, sf_dir, "events"), ["user_id"])
    return found.select(
        "user_id", "events", F.round("mean_gap", 3).alias("mean_gap"), F.round("variation", 6).alias("variation"), cadence_family(F.col("mean_gap")).alias("cadence")
    )


def _watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    watched = spark.createDataFrame([("example.com",), ("www.example.org",)], "value string")
    return content.watched_hosts(_table(spark, sf_dir, "pages"), watched)


#: Rules of the query rule_hits.
RULES = [
    {"name": "costly_error", "severity": "high", "all": [("event_type", "eq", "error"), ("value", "gte", 10)]},
    {"name": "account", "severity": "low", "any": [("event_type", "in", ["signup", "purchase"]), ("props", "contains", '"K": 6')]},
    {"name": "odd_key", "all": [("props", "regex", '"K": [0-9]*[13579]}'), ("event_type", "neq", "view")], "any": [("value", "lt", 5)]},
    {"name": "never", "all": [("event_type", "gt", 1)]},
]


def _events(change: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: change(_table(spark, sf_dir, "events"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "conversations": lambda s, d: flows.conversations(_flows(s, d)),
    "endpoints": lambda s, d: flows.endpoints(_flows(s, d)),
    "protocol_hierarchy": lambda s, d: flows.hierarchy(_flows(s, d), ["transport", "app"]),
    "port_scan": lambda s, d: flows.fan_out(_flows(s, d), ["src"], "dport", 50, "ports"),
    "host_sweep": lambda s, d: flows.fan_out(_flows(s, d), ["src"], "dst", 25, "hosts"),
    "size_histogram": lambda s, d: flows.size_histogram(_flows(s, d)),
    "retransmissions": lambda s, d: flows.repeats(_flows(s, d), ["l_orderkey", "dport"]),
    "top_conversations": lambda s, d: flows.top(flows.conversations(_flows(s, d)), "bytes", 20, "a", "b"),
    "baseline_drift": _drift,
    "intervals": _intervals,
    "timeline": lambda s, d: timing.timeline(_table(s, d, "events"), "day"),
    "failed_attempts": lambda s, d: timing.failures(_table(s, d, "events"), "user_id", F.col("event_type") == "error", 15).withColumn("share", F.round("share", 6)),
    "pivots": lambda s, d: timing.followed_by(_table(s, d, "events"), "user_id", "event_type", "signup", "purchase"),
    "beacon_scores": _events(lambda e: timing.beacon_scores(e, ["user_id"], F.col("value")).withColumn("score", F.round("score", 6)).withColumn("median_gap", F.round("median_gap", 3))),
    "peaks": _events(lambda e: timing.peaks(e, ["user_id"], 3600)),
    "burst_scores": _events(lambda e: timing.burst_scores(e, ["user_id"]).withColumn("score", F.round("score", 6))),
    "changes": _events(lambda e: timing.changes(e, ["user_id"], "event_type")),
    "paired_requests": _events(lambda e: timing.paired(e, "user_id", "event_type", "signup", "purchase")),
    "pivoted_after": _events(lambda e: timing.pivoted_after(e, "user_id", "event_type", "signup", "purchase")),
    "rule_hits": _events(lambda e: rule_hits(e, RULES)),
    "indicator_counts": lambda s, d: content.indicator_counts(_table(s, d, "documents"), "doc_id", "text"),
    "url_domains": lambda s, d: content.domains(_table(s, d, "pages")),
    "watched_hosts": _watched,
    "same_content": lambda s, d: content.same_content(_table(s, d, "documents"), "doc_id", "text"),
    "csv_export": lambda s, d: _table(s, d, "documents").select("doc_id", csv_safe(F.col("text")).alias("cell")),
}

_CONVERSATIONS = """SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS packets, count(CASE WHEN src <= dst THEN 1 END) AS packets_ab,
    CAST(sum(bytes) AS BIGINT) AS bytes, CAST(coalesce(sum(CASE WHEN src <= dst THEN bytes END), 0) AS BIGINT) AS bytes_ab FROM flows GROUP BY 1, 2"""
_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*?)\.?(?:[:/?#]|$)', 1))"

ORACLE_SQL: dict[str, str] = {
    "conversations": _FLOWS + _CONVERSATIONS,
    "endpoints": _FLOWS
    + """SELECT host, CAST(sum(o) AS BIGINT) AS packets_sent, CAST(sum(1 - o) AS BIGINT) AS packets_received,
        CAST(sum(bytes * o) AS BIGINT) AS bytes_sent, CAST(sum(bytes * (1 - o)) AS BIGINT) AS bytes_received
        FROM (SELECT src AS host, bytes, 1 AS o FROM flows UNION ALL SELECT dst, bytes, 0 FROM flows) GROUP BY host""",
    "protocol_hierarchy": _FLOWS
    + """SELECT transport, app, count(*) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(grouping(transport) + grouping(app) AS INTEGER) AS total_levels
        FROM flows GROUP BY ROLLUP (transport, app)""",
    "port_scan": _FLOWS + "SELECT src, count(DISTINCT dport) AS ports, count(*) AS packets FROM flows GROUP BY src HAVING count(DISTINCT dport) >= 50",
    "host_sweep": _FLOWS + "SELECT src, count(DISTINCT dst) AS hosts, count(*) AS packets FROM flows GROUP BY src HAVING count(DISTINCT dst) >= 25",
    "size_histogram": _FLOWS
    + """SELECT CASE WHEN bytes <= 19 THEN '0-19' WHEN bytes <= 39 THEN '20-39' WHEN bytes <= 79 THEN '40-79' ELSE '80-159' END AS bucket,
        count(*) AS packets, min(bytes) AS smallest, max(bytes) AS largest FROM flows GROUP BY 1""",
    "retransmissions": _FLOWS + "SELECT l_orderkey, dport, count(*) AS copies FROM flows GROUP BY 1, 2 HAVING count(*) > 1",
    "top_conversations": _FLOWS + f"SELECT * FROM ({_CONVERSATIONS}) ORDER BY bytes DESC, a, b LIMIT 20",
    "baseline_drift": """WITH n AS (SELECT user_id, event_id % 2 AS odd, count(*) AS n FROM events GROUP BY 1, 2)
        SELECT coalesce(x.user_id, y.user_id) AS user_id, x.n AS value_before, y.n AS value_after,
               CASE WHEN x.n IS NULL THEN 'new' WHEN y.n IS NULL THEN 'gone' ELSE 'changed' END AS status
        FROM (SELECT * FROM n WHERE odd = 0) x FULL OUTER JOIN (SELECT * FROM n WHERE odd = 1) y ON x.user_id = y.user_id
        WHERE x.n IS DISTINCT FROM y.n""",
    "intervals": """WITH gaps AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events),
        stats AS (SELECT user_id, count(*) AS events, avg(gap) AS mean_gap, stddev_pop(gap) AS dev FROM gaps GROUP BY user_id)
        SELECT user_id, events, round(mean_gap, 3) AS mean_gap, CASE WHEN mean_gap > 0 THEN round(dev / mean_gap, 6) END AS variation,
               CASE WHEN mean_gap IS NULL OR mean_gap <= 0 THEN 'unknown' WHEN mean_gap < 15 THEN 'very_fast' WHEN mean_gap < 60 THEN 'fast' WHEN mean_gap < 300 THEN 'medium'
                    WHEN mean_gap < 1800 THEN 'slow' ELSE 'very_slow' END AS cadence FROM stats""",
    "timeline": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bin, event_type, count(*) AS events FROM events GROUP BY 1, 2",
    "failed_attempts": """SELECT user_id, count(CASE WHEN event_type = 'error' THEN 1 END) AS failures, count(*) AS events,
        round(CAST(count(CASE WHEN event_type = 'error' THEN 1 END) AS DOUBLE) / count(*), 6) AS share
        FROM events GROUP BY user_id HAVING count(CASE WHEN event_type = 'error' THEN 1 END) >= 15""",
    "pivots": """WITH e AS (SELECT user_id, event_type, lead(event_type) OVER w AS following, lead(epoch_us(ts)) OVER w - epoch_us(ts) AS delay
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT user_id, count(*) AS pivots, min(delay) AS shortest_micros FROM e WHERE event_type = 'signup' AND following = 'purchase' GROUP BY user_id""",
    "beacon_scores": """WITH rows AS (SELECT user_id, epoch_us(ts) AS micros, value AS size,
            (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events),
        mid AS (SELECT user_id, count(*) AS events, median(gap) AS mg, median(size) AS ms, (max(micros) - min(micros)) / 1e6 AS duration FROM rows GROUP BY 1 HAVING count(*) >= 5),
        off AS (SELECT user_id, events, mg, ms, duration, median(abs(gap - mg)) AS og, median(abs(size - ms)) AS os FROM rows JOIN mid USING (user_id) GROUP BY ALL)
        SELECT user_id, events, round(mg, 3) AS median_gap, round(0.5e0 * CASE WHEN mg > 0 THEN 1 - least(1e0, og / mg) ELSE 0 END
            + 0.2e0 * CASE WHEN ms > 0 THEN 1 - least(1e0, os / ms) ELSE 0 END + 0.2e0 * least(1e0, duration / 3600) + 0.1e0 * least(1e0, events / 50e0), 6) AS score FROM off""",
    "peaks": """WITH rows AS (SELECT user_id, epoch_us(ts) AS micros FROM events WHERE ts IS NOT NULL),
        counted AS (SELECT user_id, count(*) OVER w AS n, min(micros) OVER w AS start FROM rows
            WINDOW w AS (PARTITION BY user_id ORDER BY micros RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW))
        SELECT user_id, max(n) AS peak, arg_min(start, (-n, start)) AS peak_micros FROM counted GROUP BY 1""",
    "burst_scores": """WITH rows AS (SELECT user_id, epoch_us(ts) AS micros FROM events WHERE ts IS NOT NULL),
        spans AS (SELECT user_id, min(micros) AS first, greatest(max(micros) - min(micros), 1) AS length FROM rows GROUP BY 1),
        bins AS (SELECT user_id, least(23, (micros - first) * 24 // length) AS bin, count(*) AS n FROM rows JOIN spans USING (user_id) GROUP BY 1, 2)
        SELECT user_id, CAST(sum(n) AS BIGINT) AS events, max(n) AS peak, 24 - count(*) AS idle,
            round(0.6e0 * least(1e0, max(n) * 24e0 / sum(n) / 4) + 0.4e0 * (24 - count(*)) / 24, 6) AS score FROM bins GROUP BY 1""",
    "changes": """SELECT * FROM (SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, event_type AS after FROM events)
        WHERE before <> after""",
    "paired_requests": """WITH e AS (SELECT user_id, event_type, event_id, ts, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS a FROM events WHERE event_type IN ('signup', 'purchase')),
        s AS (SELECT *, sum(a) OVER w AS answers, sum(1 - a) OVER w AS requests FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        g AS (SELECT *, greatest(0, max(answers - requests) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS ahead FROM s),
        n AS (SELECT *, coalesce(lag(ahead) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS before FROM g)
        SELECT x.user_id, CAST(x.requests AS BIGINT) AS nth, x.event_id AS request, y.event_id AS answer FROM (SELECT * FROM n WHERE a = 0) x
        LEFT JOIN (SELECT * FROM n WHERE a = 1 AND ahead = before) y ON x.user_id IS NOT DISTINCT FROM y.user_id AND x.requests = y.answers - y.ahead""",
    "pivoted_after": """WITH f AS (SELECT user_id, min(ts) AS start FROM events WHERE event_type = 'signup' GROUP BY 1)
        SELECT user_id, arg_min(event_id, (ts, event_id)) AS event, epoch_us(min(ts)) - epoch_us(min(start)) AS delay_micros
        FROM events JOIN f USING (user_id) WHERE event_type = 'purchase' AND ts > start GROUP BY 1""",
    "rule_hits": """SELECT 'costly_error' AS rule, 'high' AS severity, count(*) AS hits FROM events WHERE event_type = 'error' AND value >= 10 HAVING count(*) > 0
        UNION ALL SELECT 'account', 'low', count(*) FROM events WHERE event_type IN ('signup', 'purchase') OR contains(lower(props), '"k": 6') HAVING count(*) > 0
        UNION ALL SELECT 'odd_key', 'info', count(*) FROM events WHERE regexp_matches(props, '"K": [0-9]*[13579]}', 'i')
            AND event_type IS DISTINCT FROM 'view' AND value < 5 HAVING count(*) > 0""",
    "indicator_counts": r"""SELECT * FROM (SELECT doc_id,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS INTEGER) AS emails,
        CAST(len(regexp_extract_all(coalesce(text, ''), '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b')) AS INTEGER) AS ipv4,
        CAST(len(regexp_extract_all(coalesce(text, ''), '\b[0-9a-fA-F]{32,64}\b')) AS INTEGER) AS hashes FROM documents)
        WHERE emails > 0 OR ipv4 > 0 OR hashes > 0""",
    "url_domains": f"""SELECT host, hits, CASE WHEN len(string_split(host, '.')) > 2 THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE host END AS domain
        FROM (SELECT {_HOST} AS host, count(*) AS hits FROM pages GROUP BY 1)""",
    "watched_hosts": f"""SELECT host, value, hits FROM (SELECT {_HOST} AS host, count(*) AS hits FROM pages GROUP BY 1)
        JOIN (SELECT 'example.com' AS value UNION ALL SELECT 'www.example.org') w ON host = value OR host LIKE '%.' || value""",
    "same_content": "SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_seen FROM documents GROUP BY 1 HAVING count(*) > 1",
    "csv_export": r"SELECT doc_id, CASE WHEN regexp_matches(text, '^\s*[=+\-@]') THEN '''' || text ELSE text END AS cell FROM documents",
}
