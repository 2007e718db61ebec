"""Queries of the scan, control-loop, statistics and findings operators, bound to the driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payload
from ..functions.network import ip_scope, ipv4_scope, url_host
from ..operators import control, findings, scans, statistics
from ..operators.timing import micros
from .catalogue import _FLOWS, _HOST, _flows, _table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.value_changes(_events(spark, sf_dir), "user_id", "value")


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _unanswered(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("id"))
    answers = _table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("id"))
    return _rounded(scans.unanswered(probes, answers, ["id"], "src"), "ratio")


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = _table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("zone"))
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("host"), F.lit("src").alias("role"), F.col("c_nationkey").alias("n_nationkey"))
    suppliers = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("host"), F.lit("dst").alias("role"), F.col("s_nationkey").alias("n_nationkey"))
    return scans.zone_flows(_flows(spark, sf_dir), customers.unionByName(suppliers).join(nations, "n_nationkey").drop("n_nationkey"))


#: Stages of the events' kinds, and severities of the findings made of events.
STAGES = {"view": "recon", "signup": "credential", "click": "lateral", "purchase": "exfil"}
SEVERITIES = {"error": "High", "purchase": "warning ", "signup": "critical", "view": "info"}
#: Rules of the query attack_mapping.
ATTACKS = [
    {"technique": "T1110", "keywords": ["error", "fail"], "context": ["\"k\": 1"]},
    {"technique": "T1078", "keywords": ["signup"], "context": ["\"k\": 2", "\"k\""]},
    {"technique": "T1046", "keywords": ["view", "click"], "excluded": ["\"k\": 3"]},
    {"technique": "T1041", "keywords": ["purchase", "error"]},
]


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as findings: host, kind, severity, stage, text."""
    kind = F.col("event_type")
    of = lambda values: F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), kind)
    return _events(spark, sf_dir).select(
        "event_id", "ts", F.col("user_id").alias("host"), kind.alias("kind"), of(SEVERITIES).alias("level"), of(STAGES).alias("stage"), F.concat_ws(" ", "event_type", "props").alias("text")
    )


_MADE = """WITH made AS (SELECT event_id, ts, user_id AS host, event_type AS kind,
    CASE event_type WHEN 'error' THEN 'High' WHEN 'purchase' THEN 'warning ' WHEN 'signup' THEN 'critical' WHEN 'view' THEN 'info' END AS level,
    CASE event_type WHEN 'view' THEN 'recon' WHEN 'signup' THEN 'credential' WHEN 'click' THEN 'lateral' WHEN 'purchase' THEN 'exfil' END AS stage,
    event_type || ' ' || props AS text FROM events) """
_NORMAL = "lower(trim(coalesce(level, '')))"


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _made(spark, sf_dir).groupBy("host", "kind", "level").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("evidence"))
    score = findings.signal(F.col("level"), F.col("evidence"), F.col("n"), F.col("n"), F.col("kind") == "error", F.col("kind") == "view", F.col("kind") == "purchase", F.col("kind") == "signup")
    return rows.select("host", "kind", score.cast("int").alias("signal"))


def _risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda k: F.count(F.when(F.col("kind") == k, 1))
    rows = _made(spark, sf_dir).groupBy("host").agg(*(n(k).alias(k) for k in ("error", "purchase", "signup", "view", "click")))
    counts = (F.col("purchase") - 10, F.col("error") - 12, F.greatest(F.col("click") - 12, F.lit(0)), F.col("signup") - 14, F.col("view") - 11)
    score = findings.risk_posture(*(F.greatest(c, F.lit(0)) for c in counts))
    return rows.select("host", score.cast("int").alias("risk"))


def _ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' numbers as addresses of many networks, every seventh in IPv6, with how many each zone and category has."""
    n = F.col("event_id")
    first = F.element_at(F.array(*map(F.lit, ("10.0", "172.16", "172.32", "192.168", "192.169", "127.9", "169.254", "224.0", "239.255", "240.1", "8.8", "0.0", "300.1"))), (n % 13 + 1).cast("int"))
    last = F.element_at(F.array(*map(F.lit, ("::1", "fe80::7", "ff02::fb", "fd00::12", "2001:4860::8888", "::", "nonsense"))), (n % 77 / 11 + 1).cast("int"))
    address = F.when(n % 7 == 0, last).otherwise(F.concat_ws(".", first, (n / 256 % 256).cast("int"), n % 256))
    rows = _events(spark, sf_dir).select(address.alias("address"))
    return rows.groupBy(ip_scope(F.col("address")).alias("scope"), ipv4_scope(F.col("address")).alias("category")).agg(F.count(F.lit(1)).alias("addresses"), F.min("address").alias("least"))


def _merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries by day, merged by kind."""
    parts = _events(spark, sf_dir).groupBy("event_type", F.date_trunc("day", "ts")).agg(
        F.count(F.lit(1)).alias("packets"), F.min(micros("ts")).alias("first_micros"), F.max(micros("ts")).alias("last_micros")
    )
    return statistics.merged(parts, ["event_type"])


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with clients alone, servers alone, or both."""
    clients = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    servers = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    role = lambda df, name: df.withColumn("role", F.lit(name))
    both = role(clients.intersect(servers), "both")
    return both.unionByName(role(clients.subtract(servers), "clients")).unionByName(role(servers.subtract(clients), "servers"))


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", payload.found_with_context(F.col("text"), "That").alias("hit"))
    return rows.where("hit IS NOT NULL").select("doc_id", F.col("hit.at").alias("place"), "hit.context")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "capture_summary": lambda s, d: _rounded(statistics.summary(_events(s, d), "user_id"), "duration"),
    "protocol_counts": lambda s, d: _events(s, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("packets")),
    "merged_summaries": _merge,
    "size_percentiles": lambda s, d: statistics.rank_percentiles(_events(s, d), "event_type", "value"),
    "interval_modes": lambda s, d: statistics.mode(statistics.gaps(_events(s, d), "user_id"), "user_id", F.rint(F.col("gap") / 3600).cast("bigint"), "hours"),
    "regular_intervals": lambda s, d: _rounded(statistics.regular(_events(s, d), "user_id", share=1.5), "mean_gap", "deviation", digits=3),
    "timeline_bins": lambda s, d: statistics.binned(_events(s, d), 24),
    "bucket_peaks": lambda s, d: statistics.bucket_peaks(_events(s, d), "user_id", "day"),
    "text_entropy": lambda s, d: _table(s, d, "documents").select("doc_id", F.round(statistics.entropy(F.col("text")), 6).alias("entropy")),
    "scan_vertical": lambda s, d: scans.probed(_flows(s, d), ["src", "dst"], "dport", 3, "ports"),
    "scan_horizontal": lambda s, d: scans.probed(_flows(s, d), ["src", "dport"], "dst", 2, "hosts"),
    "scanner_sources": lambda s, d: scans.scanner_sources(_flows(s, d), most_ports=5, targets=50, few_targets=40, probes=48, ports=44, syns=42, few_ports=40),
    "unanswered_probes": _unanswered,
    "handshake_states": lambda s, d: scans.handshakes(_events(s, d).withColumn("week", F.date_trunc("week", "ts").cast("timestamp_ntz")), ["user_id", "week"], "event_type", "signup", "view", "click", "error"),
    "orphan_answers": lambda s, d: scans.orphan_answers(_events(s, d), "user_id", "event_type", "signup", "purchase"),
    "fan_in_out": lambda s, d: scans.fan_in_out(_flows(s, d)),
    "traffic_concentration": lambda s, d: _rounded(scans.concentration(_flows(s, d), 0.05), "share"),
    "cross_zone_flows": _zones,
    "amplification": lambda s, d: _rounded(scans.amplification(_flows(s, d), "dst", "transport", "R", "A", 1_000, 1.1), "ratio"),
    "top_k_per_group": lambda s, d: scans.ranked(_events(s, d).select("event_type", "event_id", "value"), ["event_type"], "value", 5, "event_id"),
    "top_reverse_ties": lambda s, d: _flows(s, d).groupBy("dport").agg(F.count(F.lit(1)).alias("packets")).orderBy(F.desc("packets"), F.desc("dport")).limit(20),
    "control_intensity": lambda s, d: _rounded(control.intensity(_events(s, d), "user_id", 86_400), "per_minute", digits=9),
    "value_changes": _changes,
    "burst_changes": lambda s, d: control.bursts(_changes(s, d), "user_id", 6, 86_400),
    "oscillations": lambda s, d: control.oscillations(control.value_changes(_events(s, d).withColumn("length", F.length("event_type")), "user_id", "length"), "user_id", 86_400),
    "rapid_changes": lambda s, d: _rounded(control.rapid_changes(_changes(s, d), "user_id", 7_200, floor=1.0, times=1.5), "step"),
    "large_jumps": lambda s, d: _rounded(control.large_jumps(_changes(s, d), "user_id", floor=20.0, times=3.0), "step"),
    "value_outliers": lambda s, d: _rounded(control.outliers(_changes(s, d), "user_id", times=1.5), "median"),
    "sequence_regressions": lambda s, d: _rounded(control.regressions(_events(s, d), "user_id", "value"), "largest"),
    "brute_force": lambda s, d: findings.failed_then_succeeded(_events(s, d), "user_id", "event_type", "error", "signup", "week", 8, 5),
    "attack_mapping": lambda s, d: findings.techniques(_made(s, d), ATTACKS, "text").where("technique IS NOT NULL").select("event_id", "technique", F.col("score").cast("int").alias("score")),
    "signal_scores": _signals,
    "host_scores": lambda s, d: findings.host_scores(_made(s, d), "host", "level", "kind"),
    "risk_posture": _risk,
    "multi_stage": lambda s, d: findings.multi_stage(_made(s, d).where(F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")), "host", F.col("stage"), 3),
    "collapsed_findings": lambda s, d: findings.collapsed(_made(s, d), ["host", "kind"], micros("ts")),
    "first_findings": lambda s, d: findings.first_of_each(_made(s, d).select("host", "kind", "event_id", "ts"), ["host", "kind"], ["ts", "event_id"]).drop("ts"),
    "presence_correlation": lambda s, d: findings.present(_table(s, d, "documents"), "source", F.sha2("text", 256), "sha256"),
    "string_runs": lambda s, d: _table(s, d, "pages").select("page_id", F.size(payload.ascii_strings(F.col("html"))).alias("runs"), F.coalesce(F.element_at(payload.ascii_strings(F.col("html")), 1), F.lit("")).alias("first_run")),
    "secret_key_values": lambda s, d: _table(s, d, "documents").select("doc_id", F.size(payload.key_values(F.col("text"))).alias("hits")).where("hits > 0"),
    "file_types": lambda s, d: _table(s, d, "pages").groupBy(payload.file_type(F.col("html").cast("binary")).alias("file_type")).agg(F.count(F.lit(1)).alias("files")),
    "url_parts": lambda s, d: _table(s, d, "pages").select("page_id", url_host(F.col("url")).alias("host"), payload.url_path(F.col("url")).alias("path"), payload.url_query(F.col("url")).alias("query")),
    "tld_counts": lambda s, d: _table(s, d, "pages").groupBy(payload.top_level_domain(url_host(F.col("url"))).alias("tld")).agg(F.count(F.lit(1)).alias("hits")),
    "request_scores": lambda s, d: _table(s, d, "pages").select("page_id", payload.request_score(F.col("url")).cast("int").alias("score"), payload.risk_level(payload.request_score(F.col("url"))).alias("level")),
    "payload_search": _search,
    "ip_scopes": _ips,
    "nation_roles": _nations,
}

_CHANGES = """changes AS (SELECT * FROM (SELECT user_id, event_id, epoch_us(ts) AS micros, lag(value) OVER w AS old, value AS new FROM events WHERE value IS NOT NULL
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE old <> new)"""
_STEPS = f"""WITH {_CHANGES}, usual AS (SELECT user_id, median(abs(new - old)) AS usual FROM changes GROUP BY 1),
    steps AS (SELECT c.*, abs(new - old) AS step, micros - lag(micros) OVER (PARTITION BY user_id ORDER BY micros, event_id) AS waited FROM changes c)"""
_RISKY = " + ".join(f"CASE WHEN regexp_matches(lower(coalesce(url, '')), '{p.replace(chr(39), chr(39) * 2)}') THEN {v} ELSE 0 END" for _, p, v in payload.REQUEST_RISKS)
_NAMED = " + ".join(f"CASE WHEN regexp_matches(lower(coalesce(url, '')), '[?&]{k}=[^&#]') THEN 3 ELSE 0 END" for k in payload.CREDENTIAL_KEYS)
_PERCENTS = ", ".join(
    f"min(CASE WHEN r > round_even({p / 100}e0 * (n - 1), 0) THEN value END) AS p{p}, min(CASE WHEN r > floor({p / 100}e0 * (n - 1)) THEN value END) AS t{p}" for p in (50, 95, 99)
)

ORACLE_SQL: dict[str, str] = {
    "capture_summary": """SELECT count(*) AS packets, count(DISTINCT user_id) AS hosts, min(epoch_us(ts)) AS first_micros, max(epoch_us(ts)) AS last_micros,
        round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 6) AS duration FROM events""",
    "protocol_counts": "SELECT event_type, count(*) AS packets FROM events GROUP BY 1",
    "merged_summaries": "SELECT event_type, count(*) AS packets, min(epoch_us(ts)) AS first_micros, max(epoch_us(ts)) AS last_micros FROM events GROUP BY 1",
    "size_percentiles": f"""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
        SELECT event_type, max(n) AS n, {_PERCENTS} FROM r GROUP BY 1""",
    "interval_modes": """WITH g AS (SELECT user_id, CAST(round_even((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 / 3600, 0) AS BIGINT) AS hours FROM events),
        c AS (SELECT user_id, hours, count(*) AS times FROM g WHERE hours IS NOT NULL GROUP BY 1, 2)
        SELECT user_id, arg_min(hours, (-times, hours)) AS hours, max(times) AS times FROM c GROUP BY 1""",
    "regular_intervals": """WITH g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events),
        s AS (SELECT user_id, count(*) + 1 AS events, count(CASE WHEN gap > 0 THEN 1 END) AS positive, avg(CASE WHEN gap > 0 THEN gap END) AS m, stddev_pop(CASE WHEN gap > 0 THEN gap END) AS d
            FROM g WHERE gap IS NOT NULL GROUP BY 1)
        SELECT user_id, events, positive, round(m, 3) AS mean_gap, round(d, 3) AS deviation,
            coalesce(d <= greatest(5.0, 1.5 * m) AND m BETWEEN 5 AND 86400 AND events >= 5 AND positive >= 4, false) AS regular FROM s""",
    "timeline_bins": """WITH s AS (SELECT min(epoch_us(ts)) AS f, greatest(max(epoch_us(ts)) - min(epoch_us(ts)), 1000000) AS l FROM events),
        c AS (SELECT least(23, (epoch_us(ts) - f) * 24 // l) AS bin, count(*) AS events FROM events, s WHERE ts IS NOT NULL GROUP BY 1)
        SELECT CAST(range AS BIGINT) AS bin, coalesce(events, 0) AS events FROM range(24) LEFT JOIN c ON bin = range""",
    "bucket_peaks": """WITH c AS (SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, count(*) AS n FROM events GROUP BY 1, 2)
        SELECT user_id, max(n) AS peak, arg_min(bucket, (-n, bucket)) AS bucket FROM c GROUP BY 1""",
    "text_entropy": """WITH c AS (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents WHERE text <> '') GROUP BY 1, 2),
        t AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY 1),
        e AS (SELECT doc_id, round(-sum(n / total * log2(n / total)), 6) AS entropy FROM c JOIN t USING (doc_id) GROUP BY 1)
        SELECT doc_id, coalesce(entropy, 0e0) AS entropy FROM documents LEFT JOIN e USING (doc_id)""",
    "scan_vertical": _FLOWS + "SELECT src, dst, count(DISTINCT dport) AS ports, count(*) AS packets FROM flows GROUP BY 1, 2 HAVING count(DISTINCT dport) >= 3",
    "scan_horizontal": _FLOWS + "SELECT src, dport, count(DISTINCT dst) AS hosts, count(*) AS packets FROM flows GROUP BY 1, 2 HAVING count(DISTINCT dst) >= 2",
    "scanner_sources": _FLOWS
    + """, t AS (SELECT src, dst, count(DISTINCT dport) AS ports, count(*) AS n FROM flows GROUP BY 1, 2),
        s AS (SELECT src, count(*) AS targets, max(ports) AS most_ports, CAST(sum(n) AS BIGINT) AS probes FROM t GROUP BY 1),
        w AS (SELECT src, count(DISTINCT dport) AS ports FROM flows GROUP BY 1)
        SELECT * FROM (SELECT src, targets, most_ports, probes, ports, CASE WHEN most_ports >= 5 THEN 'ports_of_one_target' WHEN targets >= 50 THEN 'targets'
            WHEN probes >= 48 AND targets >= 40 THEN 'probes_and_targets' WHEN ports >= 44 THEN 'ports' WHEN probes >= 42 AND ports >= 40 THEN 'probes_and_ports' END AS reason
            FROM s JOIN w USING (src)) WHERE reason IS NOT NULL""",
    "unanswered_probes": """SELECT o_custkey AS src, count(*) AS probes, count(a.id) AS answered, round(count(a.id) / count(*), 6) AS ratio
        FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'A') a ON o_orderkey = a.id GROUP BY 1""",
    "handshake_states": """WITH t AS (SELECT user_id, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, min(CASE WHEN event_type = 'signup' THEN ts END) AS syn, max(CASE WHEN event_type = 'view' THEN ts END) AS sa,
            max(CASE WHEN event_type = 'click' THEN ts END) AS ack, max(CASE WHEN event_type = 'error' THEN ts END) AS rst FROM events GROUP BY 1, 2)
        SELECT user_id, week, CASE WHEN sa > syn AND ack > sa THEN 'established' WHEN sa > syn THEN 'half-open' WHEN rst > syn THEN 'refused'
            WHEN syn IS NOT NULL THEN 'syn-only' ELSE 'no-handshake' END AS state FROM t""",
    "orphan_answers": """SELECT user_id, event_id FROM events e WHERE event_type = 'purchase'
        AND NOT EXISTS (SELECT 1 FROM events r WHERE r.user_id = e.user_id AND r.event_type = 'signup' AND r.ts < e.ts)""",
    "fan_in_out": _FLOWS
    + """, o AS (SELECT src AS host, count(DISTINCT dst) AS n FROM flows GROUP BY 1), i AS (SELECT dst AS host, count(DISTINCT src) AS n FROM flows GROUP BY 1)
        SELECT coalesce(o.host, i.host) AS host, coalesce(o.n, 0) AS fan_out, coalesce(i.n, 0) AS fan_in FROM o FULL OUTER JOIN i ON o.host = i.host""",
    "traffic_concentration": _FLOWS
    + """, p AS (SELECT src, dst, CAST(sum(bytes) AS BIGINT) AS n FROM flows GROUP BY 1, 2)
        SELECT * FROM (SELECT src, arg_min(dst, (-n, dst)) AS dst, CAST(sum(n) AS BIGINT) AS bytes, round(max(n) / sum(n), 6) AS share FROM p GROUP BY 1) WHERE share >= 0.05""",
    "cross_zone_flows": _FLOWS
    + """SELECT a.n_regionkey AS src_zone, b.n_regionkey AS dst_zone, count(*) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes, a.n_regionkey <> b.n_regionkey AS crosses
        FROM flows JOIN customer ON c_custkey = src JOIN supplier ON s_suppkey = dst JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey GROUP BY ALL""",
    "amplification": _FLOWS
    + """SELECT * FROM (SELECT dst, CAST(coalesce(sum(CASE WHEN transport = 'R' THEN bytes END), 0) AS BIGINT) AS asked, CAST(coalesce(sum(CASE WHEN transport = 'A' THEN bytes END), 0) AS BIGINT) AS answered,
        round(coalesce(sum(CASE WHEN transport = 'A' THEN bytes END), 0) / greatest(coalesce(sum(CASE WHEN transport = 'R' THEN bytes END), 0), 1), 6) AS ratio FROM flows GROUP BY 1)
        WHERE answered >= 1000 AND ratio >= 1.1""",
    "top_k_per_group": """SELECT * FROM (SELECT event_type, event_id, value, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM events) WHERE rank <= 5""",
    "top_reverse_ties": _FLOWS + "SELECT dport, count(*) AS packets FROM flows GROUP BY 1 ORDER BY packets DESC, dport DESC LIMIT 20",
    "control_intensity": """WITH r AS (SELECT user_id, epoch_us(ts) AS micros FROM events WHERE ts IS NOT NULL),
        c AS (SELECT user_id, micros, count(*) OVER (PARTITION BY user_id ORDER BY micros RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM r)
        SELECT user_id, max(n) AS peak, round(count(*) / greatest((max(micros) - min(micros)) / 6e7, 1e0), 9) AS per_minute FROM c GROUP BY 1""",
    "value_changes": f"WITH {_CHANGES} SELECT user_id, event_id, micros AS at, old, new FROM changes",
    "burst_changes": f"""WITH {_CHANGES}, c AS (SELECT user_id, micros, count(*) OVER (PARTITION BY user_id ORDER BY micros RANGE BETWEEN CURRENT ROW AND 86400000000 FOLLOWING) AS n FROM changes)
        SELECT user_id, min(micros) AS start_micros, arg_min(n, micros) AS changes FROM c WHERE n >= 6 GROUP BY 1""",
    "oscillations": """WITH o AS (SELECT user_id, event_id, ts, length(event_type) AS v, lag(length(event_type)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events),
        r AS (SELECT user_id, epoch_us(ts) AS micros, v, lag(v, 2) OVER w AS e, lag(epoch_us(ts), 2) OVER w AS em FROM o WHERE v <> old WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT user_id, min(micros) AS at_micros FROM r WHERE v = e AND micros - em BETWEEN 0 AND 86400000000 GROUP BY 1""",
    "rapid_changes": _STEPS
    + """ SELECT user_id, event_id, round(step, 6) AS step, waited FROM steps JOIN usual USING (user_id) WHERE waited BETWEEN 0 AND 7200000000 AND step >= greatest(1e0, 1.5e0 * usual)""",
    "large_jumps": _STEPS + " SELECT user_id, event_id, old, new, round(step, 6) AS step FROM steps JOIN usual USING (user_id) WHERE step >= greatest(20e0, 3e0 * usual)",
    "value_outliers": f"""WITH {_CHANGES}, v AS (SELECT user_id, unnest([old, new]) AS v FROM changes),
        r AS (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY v) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM v),
        q AS (SELECT user_id, median(v) AS m, median(CASE WHEN r <= n // 2 THEN v END) AS q1, median(CASE WHEN r > n - n // 2 THEN v END) AS q3 FROM r WHERE n >= 4 GROUP BY 1)
        SELECT user_id, event_id, new, round(m, 6) AS median FROM changes JOIN q USING (user_id) WHERE q3 > q1 AND (new < m - 1.5e0 * (q3 - q1) OR new > m + 1.5e0 * (q3 - q1))""",
    "sequence_regressions": """WITH r AS (SELECT user_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) - value AS fall FROM events)
        SELECT user_id, count(*) AS regressions, round(max(fall), 6) AS largest FROM r WHERE fall > 0 GROUP BY 1""",
    "brute_force": """SELECT user_id, CAST(date_trunc('week', ts) AS TIMESTAMP) AS bucket, count(*) AS attempts, count(CASE WHEN event_type = 'error' THEN 1 END) AS failures,
        count(CASE WHEN event_type = 'error' THEN 1 END) < count(*) AS succeeded FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1, 2
        HAVING count(*) >= 8 AND count(CASE WHEN event_type = 'error' THEN 1 END) >= 5""",
    "attack_mapping": _MADE
    + """, h AS (SELECT event_id, lower(text) AS t FROM made),
        k AS (SELECT event_id, 0 AS place, 'T1110' AS technique, 3 * (contains(t, 'error')::INT + contains(t, 'fail')::INT) + contains(t, '"k": 1')::INT AS score FROM h WHERE contains(t, 'error') OR contains(t, 'fail')
            UNION ALL SELECT event_id, 1, 'T1078', 3 + contains(t, '"k": 2')::INT + contains(t, '"k"')::INT FROM h WHERE contains(t, 'signup')
            UNION ALL SELECT event_id, 2, 'T1046', 3 * (contains(t, 'view')::INT + contains(t, 'click')::INT) FROM h WHERE (contains(t, 'view') OR contains(t, 'click')) AND NOT contains(t, '"k": 3')
            UNION ALL SELECT event_id, 3, 'T1041', 3 * (contains(t, 'purchase')::INT + contains(t, 'error')::INT) FROM h WHERE contains(t, 'purchase') OR contains(t, 'error'))
        SELECT event_id, arg_min(technique, (-score, place)) AS technique, CAST(max(score) AS INTEGER) AS score FROM k GROUP BY 1""",
    "signal_scores": _MADE
    + f""", r AS (SELECT host, kind, level, count(*) AS n, count(DISTINCT text) AS evidence FROM made GROUP BY 1, 2, 3)
        SELECT host, kind, CAST(CASE {_NORMAL} WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'warning' THEN 2 ELSE 0 END + (evidence >= 2)::INT + (n >= 3)::INT + (n >= 5)::INT
            + (kind = 'error')::INT - 2 * (kind = 'view')::INT - ({_NORMAL} = 'warning' AND evidence = 0 AND n <= 1 AND n < 5)::INT
            - ({_NORMAL} = 'warning' AND kind = 'purchase' AND evidence <= 1 AND n <= 2)::INT + (kind = 'signup' AND (n >= 10 OR n >= 5))::INT AS INTEGER) AS signal FROM r""",
    "host_scores": _MADE
    + f""", w AS (SELECT *, {_NORMAL} AS s, CASE {_NORMAL} WHEN 'critical' THEN 8 WHEN 'high' THEN 5 WHEN 'warning' THEN 3 ELSE 1 END AS w FROM made)
        SELECT host, CAST(sum(w) AS BIGINT) AS score, count(*) AS findings, count(DISTINCT kind) AS kinds, arg_max(s, (w, s)) AS worst FROM w GROUP BY 1""",
    "risk_posture": _MADE
    + """, r AS (SELECT host, count(CASE WHEN kind = 'purchase' THEN 1 END) - 10 AS p, count(CASE WHEN kind = 'error' THEN 1 END) - 12 AS e, greatest(count(CASE WHEN kind = 'click' THEN 1 END) - 12, 0) AS c,
            count(CASE WHEN kind = 'signup' THEN 1 END) - 14 AS s, count(CASE WHEN kind = 'view' THEN 1 END) - 11 AS v FROM made GROUP BY 1)
        SELECT host, CAST(least(100, 30 * (p > 0)::INT + 25 * (e > 0)::INT + least(15, 3 * c) + 10 * (s > 0)::INT + 5 * (v > 0)::INT) AS INTEGER) AS risk FROM r""",
    "multi_stage": _MADE
    + """SELECT host, count(DISTINCT stage) AS stages, array_to_string(list_sort(list(DISTINCT stage)), ',') AS which, count(*) AS findings FROM made
        WHERE stage IS NOT NULL AND ts < TIMESTAMP '2024-01-10' GROUP BY 1 HAVING count(DISTINCT stage) >= 3""",
    "collapsed_findings": _MADE + "SELECT host, kind, count(*) AS times, min(epoch_us(ts)) AS first_micros, max(epoch_us(ts)) AS last_micros FROM made GROUP BY 1, 2",
    "first_findings": _MADE + "SELECT host, kind, arg_min(event_id, (ts, event_id)) AS event_id FROM made GROUP BY 1, 2",
    "presence_correlation": """SELECT sha256(text) AS sha256, count(DISTINCT source) AS captures, count(*) AS seen FROM documents GROUP BY 1 HAVING count(DISTINCT source) >= 2""",
    "string_runs": r"""SELECT page_id, CAST(len(regexp_extract_all(html, '[\x20-\x7E]{4,}')) AS INTEGER) AS runs, coalesce(regexp_extract_all(html, '[\x20-\x7E]{4,}')[1][:200], '') AS first_run FROM pages""",
    "secret_key_values": r"""SELECT * FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)[ ]*[:=][ ]*[^ \t\r\n]{6,}')) AS INTEGER) AS hits FROM documents) WHERE hits > 0""",
    "file_types": "SELECT CASE WHEN starts_with(html, '<!DOCTYPE html') OR starts_with(html, '<html') THEN 'HTML' ELSE 'BINARY' END AS file_type, count(*) AS files FROM pages GROUP BY 1",
    "url_parts": rf"""SELECT page_id, {_HOST} AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages""",
    "tld_counts": f"SELECT coalesce(nullif(string_split(h, '.')[-1], ''), '-') AS tld, count(*) AS hits FROM (SELECT {_HOST} AS h FROM pages) GROUP BY 1",
    "request_scores": f"""SELECT page_id, CAST(s AS INTEGER) AS score, CASE WHEN s >= 6 THEN 'high' WHEN s >= 3 THEN 'medium' ELSE 'low' END AS level
        FROM (SELECT page_id, {_RISKY} + {_NAMED} AS s FROM pages)""",
    "payload_search": """SELECT doc_id, CAST(p AS INTEGER) AS place, substring(text, greatest(p - 20, 1), p - greatest(p - 20, 1) + 24) AS context
        FROM (SELECT doc_id, text, strpos(lower(text), 'that') AS p FROM documents) WHERE p > 0""",
    "ip_scopes": """WITH a AS (SELECT event_id % 7 = 0 AS six, event_id % 77 // 11 AS s, event_id % 13 AS f, event_id FROM events),
        b AS (SELECT CASE WHEN six THEN (['::1', 'fe80::7', 'ff02::fb', 'fd00::12', '2001:4860::8888', '::', 'nonsense'])[s + 1]
                     ELSE (['10.0', '172.16', '172.32', '192.168', '192.169', '127.9', '169.254', '224.0', '239.255', '240.1', '8.8', '0.0', '300.1'])[f + 1] || '.' || (event_id // 256 % 256) || '.' || (event_id % 256) END AS address,
                CASE WHEN six THEN (['loopback', 'link-local', 'multicast', 'internal', 'public', 'unknown', 'unknown'])[s + 1]
                     WHEN f = 11 AND event_id % 65536 = 0 THEN 'unknown'
                     ELSE (['internal', 'internal', 'public', 'internal', 'public', 'loopback', 'link-local', 'multicast', 'multicast', 'public', 'public', 'public', 'unknown'])[f + 1] END AS scope,
                CASE WHEN six THEN 'unknown' WHEN f = 11 AND event_id % 65536 = 0 THEN 'unspecified'
                     ELSE (['private', 'private', 'public', 'private', 'public', 'loopback', 'link_local', 'multicast', 'multicast', 'public', 'public', 'public', 'unknown'])[f + 1] END AS category FROM a)
        SELECT scope, category, count(*) AS addresses, min(address) AS least FROM b GROUP BY 1, 2""",
    "nation_roles": """WITH c AS (SELECT DISTINCT c_nationkey AS n FROM customer), s AS (SELECT DISTINCT s_nationkey AS n FROM supplier)
        SELECT coalesce(c.n, s.n) AS nation, CASE WHEN s.n IS NULL THEN 'clients' WHEN c.n IS NULL THEN 'servers' ELSE 'both' END AS role FROM c FULL OUTER JOIN s ON c.n = s.n""",
}
