"""Queries of the session, host and label operators, bound to the driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import sessions, timing
from .catalogue import _FLOWS, _flows, _table

_AS_OF = "1995-06-17"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events")


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with narrow ports on both sides."""
    return _flows(spark, sf_dir).withColumns({"sport": (F.col("l_orderkey") * 7) % 65536, "dport": (F.col("dport") * 31) % 65536})


_PORTS = _FLOWS + ", ports AS (SELECT src, dst, l_orderkey * 7 % 65536 AS sport, dport * 31 % 65536 AS dport FROM flows) "


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.transfers(_flows(spark, sf_dir), ["src", "dst"], F.col("transport") == "N")


_SESSIONS = _FLOWS + """, sessions AS (SELECT src, dst, CAST(coalesce(sum(CASE WHEN transport = 'N' THEN bytes END), 0) AS BIGINT) AS sent,
    CAST(coalesce(sum(CASE WHEN transport <> 'N' THEN bytes END), 0) AS BIGINT) AS received FROM flows GROUP BY 1, 2) """


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on users, their kinds of events as tactics."""
    n = lambda test: F.count(F.when(test, 1))
    kind = F.col("event_type")
    rows = _events(spark, sf_dir).where("value > 45").groupBy("user_id").agg(
        (F.bool_or(kind == "purchase").cast("int") + F.bool_or(kind == "error").cast("int")).alias("objectives"), F.count_distinct("event_type").alias("tactics"),
        n(F.col("value") > 95).alias("confident"), n(F.col("value") > 98).alias("corroborated"), n(kind == "signup").alias("control"), n(kind == "view").alias("implausible"),
    )
    score, verdict = sessions.intrusion_verdict(*map(F.col, ("objectives", "tactics", "confident", "corroborated", "control", "implausible")))
    return rows.select("user_id", score.cast("int").alias("score"), verdict.alias("verdict"))


def _exfiltration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on sources by three signals of their sessions."""
    rows = _sessions(spark, sf_dir).groupBy("src").agg(F.sum("sent").alias("sent"), F.sum("received").alias("received"), F.max("sent").alias("largest"))
    point = lambda test, n: F.when(test, n).otherwise(0)
    points = point(F.col("sent") > F.col("received"), 3) + point(F.col("largest") >= 50, 2) + point(F.col("sent") >= 1_000, 2)
    return rows.select("src", points.cast("int").alias("points"), sessions.exfiltration_verdict(points).alias("verdict"))


def _synchronized(spark: SparkSession, sf_dir: str) -> DataFrame:
    peers = timing.intervals(_events(spark, sf_dir), ["user_id", "event_type"])
    return _rounded(sessions.synchronized(peers, "user_id", "mean_gap"), "center", digits=3)


def _validities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity of certificates, made of when lines were ordered and shipped."""
    ends = [F.col(c).cast("date") for c in ("o_orderdate", "l_shipdate")]
    state = labels.validity(*ends, F.lit(_AS_OF).cast("date"))
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate").join(orders, "l_orderkey").select(state.alias("state"), F.datediff(ends[1], ends[0]).cast("long").alias("days"))
    return rows.groupBy("state").agg(F.count(F.lit(1)).alias("certificates"), F.min("days").alias("shortest"), F.max("days").alias("longest"))


def _newcomers(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = lambda y: _table(spark, sf_dir, "orders").where(F.year("o_orderdate") == y)
    return sessions.newcomers(year(1996), year(1995), "o_custkey")


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as public keys of six kinds and eight sizes."""
    kind = F.element_at(F.array(*map(F.lit, ("RSA", "DSA", "ECPublicKey", "ECDSA", "Ed25519", "other"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    bits = F.element_at(F.array(*map(F.lit, (0, 192, 255, 256, 512, 1_024, 2_048, 4_096))), (F.col("p_size") % 8 + 1).cast("int"))
    return _table(spark, sf_dir, "part").groupBy(kind.alias("kind"), bits.alias("bits"), labels.weak_key(kind, bits).alias("weak")).agg(F.count(F.lit(1)).alias("keys"))


def _macs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as hardware addresses in five forms, one of them cut short."""
    digits = F.lpad(F.hex(F.col("c_custkey") * 7_919), 12, "0")
    pairs = lambda sign: F.regexp_replace(digits, "(..)(?=.)", f"$1{sign}")
    form = F.when(F.col("c_custkey") % 5 == 0, pairs("-")).when(F.col("c_custkey") % 5 == 1, F.lower(pairs(":"))).when(F.col("c_custkey") % 5 == 2, F.concat(F.lit(" "), F.regexp_replace(digits, "(....)(?=.)", "$1."), F.lit(" ")))
    given = form.when(F.col("c_custkey") % 5 == 3, digits).otherwise(F.substring(digits, 2, 11))
    return _table(spark, sf_dir, "customer").select("c_custkey", labels.mac_address(given).alias("mac"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files of seven names and four kinds of contents."""
    name = F.element_at(F.array(*map(F.lit, ("image.gif", "setup.exe", "a.tar.JPG", "lib.so", "noextension", "dir.d/readme", "dir.d/read.me"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("EXE/DLL", "elf", "PNG", "ZIP/Office"))), (F.col("p_size") % 4 + 1).cast("int"))
    return _table(spark, sf_dir, "part").groupBy(name.alias("name"), kind.alias("file_type"), labels.masquerade(name, kind).alias("masquerade")).agg(F.count(F.lit(1)).alias("files"))


def _grease(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items' numbers as TLS numbers in lists by order, of which the reserved ones are left out."""
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list((F.col("l_partkey") * 2_570 % 65_536).cast("int")).alias("values"))
    return rows.groupBy(F.size("values").alias("given"), F.size(labels.without_grease(F.col("values"))).alias("kept")).agg(F.count(F.lit(1)).alias("lists"))


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    digest = lambda c: F.sha2(c, 256)
    return _table(spark, sf_dir, "documents").select("doc_id", digest(labels.shifted(text, 13)).alias("rot13"), digest(labels.shifted(text, -3)).alias("caesar"), digest(labels.mirrored(text)).alias("atbash"))


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html").cast("binary")
    rows = _table(spark, sf_dir, "pages").select("page_id", F.round(labels.printable_share(html), 9).alias("printable"), labels.dense_by_design(html).alias("dense"))
    return rows.withColumn("entropy_counts", ~F.col("dense") & (F.col("printable") < 0.999))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "selected_packets": lambda s, d: sessions.selected(_flows(s, d).withColumn("day", F.col("ts").cast("date")), F.lit("1995-01-01").cast("date"), F.lit("1995-12-31").cast("date"), host=7, ts="day").select("src", "dst", "dport", "bytes"),
    "timeline_categories": lambda s, d: sessions.of_categories(_events(s, d), "event_type", ["Sign-up", "PURCHASE"]).select("event_id", "event_type"),
    "timeline_other_categories": lambda s, d: sessions.of_categories(_events(s, d), "event_type", ["Sign-up", "PURCHASE"], invert=True).groupBy("event_type").agg(F.count(F.lit(1)).alias("events")),
    "initiators": lambda s, d: _ports(s, d).where(labels.starts_exchange(F.col("sport"), F.col("dport"))).groupBy("src").agg(F.count(F.lit(1)).alias("started")),
    "served_ports": lambda s, d: _ports(s, d).where(labels.to_service(F.col("sport"), F.col("dport"), list(range(400, 2600)))).groupBy("dst").agg(F.count(F.lit(1)).alias("packets")),
    "service_names": lambda s, d: _ports(s, d).select(labels.service_name(F.col("sport") % 900, F.col("dport") % 900).alias("service")).groupBy("service").agg(F.count(F.lit(1)).alias("packets")),
    "system_hints": lambda s, d: sessions.commonest(_flows(s, d).withColumn("ttl", F.col("bytes") * 5), "src", "ttl").select("src", labels.system_hint(F.col("ttl")).alias("hint")),
    "attack_stages": lambda s, d: _table(s, d, "documents").groupBy(labels.attack_stage(F.col("text")).alias("stage")).agg(F.count(F.lit(1)).alias("texts")),
    "weak_keys": _keys,
    "mac_forms": _macs,
    "masquerades": _files,
    "certificate_validities": _validities,
    "content_checks": _contents,
    "encoded_runs": lambda s, d: _table(s, d, "documents").select("doc_id", labels.encoded_runs(F.col("text"), 20).alias("runs")).where("runs > 0"),
    "classical_decodes": _decoded,
    "grease_values": _grease,
    "upload_sessions": lambda s, d: sessions.uploads(_sessions(s, d), 50),
    "response_heavy_sessions": lambda s, d: sessions.response_heavy(_sessions(s, d), 50),
    "control_ratios": lambda s, d: _rounded(sessions.control_ratios(_events(s, d), "user_id", F.col("event_type").isin("purchase", "signup"), 20, 0.3), "ratio"),
    "transactions": lambda s, d: sessions.transactions(_events(s, d), ["user_id"], "event_type", "signup", "purchase", 86_400),
    "answered_challenges": lambda s, d: sessions.answered_challenges(_events(s, d), ["user_id"], "event_type", "view", "purchase", "value"),
    "first_gap_beacons": lambda s, d: _rounded(sessions.first_gap_beacons(_events(s, d), ["user_id"], "value", variation=1.0), "mean_gap", "mean_size", "variation", digits=3),
    "external_beacons": lambda s, d: _rounded(sessions.first_gap_beacons(_events(s, d), ["user_id"], "value", gaps=10_000, variation=1.1, external=F.col("user_id") % 3 == 0, bounds=(1.0, 300_000.0)), "mean_gap", "mean_size", "variation", digits=3),
    "synchronized_peers": _synchronized,
    "address_owners": lambda s, d: sessions.owners(_flows(s, d), "dst", "src"),
    "address_flips": lambda s, d: sessions.flips(_events(s, d), "user_id", "event_type", 3),
    "new_hosts": _newcomers,
    "host_criticality": lambda s, d: sessions.criticality(_flows(s, d).withColumn("dport", F.col("dport") % 700), "dst", "dport").select("dst", F.col("boost").cast("int").alias("boost")),
    "intrusion_verdicts": _verdicts,
    "exfiltration_verdicts": _exfiltration,
    "evidence_samples": lambda s, d: sessions.evidence(_events(s, d).withColumn("item", F.concat_ws(" ", "event_type", "props")), ["user_id"], "item"),
    "exported_findings": lambda s, d: sessions.exported(_events(s, d).where("event_type = 'error'").select("event_id", "user_id", "event_type"), "events"),
}

_CASES = lambda test, start=0: " ".join(test(*x) for x in labels.STAGE_WORDS[start:])
_STAGES = _CASES(lambda stage, words: "WHEN " + " OR ".join(f"contains(t, '{w}')" for w in words) + f" THEN '{stage}'")
_NAMES = "CASE {} " + " ".join(f"WHEN {p} THEN '{n}'" for p, n in labels.SERVICES.items()) + " END"
_AMPLIFY = "(" + ", ".join(map(str, labels.AMPLIFIERS)) + ")"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MOVED = lambda n: f"sha256(translate(coalesce(text, ''), '{_UP + _LOW}', '{_UP[n:] + _UP[:n] + _LOW[n:] + _LOW[:n]}'))"
_GAPS = """WITH g AS (SELECT user_id, value, row_number() OVER w AS n, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS gap FROM events WHERE {where} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, count(gap) AS gaps, avg(gap) AS m, stddev_pop(gap) AS d, avg(value) AS v FROM g WHERE n <= {most} GROUP BY 1)
    SELECT user_id, gaps, round(m, 3) AS mean_gap, round(v, 3) AS mean_size, round(d / m, 3) AS variation FROM s WHERE gaps >= 6 AND m >= 1 AND d / m < {variation} AND v <= 1024 {also}"""

ORACLE_SQL: dict[str, str] = {
    "selected_packets": _FLOWS + "SELECT src, dst, dport, bytes FROM flows WHERE CAST(ts AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-12-31' AND 7 IN (src, dst)",
    "timeline_categories": "SELECT event_id, event_type FROM events WHERE event_type IN ('signup', 'purchase')",
    "timeline_other_categories": "SELECT event_type, count(*) AS events FROM events WHERE event_type NOT IN ('signup', 'purchase') GROUP BY 1",
    "initiators": _PORTS
    + f"""SELECT src, count(*) AS started FROM ports WHERE CASE WHEN dport IN {_AMPLIFY} AND sport NOT IN {_AMPLIFY} THEN true WHEN sport IN {_AMPLIFY} AND dport NOT IN {_AMPLIFY} THEN false
        WHEN dport <= 1024 AND sport > 1024 THEN true WHEN sport <= 1024 AND dport > 1024 THEN false WHEN dport <= 49151 AND sport > 49151 THEN true
        WHEN sport <= 49151 AND dport > 49151 THEN false ELSE sport <> dport END GROUP BY 1""",
    "served_ports": _PORTS + "SELECT dst, count(*) AS packets FROM ports WHERE dport BETWEEN 400 AND 2599 OR (sport BETWEEN 400 AND 2599 AND dport >= 32768) GROUP BY 1",
    "service_names": _PORTS + f"SELECT coalesce({_NAMES.format('sport % 900')}, {_NAMES.format('dport % 900')}) AS service, count(*) AS packets FROM ports GROUP BY 1",
    "system_hints": _FLOWS
    + """, c AS (SELECT src, bytes * 5 AS ttl, count(*) AS n FROM flows GROUP BY 1, 2), m AS (SELECT src, arg_min(ttl, (-n, ttl)) AS ttl FROM c GROUP BY 1)
        SELECT src, CASE WHEN ttl <= 0 THEN '-' ELSE CASE WHEN ttl <= 64 THEN 'Linux/Unix-like' WHEN ttl <= 128 THEN 'Windows-like' ELSE 'Network/embedded device' END || ' (TTL~' || ttl || ')' END AS hint FROM m""",
    "attack_stages": f"SELECT CASE {_STAGES} ELSE 'other' END AS stage, count(*) AS texts FROM (SELECT lower(coalesce(text, '')) AS t FROM documents) GROUP BY 1",
    "weak_keys": """SELECT kind, bits, bits > 0 AND bits < CASE kind WHEN 'RSA' THEN 2048 WHEN 'DSA' THEN 2048 WHEN 'ECPublicKey' THEN 256 WHEN 'ECDSA' THEN 256 WHEN 'Ed25519' THEN 0 ELSE 1024 END AS weak, count(*) AS keys
        FROM (SELECT (['RSA', 'DSA', 'ECPublicKey', 'ECDSA', 'Ed25519', 'other'])[p_partkey % 6 + 1] AS kind, ([0, 192, 255, 256, 512, 1024, 2048, 4096])[p_size % 8 + 1]::INTEGER AS bits FROM part) GROUP BY ALL""",
    "mac_forms": """SELECT c_custkey, CASE WHEN c_custkey % 5 < 4 THEN d[1:2] || ':' || d[3:4] || ':' || d[5:6] || ':' || d[7:8] || ':' || d[9:10] || ':' || d[11:12] END AS mac
        FROM (SELECT c_custkey, lower(lpad(to_hex(c_custkey * 7919), 12, '0')) AS d FROM customer)""",
    "masquerades": """SELECT name, file_type, file_type IN ('EXE/DLL', 'elf') AND name IN ('image.gif', 'a.tar.JPG', 'dir.d/read.me') AS masquerade, count(*) AS files
        FROM (SELECT (['image.gif', 'setup.exe', 'a.tar.JPG', 'lib.so', 'noextension', 'dir.d/readme', 'dir.d/read.me'])[p_partkey % 7 + 1] AS name, (['EXE/DLL', 'elf', 'PNG', 'ZIP/Office'])[p_size % 4 + 1] AS file_type FROM part) GROUP BY ALL""",
    "certificate_validities": f"""SELECT CASE WHEN a IS NULL OR b IS NULL THEN 'unknown' WHEN a > b THEN 'inverted' WHEN a > DATE '{_AS_OF}' THEN 'not_yet_valid' WHEN b < DATE '{_AS_OF}' THEN 'expired' ELSE 'valid' END AS state,
        count(*) AS certificates, min(b - a) AS shortest, max(b - a) AS longest FROM (SELECT CAST(o_orderdate AS DATE) AS a, CAST(l_shipdate AS DATE) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1""",
    "content_checks": r"""SELECT page_id, printable, false AS dense, printable < 0.999 AS entropy_counts FROM (SELECT page_id,
        CASE WHEN strlen(html) > 0 THEN round(length(regexp_replace(html, '[^\x20-\x7E\t\r\n]', '', 'g')) / strlen(html), 9) ELSE 0e0 END AS printable FROM pages)""",
    "encoded_runs": "SELECT * FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9+/]{20,}={0,2}')) AS INTEGER) AS runs FROM documents) WHERE runs > 0",
    "classical_decodes": f"SELECT doc_id, {_MOVED(13)} AS rot13, {_MOVED(23)} AS caesar, sha256(translate(coalesce(text, ''), '{_UP + _LOW}', '{_UP[::-1] + _LOW[::-1]}')) AS atbash FROM documents",
    "grease_values": """SELECT given, kept, count(*) AS lists FROM (
            SELECT l_orderkey, count(*)::INTEGER AS given, count(CASE WHEN v NOT IN (2570, 6682, 10794, 14906, 19018, 23130, 27242, 31354, 35466, 39578, 43690, 47802, 51914, 56026, 60138, 64250) THEN 1 END)::INTEGER AS kept
            FROM (SELECT l_orderkey, l_partkey * 2570 % 65536 AS v FROM lineitem) GROUP BY 1) GROUP BY 1, 2""",
    "upload_sessions": _SESSIONS + "SELECT * FROM sessions WHERE sent >= 50 AND sent > 3 * received",
    "response_heavy_sessions": _SESSIONS + "SELECT * FROM sessions WHERE received > 50 AND received > 5 * sent",
    "control_ratios": """SELECT * FROM (SELECT user_id, count(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 END) AS controls, count(*) AS messages,
        round(count(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 END) / count(*), 6) AS ratio FROM events GROUP BY 1) WHERE controls >= 20 AND ratio >= 0.3""",
    "transactions": """WITH r AS (SELECT user_id, event_type AS kind, event_id AS answer, epoch_us(ts) AS m FROM events WHERE event_type IN ('signup', 'purchase')),
        p AS (SELECT a.user_id, a.answer, a.m, max((b.m, b.answer, b.kind)) AS before FROM r a JOIN r b ON a.user_id = b.user_id AND (b.m, b.answer) < (a.m, a.answer) WHERE a.kind = 'purchase' GROUP BY ALL)
        SELECT user_id, before[2] AS request, answer, m - before[1] AS waited FROM p WHERE before[3] = 'signup' AND m - before[1] <= 86400000000""",
    "answered_challenges": """SELECT a.user_id, a.event_id, arg_max(c.event_id, (c.ts, c.event_id)) AS challenge, CASE WHEN any_value(a.value) > 24 THEN 'v2' ELSE 'v1' END AS version
        FROM events a JOIN events c ON a.user_id = c.user_id AND c.event_type = 'view' AND (c.ts, c.event_id) < (a.ts, a.event_id) WHERE a.event_type = 'purchase' GROUP BY 1, 2""",
    "first_gap_beacons": _GAPS.format(where="true", most=26, variation="1e0", also=""),
    "external_beacons": _GAPS.format(where="user_id % 3 = 0", most=10_001, variation="1.1e0", also="AND m <= 300000"),
    "synchronized_peers": """WITH g AS (SELECT user_id, event_type, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) / 1e6 AS gap FROM events),
        m AS (SELECT user_id, event_type, avg(gap) AS m FROM g GROUP BY 1, 2 HAVING avg(gap) > 0), c AS (SELECT user_id, median(m) AS center FROM m GROUP BY 1 HAVING count(*) >= 2)
        SELECT user_id, round(center, 3) AS center, count(*) AS close FROM m JOIN c USING (user_id) WHERE abs(m - center) / greatest(center, 1e0) <= 0.2e0 GROUP BY ALL HAVING count(*) >= 2""",
    "address_owners": _FLOWS
    + """, p AS (SELECT dst, src, count(*) AS n FROM flows GROUP BY 1, 2) SELECT dst, count(*) AS "values", arg_min(src, (-n, src)) AS commonest, CAST(sum(n) AS BIGINT) AS seen FROM p GROUP BY 1""",
    "address_flips": """WITH r AS (SELECT user_id, epoch_us(ts) AS m, event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events)
        SELECT user_id, count(*) AS flips, max(m) - min(m) AS spread FROM r WHERE f GROUP BY 1 HAVING count(*) >= 3""",
    "new_hosts": """SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996 EXCEPT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1995""",
    "host_criticality": _FLOWS
    + """SELECT dst, CAST(3 * bool_or(dport % 700 IN (88, 389, 445, 464, 636))::INT + bool_or(dport % 700 = 22)::INT AS INTEGER) AS boost FROM flows GROUP BY 1""",
    "intrusion_verdicts": """WITH r AS (SELECT user_id, bool_or(event_type = 'purchase')::INT + bool_or(event_type = 'error')::INT AS o, count(DISTINCT event_type) AS t, count(CASE WHEN value > 95 THEN 1 END) AS h,
            count(CASE WHEN value > 98 THEN 1 END) AS c, bool_or(event_type = 'signup')::INT AS x, bool_or(event_type = 'view')::INT AS y FROM events WHERE value > 45 GROUP BY 1),
        s AS (SELECT user_id, t, CAST([0, 2, 3][o + 1] + CASE WHEN t >= 4 THEN 2 WHEN t >= 2 THEN 1 ELSE 0 END + CASE WHEN h >= 3 THEN 2 WHEN h >= 1 THEN 1 ELSE 0 END
            + CASE WHEN c >= 2 THEN 2 WHEN c >= 1 THEN 1 ELSE 0 END + x - y AS INTEGER) AS score FROM r)
        SELECT user_id, score, CASE WHEN t = 0 THEN 'NO MAPPED TTPs' WHEN score >= 6 THEN 'LIKELY INTRUSION' WHEN score >= 3 THEN 'POSSIBLE INTRUSION' ELSE 'LOW-CONFIDENCE SIGNAL' END AS verdict FROM s""",
    "exfiltration_verdicts": _SESSIONS
    + """, p AS (SELECT src, CAST(3 * (sum(sent) > sum(received))::INT + 2 * (max(sent) >= 50)::INT + 2 * (sum(sent) >= 1000)::INT AS INTEGER) AS points FROM sessions GROUP BY 1)
        SELECT src, points, CASE WHEN points >= 7 THEN 'yes' WHEN points >= 5 THEN 'likely' WHEN points >= 3 THEN 'potential' ELSE 'none' END AS verdict FROM p""",
    "evidence_samples": """SELECT user_id, count(DISTINCT i) AS different, array_to_string(list_sort(list(DISTINCT i))[:12], '; ') AS sample
        FROM (SELECT user_id, event_type || ' ' || props AS i FROM events) GROUP BY 1""",
    "exported_findings": """SELECT 'events' AS module, CAST(to_json({'event_id': event_id, 'user_id': user_id, 'event_type': event_type}) AS VARCHAR) AS data FROM events WHERE event_type = 'error'""",
}
