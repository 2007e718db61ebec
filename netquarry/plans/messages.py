"""Queries of the message extracts, on payloads made of the driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import messages
from .catalogue import _table
from .wire import _hex, _packets


def _events(spark: SparkSession, sf_dir: str, **columns: Column) -> DataFrame:
    user = F.concat(F.lit("u"), F.col("user_id"))
    return _packets(_table(spark, sf_dir, "events"), **({"pkt_no": F.col("event_id"), "src": user} | columns))


def _kinds(**values: str) -> Column:
    """A value for each kind of event; null for the others."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), F.col("event_type"))


def _line(*parts: Column) -> Column:
    return F.concat(*parts).cast("binary")


def _syslog(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _line(F.lit("<"), (F.col("doc_id") % 200).cast("string"), F.lit(">"), F.coalesce("text", F.lit("")))
    found = messages.syslog(_packets(_table(spark, sf_dir, "documents"), pkt_no=F.col("doc_id"), dport=F.lit(514), payload=line))
    return found.groupBy("facility", "severity").agg(F.count(F.lit(1)).alias("messages"), F.sum("bytes").alias("bytes"))


def _ssh(spark: SparkSession, sf_dir: str) -> DataFrame:
    banner = F.when(F.col("event_type") != "view", F.concat(F.lit("SSH-2.0-server_"), F.col("event_type"), F.lit(" some comment\r\n"))).otherwise("GET / HTTP/1.1\r\n")
    found = messages.ssh_banners(_events(spark, sf_dir, payload=banner.cast("binary")))
    return found.groupBy("version", "software").agg(F.count(F.lit(1)).alias("banners"), F.count_distinct("src").alias("hosts"))


def _ftp(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = F.col("event_type").isin("error", "signup")
    user, server = F.concat(F.lit("u"), F.col("user_id")), F.lit("files")
    line = _kinds(error="530 no\r\n", signup="230 welcome\r\n", purchase="STOR a b.txt\r\n", click="retr x\r\n", view="USER ")
    line = F.when(F.col("event_type") == "view", F.concat(line, F.col("event_id") % 7, F.lit("\r\n"))).otherwise(line)
    rows = _events(
        spark, sf_dir, payload=line.cast("binary"), src=F.when(back, server).otherwise(user), dst=F.when(back, user).otherwise(server),
        sport=F.when(back, 21).otherwise(40_000), dport=F.when(back, 40_000).otherwise(21),
    )
    return messages.logins(messages.ftp(rows), 12)


def _mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.when(F.col("event_type") == "signup", "MAIL FROM:<").when(F.col("event_type") == "purchase", "rcpt to: <").otherwise("NOOP <"), F.lit("Name"), F.col("user_id"), F.lit("@Example.org>\r\n"))
    found = messages.mail_envelopes(_events(spark, sf_dir, payload=line.cast("binary"), dport=F.lit(25)))
    return found.groupBy("address").agg(F.count(F.when(F.col("role") == "sender", 1)).alias("sent"), F.count(F.when(F.col("role") == "recipient", 1)).alias("received"))


def _credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.concat(F.lit("user"), F.col("user_id"), F.when(F.col("event_type") == "view", "").otherwise(":"), F.lit("p:"), F.col("event_id"))
    pair = F.when(F.col("event_type") == "error", F.lit("nocolon")).otherwise(pair)
    request = _line(F.lit("GET / HTTP/1.1\r\nauthorization: basic "), F.base64(pair.cast("binary")), F.lit("\r\n\r\n"))
    return messages.basic_credentials(_events(spark, sf_dir, payload=request)).select(F.col("pkt_no").alias("event_id"), "user", "password")


def _icmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = _kinds(view="0800", click="0800", error="0301", signup="0000", purchase="FF00")
    payload = F.unhex(F.concat(head, F.lit("0" * 12), F.repeat(F.lit("41"), F.col("value").cast("int"))))
    return messages.icmp(_events(spark, sf_dir, payload=payload, transport=F.lit("ICMP"), dst=F.concat(F.lit("h"), F.col("event_id") % 25)))


def _ntp(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.unhex(F.concat(_hex(F.col("event_id") % 64, 2), _hex(F.col("user_id") % 4, 2)))
    found = messages.ntp(_events(spark, sf_dir, payload=payload, transport=F.lit("UDP"), dport=F.lit(123)))
    return found.groupBy("version", "mode", "stratum").agg(F.count(F.lit(1)).alias("packets"))


def _snmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("event_type") == "error", "public").otherwise(F.concat(F.lit("c"), F.col("user_id") % 9))
    rest = F.concat(F.lit("0201"), _hex(F.col("event_id") % 4, 2), F.lit("04"), _hex(F.length(name), 2), F.hex(name), F.lit("A000"))
    payload = F.unhex(F.concat(F.lit("30"), _hex(F.length(rest) / 2, 2), rest))
    found = messages.snmp(_events(spark, sf_dir, payload=payload, transport=F.lit("UDP"), dport=F.lit(161)))
    return found.groupBy("version", "community").agg(F.count(F.lit(1)).alias("packets"))


def _vlans(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.when(F.col("event_type") == "view", F.array((F.col("event_id") % 3).cast("int"))).when(F.col("event_type") == "error", F.array(F.lit(1), F.lit(9))).otherwise(F.array().cast("array<int>"))
    return messages.in_vlans(_events(spark, sf_dir, vlan_ids=tags), 3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "syslog_severities": _syslog,
    "ssh_banners": _ssh,
    "ftp_logins": _ftp,
    "mail_addresses": _mail,
    "basic_credentials": _credentials,
    "icmp_kinds": lambda s, d: _icmp(s, d).groupBy("type", "code", "name").agg(F.count(F.lit(1)).alias("packets"), F.sum("bytes").alias("bytes")),
    "echo_hosts": lambda s, d: messages.echo_hosts(_icmp(s, d), 12, 50),
    "ntp_modes": _ntp,
    "snmp_communities": _snmp,
    "vlan_hosts": _vlans,
}

_IS = lambda *kinds: f"event_type IN ({', '.join(map(repr, kinds))})"
_N = lambda *kinds: f"count(CASE WHEN event_type IN ({', '.join(map(repr, kinds))}) THEN 1 END)"

ORACLE_SQL: dict[str, str] = {
    "syslog_severities": """SELECT CAST(doc_id % 200 // 8 AS INTEGER) AS facility, CAST(doc_id % 200 % 8 AS INTEGER) AS severity, count(*) AS messages, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes
        FROM documents WHERE doc_id % 200 <= 191 GROUP BY 1, 2""",
    "ssh_banners": "SELECT '2.0' AS version, 'server_' || event_type AS software, count(*) AS banners, count(DISTINCT user_id) AS hosts FROM events WHERE event_type <> 'view' GROUP BY 2",
    "ftp_logins": f"""SELECT 'u' || user_id AS client, 'files' AS server, count(DISTINCT CASE WHEN event_type = 'view' THEN event_id % 7 END) AS users, {_N('error')} AS failures, {_N('signup')} AS successes,
        {_N('purchase')} AS uploads, {_N('click')} AS downloads, {_N('error')} >= 12 AS guessed FROM events GROUP BY user_id""",
    "mail_addresses": f"SELECT 'name' || user_id || '@example.org' AS address, {_N('signup')} AS sent, {_N('purchase')} AS received FROM events WHERE {_IS('signup', 'purchase')} GROUP BY 1",
    "basic_credentials": """SELECT event_id, CASE WHEN event_type = 'view' THEN 'user' || user_id || 'p' ELSE 'user' || user_id END AS user,
        CASE WHEN event_type = 'view' THEN '' ELSE 'p:' END || event_id AS password FROM events WHERE event_type <> 'error'""",
    "icmp_kinds": """SELECT CASE event_type WHEN 'error' THEN 3 WHEN 'signup' THEN 0 WHEN 'purchase' THEN 255 ELSE 8 END AS type, CASE event_type WHEN 'error' THEN 1 ELSE 0 END AS code,
        CASE event_type WHEN 'error' THEN 'unreachable' WHEN 'signup' THEN 'echo_reply' WHEN 'purchase' THEN 'other' ELSE 'echo' END AS name, count(*) AS packets, CAST(sum(CAST(trunc(value) AS BIGINT)) AS BIGINT) AS bytes
        FROM events GROUP BY 1, 2, 3""",
    "echo_hosts": """SELECT 'u' || user_id AS src, count(*) AS echoes, count(DISTINCT event_id % 25) AS targets, count(CASE WHEN trunc(value) > 50 THEN 1 END) AS large, count(DISTINCT event_id % 25) >= 12 AS sweep,
        2 * count(CASE WHEN trunc(value) > 50 THEN 1 END) > count(*) AS tunnel FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id""",
    "ntp_modes": """SELECT CAST(event_id % 64 // 8 AS INTEGER) AS version, ['reserved', 'symmetric_active', 'symmetric_passive', 'client', 'server', 'broadcast', 'control', 'private'][event_id % 8 + 1] AS mode,
        CAST(user_id % 4 AS INTEGER) AS stratum, count(*) AS packets FROM events GROUP BY 1, 2, 3""",
    "snmp_communities": """SELECT CASE event_id % 4 WHEN 0 THEN '1' ELSE '2c' END AS version, CASE WHEN event_type = 'error' THEN 'public' ELSE 'c' || (user_id % 9) END AS community, count(*) AS packets
        FROM events WHERE event_id % 4 < 2 GROUP BY 1, 2""",
    "vlan_hosts": f"""SELECT 'u' || user_id AS src, count(DISTINCT CASE WHEN event_type = 'error' THEN 1 ELSE event_id % 3 END) AS vlans, count(*) AS packets, {_N('error')} AS stacked
        FROM events WHERE {_IS('view', 'error')} GROUP BY user_id HAVING count(DISTINCT CASE WHEN event_type = 'error' THEN 1 ELSE event_id % 3 END) >= 3""",
}
