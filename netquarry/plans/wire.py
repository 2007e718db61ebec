"""Queries of the protocol operators: the driver tables are put into messages byte by byte, which the operators take apart again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.network import url_host
from ..functions.payload import url_path, url_query
from ..operators import packets as tcp
from ..operators import protocols
from ..sources import protocols as extracts
from .catalogue import _FLOWS, _HOST, _flows, _table

#: Bytes of a segment that carries a text.
SEGMENT = 100


def _hex(n: Column, digits: int) -> Column:
    return F.lpad(F.hex(n.cast("bigint")), digits, "0")


def _packets(rows: DataFrame, **columns: Column) -> DataFrame:
    given = {"capture": F.lit("made"), "pkt_no": F.lit(0), "ts": F.lit(0.0), "src": F.lit("10.0.0.1"), "sport": F.lit(40_000), "dst": F.lit("10.0.0.2"), "dport": F.lit(80), "transport": F.lit("TCP")} | columns
    return rows.select(*(c.alias(n) for n, c in given.items()))


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").withColumn("host", url_host(F.col("url")))


def _http(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _hosts(spark, sf_dir)
    query = url_query(F.col("url"))
    uri = F.concat(F.when(url_path(F.col("url")) == "", "/").otherwise(url_path(F.col("url"))), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    head = F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1\r\nHost: "), F.col("host"), F.lit("\r\nUser-Agent: made/1\r\ncontent-length:  "), F.col("page_id"), F.lit("\r\n\r\nbody"))
    found = extracts.http_requests(_packets(pages, pkt_no=F.col("page_id"), payload=head.cast("binary")))
    return found.select(F.col("pkt_no").alias("page_id"), "method", "uri", "host", "user_agent", "content_length")


def _dns_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for each page's host under one of 40 numbers. Every other one is answered with a code; answers to every tenth from 3 on come before the query."""
    labels = F.transform(F.split("host", r"\."), lambda x: F.concat(_hex(F.octet_length(x), 2), F.hex(x)))
    name = F.concat(F.array_join(labels, ""), F.lit("0000010001"))
    txid, number = F.pmod("page_id", F.lit(40)), F.col("page_id") * 2
    pages = _hosts(spark, sf_dir)
    asked = _packets(
        pages, pkt_no=number, ts=F.col("page_id").cast("double"), transport=F.lit("UDP"), dport=F.lit(53), sport=(40_000 + F.col("page_id") % 7).cast("int"),
        payload=F.unhex(F.concat(_hex(txid, 4), F.lit("01000001000000000000"), name)),
    )
    flags = F.concat(F.lit("818"), F.hex(F.pmod("page_id", F.lit(4))))
    early = F.col("page_id") % 10 == 3
    answered = _packets(
        pages.where((F.col("page_id") % 2 == 0) | early), pkt_no=number + 1, ts=F.col("page_id") + F.when(early, -0.25).otherwise(0.5), transport=F.lit("UDP"), src=F.lit("10.0.0.2"), sport=F.lit(53),
        dst=F.lit("10.0.0.1"), dport=F.lit(40_000), payload=F.unhex(F.concat(_hex(txid, 4), flags, F.lit("0001000100000000"), name)),
    )
    return extracts.dns(asked.unionByName(answered))


def _dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = protocols.dns_exchanges(_dns_messages(spark, sf_dir))
    both = F.col("asked_ts").isNotNull() & F.col("answered_ts").isNotNull()
    return found.groupBy("qname").agg(
        F.count("asked_ts").alias("asked"), F.count(F.when(both, 1)).alias("answered"), F.count(F.when(F.col("asked_ts").isNull(), 1)).alias("orphans"),
        F.count(F.when(both & (F.col("rcode") == 2), 1)).alias("failed"), F.max(F.when(both, F.col("answered_ts") - F.col("asked_ts"))).alias("slowest"),
    )


def _dns_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = protocols.dns_clients(_dns_messages(spark, sf_dir), least_unique=0.01, long_label=4)
    return found.select("client", "queries", "names", "domains", "longest_label", "tunnel")


def _tls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hello for each page with one of three cipher lists; reserved numbers stand before them."""
    size = F.octet_length("host")
    name = F.concat(F.lit("0A0A0000"), F.lit("0000"), _hex(size + 5, 4), _hex(size + 3, 4), F.lit("00"), _hex(size, 4), F.hex("host"))
    ciphers = F.concat(F.lit("00060A0A"), _hex(4_865 + F.pmod("page_id", F.lit(3)), 4), F.lit("C02B"))
    body = F.concat(F.lit("0303" + "00" * 32 + "00"), ciphers, F.lit("0100"), _hex(F.length(name) / 2, 4), name)
    hello = F.concat(F.lit("01"), _hex(F.length(body) / 2, 6), body)
    record = F.unhex(F.concat(F.lit("160301"), _hex(F.length(hello) / 2, 4), hello))
    rows = _packets(_hosts(spark, sf_dir), pkt_no=F.col("page_id"), src=F.concat(F.lit("10.0.1."), F.pmod("page_id", F.lit(50))), dport=F.lit(443), payload=record)
    return protocols.fingerprints(extracts.tls_hellos(rows))


def _modbus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of a user, and errors as exceptions that it was given."""
    code = F.when(F.col("event_type") == "signup", "06").when(F.col("event_type") == "purchase", "10").when(F.col("event_type") == "click", "01").when(F.col("event_type") == "error", "83").otherwise("03")
    message = F.unhex(F.concat(_hex(F.pmod("event_id", F.lit(65_536)), 4), F.lit("0000000601"), code, F.lit("000A0002")))
    failed = F.col("event_type") == "error"
    user, server = F.concat(F.lit("u"), F.col("user_id")), F.lit("plc")
    rows = _packets(
        _table(spark, sf_dir, "events"), pkt_no=F.col("event_id"), src=F.when(failed, server).otherwise(user), dst=F.when(failed, user).otherwise(server),
        sport=F.when(failed, 502).otherwise(40_000), dport=F.when(failed, 40_000).otherwise(502), payload=message,
    )
    return protocols.modbus_writers(extracts.modbus(rows), least=10)


def _control(spark: SparkSession, sf_dir: str) -> DataFrame:
    ports = F.array(*map(F.lit, (502, 20_000, 44_818, 80, 443, 102, 47_808)))
    own = _flows(spark, sf_dir)
    server = F.concat(F.when(F.col("dst") % 5 == 0, "8.8.8.").otherwise("192.168.1."), F.col("dst") % 50)
    rows = _packets(own, src=F.concat(F.lit("10.0.0."), F.col("src") % 20), dst=server, dport=F.element_at(ports, (F.col("dport") % 7 + 1).cast("int")), caplen=F.col("bytes"))
    return protocols.control_traffic(rows).drop("capture")


def _reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts sent in segments, captured out of order, some twice; each text is a stream whose sequence numbers may wrap."""
    texts = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data")).where("octet_length(data) > 0")
    parts = texts.select("doc_id", "data", F.explode(F.sequence(F.lit(0), F.ceil(F.octet_length("data") / SEGMENT).cast("int") - 1)).alias("n"))
    parts = parts.select("doc_id", "n", F.substring("data", F.col("n") * SEGMENT + 1, F.lit(SEGMENT)).alias("part"), F.explode(F.when(F.col("n") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    start = F.lit(4_294_967_296 - 5_000)
    number = F.col("n") * 4 + F.when(F.col("n") % 2 == 0, 5).otherwise(0) + F.col("copy") * 6
    rows = _packets(
        parts, capture=F.col("doc_id").cast("string"), pkt_no=number.cast("bigint"), payload=F.col("part"), tcp_flags=F.lit(24),
        tcp_seq=F.pmod(start + F.col("n") * SEGMENT, F.lit(4_294_967_296)), caplen=F.octet_length("part"),
    )
    found = tcp.reassembled_blocks(rows)
    return found.select(F.col("capture").cast("bigint").alias("doc_id"), "block", F.octet_length("data").alias("bytes"), F.sha2("data", 256).alias("sha256"), "gap_bytes")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "http_requests": _http,
    "dns_exchanges": _dns,
    "dns_clients": _dns_clients,
    "tls_fingerprints": _tls,
    "modbus_writers": _modbus,
    "control_traffic": _control,
    "tcp_reassembly": _reassembly,
}

ORACLE_SQL: dict[str, str] = {
    "http_requests": rf"""SELECT page_id, 'GET' AS method, CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS uri, host, 'made/1' AS user_agent, page_id AS content_length
        FROM (SELECT page_id, {_HOST} AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS p, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages)""",
    "dns_exchanges": f"""WITH p AS (SELECT page_id, {_HOST} AS qname FROM pages),
        m AS (SELECT page_id % 40 AS txid, page_id::DOUBLE AS t, FALSE AS answer, qname, NULL AS rcode FROM p
              UNION ALL SELECT page_id % 40, page_id + CASE WHEN page_id % 10 = 3 THEN -0.25e0 ELSE 0.5e0 END, TRUE, qname, page_id % 4 FROM p WHERE page_id % 2 = 0 OR page_id % 10 = 3),
        o AS (SELECT *, lag(answer) OVER w AS before, lead(answer) OVER w AS next, lead(t) OVER w AS next_at, lead(rcode) OVER w AS next_code FROM m WINDOW w AS (PARTITION BY txid ORDER BY t))
        SELECT qname, count(CASE WHEN NOT answer THEN 1 END) AS asked, count(CASE WHEN NOT answer AND next THEN 1 END) AS answered,
               count(CASE WHEN answer AND coalesce(before, TRUE) AND txid <> 0 THEN 1 END) AS orphans, count(CASE WHEN NOT answer AND next AND next_code = 2 THEN 1 END) AS failed,
               max(CASE WHEN NOT answer AND next THEN next_at - t END) AS slowest
        FROM o WHERE NOT answer OR (coalesce(before, TRUE) AND txid <> 0) GROUP BY 1""",
    "dns_clients": f"""SELECT '10.0.0.1' AS client, count(*) AS queries, count(DISTINCT h) AS names, count(DISTINCT array_to_string(string_split(h, '.')[-2:], '.')) AS domains,
        max(length(string_split(h, '.')[1])) AS longest_label, count(*) >= 20 AND count(DISTINCT h) >= 0.01 * count(*) AND max(length(string_split(h, '.')[1])) >= 4 AS tunnel
        FROM (SELECT {_HOST} AS h FROM pages)""",
    "tls_fingerprints": f"""SELECT md5('771,' || (4865 + page_id % 3) || '-49195,0,,') AS ja3_md5, count(*) AS hellos, count(DISTINCT page_id % 50) AS clients, count(DISTINCT {_HOST}) AS server_names
        FROM pages GROUP BY 1""",
    "modbus_writers": """SELECT client, requests, writes, exceptions, writes >= 10 AND writes >= 0.3 * requests AS burst FROM (SELECT 'u' || user_id AS client, count(CASE WHEN event_type <> 'error' THEN 1 END) AS requests,
        count(CASE WHEN event_type IN ('signup', 'purchase') THEN 1 END) AS writes, count(CASE WHEN event_type = 'error' THEN 1 END) AS exceptions FROM events GROUP BY 1) WHERE requests > 0""",
    "control_traffic": _FLOWS
    + """, f AS (SELECT CASE dport % 7 WHEN 0 THEN 'modbus' WHEN 1 THEN 'dnp3' WHEN 2 THEN 'enip' WHEN 5 THEN 's7' WHEN 6 THEN 'bacnet' END AS service, '10.0.0.' || (src % 20) AS client,
            CASE WHEN dst % 5 = 0 THEN '8.8.8.' ELSE '192.168.1.' END || (dst % 50) AS server, dst % 5 = 0 AS public, bytes FROM flows)
        SELECT service, client, server, count(*) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes, public FROM f WHERE service IS NOT NULL GROUP BY ALL""",
    "tcp_reassembly": """SELECT doc_id, CAST(0 AS BIGINT) AS block, CAST(octet_length(encode(text)) AS INTEGER) AS bytes, sha256(text) AS sha256, CAST(0 AS BIGINT) AS gap_bytes FROM documents WHERE text <> ''""",
}
