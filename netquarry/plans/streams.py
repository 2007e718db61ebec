"""Queries of messages out of streams: the driver tables are sent as streams, cut anywhere, which the operators put together again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import framing
from ..operators.packets import reassembled_blocks
from ..operators.requests import request_risks
from ..sources.protocols import MODBUS_COLUMNS, extract, modbus_message
from ..sources.tls import handshakes
from .catalogue import _HOST, _table
from .wire import _hex, _hosts

#: Bytes of a segment, which no message's length is a multiple of, and of a block.
SEGMENT, BLOCK = 601, 8_192


def _blocks(messages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Streams of messages (capture, src, sport, dst, dport, nth, hex): cut into segments, captured out of order, some twice, and put together again."""
    way = ["capture", "src", "sport", "dst", "dport"]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "hex"))), lambda m: m["hex"]), "")
    whole = messages.groupBy(*way).agg(text.alias("all"))
    parts = whole.select(*way, "all", F.explode(F.sequence(F.lit(0), F.floor((F.length("all") - 1) / (2 * segment)))).alias("n"))
    copies = F.explode(F.when(F.col("n") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    parts = parts.select(*way, "n", F.unhex(F.substring("all", (F.col("n") * 2 * segment + 1).cast("int"), F.lit(2 * segment))).alias("payload"), copies)
    number = F.col("n") * 4 + F.when(F.col("n") % 2 == 0, 5).otherwise(0) + F.col("copy") * 6
    packets = parts.select(
        *way, "payload", F.lit("TCP").alias("transport"), F.lit(24).alias("tcp_flags"), (F.col("n") * segment).alias("tcp_seq"), number.alias("pkt_no"),
        F.col("n").cast("double").alias("ts"), F.octet_length("payload").alias("caplen"),
    )
    return reassembled_blocks(packets, BLOCK)


def _text(*parts: Column) -> Column:
    """Texts one after the other, in hexadecimal."""
    return F.concat(*(F.hex(p.cast("string").cast("binary")) for p in parts))


def _http_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five exchanges a connection. Every fifth page is asked for by HEAD, every third otherwise posted to; every second answer is in chunks of 1,000 bytes, every seventh has no body."""
    pages = _table(spark, sf_dir, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    n = F.col("page_id")
    head, posted, empty = n % 5 == 0, (n % 5 != 0) & (n % 3 == 0), n % 7 == 0
    crlf = F.lit("\r\n")
    request = F.concat(
        _text(F.when(head, "HEAD").when(posted, "POST").otherwise("GET"), F.lit(" /page/"), n, F.lit(" HTTP/1.1\r\nHost: made\r\nX-Page:  "), n, crlf),
        F.when(posted, F.concat(_text(F.lit("Content-Length: "), F.octet_length("url"), F.lit("\r\n\r\n")), F.hex(F.col("url").cast("binary")))).otherwise(_text(crlf)),
    )
    size = F.octet_length("html")
    chunk = lambda k: F.substring("html", (k * 1_000 + 1).cast("int"), F.lit(1_000))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / 1_000)), lambda k: F.concat(_text(F.lower(F.hex(F.octet_length(chunk(k)).cast("bigint"))), F.lit(";x=1\r\n")), F.hex(chunk(k)), _text(crlf)))
    chunked = F.concat(_text(F.lit("Transfer-Encoding: chunked\r\n\r\n")), F.when(size > 0, F.array_join(chunks, "")).otherwise(""), _text(F.lit("0\r\nTrailer: y\r\n\r\n")))
    plain = F.concat(_text(F.lit("content-length: "), size, F.lit("\r\n\r\n")), F.when(head, "").otherwise(F.hex("html")))
    answer = F.concat(
        F.when(n % 4 == 0, _text(F.lit("HTTP/1.1 100 Continue\r\n\r\n"))).otherwise(""),
        F.when(empty, _text(F.lit("HTTP/1.1 204 None\r\n\r\n"))).otherwise(F.concat(_text(F.lit("HTTP/1.1 200 OK\r\nServer: made\r\n")), F.when(head | (n % 2 == 1), plain).otherwise(chunked))),
    )
    stream = F.floor(n / 5)
    asked = pages.select(F.lit("made").alias("capture"), F.lit("10.0.0.1").alias("src"), (20_000 + stream).cast("int").alias("sport"), F.lit("10.0.0.2").alias("dst"), F.lit(8_080).alias("dport"), n.alias("nth"), request.alias("hex"))
    told = pages.select(F.lit("made").alias("capture"), F.lit("10.0.0.2").alias("src"), F.lit(8_080).alias("sport"), F.lit("10.0.0.1").alias("dst"), (20_000 + stream).cast("int").alias("dport"), n.alias("nth"), answer.alias("hex"))
    return framing.http_messages(_blocks(asked.unionByName(told)))


def _exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = framing.http_exchanges(_http_messages(spark, sf_dir))
    return found.select(
        F.col("request.headers")["x-page"].cast("bigint").alias("page_id"), "request.method", "request.uri", F.col("request.body_bytes").alias("sent"), "response.status",
        F.col("response.body_bytes").alias("received"), F.col("response.body_sha256").alias("sha256"), (F.col("request.complete") & F.col("response.complete")).alias("complete"), "server_port",
    )


def _risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as requests of eight kinds on one connection each, some of them attacks; their scores."""
    pages = _table(spark, sf_dir, "pages").select("page_id", F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
    n, crlf = F.col("page_id"), F.lit("\r\n")
    target = F.element_at(F.array(*map(F.lit, (
        "/a/b", "/login?user=x&password=y", "/q?id=1;&x=sleep(9)", "/../../etc/passwd", "/go?to=http://127.0.0.1/x", "/up", "/api?Token=", "/run",
    ))), (n % 8 + 1).cast("int"))
    body = F.when(n % 8 == 5, F.repeat(F.lit("Ab1"), 100)).when(n % 8 == 7, "x=1;/bin/sh&secret=s").otherwise("")
    agent = F.when(n % 3 == 0, "sqlmap/1.0").otherwise("made/1")
    kind = F.when(n % 8 == 7, "application/x-www-form-urlencoded").otherwise("text/plain")
    method = F.when(n % 8 == 5, "POST").when(n % 8 == 7, "PUT").when(n % 11 == 0, "TRACE").otherwise("GET")
    request = _text(method, F.lit(" "), target, F.lit(" HTTP/1.1\r\nUser-Agent: "), agent, F.lit("\r\nContent-Type: "), kind, F.lit("\r\nX-Page: "), n, F.lit("\r\nContent-Length: "), F.length(body), crlf, crlf, body)
    rows = pages.select(
        F.lit("made").alias("capture"), F.lit("10.0.0.1").alias("src"), (1_024 + n % 60_000).cast("int").alias("sport"), F.when(n % 2 == 0, "10.0.0.2").otherwise("8.8.8.8").alias("dst"), F.lit(80).alias("dport"),
        n.alias("nth"), request.alias("hex"),
    )
    found = request_risks(framing.http_messages(_blocks(rows, 31)).where("kind = 'request'"))
    return found.select(F.col("headers")["x-page"].cast("bigint").alias("page_id"), "score", "level", F.array_join("reasons", " ").alias("reasons"))


def _hellos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hello for each page, of one of three cipher lists; every second is sent in records of 40 bytes."""
    pages = _hosts(spark, sf_dir)
    size = F.octet_length("host")
    lengths = lambda *more: F.concat(*(_hex(size + m, 4) for m in more))
    name = F.concat(F.lit("0A0A0000" + "0000"), lengths(5, 3), F.lit("00"), lengths(0), F.hex("host"))
    rest = F.lit("002B0005040A0A0304" + "000D0006000404030804" + "0010000E000C02683208687474702F312E31" + "000A00040002001D")
    ciphers = F.concat(F.lit("00061A1A"), _hex(4_865 + F.pmod("page_id", F.lit(3)), 4), F.lit("C02B"))
    extensions = F.concat(name, rest)
    body = F.concat(F.lit("0303" + "00" * 32 + "00"), ciphers, F.lit("0100"), _hex(F.length(extensions) / 2, 4), extensions)
    hello = F.concat(F.lit("01"), _hex(F.length(body) / 2, 6), body)
    step = F.when(F.col("page_id") % 2 == 0, 80).otherwise(F.length(hello))
    record = lambda k: F.substring(hello, (k * step + 1).cast("int"), step.cast("int"))
    records = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length(hello) - 1) / step)), lambda k: F.concat(F.lit("160301"), _hex(F.length(record(k)) / 2, 4), record(k))), "")
    rows = pages.select(
        F.lit("made").alias("capture"), F.concat(F.lit("10.0.1."), F.pmod("page_id", F.lit(50))).alias("src"), (30_000 + F.col("page_id")).cast("int").alias("sport"), F.lit("10.0.0.2").alias("dst"),
        F.lit(443).alias("dport"), F.lit(0).alias("nth"), records.alias("hex"),
    )
    found = handshakes(_blocks(rows, 37)).where("kind = 'client_hello'")
    return found.groupBy("ja4", "alpn", "version").agg(F.count(F.lit(1)).alias("hellos"), F.count_distinct("src").alias("clients"), F.count_distinct("server_name").alias("names"))


def modbus_size(head: bytes) -> int | None:
    """The length of a Modbus message from its first six bytes."""
    length = int.from_bytes(head[4:6], "big")
    return 6 + length if head[2:4] == b"\0\0" and 2 <= length <= 254 else None


def _modbus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as messages of one connection, of 12 bytes and of what their properties add."""
    code = F.when(F.col("event_type") == "signup", "06").when(F.col("event_type") == "purchase", "10").when(F.col("event_type") == "click", "01").when(F.col("event_type") == "error", "04").otherwise("03")
    message = F.concat(_hex(F.pmod("event_id", F.lit(65_536)), 4), F.lit("0000"), _hex(6 + F.octet_length("props"), 4), F.lit("01"), code, F.lit("000A0002"), F.hex(F.col("props").cast("binary")))
    rows = _table(spark, sf_dir, "events").select(
        F.lit("made").alias("capture"), F.concat(F.lit("u"), F.col("user_id")).alias("src"), F.lit(40_000).alias("sport"), F.lit("plc").alias("dst"), F.lit(502).alias("dport"), F.col("event_id").alias("nth"), message.alias("hex"),
    )
    framed = framing.prefixed_messages(_blocks(rows, 61), 6, modbus_size).withColumnRenamed("message", "payload")
    found = extract(framed, modbus_message, MODBUS_COLUMNS)
    return found.groupBy(F.col("src").alias("client"), "function").agg(F.count(F.lit(1)).alias("messages"), F.sum("transaction").alias("transactions"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"http_exchanges": _exchanges, "web_request_risks": _risks, "tls_hellos_in_records": _hellos, "modbus_in_streams": _modbus}

ORACLE_SQL: dict[str, str] = {
    "http_exchanges": """
        SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'HEAD' WHEN page_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method, '/page/' || page_id AS uri,
               CASE WHEN page_id % 5 <> 0 AND page_id % 3 = 0 THEN octet_length(encode(coalesce(url, ''))) ELSE 0 END AS sent, CASE WHEN page_id % 7 = 0 THEN 204 ELSE 200 END AS status,
               CASE WHEN page_id % 7 = 0 OR page_id % 5 = 0 THEN 0 ELSE octet_length(encode(coalesce(html, ''))) END AS received,
               sha256(CASE WHEN page_id % 7 = 0 OR page_id % 5 = 0 THEN '' ELSE coalesce(html, '') END) AS sha256, TRUE AS complete, 8080 AS server_port
        FROM pages""",
    "web_request_risks": """
        WITH p AS (SELECT page_id, page_id % 8 AS k, page_id % 3 = 0 AS tool, page_id % 11 = 0 AND page_id % 8 NOT IN (5, 7) AS trace, page_id % 2 = 1 AS public FROM pages),
        r AS (SELECT page_id, trace, public AND k = 5 AS post, k, tool, [
                CASE WHEN trace THEN 'uncommon_method' END, CASE WHEN k = 5 AND public THEN 'post_to_public' END, CASE WHEN k = 2 THEN 'sql' END, CASE WHEN k = 3 THEN 'traversal' END,
                CASE WHEN k = 7 THEN 'command' END, CASE WHEN k = 4 THEN 'internal_target' END, CASE WHEN tool THEN 'tool' END, CASE WHEN k = 1 OR k = 7 THEN 'credential_parameter' END, CASE WHEN k = 4 THEN 'internal_parameter' END,
                CASE WHEN k = 7 THEN 'credential_in_body' END, CASE WHEN k = 5 THEN 'long_base64' END] AS reasons,
                CASE WHEN trace THEN 2 ELSE 0 END + CASE WHEN k = 5 AND public THEN 1 ELSE 0 END + CASE WHEN tool THEN 2 ELSE 0 END
                + CASE k WHEN 1 THEN CASE WHEN trace THEN 1 ELSE 3 END WHEN 2 THEN 3 WHEN 3 THEN 3 WHEN 4 THEN 5 WHEN 5 THEN 2 WHEN 7 THEN 5 ELSE 0 END AS score FROM p)
        SELECT page_id, score::INTEGER AS score, CASE WHEN score >= 6 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS level, coalesce(array_to_string(reasons, ' '), '') AS reasons FROM r""",
    "tls_hellos_in_records": f"""
        SELECT 't13d0205h2_' || substr(sha256('130' || (1 + page_id % 3) || ',c02b'), 1, 12) || '_' || substr(sha256('000a,000d,002b_0403,0804'), 1, 12) AS ja4, 'h2' AS alpn, 772 AS version,
               count(*) AS hellos, count(DISTINCT page_id % 50) AS clients, count(DISTINCT {_HOST}) AS names FROM pages GROUP BY 1""",
    "modbus_in_streams": """
        SELECT 'u' || user_id AS client, CASE event_type WHEN 'signup' THEN 6 WHEN 'purchase' THEN 16 WHEN 'click' THEN 1 WHEN 'error' THEN 4 ELSE 3 END AS function,
               count(*) AS messages, sum(event_id % 65536)::BIGINT AS transactions FROM events GROUP BY 1, 2""",
}
