"""Queries of indicators, host inventories and tag-length-value messages, with their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import weak_key
from ..functions.network import base_domain, url_host
from ..operators.indicators import indicator_hits
from ..operators.inventory import bindings, inventory
from ..operators.timing import micros
from ..sources import der
from .catalogue import _HOST, _table


def _dotted(number) -> F.Column:
    """10.0.0.0 and so many addresses on."""
    return F.concat_ws(".", F.lit("10"), F.floor(number / 65_536) % 256, F.floor(number / 256) % 256, number % 256)


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events from users' addresses to servers', against suppliers as single addresses, networks of 16 or of 64, and ranges of 21."""
    packets = _table(spark, sf_dir, "events").select(_dotted(F.col("user_id")).alias("src"), _dotted(F.col("event_id") % 5_000).alias("dst"), micros("ts").alias("ts"))
    k = F.col("s_suppkey")
    value = (
        F.when(k % 4 == 0, _dotted(k * 3)).when(k % 4 == 1, F.concat(_dotted(k * 16 % 4_096), F.lit("/28"))).when(k % 4 == 2, F.concat(_dotted(k * 7), F.lit("-"), _dotted(k * 7 + 20)))
        .otherwise(F.concat(_dotted(k * 64 % 8_192), F.lit("/26")))
    )
    kind = F.when(k % 4 == 0, "ip").when(k % 4 == 2, "range").otherwise("network")
    listed = _table(spark, sf_dir, "supplier").select(value.alias("value"), kind.alias("kind"))
    return indicator_hits(packets, listed)


def _domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' texts and hosts against the base domains of every tenth page, in one list with digests of every seventh."""
    pages = _table(spark, sf_dir, "pages").select("page_id", F.col("url").cast("binary").alias("payload"), url_host(F.col("url")).alias("host"), F.sha2("html", 256).alias("digest"), F.col("page_id").alias("ts"))
    domains = pages.where("page_id % 10 = 0").select(base_domain(F.col("host")).alias("value"), F.lit("domain").alias("kind")).where("value <> ''")
    digests = pages.where("page_id % 7 = 0").select(F.upper("digest").alias("value"), F.lit("hash").alias("kind"))
    return indicator_hits(pages, domains.unionByName(digests), addresses=(), texts=("payload",), names=("host",), digests=("digest",)).select("value", "kind", "place", "hits", "first_ts", "last_ts")


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups as leases that give a user's address one of eleven names; what was done under each name, in its time."""
    events = _table(spark, sf_dir, "events").withColumn("at", micros("ts"))
    leases = events.where("event_type = 'signup'").select(F.col("user_id").alias("address"), F.lit("name").alias("kind"), F.concat(F.lit("host"), F.col("event_id") % 11).alias("value"), "at")
    return inventory(events.select(F.col("user_id").alias("src"), "at"), bindings(leases))


def _made(rows: DataFrame, write: Callable[..., bytes], *columns: str) -> DataFrame:
    """Rows with ``data``, which a function writes from some of their columns."""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), "data binary"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [write(*values) for values in zip(*(batch.column(c).to_pylist() for c in columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], [*batch.schema.names, "data"])

    return rows.mapInArrow(made, schema)


def made_certificate(number: int, name: str, city: int) -> bytes:
    """A certificate of a supplier: an RSA key of 1,024 or 2,048 bits, or one on a curve; valid for a year from a day by its number."""
    e, string = der.element, lambda s: der.element(der.UTF8, s.encode())
    called = lambda common: e(der.SEQUENCE, e(der.SET, e(der.SEQUENCE, der.oid("2.5.4.10"), string("Made"))), e(der.SET, e(der.SEQUENCE, der.oid("2.5.4.3"), string(common))))
    month = number % 12 + 1
    valid = e(der.SEQUENCE, e(der.UTC_TIME, f"20{month:02}15080910Z".encode()), e(der.TIME, f"2021{month:02}15080910Z".encode()))
    if number % 3 == 2:
        key = e(der.SEQUENCE, e(der.SEQUENCE, der.oid("1.2.840.10045.2.1"), der.oid("1.2.840.10045.3.1.7")), e(der.BITS, b"\0\4" + bytes(64)))
    else:
        modulus = (1 << (1_024 * (number % 3 + 1) - 1)) + number
        key = e(der.SEQUENCE, e(der.SEQUENCE, der.oid("1.2.840.113549.1.1.1"), e(5)), e(der.BITS, b"\0" + e(der.SEQUENCE, der.integer(modulus), der.integer(65_537))))
    other = e(der.SEQUENCE, der.oid(der.ALTERNATIVE_NAMES), e(der.OCTETS, e(der.SEQUENCE, e(0x82, f"S{number}.Example".encode()), e(0x82, b"all.example"))))
    limits = e(der.SEQUENCE, der.oid(der.BASIC_CONSTRAINTS), e(der.BOOLEAN, b"\xff"), e(der.OCTETS, e(der.SEQUENCE, e(der.BOOLEAN, b"\xff") if number % 5 == 0 else b"")))
    algorithm = e(der.SEQUENCE, der.oid("1.2.840.113549.1.1.11"), e(5))
    body = e(
        der.SEQUENCE, e(0xA0, der.integer(2)), der.integer(number), algorithm, called(name if number % 5 == 0 else f"Issuer {city}"), valid, called(name), key, e(0xA3, e(der.SEQUENCE, other, limits))
    )
    return e(der.SEQUENCE, body, algorithm, e(der.BITS, b"\0" + bytes(64)))


def _certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("int").alias("city"))
    found = der.decoded(_made(rows, made_certificate, "s_suppkey", "s_name", "city"), "data", der.certificate, der.CERTIFICATE_COLUMNS)
    return found.select(
        "s_suppkey", "version", F.conv("serial", 16, 10).cast("bigint").alias("serial"), "issuer", "subject_cn", "not_before", "not_after", "key_type", "key_bits", F.array_join("names", " ").alias("names"), "is_ca", "self_issued",
        weak_key(F.when(F.col("key_type") == "ec", "ECDSA").otherwise(F.col("key_type")), F.col("key_bits")).alias("weak"),
    )


def made_bind(number: int, name: str, secret: float) -> bytes:
    """A bind of a customer, by a password or otherwise, or the answer to one."""
    e = der.element
    if number % 4 == 3:
        return e(der.SEQUENCE, der.integer(number), e(0x61, e(10, bytes([49 if number % 8 == 3 else 0])), e(der.OCTETS), e(der.OCTETS, b"told")))
    how = e(0x80, f"pw{secret:.2f}".encode()) if number % 4 else e(0xA3, e(der.OCTETS, b"GSSAPI"))
    return e(der.SEQUENCE, der.integer(number), e(0x60, der.integer(3), e(der.OCTETS, f"cn={name}".encode()), how))


def _binds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    found = der.decoded(_made(rows, made_bind, "c_custkey", "c_name", "c_acctbal"), "data", der.ldap_message, der.LDAP_COLUMNS)
    return found.select("c_custkey", "message", "operation", "name", "method", "password", "result")


def made_ticket_request(number: int, name: str, nation: int) -> bytes:
    """A customer's request for a ticket, with strong ciphers or with weak ones alone, or an error."""
    e = der.element
    word = lambda s: e(27, s.encode())
    called = lambda *parts: e(der.SEQUENCE, e(0xA0, der.integer(1)), e(0xA1, e(der.SEQUENCE, *map(word, parts))))
    realm = f"REALM{nation}"
    if number % 5 == 4:
        body = e(0xA0, der.integer(5)) + e(0xA1, der.integer(30)) + e(0xA6, der.integer(24 if number % 2 else 6)) + e(0xA9, word(realm)) + e(0xAA, called("krbtgt", realm))
        return e(0x7E, e(der.SEQUENCE, body))
    ciphers = [23] if number % 3 == 0 else [18, 17, 23]
    inner = e(0xA0, e(der.BITS, bytes(5))) + e(0xA1, called(name)) + e(0xA2, word(realm)) + e(0xA3, called("krbtgt", realm)) + e(0xA7, der.integer(number)) + e(0xA8, e(der.SEQUENCE, *map(der.integer, ciphers)))
    return e(0x6A, e(der.SEQUENCE, e(0xA1, der.integer(5)), e(0xA2, der.integer(10)), e(0xA4, e(der.SEQUENCE, inner))))


def _tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests, those that ask for weak ciphers alone, and errors, by realm."""
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("int").alias("nation"))
    found = der.decoded(_made(rows, made_ticket_request, "c_custkey", "c_name", "nation"), "data", der.kerberos_message, der.KERBEROS_COLUMNS)
    weak = F.forall(F.coalesce("ciphers", F.array(F.lit(0))), lambda c: c.isin(1, 2, 3, 23, 24))
    return found.groupBy("realm").agg(
        F.count(F.when(F.col("kind") == 10, 1)).alias("requests"), F.count(F.when((F.col("kind") == 10) & weak, 1)).alias("weak"), F.count(F.when(F.col("error") == 24, 1)).alias("refused"),
        F.count(F.when(F.col("error") == 6, 1)).alias("unknown"), F.count_distinct("client").alias("clients"), F.min("service").alias("service"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "indicator_hits": _addresses, "indicator_domains": _domains, "host_inventory": _inventory, "certificates": _certificates, "ldap_binds": _binds, "kerberos_requests": _tickets,
}

_IP = "'10.' || ({0}) // 65536 % 256 || '.' || ({0}) // 256 % 256 || '.' || ({0}) % 256"

ORACLE_SQL: dict[str, str] = {
    "indicator_hits": f"""
        WITH i AS (SELECT DISTINCT CASE s_suppkey % 4 WHEN 0 THEN {_IP.format('s_suppkey * 3')} WHEN 1 THEN {_IP.format('s_suppkey * 16 % 4096')} || '/28'
                       WHEN 2 THEN {_IP.format('s_suppkey * 7')} || '-' || {_IP.format('s_suppkey * 7 + 20')} ELSE {_IP.format('s_suppkey * 64 % 8192')} || '/26' END AS value,
                   CASE s_suppkey % 4 WHEN 0 THEN 'ip' WHEN 2 THEN 'range' ELSE 'network' END AS kind,
                   CASE s_suppkey % 4 WHEN 0 THEN s_suppkey * 3 WHEN 1 THEN s_suppkey * 16 % 4096 WHEN 2 THEN s_suppkey * 7 ELSE s_suppkey * 64 % 8192 END AS low,
                   CASE s_suppkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 16 WHEN 2 THEN 21 ELSE 64 END AS n FROM supplier),
        p AS (SELECT 'src' AS place, user_id AS own, epoch_us(ts) AS ts FROM events UNION ALL SELECT 'dst', event_id % 5000, epoch_us(ts) FROM events)
        SELECT value, kind, place, count(*) AS hits, min(ts) AS first_ts, max(ts) AS last_ts FROM p JOIN i ON own >= low AND own < low + n GROUP BY 1, 2, 3""",
    "indicator_domains": f"""
        WITH p AS (SELECT page_id, lower(url) AS url, {_HOST} AS host, sha256(html) AS digest FROM pages),
        d AS (SELECT DISTINCT array_to_string(string_split(host, '.')[-2:], '.') AS value FROM p WHERE page_id % 10 = 0 AND host <> ''),
        h AS (SELECT DISTINCT digest AS value FROM p WHERE page_id % 7 = 0)
        SELECT value, 'domain' AS kind, 'payload' AS place, count(*) AS hits, min(page_id) AS first_ts, max(page_id) AS last_ts
        FROM p JOIN d ON regexp_matches(url, '(^|[^a-z0-9-])' || replace(value, '.', '[.]') || '([^a-z0-9-]|$)') GROUP BY 1
        UNION ALL SELECT value, 'domain', 'host', count(*), min(page_id), max(page_id) FROM p JOIN d ON host = value OR ends_with(host, '.' || value) GROUP BY 1
        UNION ALL SELECT value, 'hash', 'digest', count(*), min(page_id), max(page_id) FROM p JOIN h ON digest = value GROUP BY 1""",
    "host_inventory": """
        WITH l AS (SELECT user_id, ts, max('host' || event_id % 11) AS name FROM events WHERE event_type = 'signup' GROUP BY 1, 2),
        a AS (SELECT e.user_id, epoch_us(e.ts) AS own, l.name FROM events e ASOF JOIN l ON e.user_id = l.user_id AND e.ts >= l.ts)
        SELECT name, count(DISTINCT user_id) AS addresses, count(*) AS packets, min(own) AS first_at, max(own) AS last_at FROM a GROUP BY 1""",
    "certificates": """
        SELECT s_suppkey, 3 AS version, s_suppkey AS serial, 'O=Made, CN=' || CASE WHEN s_suppkey % 5 = 0 THEN s_name ELSE 'Issuer ' || s_nationkey END AS issuer, s_name AS subject_cn,
               epoch_us(make_timestamp(2020, s_suppkey % 12 + 1, 15, 8, 9, 10)) // 1000000 AS not_before, epoch_us(make_timestamp(2021, s_suppkey % 12 + 1, 15, 8, 9, 10)) // 1000000 AS not_after,
               CASE WHEN s_suppkey % 3 = 2 THEN 'ec' ELSE 'rsa' END AS key_type, (CASE s_suppkey % 3 WHEN 0 THEN 1024 WHEN 1 THEN 2048 ELSE 256 END)::INTEGER AS key_bits,
               's' || s_suppkey || '.example all.example' AS names, s_suppkey % 5 = 0 AS is_ca, s_suppkey % 5 = 0 AS self_issued, s_suppkey % 3 = 0 AS weak FROM supplier""",
    "ldap_binds": """
        SELECT c_custkey, c_custkey AS message, CASE WHEN c_custkey % 4 = 3 THEN 1 ELSE 0 END AS operation, CASE WHEN c_custkey % 4 = 3 THEN '' ELSE 'cn=' || c_name END AS name,
               CASE c_custkey % 4 WHEN 3 THEN NULL WHEN 0 THEN 'sasl' ELSE 'simple' END AS method, CASE WHEN c_custkey % 4 IN (1, 2) THEN 'pw' || printf('%.2f', c_acctbal) END AS password,
               CASE WHEN c_custkey % 8 = 3 THEN 49 WHEN c_custkey % 4 = 3 THEN 0 END AS result FROM customer""",
    "kerberos_requests": """
        SELECT 'REALM' || c_nationkey AS realm, count(CASE WHEN c_custkey % 5 <> 4 THEN 1 END) AS requests, count(CASE WHEN c_custkey % 5 <> 4 AND c_custkey % 3 = 0 THEN 1 END) AS weak,
               count(CASE WHEN c_custkey % 5 = 4 AND c_custkey % 2 = 1 THEN 1 END) AS refused, count(CASE WHEN c_custkey % 5 = 4 AND c_custkey % 2 = 0 THEN 1 END) AS unknown,
               count(DISTINCT CASE WHEN c_custkey % 5 <> 4 THEN c_name END) AS clients, 'krbtgt/REALM' || c_nationkey AS service FROM customer GROUP BY c_nationkey""",
}
