"""Indicators, host inventories, and tag-length-value messages with damage."""

from __future__ import annotations

import base64
import ipaddress
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from netquarry.operators.indicators import indicator_hits, indicator_keys, label_windows, read_indicators
from netquarry.operators.inventory import DAY, attributed, bindings
from netquarry.plans.intel import made_bind, made_certificate, made_ticket_request
from netquarry.sources import der

#: A certificate that another program made.
CERTIFICATE = "MIICGTCCAZ+gAwIBAgIJAKvN7wEjRWeJMAoGCCqGSM49BAMCMDcxCzAJBgNVBAYTAkRFMREwDwYDVQQKDAhNYWRlIEx0ZDEVMBMGA1UEAwwMVGVzdCBHcsO2w59lMB4XDTI2MTEyODEwMTE1NFoXDTI4MDEwMjEwMTE1NFowNzELMAkGA1UEBhMCREUxETAPBgNVBAoMCE1hZGUgTHRkMRUwEwYDVQQDDAxUZXN0IEdyw7bDn2UwdjAQBgcqhkjOPQIBBgUrgQQAIgNiAAQ5wA9+KWxs1lWd5o28yMmz90JK2wNrvXwKa/O44s5Ei9dxkan3KWf4pYuU9/aMjtsU+d3W4el/gH6RwsddfL/cYpGoe+ryfUUTdwP6MPL8ZBe57RVJ0fWnycBL/qjGuWyjdzB1MB0GA1UdDgQWBBROM2+sZ2LNCg4tmWKkMqX2UsvxAzAfBgNVHSMEGDAWgBROM2+sZ2LNCg4tmWKkMqX2UsvxAzAlBgNVHREEHjAcgglhLmV4YW1wbGWCCUIuZXhhbXBsZYcECgAAATAMBgNVHRMBAf8EAjAAMAoGCCqGSM49BAMCA2gAMGUCMBb84z4tIB00lCAwAIafogx8x+wTKpAajT3ZWiBxX1j0lIVJaJq694JtMlzfsXjIvwIxAKEW8LJzs44U4hyg0WXzoIwBJ2DDintSgf2hvIg+Lk21yBBz7UROwvUC1HE1Q8k6OQ=="


def test_certificate_of_another_program():
    found = der.certificate(base64.b64decode(CERTIFICATE))
    assert found["subject"] == "C=DE, O=Made Ltd, CN=Test Größe" and found["names"] == ["a.example", "b.example"] and found["self_issued"] and not found["is_ca"]
    assert (found["serial"], found["key_type"], found["key_bits"], found["version"]) == ("00abcdef0123456789", "ec", 384, 3)
    assert (found["not_before"], found["not_after"]) == (1_795_860_714, 1_830_420_714)
    assert found["sha256"] == "1d886745200d7af8baa25ef53962df0072de234b47830e1b0095e97fc2c61e14"


SNMP = der.element(0x30, der.integer(1), der.element(4, b"public"), der.element(0xA1, der.integer(77), der.integer(0), der.integer(0), der.element(0x30, der.element(0x30, der.oid("1.3.6.1.2.1.1.5.0"), der.element(5)), der.element(0x30, der.oid("2.999.3"), der.element(5)))))
MESSAGES = [
    (der.certificate, base64.b64decode(CERTIFICATE)), (der.certificate, made_certificate(15, "x", 3)), (der.snmp_message, SNMP), (der.ldap_message, made_bind(1, "n", 2.5)), (der.ldap_message, made_bind(3, "n", 2.5)),
    (der.kerberos_message, made_ticket_request(3, "n", 1)), (der.kerberos_message, made_ticket_request(4, "n", 1)),
]


@pytest.mark.parametrize(("decoder", "data"), MESSAGES)
def test_damaged_messages_give_a_row_or_none(decoder, data):
    assert decoder(data) is not None
    rng = random.Random(1)
    assert all(decoder(data[:n]) is None for n in range(len(data)))
    for _ in range(1_500):
        broken = bytearray(data)
        for _ in range(rng.randrange(1, 4)):
            broken[rng.randrange(len(broken))] = rng.randrange(256)
        found = decoder(bytes(broken))
        assert found is None or isinstance(found, dict)


def test_messages():
    assert der.snmp_message(SNMP) == {"version": 2, "community": "public", "operation": 1, "request": 77, "error": 0, "objects": ["1.3.6.1.2.1.1.5.0", "2.999.3"]}
    assert der.ldap_message(made_bind(1, "n", 2.5)) == {"message": 1, "operation": 0, "name": "cn=n", "method": "simple", "password": "pw2.50", "result": None}
    assert der.ldap_message(made_bind(3, "n", 2.5))["result"] == 49
    found = der.kerberos_message(made_ticket_request(3, "n", 1))
    assert (found["kind"], found["client"], found["service"], found["ciphers"]) == (10, "n", "krbtgt/REALM1", [23])
    assert der.kerberos_message(made_ticket_request(4, "n", 1))["error"] == 6


def test_bounds_of_reading():
    deep = b""
    for _ in range(200):
        deep = der.element(0x30, deep)
    indefinite = b"\x30\x80" * 500 + b"\0\0" * 500
    many = der.element(0x30, der.element(5) * 50_000)
    assert der.certificate(deep) is None and der.ldap_message(indefinite) is None and der.snmp_message(many) is None
    reader = der.Reader(b"\x30\x80\x02\x01\x05\x30\x80\x05\x00\x00\x00\x00\x00\x05\x00")
    first, second = reader.parts()
    assert [p.tag for p in reader.parts(first)] == [2, 0x30] and second.tag == 5


def test_chains_in_rows(spark):
    certs = [made_certificate(n, f"s{n}", 1) for n in (3, 5)] + [base64.b64decode(CERTIFICATE), b"none"]
    listed = b"".join(len(c).to_bytes(3, "big") + c for c in certs)
    rows = [("c", "a", 443, "b", 5, 1.5, len(listed).to_bytes(3, "big") + listed), ("c", "a", 443, "b", 5, 2.5, b"\0\0"), ("c", "a", 443, "b", 6, 3.5, None)]
    found = der.certificates(spark.createDataFrame(rows, "capture string, src string, sport int, dst string, dport int, ts double, certificates binary")).orderBy("place").collect()
    assert [(r.place, r.subject_cn, r.ts) for r in found] == [(0, "s3", 1.5), (1, "s5", 1.5), (2, "Test Größe", 1.5)]


def test_indicator_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# list\n10.0.0.1\n 10.0.0.0/8 # net\nEvil.Example\n10.0.0.5-10.0.0.9\n\nd41d8cd98f00b204e9800998ecf8427e\nnot a thing!\n2001:db8::/32\n")
    found = {r.value: r.kind for r in read_indicators(spark, str(tmp_path / "a.txt")).collect()}
    assert found == {"10.0.0.1": "ip", "10.0.0.0/8": "network", "evil.example": "domain", "10.0.0.5-10.0.0.9": "range", "d41d8cd98f00b204e9800998ecf8427e": "hash", "2001:db8::/32": "network"}
    items = [{"value": "1.2.3.4", "confidence": 0.5, "source": "s", "tags": ["t"]}, {"indicator": "a.b", "confidence": 70}, "c.d"]
    for name, data in (("b.json", items), ("c.json", {"indicators": items})):
        (tmp_path / name).write_text(json.dumps(data))
        rows = {r.value: r for r in read_indicators(spark, str(tmp_path / name)).collect()}
        assert rows.keys() == {"1.2.3.4", "a.b", "c.d"} and rows["1.2.3.4"].confidence == 50 and rows["a.b"].confidence == 70 and rows["1.2.3.4"].tags == ["t"]


def test_indicators_against_brute_force(spark):
    rng = random.Random(2)
    address = lambda: rng.choice([f"10.0.{rng.randrange(4)}.{rng.randrange(256)}", f"2001:db8::{rng.randrange(64):x}", None, "none"])
    words = ["evil.example", "www.evil.example", "evil.example.org", "notevil.example", "evil-example", "a.b", "x.a.b.c", "a.b-c", "_a.b_", "a..b", "A.B", "é", " ", "/", "xn--1.a.b"]
    rows = [(address(), address(), "".join(rng.choice(words) for _ in range(rng.randrange(4))).encode("latin-1"), rng.choice([None, "evil.example", "m.evil.example.", "a.b", "b", "Xa.b"]), rng.choice([None, "AB" * 16, "cd" * 16]), n) for n in range(600)]
    listed = [("10.0.0.7", "ip"), ("10.0.1.0/25", "network"), ("10.0.0.250-10.0.2.9", "range"), ("2001:db8::/123", "network"), ("2001:db8::5", "ip"), ("evil.example", "domain"), ("a.b", "domain"), ("ab" * 16, "hash"), ("9.9.9.9-1.1.1.1", "range"), (None, "ip"), ("10.0.0.7", "ip")]
    observed = spark.createDataFrame(rows, "src string, dst string, payload binary, name string, digest string, ts long").repartition(3)
    got = indicator_hits(observed, spark.createDataFrame(listed, "value string, kind string"), texts=("payload",), names=("name",), digests=("digest",))
    want = {}

    def add(value, place, row):
        want.setdefault((value, place), []).append(row[5])

    ip = ipaddress.ip_address
    for row in rows:
        for place, own in (("src", row[0]), ("dst", row[1])):
            if own in (None, "none"):
                continue
            for value, kind in set(listed):
                if kind == "ip" and value and ip(own) == ip(value) or kind == "network" and ip(own) in ipaddress.ip_network(value):
                    add(value, place, row)
                elif kind == "range" and value[0] == "1" and ip(own).version == 4 and ip("10.0.0.250") <= ip(own) <= ip("10.0.2.9"):
                    add(value, place, row)
        for domain in ("evil.example", "a.b"):
            if re.search(rf"(?<![a-z0-9-]){re.escape(domain)}(?![a-z0-9-])", row[2].decode("latin-1").lower()):
                add(domain, "payload", row)
            name = (row[3] or "").lower().rstrip(".")
            if name == domain or name.endswith("." + domain):
                add(domain, "name", row)
        if (row[4] or "").lower() == "ab" * 16:
            add("ab" * 16, "digest", row)
    assert {(r.value, r.place): (r.hits, r.first_ts, r.last_ts) for r in got.collect()} == {k: (len(v), min(v), max(v)) for k, v in want.items()}
    assert indicator_hits(observed, spark.createDataFrame([], "value string, kind string")).count() == 0


def test_long_lists_meet_by_equality(spark):
    listed = spark.range(100_000).select(F.concat_ws(".", F.lit("10"), F.floor(F.col("id") / 65_536), F.floor(F.col("id") / 256) % 256, F.col("id") % 256).alias("value"), F.lit("ip").alias("kind"))
    observed = spark.createDataFrame([("10.0.1.2", "10.1.0.9", 1), ("10.9.9.9", "10.0.1.2", 2)], "src string, dst string, ts long")
    assert {(r.value, r.place) for r in indicator_hits(observed, listed).collect()} == {("10.0.1.2", "src"), ("10.0.1.2", "dst"), ("10.1.0.9", "dst")}
    assert indicator_keys(listed.limit(5)).where("size = 128").count() == 5


def test_label_windows(spark):
    (row,) = spark.createDataFrame([("see a.b.c or d..e, -f.g_h",)], "t string").select(label_windows(F.col("t"), [1, 2, 3])).collect()
    assert set(row[0]) == {"see", "a", "b", "c", "or", "d", "e", "-f", "g", "h", "a.b", "b.c", "-f.g", "a.b.c"}


@pytest.mark.parametrize("lease", [None, DAY // 3])
def test_inventory_against_a_walk(spark, lease):
    rng = random.Random(6)
    seen = [(rng.choice(["a", "b", None]), rng.choice(["name", "mac"]), rng.choice(["x", "y", "z", None]), rng.choice([None, rng.randrange(5 * DAY)])) for _ in range(300)]
    packets = [(rng.choice(["a", "b", "c", None]), rng.randrange(6 * DAY)) for _ in range(400)] + [("a", t) for _, _, _, t in seen if t is not None]

    def at_time(address, kind, at):
        known = [(t, v) for a, k, v, t in seen if address is not None and a == address and k == kind and v is not None and t is not None and t <= at]
        if not known:
            return None
        last = max(t for t, _ in known)
        return max(v for t, v in known if t == last) if lease is None or at - last <= lease else None

    held = bindings(spark.createDataFrame(seen, "address string, kind string, value string, at long"), lease)
    got = attributed(spark.createDataFrame(packets, "src string, at long").repartition(3), held, ("name", "mac")).collect()
    want = sorted(((a or "", t, at_time(a, "name", t) or "", at_time(a, "mac", t) or "") for a, t in packets))
    assert sorted((r.src or "", r["at"], r.name or "", r.mac or "") for r in got) == want
    assert attributed(spark.createDataFrame([], "src string, at long"), held, ("name",)).count() == 0
