"""Labels and message extracts on nulls, empty and cut payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from netquarry.functions import labels
from netquarry.operators import sessions
from netquarry.sources import messages

PACKET = "capture string, pkt_no bigint, ts double, src string, sport int, dst string, dport int, transport string, vlan_ids array<int>, payload binary"


def packets(spark, *payloads, transport="UDP", dport=514):
    return spark.createDataFrame([("c", n, 0.0, "a", 40_000, "b", dport, transport, None, p) for n, p in enumerate(payloads)], PACKET)


def test_labels_of_nothing(spark):
    row = spark.createDataFrame([(None, None, None)], "s string, n int, b binary").select(
        labels.attack_stage(F.col("s")), labels.mac_address(F.col("s")), labels.weak_key(F.col("s"), F.col("n")), labels.printable_share(F.col("b")), labels.dense_by_design(F.col("b")),
        labels.encoded_runs(F.col("s")), labels.masquerade(F.col("s"), F.col("s")), labels.system_hint(F.col("n")), labels.service_name(F.col("n"), F.col("n")),
    ).first()
    assert tuple(row) == ("other", None, False, 0.0, False, 0, False, "-", None)


def test_dense_contents(spark):
    given = [(b"\x1f\x8b\x08\x00", True), (b"\x00\x00\x00\x18ftypmp42", True), (b"PK\x03\x04", True), (b"PK", False), (b"plain text", False), (b"", False)]
    rows = spark.createDataFrame([(bytearray(b),) for b, _ in given], "b binary").select(labels.dense_by_design(F.col("b"))).collect()
    assert [r[0] for r in rows] == [d for _, d in given]


def test_sides(spark):
    given = [(50_000, 53, True), (53, 50_000, False), (53, 123, True), (123, 123, False), (50_000, 80, True), (80, 2_000, False), (60_000, 5_000, True), (5_000, 60_000, False), (2_000, 3_000, True)]
    rows = spark.createDataFrame([g[:2] for g in given], "s int, d int").select(labels.starts_exchange(F.col("s"), F.col("d"))).collect()
    assert [r[0] for r in rows] == [g[2] for g in given]


def test_cut_payloads(spark):
    cut = packets(spark, None, b"", b"<", b"<9", b"<999>x", b"<34>", b"\x30\x06\x02", b"\x08")
    assert [(r.facility, r.severity, r.bytes) for r in messages.syslog(cut).collect()] == [(4, 2, 0)]
    for extract in (messages.ssh_banners, messages.ftp, messages.mail_envelopes, messages.basic_credentials, messages.snmp, messages.ntp, messages.icmp, messages.in_vlans):
        assert extract(cut).count() == 0
    port = packets(spark, None, b"", b"\x30", b"\x30\x09\x02\x01\x01\x04\x7fpublic", b"\x30\x0b\x02\x01\x01\x04\x06public", dport=161)
    assert [(r.version, r.community) for r in messages.snmp(port).collect()] == [("2c", "public")]


def test_credentials(spark):
    head = b"GET / HTTP/1.1\r\nAuthorization: Basic "
    rows = messages.basic_credentials(packets(spark, head + b"YTpiOmM=\r\n", head + b"YQ==\r\n", head + b"Y\r\n", head + b"\r\n", transport="TCP", dport=80)).collect()
    assert [(r.user, r.password) for r in rows] == [("a", "b:c")]


def test_empty_tables(spark):
    none = packets(spark).withColumn("bytes", F.lit(1))
    up = sessions.transfers(none, ["src", "dst"], F.col("sport") > F.col("dport"))
    assert sessions.uploads(up).count() == sessions.response_heavy(up).count() == sessions.owners(none, "src", "dst").count() == 0
    assert sessions.evidence(none, ["src"], "dst").count() == sessions.criticality(none, "dst", "dport").count() == sessions.of_categories(none, "transport", ["tcp"]).count() == 0
