"""The pcap data source, its filters and expressions, and the sink, against unfiltered scans."""

from __future__ import annotations

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from netquarry.functions.addresses import address_key, leading_bits, prefix_of, prefixes_between, within
from netquarry.functions.bpf import BadFilter, column, parsed
from netquarry.sources.captures import SCHEMA, read_captures
from netquarry.sources.pcap_source import register, write_captures, write_index

from .test_captures import TALK, pcap, pcapng

HOSTS = ["10.0.0.1", "10.0.0.2", "10.1.2.3", "192.0.2.9", "2001:db8::1", "2001:db8::2"]


@pytest.fixture(scope="module")
def captured(spark, tmp_path_factory):
    """A folder of captures that were written from rows, and the rows as Spark reads them back without filters."""
    rng, rows = random.Random(1), []
    for n in range(2_000):
        kind = rng.choice(["TCP", "UDP", "ICMP"])
        four = rng.random() < 0.7
        pool = HOSTS[:4] if four else HOSTS[4:]
        ports = (rng.choice([80, 443, 53, 1234]), rng.choice([80, 443, 5000, 5005])) if kind != "ICMP" else (None, None)
        rows.append((1_000.0 + n / 4, rng.choice(pool), rng.choice(pool), *ports, kind, 1 if kind == "ICMP" and four else 58 if kind == "ICMP" else None, rng.choice([[], [7], [9, 7]]), b"x" * rng.randrange(200)))
    packets = spark.createDataFrame(rows, "ts double, src string, dst string, sport int, dport int, transport string, ip_proto int, vlan_ids array<int>, payload binary").repartition(3)
    folder = f"file://{tmp_path_factory.mktemp('captures')}"
    written = write_captures(packets, folder, file_bytes=40_000).collect()
    assert sum(r.packets for r in written) == 2_000 and len(written) > 3
    register(spark)
    return folder


def rows_of(df):
    return sorted(repr(r).replace("file:///", "file:/") for r in df.select(*(c.split()[0] for c in SCHEMA.split(", "))).collect())


FILTERS = [
    "tcp", "udp port 53", "icmp or icmp6", "host 10.0.0.1", "src host 10.0.0.1 and not tcp", "dst 2001:db8::1", "net 10.0.0.0/8", "src net 2001:db8::/33", "net 10.0.0.0/30 and port 80 or 443",
    "portrange 5000-5010", "tcp dst portrange 5000-5010 && !host 192.0.2.9", "not (tcp or udp)", "vlan", "vlan 9", "ip6 and udp", "less 100", "greater 200 || arp", "ip host 10.1.2.3", "host 10.0.0.1 or 10.0.0.2",
]


@pytest.mark.parametrize("expression", FILTERS)
def test_expressions_in_source_and_columns(spark, captured, expression):
    whole = spark.read.format("pcap").load(captured)
    by_column = rows_of(whole.where(column(expression)))
    assert by_column == rows_of(spark.read.format("pcap").option("bpf", expression).load(captured))
    assert by_column or expression in ("greater 200 || arp",)
    assert len(by_column) + whole.where(~column(expression)).count() == 2_000


@pytest.mark.parametrize("bad", ["", "port", "host 1.2.3", "tcp and", "(tcp", "tcp)", "fuzz 3", "port x", "net 10/x", "80"])
def test_bad_expressions(bad):
    with pytest.raises(BadFilter):
        parsed(bad)


CONDITIONS = [
    "true", "ts >= 1200 AND ts <= 1210", "ts = 1100.25", "src = '10.0.0.1' AND dport = 80", "dst IN ('10.0.0.2', '2001:db8::2')", "sport < 100",
    "src = dst", "src = 'nothing'", "transport = 'UDP' OR sport = 80", "sport IS NULL", "dst IS NOT NULL AND ttl > 63", "ts > 5000", "NOT (sport = 80)",
]


@pytest.fixture(scope="module")
def index(spark, captured):
    return write_index(spark, captured, range_bytes=3_000)


@pytest.fixture(scope="module")
def unfiltered(spark, captured):
    return read_captures(spark, captured).persist()


@pytest.mark.parametrize("condition", CONDITIONS)
def test_pushed_filters_lose_nothing(spark, captured, index, unfiltered, condition):
    expected = rows_of(unfiltered.where(condition))
    assert rows_of(spark.read.format("pcap").load(captured).where(condition)) == expected
    assert rows_of(spark.read.format("pcap").option("index", index).load(captured).where(condition)) == expected


def test_filters_reach_the_source_and_prune_ranges(spark, captured, index):
    ranges = spark.read.parquet(index)
    found = spark.read.format("pcap").option("index", index).load(captured).where("ts >= 1200 AND ts <= 1201 AND src = '10.0.0.1'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert " Filter (" not in plan, plan  # the source has taken all of them
    touched = ranges.where("low <= 1201 AND high >= 1200").count()
    assert 0 < touched < ranges.count() / 5
    assert found.rdd.getNumPartitions() == touched


def test_host_option_and_odd_files(spark, tmp_path):
    register(spark)
    (tmp_path / "a.pcap").write_bytes(pcap(TALK))
    (tmp_path / "b.pcapng").write_bytes(pcapng(TALK))
    (tmp_path / "cut.pcap").write_bytes(pcap(TALK)[:-3])
    (tmp_path / "none.pcap").write_bytes(b"nothing of the kind at all")
    (tmp_path / "empty.pcap").write_bytes(b"")
    whole = spark.read.format("pcap").load(str(tmp_path))
    assert whole.count() == 35
    assert spark.read.format("pcap").option("host", "10.0.0.9").load(str(tmp_path)).count() == whole.where("src = '10.0.0.9' OR dst = '10.0.0.9'").count()
    assert spark.read.format("pcap").option("pathGlobFilter", "*.pcapng").load(str(tmp_path)).count() == 12
    assert spark.read.format("pcap").load(str(tmp_path / "a.pcap")).count() == 12


ADDRESSES = ["0.0.0.0", "10.1.2.3", "255.255.255.255", "::", "::1", "1::", "2001:db8::1", "fe80::1%eth0", "::ffff:10.1.2.3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4", "ABCD::ef"]
NONE = ["", "x", "1.2.3", "1.2.3.256", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "g::", ":1::", "1::2:", None]


def test_address_keys(spark):
    rows = spark.createDataFrame([(a,) for a in ADDRESSES + NONE], "a string").select(address_key(F.col("a")), within(F.col("a"), "10.0.0.0/9"), within(F.col("a"), "2001:db8::/29")).collect()
    for address, (key, in_four, in_six) in zip(ADDRESSES, rows):
        own = ipaddress.ip_address(address.split("%")[0])
        number = int(own) if own.version == 6 else (0xFFFF << 32) + int(own)
        assert key == f"{number:032x}", address
        assert in_four == (ipaddress.ip_address("10.0.0.0") <= own <= ipaddress.ip_address("10.127.255.255") if own.version == 4 else address == "::ffff:10.1.2.3")
        assert in_six == (own.version == 6 and own in ipaddress.ip_network("2001:db8::/29"))
    assert [tuple(r) for r in rows[len(ADDRESSES) :]] == [(None, False, False)] * len(NONE)


def test_leading_bits_and_ranges(spark):
    key = f"{random.Random(3).getrandbits(128):032x}"
    (row,) = spark.createDataFrame([(key,)], "k string").select(*(leading_bits(F.col("k"), n) for n in range(129))).collect()
    assert list(row) == [f"{int(key, 16) >> (128 - n) << (128 - n):032x}" for n in range(129)]
    assert prefixes_between("10.0.0.1", "10.0.0.4") == [prefix_of("10.0.0.1/32"), prefix_of("10.0.0.2/31"), prefix_of("10.0.0.4/32")]
