"""Captures written byte by byte, read back as packets, streams and payloads."""

from __future__ import annotations

import ipaddress
import struct

import pytest

from netquarry.operators.packets import reassembled, reassembled_blocks, retransmissions, streams
from netquarry.sources.captures import capture_errors, capture_ranges, read_captures

A, B = "10.0.0.9", "192.0.2.1"


def tcp(src, sport, dst, dport, flags, seq, payload=b"", vlan=None):
    segment = struct.pack(">2H2I2B3H", sport, dport, seq, 0, 5 << 4, flags, 512, 0, 0) + payload
    ip = struct.pack(">2B3H2BH", 0x45, 0, 20 + len(segment), 1, 0, 64, 6, 0) + ipaddress.ip_address(src).packed + ipaddress.ip_address(dst).packed
    tag = struct.pack(">2H", 0x8100, vlan) if vlan else b""
    return bytes(range(12)) + tag + b"\x08\x00" + (ip + segment).ljust(46, b"\0")  # padded as on the wire


def pcap(packets, order="<", magic=0xA1B2C3D4):
    head = struct.pack(order + "I2H4I", magic, 2, 4, 0, 0, 65535, 1)
    return head + b"".join(struct.pack(order + "4I", 100 + i, 5, len(p), len(p)) + p for i, p in enumerate(packets))


def block(kind, body):
    body += b"\0" * (-len(body) % 4)
    return struct.pack("<2I", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))


def pcapng(packets):
    out = block(0x0A0D0D0A, struct.pack("<I2Hq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<2HI", 1, 0, 0) + struct.pack("<2HB3x", 9, 1, 9))
    return out + b"".join(block(6, struct.pack("<5I", 0, (t := (100 + i) * 10**9) >> 32, t & 0xFFFFFFFF, len(p), len(p)) + p) for i, p in enumerate(packets))


TALK = [
    tcp(A, 5000, B, 80, 2, 99),
    tcp(B, 80, A, 5000, 18, 499),
    tcp(A, 5000, B, 80, 16, 100),
    tcp(A, 5000, B, 80, 24, 104, b"efgh"),
    tcp(A, 5000, B, 80, 24, 100, b"abcd", vlan=7),
    tcp(A, 5000, B, 80, 24, 104, b"efgh"),
    tcp(A, 5000, B, 80, 24, 106, b"ghij"),
    tcp(A, 5000, B, 80, 24, 115, b"xyz"),
    tcp(B, 80, A, 5000, 24, 500, b"\x00\xff"),
    tcp(A, 6000, B, 22, 2, 1),
    tcp(B, 22, A, 6000, 20, 0),
    tcp(A, 6001, B, 23, 2, 1),
]


@pytest.mark.parametrize("data", [pcap(TALK), pcap(TALK, ">"), pcap(TALK, "<", 0xA1B23C4D), pcapng(TALK)])
def test_capture(spark, tmp_path, data):
    (tmp_path / "x.pcap").write_bytes(data)
    (tmp_path / "none.pcap").write_bytes(b"nothing of the kind at all")
    (tmp_path / "empty.pcap").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(data)
    packets = read_captures(spark, str(tmp_path)).persist()
    rows = packets.orderBy("pkt_no").collect()
    assert [r.pkt_no for r in rows] == list(range(1, 13)) and [int(r.ts) for r in rows] == list(range(100, 112))
    assert rows[0].payload == b"" and rows[4].payload == b"abcd" and rows[4].vlan_ids == [7] and rows[4].src == A
    found = {r.client_port: r for r in streams(packets).collect()}
    assert {p: r.state for p, r in found.items()} == {5000: "established", 6000: "refused", 6001: "syn-only"}
    assert (found[5000].client, found[5000].server_port, found[5000].packets, found[5000].client_bytes) == (A, 80, 9, 19)
    assert [(r.tcp_seq, r.sent) for r in retransmissions(packets).collect()] == [(104, 2)]
    assert {r.sport: (bytes(r.data), r.gap_bytes) for r in reassembled(packets).collect()} == {5000: (b"abcdefghijxyz", 5), 80: (b"\x00\xff", 0)}
    assert {r.sport: bytes(r.data) for r in reassembled(packets, 5).collect()}[5000] == b"abcde"
    packets.unpersist()


def test_cut_capture(spark, tmp_path):
    (tmp_path / "x.pcap").write_bytes(pcap(TALK)[:-3])
    (tmp_path / "y.pcap").write_bytes(pcap([TALK[3][:20], TALK[3][:40], b""]))
    rows = read_captures(spark, str(tmp_path)).collect()
    assert len(rows) == 11 + 3 and streams(read_captures(spark, str(tmp_path))).count() == 2


@pytest.mark.parametrize("data", [pcap(TALK * 50), pcapng(TALK * 50)])
def test_ranges_give_the_same_packets(spark, tmp_path, data):
    (tmp_path / "x.pcap").write_bytes(data)
    (tmp_path / "cut.pcap").write_bytes(data[:-3])
    (tmp_path / "none.pcap").write_bytes(b"nothing of the kind at all")
    ranges = capture_ranges(spark, str(tmp_path), range_bytes=2_000)
    assert ranges.where("error IS NULL").count() > 20
    assert sorted(r.capture.rsplit("/", 1)[1] for r in capture_errors(ranges).collect()) == ["cut.pcap", "none.pcap"]
    whole, parts = (sorted(map(repr, read_captures(spark, str(tmp_path), range_bytes=n).collect())) for n in (1 << 20, 700))
    assert whole == parts and len(whole) == 2 * 600 - 1


def test_reassembly_across_blocks_and_wraps(spark, tmp_path):
    start = (1 << 32) - 10
    pieces = [bytes([65 + i]) * 7 for i in range(9)]
    sent = [tcp(A, 5000, B, 80, 24, (start + 7 * i) % (1 << 32), p) for i, p in enumerate(pieces)]
    (tmp_path / "x.pcap").write_bytes(pcap([sent[0], sent[2], sent[1], *sent[3:5], sent[4], sent[3], *sent[6:]]))
    packets = read_captures(spark, str(tmp_path))
    expected = b"".join(pieces[:5] + pieces[6:])
    for size in (5, 16, 1 << 20):
        rows = reassembled_blocks(packets, size).orderBy("block").collect()
        assert b"".join(bytes(r.data) for r in rows) == expected and sum(r.gap_bytes for r in rows) == 7
        assert [(g.offset, g.gap) for r in rows for g in r.gaps] == [(35, 7)] and all(len(r.data) == size for r in rows[:-1])
