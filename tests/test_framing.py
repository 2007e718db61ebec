"""Messages from streams cut anywhere, with bytes missing and bytes that are none of theirs."""

from __future__ import annotations

import random
import struct
from hashlib import md5, sha256

import pytest
from pyspark.sql import functions as F

from netquarry.operators.framing import Http, Prefixed, http_exchanges, http_messages, prefixed_messages
from netquarry.operators.packets import reassembled_blocks
from netquarry.plans.streams import modbus_size
from netquarry.sources.captures import read_captures
from netquarry.sources.protocols import tls_hello
from netquarry.sources.tls import Handshakes, client_hello, handshakes, server_hello

from .test_captures import pcap, tcp


def fed(reader, data, rng, most=30):
    found, at = [], 0
    while at < len(data):
        size = rng.randrange(1, most)
        found += reader.feed(data[at : at + size])
        at += size
    return [*found, *reader.finish()]


REQUESTS = (
    b"GET /a HTTP/1.1\r\nHost: x\r\nA: 1\r\nA: 2\r\n\r\nPOST /b?c=d HTTP/1.1\r\ncontent-length: 5\r\n\r\nhelloHEAD /h HTTP/1.0\r\n\r\n"
    b"PUT /t HTTP/1.1\r\nTransfer-Encoding: gzip, chunked\r\n\r\n3;e=1\r\nabc\r\nA\r\n0123456789\r\n0\r\nT: 1\r\nU: 2\r\n\r\nGET /z HTTP/1.1\n\n"
)
RESPONSES = (
    b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nokHTTP/1.1 100 Continue\r\n\r\nHTTP/1.1 201 Made it\r\ncontent-length: 0\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 99\r\n\r\n"
    b"HTTP/1.1 304 Not Modified\r\nContent-Length: 7\r\n\r\nHTTP/1.1 404\r\n\r\nall the rest\r\nHTTP/1.1 200 no head any more"
)


@pytest.mark.parametrize("seed", range(20))
def test_http_however_cut(seed):
    rng = random.Random(seed)
    asked = [m for _, m in fed(Http(), REQUESTS, rng)]
    assert [(m["method"], m["uri"], m["body"], m["body_bytes"]) for m in asked] == [
        ("GET", "/a", b"", 0), ("POST", "/b?c=d", b"hello", 5), ("HEAD", "/h", b"", 0), ("PUT", "/t", b"abc0123456789", 13), ("GET", "/z", b"", 0)
    ]
    assert asked[0]["headers"] == {"host": "x", "a": "1, 2"} and all(m["complete"] for m in asked)
    told = fed(Http([m["method"] for m in asked]), RESPONSES, rng)
    assert [(m["status"], m["body"]) for _, m in told] == [(200, b"ok"), (100, b""), (201, b""), (200, b""), (304, b""), (404, b"all the rest\r\nHTTP/1.1 200 no head any more")]
    assert [RESPONSES[o : o + 4] for o, _ in told] == [b"HTTP"] * 6
    assert told[-1][1]["body_sha256"] == sha256(told[-1][1]["body"]).hexdigest()


@pytest.mark.parametrize("seed", range(10))
def test_http_with_garbage_and_long_bodies(seed):
    rng = random.Random(seed)
    garbage = bytes(rng.randrange(256) for _ in range(500)).replace(b"\n", b" ")
    body = bytes(rng.randrange(256) for _ in range(20_000))
    data = garbage + b"\nPOST /u HTTP/1.1\r\nContent-Length: 20000\r\n\r\n" + body + garbage + b"GET /v HTTP/1.1\r\n\r\n"
    found = [m for _, m in fed(Http(body_bytes=100), data, rng, 3_000)]
    assert [(m["uri"], m["body_bytes"], m["body"]) for m in found] == [("/u", 20_000, body[:100]), ("/v", 0, b"")]
    assert found[0]["body_sha256"] == sha256(body).hexdigest()


def test_http_with_missing_bytes():
    reader = Http()
    found = list(reader.feed(b"POST /u HTTP/1.1\r\nContent-Length: 10\r\n\r\nabc"))
    reader.skip(4)
    found += reader.feed(b"hijGET /v HTTP/1.1\r\nHo")
    reader.skip(50)
    found += reader.feed(b"st: x\r\n\r\nGET /w HTTP/1.1\r\n\r\nGET /x HTTP/1.1\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nab")
    found += reader.finish()
    assert [(m["uri"], m["body"], m["complete"]) for _, m in found] == [("/u", b"abchij", False), ("/w", b"", True), ("/x", b"ab", False)]


def modbus(n, data=b""):
    return struct.pack(">3H", n, 0, 2 + len(data)) + b"\x01\x03" + data


@pytest.mark.parametrize("seed", range(20))
def test_prefixed_however_cut_and_after_damage(seed):
    rng = random.Random(seed)
    sent = [modbus(n, bytes(rng.randrange(1, 250))) for n in range(1, 40)]
    data = b"".join(sent)
    assert [m for _, m in fed(Prefixed(6, modbus_size), data, rng)] == sent
    assert [data[o : o + len(m)] for o, m in fed(Prefixed(6, modbus_size), data, rng)] == sent
    damaged = b"\xff" * 9 + b"".join(sent[:20]) + b"\xff" * 7 + b"".join(sent[20:])
    assert [m for _, m in fed(Prefixed(6, modbus_size), damaged, rng)] == sent
    reader = Prefixed(6, modbus_size)
    found = list(reader.feed(b"".join(sent[:10]) + sent[10][:5]))
    reader.skip(len(sent[10]) - 5 + len(sent[11]))
    found += reader.feed(b"".join(sent[12:]))
    assert [m for _, m in found] == sent[:10] + sent[12:]


def extension(kind, data):
    return struct.pack(">2H", kind, len(data)) + data


def hello(ciphers=(0x0A0A, 0x1301, 0xC02F), extensions=b"", name=b"made.example"):
    own = extension(0, struct.pack(">HBH", len(name) + 3, 0, len(name)) + name) + extensions if name else extensions
    return b"\x03\x03" + bytes(32) + b"\x00" + struct.pack(f">H{len(ciphers)}H", 2 * len(ciphers), *ciphers) + b"\x01\x00" + struct.pack(">H", len(own)) + own


def handshake(kind, body):
    return bytes([kind]) + len(body).to_bytes(3, "big") + body


def records(data, rng, kind=22):
    out = b""
    while data:
        size = rng.randrange(1, 60)
        out += struct.pack(">BHH", kind, 0x0301, len(data[:size])) + data[:size]
        data = data[size:]
    return out


MORE = extension(0x1A1A, b"") + extension(16, b"\0\x03\x02h2") + extension(43, b"\x04\x0a\x0a\x03\x04") + extension(13, b"\0\x04\x04\x03\x08\x04") + extension(10, b"\0\x04\x0a\x0a\0\x1d") + extension(11, b"\x01\0")


def test_fingerprints():
    found = client_hello(hello(extensions=MORE))
    assert found["ja4"] == "t13d0206h2_" + sha256(b"1301,c02f").hexdigest()[:12] + "_" + sha256(b"000a,000b,000d,002b_0403,0804").hexdigest()[:12]
    assert found["ja3"] == "771,4865-49199,0-16-43-13-10-11,29,0" and found["server_name"] == "made.example" and found["version"] == 0x0304
    whole = handshake(1, hello(extensions=MORE))
    assert tls_hello(b"\x16\x03\x01" + struct.pack(">H", len(whole)) + whole)["ja3_md5"] == found["ja3_md5"]
    bare = client_hello(hello((0x0035,), b"", b""))
    assert bare["ja4"] == "t12i010000_" + sha256(b"0035").hexdigest()[:12] + "_000000000000"
    own = b"\x03\x03" + bytes(32) + b"\x00\x13\x01\x00" + struct.pack(">H", 6) + extension(43, b"\x03\x04")
    told = server_hello(own)
    assert told["ja4"] == "t130100_1301_" + sha256(b"002b").hexdigest()[:12] and told["ja3_md5"] == md5(b"771,4865,43").hexdigest()


@pytest.mark.parametrize("cut", range(0, 150, 7))
def test_damaged_hellos(cut):
    whole = hello(extensions=MORE)
    client_hello(whole[:cut])
    server_hello(whole[:cut])


@pytest.mark.parametrize("seed", range(20))
def test_handshakes_however_cut(seed):
    rng = random.Random(seed)
    sent = [(2, bytes(rng.randrange(256) for _ in range(80))), (11, bytes(rng.randrange(256) for _ in range(3_000))), (14, b"")]
    data = records(b"".join(handshake(*m) for m in sent), rng) + b"\x14\x03\x03\0\x01\x01" + records(b"\xff" * 50, rng)
    found = fed(Handshakes(), data, rng)
    assert [m for _, m in found] == sent
    assert found[0][0] == 0 and all(data[o] == 22 for o, _ in found)
    assert fed(Handshakes(), b"GET / HTTP/1.1\r\n\r\n" * 9, rng) == []


A, B = "10.0.0.9", "192.0.2.1"


def talk(up, down, port, size):
    """Packets of both directions in segments, the second before the first."""
    out = []
    for data, (src, sport, dst, dport) in ((up, (A, 40_000 + port, B, port)), (down, (B, port, A, 40_000 + port))):
        parts = [tcp(src, sport, dst, dport, 24, at, data[at : at + size]) for at in range(0, len(data), size)]
        out += parts[1::2] + parts[::2] if len(parts) > 1 else parts
    return out


@pytest.mark.parametrize(("size", "block"), [(5, 16), (23, 1 << 20), (400, 7)])
def test_streams_of_captures(spark, tmp_path, size, block):
    rng = random.Random(size)
    tls = records(handshake(1, hello(extensions=MORE)), rng)
    sent = [modbus(n, bytes(rng.randrange(1, 250))) for n in range(1, 40)]
    packets = talk(REQUESTS, RESPONSES, 8_080, size) + talk(tls, records(handshake(11, b"chain" * 99), rng), 443, size) + talk(b"".join(sent), b"", 502, size)
    (tmp_path / "x.pcap").write_bytes(pcap([packets[-1], *packets]))
    blocks = reassembled_blocks(read_captures(spark, str(tmp_path)), block).persist()
    found = http_exchanges(http_messages(blocks)).orderBy("nth").collect()
    assert [(r.request.method, r.request.body_bytes, r.response.status) for r in found] == [("GET", 0, 200), ("POST", 5, 201), ("HEAD", 0, 200), ("PUT", 13, 304), ("GET", 0, 404)]
    assert {(r.client, r.client_port, r.server, r.server_port) for r in found} == {(A, 48_080, B, 8_080)}
    own = {r.kind: r for r in handshakes(blocks).collect()}
    assert own["client_hello"].ja4 == client_hello(hello(extensions=MORE))["ja4"] and bytes(own["certificate"].certificates) == b"chain" * 99
    framed = prefixed_messages(blocks.where("dport = 502"), 6, modbus_size).orderBy("offset")
    assert [bytes(r.message) for r in framed.collect()] == sent
    blocks.unpersist()


def test_gap_and_time_of_messages(spark, tmp_path):
    parts = [(100, b"POST /u HTTP/1.1\r\nContent-Length: 10\r\n\r\nabc"), (147, b"hijGET /v HTTP/1.1\r\n\r\n")]
    (tmp_path / "x.pcap").write_bytes(pcap([tcp(A, 5_000, B, 80, 24, seq, data) for seq, data in parts]))
    rows = http_messages(reassembled_blocks(read_captures(spark, str(tmp_path)), 20)).orderBy("offset").collect()
    assert [(r.uri, r.complete, bytes(r.body), int(r.ts), r.pkt_no) for r in rows] == [("/u", False, b"abchij", 100, 1), ("/v", True, b"", 101, 2)]
    assert http_messages(reassembled_blocks(read_captures(spark, str(tmp_path))).where(F.lit(False))).count() == 0


def test_slices_of_blocks_keep_all_in_order():
    import pyarrow as pa

    from netquarry.operators.framing import blocks_of

    data = [b"x" * n for n in (5, 300, 2, 2, 2, 0, 1_000, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(data)], ["block", "data"])
    found = list(blocks_of([batch, batch], rows=3, size=400))
    assert [n for own in found for n in own.column(0).to_pylist()] == [*range(8)] * 2
    assert all(own.num_rows <= 3 and (own.num_rows == 1 or own.column(1).nbytes <= 500) for own in found)
