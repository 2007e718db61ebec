"""DNP3 and S7 messages with damage, and what captures tell of their interfaces."""

from __future__ import annotations

import random
import struct

import pytest

from netquarry.operators.framing import Prefixed
from netquarry.plans.plants import made_answer, made_frame, made_job
from netquarry.sources import control
from netquarry.sources.captures import capture_interfaces

from .test_captures import TALK, block, pcap


def test_checksum_and_a_known_frame():
    assert control.dnp3_checksum(b"123456789") == struct.pack("<H", 0xEA82)  # the check value of this checksum
    link_status = bytes.fromhex("056405c901000000")  # a frame without user data begins no message
    assert control.dnp3_frame(link_status + control.dnp3_checksum(link_status)) is None


def test_messages():
    frame = made_frame(37, 5, "purchase")
    assert control.dnp3_frame(frame) == {"from_master": True, "master": 1, "outstation": 15, "sequence": 5, "function": "operate", "group_number": 12, "variation": 1}
    told = control.dnp3_frame(made_frame(37, 5, "error"))
    assert (told["from_master"], told["master"], told["outstation"], told["function"]) == (False, 1, 15, "response")
    assert control.s7_message(made_job(70_000, "P", 9)) == {"kind": "job", "reference": 4_464, "function": "stop", "error": None}
    assert control.s7_message(made_answer(9, "F", 9)) == {"kind": "ack_data", "reference": 9, "function": "write", "error": 0x8104}
    assert control.s7_message(b"\x03\x00\x00\x0b\x06\xe0\x00\x00\x00\x01\x00") is None


@pytest.mark.parametrize(("decoder", "data"), [(control.dnp3_frame, made_frame(39, 5, "view")), (control.s7_message, made_job(7, "O", 20))])
def test_damage(decoder, data):
    rng = random.Random(1)
    assert all(decoder(data[:n]) is None for n in range(len(data)))
    for _ in range(800):
        broken = bytearray(data)
        broken[rng.randrange(len(broken))] ^= 1 << rng.randrange(8)
        found = decoder(bytes(broken))
        assert found is None or decoder is control.s7_message  # a frame's checksums find any bit


@pytest.mark.parametrize("seed", range(8))
def test_frames_between_noise(seed):
    rng = random.Random(seed)
    sent = [made_frame(n, n, rng.choice(["view", "error", "purchase"])) for n in range(40)]
    data = b"".join(f + (bytes(rng.randrange(256) for _ in range(rng.randrange(20))) if n % 5 == 4 else b"") for n, f in enumerate(sent))
    reader, found, at = Prefixed(10, control.dnp3_size), [], 0
    while at < len(data):
        size = rng.randrange(1, 50)
        found += [m for _, m in reader.feed(data[at : at + size])]
        at += size
    # A head's checksum tells frames from noise, but where noise follows a frame that came after noise, the frame is doubted.
    assert set(found) <= set(sent) and len(found) >= 30


def option(code, value):
    return struct.pack("<2H", code, len(value)) + value + b"\0" * (-len(value) % 4)


def test_interfaces(spark, tmp_path):
    section = block(0x0A0D0D0A, struct.pack("<I2Hq", 0x1A2B3C4D, 1, 0, -1) + option(2, b"PC") + option(3, b"OS 1") + option(4, b"tool") + option(0, b""))
    link = lambda *more: block(1, struct.pack("<2HI", 1, 0, 9_000) + b"".join(more))
    counted = block(5, struct.pack("<3I", 1, 0, 0) + option(4, struct.pack("<Q", 70)) + option(5, struct.pack("<Q", 7)))
    packet = block(6, struct.pack("<5I", 0, 0, 5, 4, 4) + b"abcd")
    data = section + link(option(2, b"eth0"), option(6, bytes(range(6))), option(8, struct.pack("<Q", 10**9))) + packet + link(option(2, b"eth1"), option(3, "größer".encode()), option(11, b"\0tcp"), option(12, b"OS 2")) + counted
    (tmp_path / "a.pcapng").write_bytes(data + section + data[len(section) :][:-4])
    (tmp_path / "b.pcap").write_bytes(pcap(TALK))
    (tmp_path / "c.pcap").write_bytes(b"nothing of the kind at all")
    rows = sorted(capture_interfaces(spark, str(tmp_path)).collect(), key=lambda r: (r.kind, r.section, r.interface))
    assert [(r.kind, r.section, r.interface, r.link_type, r.snaplen) for r in rows] == [("pcap", 1, 0, 1, 65_535), ("pcapng", 1, 0, 1, 9_000), ("pcapng", 1, 1, 1, 9_000), ("pcapng", 2, 0, 1, 9_000), ("pcapng", 2, 1, 1, 9_000)]
    first, second = rows[1], rows[2]
    assert (first.name, first.mac, first.speed, first.os, first.hardware, first.application, first.dropped) == ("eth0", "00:01:02:03:04:05", 10**9, "OS 1", "PC", "tool", None)
    assert (second.name, second.description, second.filter, second.os, second.received, second.dropped) == ("eth1", "größer", "tcp", "OS 2", 70, 7)
    assert rows[4].dropped is None  # cut off
