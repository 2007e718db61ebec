"""Messages of control networks out of streams: DNP3 frames and S7 messages."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.framing import prefixed_messages
from .protocols import extract

#: What begins a DNP3 frame, and its checksum's polynomial, reflected.
DNP3_START, DNP3_POLYNOMIAL = b"\x05\x64", 0xA6BC
#: DNP3 functions by code.
DNP3_FUNCTIONS = {
    0: "confirm", 1: "read", 2: "write", 3: "select", 4: "operate", 5: "direct_operate", 6: "direct_operate_no_ack", 7: "freeze", 13: "cold_restart", 14: "warm_restart", 18: "stop_application",
    20: "enable_unsolicited", 21: "disable_unsolicited", 129: "response", 130: "unsolicited_response",
}
#: S7 kinds of messages and functions by code.
S7_KINDS = {1: "job", 2: "ack", 3: "ack_data", 7: "user_data"}
S7_FUNCTIONS = {0x04: "read", 0x05: "write", 0x1A: "request_download", 0x1B: "download_block", 0x1C: "download_ended", 0x1D: "start_upload", 0x1E: "upload", 0x1F: "end_upload", 0x28: "control", 0x29: "stop", 0xF0: "setup"}
DNP3_COLUMNS = "from_master boolean, master int, outstation int, sequence int, function string, group_number int, variation int"
S7_COLUMNS = "kind string, reference int, function string, error int"


def _table() -> list[int]:
    found = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ DNP3_POLYNOMIAL if byte & 1 else byte >> 1
        found.append(byte)
    return found


_CRC = _table()


def dnp3_checksum(data: bytes) -> bytes:
    crc = 0
    for byte in data:
        crc = crc >> 8 ^ _CRC[(crc ^ byte) & 0xFF]
    return struct.pack("<H", crc ^ 0xFFFF)


def dnp3_size(head: bytes) -> int | None:
    """The length of a DNP3 frame from its first ten bytes, whose checksum must be right."""
    if head[:2] != DNP3_START or head[2] < 5 or dnp3_checksum(head[:8]) != head[8:10]:
        return None
    user = head[2] - 5
    return 10 + user + 2 * -(-user // 16)


def dnp3_frame(data: bytes) -> dict | None:
    """A DNP3 frame that begins a message of the application: its ends, function and first object; None if a checksum is wrong or it goes on with another."""
    if len(data) < 10 or dnp3_size(data[:10]) != len(data):
        return None
    user, at = b"", 10
    while at < len(data):
        block = data[at : at + 18]
        if dnp3_checksum(block[:-2]) != block[-2:]:
            return None
        user += block[:-2]
        at += 18
    if len(user) < 3 or not user[0] & 0x40:
        return None
    to, sender = struct.unpack_from("<2H", data, 4)
    master = bool(data[3] & 0x80)
    code = user[2]
    objects = user[5:] if code in (129, 130) else user[3:]
    return {
        "from_master": master, "master": sender if master else to, "outstation": to if master else sender, "sequence": user[1] & 15, "function": DNP3_FUNCTIONS.get(code, str(code)),
        "group_number": objects[0] if objects else None, "variation": objects[1] if len(objects) > 1 else None,
    }


def written_dnp3(master: bool, to: int, sender: int, user: bytes) -> bytes:
    """A frame of one's own."""
    head = DNP3_START + struct.pack("<2B2H", 5 + len(user), 0xC4 if master else 0x44, to, sender)
    blocks = [user[k : k + 16] for k in range(0, len(user), 16)]
    return head + dnp3_checksum(head) + b"".join(b + dnp3_checksum(b) for b in blocks)


def tpkt_size(head: bytes) -> int | None:
    """The length of a TPKT from its first four bytes."""
    size = int.from_bytes(head[2:4], "big")
    return size if head[:2] == b"\x03\x00" and size >= 7 else None


def s7_message(data: bytes) -> dict | None:
    """An S7 message in a TPKT: kind, reference, function and error; None for connection set-up and other contents."""
    if len(data) < 17 or tpkt_size(data[:4]) != len(data) or data[5] & 0xF0 != 0xF0:
        return None
    at = 5 + data[4]
    if len(data) < at + 10 or data[at] != 0x32:
        return None
    kind, _, reference, parameters, _ = struct.unpack_from(">BH3H", data, at + 1)
    error, start = None, at + 10
    if kind in (2, 3):
        if len(data) < at + 12:
            return None
        error, start = struct.unpack_from(">H", data, at + 10)[0], at + 12
    function = S7_FUNCTIONS.get(data[start], str(data[start])) if parameters and start < len(data) and kind != 7 else None
    return {"kind": S7_KINDS.get(kind, str(kind)), "reference": reference, "function": function, "error": error}


def written_s7(kind: int, reference: int, parameters: bytes, error: int | None = None) -> bytes:
    """A message of one's own."""
    body = struct.pack(">2BH3H", 0x32, kind, 0, reference, len(parameters), 0) + (struct.pack(">H", error) if error is not None else b"") + parameters
    return struct.pack(">2BH", 3, 0, 7 + len(body)) + b"\x02\xf0\x80" + body


def dnp3(blocks: DataFrame) -> DataFrame:
    """DNP3 messages of streams at port 20000: the packet's columns, offset, and ``DNP3_COLUMNS``."""
    own = blocks.where("sport = 20000 OR dport = 20000")
    return extract(prefixed_messages(own, 10, dnp3_size).withColumnRenamed("message", "payload").withColumn("pkt_no", F.col("offset")), dnp3_frame, DNP3_COLUMNS).withColumnRenamed("pkt_no", "offset")


def s7(blocks: DataFrame) -> DataFrame:
    """S7 messages of streams at port 102: the packet's columns, offset, and ``S7_COLUMNS``."""
    own = blocks.where("sport = 102 OR dport = 102")
    return extract(prefixed_messages(own, 4, tpkt_size).withColumnRenamed("message", "payload").withColumn("pkt_no", F.col("offset")), s7_message, S7_COLUMNS).withColumnRenamed("pkt_no", "offset")
