"""Packets of capture files (pcap and pcapng), one row each.

Spark lists the files; a first pass finds ranges of whole records by their heads,
a second one decodes the ranges, each a row of its own, so that files of any size
are read by many tasks. Files that are no capture give no packet, and one that is
cut short gives those before the cut; ``capture_errors`` tells both.
"""

from __future__ import annotations

import ipaddress
import json
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Magic numbers of pcap files, as ticks a second; the byte order is tried both ways.
PCAP_TICKS = {0xA1B2C3D4: 1_000_000, 0xA1B23C4D: 1_000_000_000}
#: Blocks of pcapng files and its byte-order mark.
SECTION, INTERFACE, SIMPLE, ENHANCED, ORDER_MARK = 0x0A0D0D0A, 1, 3, 6, 0x1A2B3C4D
#: A block that claims more is damage.
LARGEST_BLOCK = 64 << 20
#: IPv6 extension headers that stand before the transport.
EXTENSIONS = (0, 43, 44, 60)
#: Link types and ethertypes that are decoded.
ETHERNET, RAW_IP, IPV4, IPV6, ARP, VLANS = 1, 101, 0x0800, 0x86DD, 0x0806, (0x8100, 0x88A8, 0x9100)
#: Transports by IP protocol.
TRANSPORTS = {1: "ICMP", 6: "TCP", 17: "UDP", 58: "ICMP"}

SCHEMA = (
    "capture string, pkt_no bigint, ts double, caplen int, orig_len int, src_mac string, dst_mac string, ethertype int, vlan_ids array<int>, "
    "src string, dst string, ip_version int, ttl int, ip_proto int, sport int, dport int, transport string, "
    "tcp_flags int, tcp_seq bigint, tcp_ack bigint, tcp_window int, payload binary"
)
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}
_ARROW = pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in SCHEMA.split(", ")])


@dataclass
class Walk:
    """Where a capture's records are: what is needed to decode from any of them on."""

    kind: str  # pcap or pcapng
    order: str
    ticks: int
    link: int
    links: list[tuple[int, int]]  # of a section's interfaces: link type and ticks a second
    at: int

    def state(self) -> str:
        return json.dumps([self.kind, self.order, self.ticks, self.link, self.links])


class Window:
    """A file's bytes by place, read in large pieces."""

    def __init__(self, file, size: int, piece: int = 4 << 20):
        self.file, self.size, self.piece, self.start, self.data = file, size, piece, 0, b""

    def read(self, at: int, size: int) -> bytes:
        """Up to ``size`` bytes at a place; fewer only at the file's end."""
        if at < self.start or at + size > self.start + len(self.data):
            self.file.seek(at)
            self.start, self.data = at, self.file.read(min(max(size, self.piece), max(self.size - at, 0)))
        return self.data[at - self.start : at - self.start + size]


def begin(source: Window) -> Walk | None:
    """The start of a capture's records; None if it is none."""
    head = source.read(0, 24)
    if len(head) < 12:
        return None
    if struct.unpack_from("<I", head)[0] == SECTION:
        return Walk("pcapng", "<", 1, 0, [], 0)
    order = next((o for o in "<>" if struct.unpack_from(o + "I", head)[0] in PCAP_TICKS), None)
    if order is None or len(head) < 24:
        return None
    return Walk("pcap", order, PCAP_TICKS[struct.unpack_from(order + "I", head)[0]], struct.unpack_from(order + "I", head, 20)[0] & 0xFFFF, [], 24)


def records(source: Window, walk: Walk, end: int, whole: bool = True) -> Iterator[tuple[float | None, int, int, bytes]]:
    """Time, link type, original length and bytes of each packet that begins before ``end``; moves the walk along.

    Without ``whole`` the packets' bytes aren't read, which is enough to find their places.
    """
    while walk.at < end:
        if walk.kind == "pcap":
            head = source.read(walk.at, 16)
            if len(head) < 16:
                return
            seconds, part, kept, full = struct.unpack(walk.order + "4I", head)
            if walk.at + 16 + kept > source.size:
                return
            data = source.read(walk.at + 16, kept) if whole else b""
            walk.at += 16 + kept
            yield seconds + part / walk.ticks, walk.link, full, data
            continue
        head = source.read(walk.at, 12)
        if len(head) < 12:
            return
        kind = struct.unpack_from(walk.order + "I", head)[0]
        if kind == SECTION:
            walk.order, walk.links = "<" if struct.unpack_from("<I", head, 8)[0] == ORDER_MARK else ">", []
        size = struct.unpack_from(walk.order + "I", head, 4)[0]
        if size < 12 or size % 4 or size > LARGEST_BLOCK or walk.at + size > source.size:
            return
        body = source.read(walk.at + 8, size - 12 if whole or kind == INTERFACE else min(size - 12, 20))
        walk.at += size
        if kind == INTERFACE and len(body) >= 8:
            walk.links.append((struct.unpack_from(walk.order + "H", body)[0], _ticks(body[8:], walk.order)))
        elif kind == ENHANCED and len(body) >= 20:
            port, high, low, kept, full = struct.unpack_from(walk.order + "5I", body)
            if port < len(walk.links) and 20 + kept <= size - 12:
                yield (high << 32 | low) / walk.links[port][1], walk.links[port][0], full, body[20 : 20 + kept]
        elif kind == SIMPLE and walk.links and len(body) >= 4:
            full = struct.unpack_from(walk.order + "I", body)[0]
            yield None, walk.links[0][0], full, body[4 : 4 + full]


def _ticks(options: bytes, order: str) -> int:
    """Ticks a second of an interface: its option 9, else microseconds."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "2H", options, at)
        if code == 9 and size == 1 and at + 4 < len(options):
            exponent = options[at + 4]
            return 2 ** (exponent & 127) if exponent & 128 else 10**exponent
        at += 4 + size + -size % 4
    return 1_000_000


def decode(frame: bytes, link: int) -> dict:
    """The columns that a frame's headers give; what is cut short or unknown is left out."""
    row: dict = {"transport": "OTHER"}
    try:
        if link == ETHERNET:
            row |= {"dst_mac": frame[0:6].hex(":"), "src_mac": frame[6:12].hex(":"), "vlan_ids": []}
            kind, at = struct.unpack_from(">H", frame, 12)[0], 14
            while kind in VLANS:
                tag, kind = struct.unpack_from(">2H", frame, at)
                row["vlan_ids"].append(tag & 0xFFF)
                at += 4
            row["ethertype"] = kind
            packet = frame[at:]
        elif link == RAW_IP and frame:
            packet, kind = frame, IPV6 if frame[0] >> 4 == 6 else IPV4
        else:
            return row
        if kind == ARP:
            return row | {"src": str(ipaddress.IPv4Address(packet[14:18])), "dst": str(ipaddress.IPv4Address(packet[24:28]))}
        if kind == IPV4:
            header, total = (packet[0] & 15) * 4, struct.unpack_from(">H", packet, 2)[0]
            row |= {"ip_version": 4, "ttl": packet[8], "ip_proto": packet[9]}
            row |= {"src": str(ipaddress.IPv4Address(packet[12:16])), "dst": str(ipaddress.IPv4Address(packet[16:20]))}
            inner = packet[header : total or None]  # without the frame's padding; 0 is left by offloading
            if struct.unpack_from(">H", packet, 6)[0] & 0x1FFF:
                return row | {"payload": inner}  # a later fragment has no ports
        elif kind == IPV6:
            length, proto, hops = struct.unpack_from(">HBB", packet, 4)
            row |= {"ip_version": 6, "ttl": hops, "ip_proto": proto}
            row |= {"src": str(ipaddress.IPv6Address(packet[8:24])), "dst": str(ipaddress.IPv6Address(packet[24:40]))}
            inner = packet[40 : 40 + length]
            while proto in EXTENSIONS and len(inner) >= 8:
                if proto == 44 and struct.unpack_from(">H", inner, 2)[0] & 0xFFF8:
                    return row | {"ip_proto": inner[0], "payload": inner[8:]}  # a later fragment has no ports
                proto, inner = inner[0], inner[8 if proto == 44 else 8 * (inner[1] + 1) :]
            row["ip_proto"] = proto
        else:
            return row
        proto = row["ip_proto"]
        if proto == 6:
            sport, dport, seq, ack, offset, flags, window = struct.unpack_from(">2H2I2BH", inner)
            row |= {"sport": sport, "dport": dport, "tcp_seq": seq, "tcp_ack": ack, "tcp_flags": flags, "tcp_window": window, "payload": inner[(offset >> 4) * 4 :]}
        elif proto == 17:
            row |= {"sport": struct.unpack_from(">H", inner)[0], "dport": struct.unpack_from(">H", inner, 2)[0], "payload": inner[8:]}
        else:
            row["payload"] = inner
        row["transport"] = TRANSPORTS.get(proto, "OTHER")
    except (struct.error, ipaddress.AddressValueError, IndexError):
        pass  # a header that the capture cut: the columns before it stay
    return row


def _open(name: str) -> Window:
    """A file by the name that Spark lists it under."""
    uri = re.sub("^file:/+", "file:///", name).replace("s3a://", "s3://", 1)
    system, path = fs.FileSystem.from_uri(uri)
    file = system.open_input_file(path)
    return Window(file, file.size())


def capture_ranges(spark: SparkSession, path: str, pattern: str = "*.{pcap,pcapng,cap}", recursive: bool = False, range_bytes: int = 16 << 20) -> DataFrame:
    """Captures below a path in ranges of whole records: capture, start, end, first_pkt, state, error, and the least and greatest time (low, high).

    A task walks over a file's record heads, in large pieces, and holds one piece;
    files of any size are split. What is no capture, or can't be opened, is one
    row with an error and no range. ``pattern`` is a glob of file names.
    """
    schema = "capture string, start bigint, `end` bigint, first_pkt bigint, state string, error string, low double, high double"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = list(_ranges(name, range_bytes))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
                names = ["capture", "start", "end", "first_pkt", "state", "error", "low", "high"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path").mapInArrow(walk, schema)


def _ranges(name: str, range_bytes: int) -> Iterator[tuple]:
    """The rows of ``capture_ranges`` for one file."""
    wrong = lambda text: (name, None, None, None, None, text, None, None)
    try:
        source = _open(name)
        own = begin(source)
        if own is None:
            yield wrong("not a capture")
            return
        start, first, state, low, high = own.at, 1, own.state(), None, None
        for n, (ts, *_) in enumerate(records(source, own, source.size, whole=False), 1):
            if ts is not None:
                low, high = ts if low is None else min(low, ts), ts if high is None else max(high, ts)
            if own.at - start >= range_bytes:
                yield name, start, own.at, first, state, None, low, high
                start, first, state, low, high = own.at, n + 1, own.state(), None, None
        if own.at > start:
            yield name, start, own.at, first, state, None, low, high
        if own.at < source.size:
            yield wrong(f"damaged at byte {own.at}")
    except OSError as problem:
        yield wrong(str(problem))


def packets_of(ranges: DataFrame, rows_at_once: int = 4_096) -> DataFrame:
    """The packets of capture ranges (see ``capture_ranges``), numbered from 1 in each file; ranges are dealt evenly to as many tasks as a shuffle has.

    That number is given, as Spark would put rows as small as ranges into a single task.
    """

    def packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start, end, first, state in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                source, rows = _open(name), []
                own = Walk(*json.loads(state), start)
                for number, (ts, link, full, frame) in enumerate(records(source, own, end), first):
                    rows.append({"capture": name, "pkt_no": number, "ts": ts, "caplen": len(frame), "orig_len": full} | decode(frame, link))
                    if len(rows) == rows_at_once:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    found = ranges.where("error IS NULL").select("capture", "start", "end", "first_pkt", "state")
    return found.repartition(int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(packets, SCHEMA)


def read_captures(spark: SparkSession, path: str, pattern: str = "*.{pcap,pcapng,cap}", recursive: bool = False, **options) -> DataFrame:
    """Packets of all captures below a path; numbered from 1 in each file."""
    return packets_of(capture_ranges(spark, path, pattern, recursive, **options))


def capture_errors(ranges: DataFrame) -> DataFrame:
    """Files that are no capture, can't be read or are cut short: capture, error."""
    return ranges.where("error IS NOT NULL").select("capture", "error")


#: Options of pcapng blocks that are told, by block, with how they are read.
OPTIONS = {
    SECTION: {2: ("hardware", "text"), 3: ("os", "text"), 4: ("application", "text")},
    INTERFACE: {2: ("name", "text"), 3: ("description", "text"), 6: ("mac", "mac"), 8: ("speed", "number"), 11: ("filter", "filter"), 12: ("os", "text")},
    5: {4: ("received", "number"), 5: ("dropped", "number")},
}
STATISTICS = 5
INTERFACES = (
    "capture string, kind string, section int, interface int, link_type int, snaplen bigint, name string, description string, mac string, speed bigint, filter string, "
    "hardware string, os string, application string, received bigint, dropped bigint"
)


def _options(data: bytes, order: str, kind: int) -> dict:
    """The known options in a block's end; those before damage."""
    found, at = {}, 0
    while at + 4 <= len(data):
        code, size = struct.unpack_from(order + "2H", data, at)
        value = data[at + 4 : at + 4 + size]
        if code == 0 or len(value) < size:
            break
        if code in OPTIONS[kind]:
            name, how = OPTIONS[kind][code]
            if how == "number":
                found[name] = int.from_bytes(value, "little" if order == "<" else "big") & (1 << 63) - 1
            else:
                found[name] = value.hex(":") if how == "mac" else value[how == "filter" :].decode("utf-8", "replace").rstrip("\0")
        at += 4 + size + -size % 4
    return found


def _described(name: str) -> Iterator[dict]:
    """The sections and interfaces of one capture; a pcap file is a section with one interface."""
    try:
        source = _open(name)
        own = begin(source)
    except OSError:
        return
    if own is None:
        return
    if own.kind == "pcap":
        yield {"capture": name, "kind": "pcap", "section": 1, "interface": 0, "link_type": own.link, "snaplen": struct.unpack_from(own.order + "I", source.read(0, 24), 16)[0]}
        return
    section, of_section, links, counted = 0, {}, [], {}

    def told() -> Iterator[dict]:
        for n, link in enumerate(links or [{}]):
            yield {"capture": name, "kind": "pcapng", "section": section, "interface": n if links else None} | of_section | link | counted.get(n, {})

    while own.at < source.size:
        head = source.read(own.at, 12)
        if len(head) < 12:
            break
        kind = struct.unpack_from(own.order + "I", head)[0]
        if kind == SECTION:
            if section:
                yield from told()
            own.order = "<" if struct.unpack_from("<I", head, 8)[0] == ORDER_MARK else ">"
            section, links, counted = section + 1, [], {}
        size = struct.unpack_from(own.order + "I", head, 4)[0]
        if size < 12 or size % 4 or size > LARGEST_BLOCK or own.at + size > source.size:
            break
        body = source.read(own.at + 8, size - 12) if kind in OPTIONS else b""
        own.at += size
        if kind == SECTION:
            of_section = _options(body[16:], own.order, SECTION)
        elif kind == INTERFACE and len(body) >= 8:
            links.append({"link_type": struct.unpack_from(own.order + "H", body)[0], "snaplen": struct.unpack_from(own.order + "I", body, 4)[0]} | _options(body[8:], own.order, INTERFACE))
        elif kind == STATISTICS and len(body) >= 12:
            counted[struct.unpack_from(own.order + "I", body)[0]] = _options(body[12:], own.order, STATISTICS)
    if section:
        yield from told()


def capture_interfaces(spark: SparkSession, path: str, pattern: str = "*.{pcap,pcapng,cap}", recursive: bool = False) -> DataFrame:
    """The interfaces of captures with what their blocks tell: ``INTERFACES``; one row a section without any. An interface's own system stands before its section's.

    A task walks over a file's block heads; packets aren't read. What is no capture gives no row.
    """
    names = [f.split()[0] for f in INTERFACES.split(", ")]
    types = pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in INTERFACES.split(", ")])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = [{n: row.get(n) for n in names} for row in _described(name)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, types)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path").mapInArrow(describe, INTERFACES)
