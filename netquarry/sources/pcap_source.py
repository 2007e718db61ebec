"""``spark.read.format("pcap")``: captures as a data source that takes filters, and the sink that writes captures."""

from __future__ import annotations

import ipaddress
import json
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ..functions.bpf import matches, needed_addresses, parsed
from .captures import _ARROW, SCHEMA, TRANSPORTS, Walk, _open, begin, capture_ranges, decode, records
from .shared import shared_path

#: Columns whose comparisons the source takes from Spark.
TESTED = ("ts", "src", "dst", "sport", "dport", "transport", "ip_proto", "ip_version", "ethertype", "caplen", "orig_len", "ttl", "tcp_flags", "pkt_no")
_TESTS = {
    EqualTo: lambda value, own: own == value,
    In: lambda value, own: own in value,
    GreaterThan: lambda value, own: own > value,
    GreaterThanOrEqual: lambda value, own: own >= value,
    LessThan: lambda value, own: own < value,
    LessThanOrEqual: lambda value, own: own <= value,
}


@dataclass
class Range(InputPartition):
    """Whole records of a capture, with their first and last time if an index told them; without a state, all of the file."""

    capture: str
    start: int = 0
    end: int = 0
    first: int = 1
    state: str | None = None
    low: float | None = None
    high: float | None = None


class PcapReader(DataSourceReader):
    """Packets of ranges, with what Spark's filters and the options leave.

    Comparisons on ``TESTED`` columns are taken over whole, so that Spark needn't
    repeat them: ranges outside the times asked for aren't opened, packets
    outside them aren't decoded, nor are those without the bytes of an address asked for.
    """

    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}
        self.tree = parsed(self.options["bpf"]) if self.options.get("bpf", "").strip() else None
        if self.options.get("host"):
            host = ("host", None, str(ipaddress.ip_address(self.options["host"])))
            self.tree = host if self.tree is None else ("and", [host, self.tree])
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of known columns, and that these aren't null, which a comparison asks for anyway; gives back the rest."""
        name_of = lambda f: f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        taken = [f for f in filters if name_of(f) in TESTED and type(f) in _TESTS]
        self.tests += [(name_of(f), type(f), f.value) for f in taken]
        compared = {name_of(f) for f in taken}
        return [f for f in filters if f not in taken and not (isinstance(f, IsNotNull) and name_of(f) in compared)]

    def partitions(self) -> list[Range]:
        if self.options.get("index"):
            system, path = fs.FileSystem.from_uri(self.options["index"])
            table = ds.dataset(path, filesystem=system, format="parquet").to_table()
            names = ["capture", "start", "end", "first_pkt", "state", "low", "high"]
            found = [Range(*row) for row in zip(*(table.column(n).to_pylist() for n in names), strict=True) if row[1] is not None]
            return [r for r in found if self._times_allow(r.low, r.high)]
        path = self.options["path"]
        system, below = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        base = path[: len(path) - len(below)] if "://" in path else "file://"
        info = system.get_file_info(below)
        if info.type == fs.FileType.File:
            return [Range(base + below)]
        pattern = self.options.get("pathglobfilter", "*")
        files = system.get_file_info(fs.FileSelector(below, recursive=self.options.get("recursivefilelookup", "false").lower() == "true"))
        return [Range(base + f.path) for f in sorted(files, key=lambda f: f.path) if f.is_file and fnmatch(f.base_name, pattern)]

    def _times_allow(self, low: float | None, high: float | None) -> bool:
        """Whether a range's times can meet the comparisons of ts; ranges without a known time can't."""
        for name, kind, value in self.tests:
            if name != "ts":
                continue
            if low is None or high is None:
                return False
            least, most = (min(value), max(value)) if kind is In else (value, value)
            if kind in (EqualTo, In) and (most < low or least > high):
                return False
            if kind in (GreaterThan, GreaterThanOrEqual) and not _TESTS[kind](value, high):
                return False
            if kind in (LessThan, LessThanOrEqual) and not _TESTS[kind](value, low):
                return False
        return True

    def _addresses(self) -> list[frozenset[bytes]]:
        """Sets of addresses, of each of which a packet must hold one."""
        found = [needed_addresses(self.tree)] if self.tree is not None else []
        for name, kind, value in self.tests:
            if name in ("src", "dst") and kind in (EqualTo, In):
                try:
                    found.append(frozenset(ipaddress.ip_address(v).packed for v in (value if kind is In else [value])))
                except ValueError:
                    pass  # no address: nothing will be equal to it
        return [f for f in found if f is not None]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark makes of no partitions at all
            return
        try:
            source = _open(partition.capture)
            walk = begin(source) if partition.state is None else Walk(*json.loads(partition.state), partition.start)
        except OSError:
            return
        if walk is None:
            return  # no capture: no rows, as ``capture_errors`` tells
        of_time = [(_TESTS[k], v) for name, k, v in self.tests if name == "ts"]
        others = [(name, _TESTS[k], v) for name, k, v in self.tests if name != "ts"]
        addresses, rows = self._addresses(), []
        for number, (ts, link, full, frame) in enumerate(records(source, walk, partition.end or source.size), partition.first):
            if of_time and (ts is None or not all(test(v, ts) for test, v in of_time)):
                continue
            if not all(any(a in frame for a in own) for own in addresses):
                continue
            row = {"capture": partition.capture, "pkt_no": number, "ts": ts, "caplen": len(frame), "orig_len": full} | decode(frame, link)
            if not all(row.get(name) is not None and test(v, row[name]) for name, test, v in others):
                continue
            if self.tree is not None and not matches(self.tree, row):
                continue
            rows.append(row)
            if len(rows) == 4_096:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class PcapSource(DataSource):
    """Packets of pcap and pcapng files below a path, one row each.

    Options: ``path``; ``pathGlobFilter`` and ``recursiveFileLookup`` as of
    Spark's own sources; ``index``, a table of ``write_index``, by which large
    files are split and ranges left out by time; ``host``, an address that must be
    an end; ``bpf``, a capture filter. Files that are no captures give no row.
    """

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PcapReader:
        return PcapReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known, and let Spark hand its filters over."""
    spark.dataSource.register(PcapSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_index(spark: SparkSession, path: str, index: str | None = None, **options) -> str:
    """Write the ranges of all captures below a path, with their times, as a table for the ``index`` option; returns where."""
    index = index or shared_path(spark, "capture-index")
    capture_ranges(spark, path, **options).where("error IS NULL").drop("error").write.parquet(index)
    return index


def frame_of(row: dict) -> bytes:
    """An Ethernet frame of a packet's columns: IPv4 or IPv6 with TCP, UDP or another payload; checksums are left zero."""
    payload = row.get("payload") or b""
    proto = row.get("ip_proto") or next((p for p, name in TRANSPORTS.items() if name == row.get("transport")), 253)
    if proto == 6:
        inner = struct.pack(">2H2I2B3H", row["sport"], row["dport"], row.get("tcp_seq") or 0, row.get("tcp_ack") or 0, 5 << 4, row.get("tcp_flags") or 0, row.get("tcp_window") or 0, 0, 0) + payload
    elif proto == 17:
        inner = struct.pack(">4H", row["sport"], row["dport"], 8 + len(payload), 0) + payload
    else:
        inner = payload
    src, dst = ipaddress.ip_address(row["src"]), ipaddress.ip_address(row["dst"])
    ttl = row.get("ttl") or 64
    if src.version == 4:
        packet = struct.pack(">2B3H2BH", 0x45, 0, 20 + len(inner), 0, 0, ttl, proto, 0) + src.packed + dst.packed + inner
    else:
        packet = struct.pack(">IHBB", 6 << 28, len(inner), proto, ttl) + src.packed + dst.packed + inner
    macs = b"".join(bytes.fromhex((row.get(c) or "").replace(":", "").zfill(12)) for c in ("dst_mac", "src_mac"))
    tags = b"".join(struct.pack(">2H", 0x8100, v) for v in row.get("vlan_ids") or ())
    return macs + tags + struct.pack(">H", 0x0800 if src.version == 4 else 0x86DD) + packet


def write_captures(packets: DataFrame, folder: str, file_bytes: int = 256 << 20) -> DataFrame:
    """Write packets (src, dst and what else of the source's columns there is) as pcap files of about ``file_bytes``, each task its own: uri, packets.

    Call an action on the result to write. Only the files that it lists count;
    a task that runs again writes new ones. Times are kept to the microsecond.
    """
    columns = [c for c in _ARROW.names if c in packets.columns]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        rows = (row for batch in batches for at in range(0, batch.num_rows, 1_024) for row in batch.slice(at, 1_024).to_pylist())
        row = next(rows, None)
        while row is not None:
            name, written, count = f"{uuid.uuid4().hex}.pcap", 0, 0
            with system.open_output_stream(f"{path}/{name}") as out:
                out.write(struct.pack("<I2H4I", 0xA1B2C3D4, 2, 4, 0, 0, 262_144, 1))
                while row is not None and written < file_bytes:
                    frame, micros = frame_of(row), round((row.get("ts") or 0) * 1_000_000)
                    out.write(struct.pack("<4I", micros // 1_000_000, micros % 1_000_000, len(frame), len(frame)) + frame)
                    written, count = written + 16 + len(frame), count + 1
                    row = next(rows, None)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([count], pa.int64())], ["uri", "packets"])

    return packets.select(*columns).mapInArrow(write, "uri string, packets bigint")


def seconds(ts: str) -> "F.Column":
    """A timestamp column as seconds from the epoch."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts}) / 1e6D")
