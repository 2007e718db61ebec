"""WARC records in ZIP-packaged archives: a writer, and a reader that works on byte ranges."""

from __future__ import annotations

import gzip
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, join_groups, scratch, split_by_sieve, staged, utf8

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: ZIP signatures and sizes (end, ZIP64 locator, ZIP64 end, directory entry, local header), and the extra field of ZIP64.
END, LOCATOR, END64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, LOCATOR_SIZE, ENTRY_SIZE, LOCAL_SIZE, ZIP64_EXTRA, STORED = 22, 20, 46, 30, 1, 0
LONGEST_COMMENT = 65_535
#: Bytes of payload that a reader hands on at once, unless one payload is longer.
BATCH_BYTES = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Member:
    """A member of a ZIP file: its name, method, size as stored, and where its local header is."""

    name: str
    method: int
    size: int
    header_at: int


class RangeReader:
    """Reads byte ranges of one file, anywhere that pyarrow reaches; counts the bytes it read."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        self.size, self.bytes_read = self.file.size(), 0

    def read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(size)
        if len(data) != size:
            raise ValueError(f"the file ends within the {size} bytes at {at}")
        self.bytes_read += size
        return data

    def __enter__(self) -> RangeReader:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def members(source: RangeReader) -> list[Member]:
    """The central directory of a ZIP file, with ZIP64 ends and entries, from its tail alone."""
    tail_at = max(0, source.size - END_SIZE - LONGEST_COMMENT - LOCATOR_SIZE)
    tail = source.read(tail_at, source.size - tail_at)
    end = tail.rfind(END)
    while end >= 0 and end + END_SIZE + int.from_bytes(tail[end + 20 : end + 22], "little") != len(tail):
        end = tail.rfind(END, 0, end)  # the signature within a comment
    if end < 0:
        raise ValueError("not a ZIP file: no end of central directory")
    count, size, at = struct.unpack("<HII", tail[end + 10 : end + 20])
    if count == 0xFFFF or 0xFFFFFFFF in (size, at):
        if end < LOCATOR_SIZE or tail[end - LOCATOR_SIZE : end - LOCATOR_SIZE + 4] != LOCATOR:
            raise ValueError("no ZIP64 locator before the end of central directory")
        end64 = source.read(struct.unpack("<Q", tail[end - LOCATOR_SIZE + 8 : end - LOCATOR_SIZE + 16])[0], 56)
        if end64[:4] != END64:
            raise ValueError("the ZIP64 locator points elsewhere")
        count, size, at = struct.unpack("<QQQ", end64[32:56])
    directory, found, place = source.read(at, size), [], 0
    for _ in range(count):
        if directory[place : place + 4] != ENTRY:
            raise ValueError("a directory entry is damaged")
        flags, method = struct.unpack("<HH", directory[place + 8 : place + 12])
        stored, whole = struct.unpack("<II", directory[place + 20 : place + 28])
        name_size, extra_size, comment_size = struct.unpack("<HHH", directory[place + 28 : place + 34])
        header_at = struct.unpack("<I", directory[place + 42 : place + 46])[0]
        name = directory[place + ENTRY_SIZE : place + ENTRY_SIZE + name_size].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[place + ENTRY_SIZE + name_size : place + ENTRY_SIZE + name_size + extra_size]
        wide = _zip64_fields(extra)
        if whole == 0xFFFFFFFF:
            whole = next(wide)
        if stored == 0xFFFFFFFF:
            stored = next(wide)
        if header_at == 0xFFFFFFFF:
            header_at = next(wide)
        found.append(Member(name, method, stored, header_at))
        place += ENTRY_SIZE + name_size + extra_size + comment_size
    return found


def _zip64_fields(extra: bytes) -> Iterator[int]:
    """The 64-bit numbers of the ZIP64 extra field, in order."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack("<HH", extra[at : at + 4])
        if kind == ZIP64_EXTRA:
            yield from struct.unpack(f"<{size // 8}Q", extra[at + 4 : at + 4 + size // 8 * 8])
        at += 4 + size


def data_start(source: RangeReader, member: Member) -> int:
    """Where a stored member's bytes begin, by its local header."""
    if member.method != STORED:
        raise ValueError(f"{member.name} is compressed as a whole and can't be read by ranges")
    header = source.read(member.header_at, LOCAL_SIZE)
    if header[:4] != LOCAL:
        raise ValueError(f"no local header of {member.name}")
    return member.header_at + LOCAL_SIZE + sum(struct.unpack("<HH", header[26:30]))


def record(kind: str, name: str, uri: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A WARC record as a gzip member. Its block is the response's head and, unless it is a revisit, the payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name}",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_to}"]
    else:
        block += payload
    head += [f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + block + b"\r\n\r\n", 3, mtime=0)


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Fields of a record's head, of the response's head, and the payload."""
    plain = zlib.decompress(data, wbits=31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, _fields(http), payload


def _fields(head: bytes) -> dict[str, str]:
    return {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in head.decode().split("\r\n")[1:])}


def _record_name(page_id: object) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Pages whose payload a page of smaller id has: page_id, digest, refers_to.

    Digests alone are shuffled, and those of large groups not even once more
    (``join_groups``). Pages with null ids refer to the smallest id, if any.
    """
    digests = staged(
        pages.select("page_id", F.sha2(utf8("html"), 256).alias("digest"), F.octet_length(utf8("html")).alias("size")).where(F.col("size") >= least_bytes), "digests"
    )
    first = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    later = join_groups(digests, staged(first, "first"), ["digest"], digests.count(), "n").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return staged(later.select("page_id", "digest", "refers_to").distinct(), "revisits")


def write_archives(pages: DataFrame, least_bytes: int = 100, archive_bytes: int = 64 << 20) -> DataFrame:
    """Write a WARC record for each page into ZIP archives in the shared folder: one row (uri, records) an archive.

    Of pages with equal payloads of ``least_bytes`` or more, that of the
    smallest id is a response and the others are revisits of it; the rest are
    responses. Each task writes its rows into archives of about
    ``archive_bytes``: records as gzip members in a stored ``archive/`` member,
    and an index of their offsets in a stored ``indexes/`` member. A task that
    runs again writes new files; only those of the attempt that counted are
    listed. Null html is an empty payload, a null url an empty target.
    Payloads of responses never move: a Bloom filter of the revisits lets them
    pass, and only what it holds back meets the table of revisits.
    """
    spark = pages.sparkSession
    later = revisits(pages, least_bytes)
    own = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), utf8("html").alias("payload"))
    own = own.withColumn("sha256", F.sha2("payload", 256))
    clear, maybe = split_by_sieve(own, F.xxhash64("page_id", "sha256"), later.select(F.xxhash64("page_id", "digest").alias("key")))
    columns = ["page_id", "url", "payload", "sha256", "refers_to"]
    is_later = maybe["page_id"].eqNullSafe(later["page_id"]) & (maybe["sha256"] == later["digest"])
    joined = maybe.join(later, is_later, "left").select(maybe["page_id"], *columns[1:])
    rows = clear.withColumn("refers_to", F.lit(None).cast(later.schema["refers_to"].dataType)).select(*columns).unionByName(joined)
    folder = scratch(spark, "archives")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        lines: Iterator[dict] = (row for batch in blocks(batches, 256, BATCH_BYTES, column=2) for row in _rows(batch))
        row = next(lines, None)
        while row is not None:
            name, index, at = f"{uuid.uuid4().hex}.wacz", [], 0
            with system.open_output_stream(f"{path}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
                with archive.open(ARCHIVE, "w", force_zip64=True) as member:
                    while row is not None and at < archive_bytes:
                        kind = "response" if row["refers_to"] is None else "revisit"
                        to = None if row["refers_to"] is None else _record_name(row["refers_to"])
                        data = record(kind, _record_name(row["page_id"]), _one_line(row["url"]), row["payload"], row["sha256"], to)
                        member.write(data)
                        index.append(f"{_record_name(row['page_id'])} {json.dumps({'offset': at, 'length': len(data)})}\n")
                        at += len(data)
                        row = next(lines, None)
                archive.writestr(INDEX, "".join(index))
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(index)], pa.int64())], ["uri", "records"])

    return staged(rows.mapInArrow(write, "uri string, records bigint"), "archive-list")


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for at in range(batch.num_rows):
        yield {name: batch.column(k)[at].as_py() for k, name in enumerate(batch.schema.names)}


def _one_line(uri: str) -> str:
    return "".join(c if " " < c != "\x7f" else "%%%02X" % ord(c) for c in uri)


def record_ranges(archives: DataFrame) -> DataFrame:
    """The stored records of ZIP archives: (uri, offset, length), from each archive's directory and index alone."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with RangeReader(uri) as source:
                    by_name = {m.name: m for m in members(source)}
                    begin = data_start(source, by_name[ARCHIVE])
                    index = by_name[INDEX]
                    lines = source.read(data_start(source, index), index.size).decode().splitlines()
                ranges = [json.loads(line.split(" ", 1)[1]) for line in lines]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri] * len(ranges), pa.string()), pa.array([begin + r["offset"] for r in ranges], pa.int64()), pa.array([r["length"] for r in ranges], pa.int64())],
                    ["uri", "offset", "length"],
                )

    return archives.select("uri").mapInArrow(locate, "uri string, offset bigint, length bigint")


def read_records(ranges: DataFrame, rows_at_once: int = 256) -> DataFrame:
    """Range-read records: page_id, record_type, url, payload_bytes, payload_digest, refers_to, payload.

    A response's length and digest are taken from its payload and must agree
    with its head; a revisit's are those that its head gives of the full
    payload, and its own payload is null.
    """
    schema = "page_id bigint, record_type string, url string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = [f.split()[0] for f in schema.split(", ")]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            rows, held = [], 0
            for uri in pc.unique(batch.column(0)).to_pylist():
                own = batch.filter(pc.equal(batch.column(0), uri))
                with RangeReader(uri) as source:
                    for begin, size in zip(own.column(1).to_pylist(), own.column(2).to_pylist(), strict=True):
                        rows.append(_row(*parse_record(source.read(begin, size))))
                        held += len(rows[-1][-1] or b"")
                        if len(rows) >= rows_at_once or held >= BATCH_BYTES:
                            yield packed(rows)
                            rows, held = [], 0
            if rows:
                yield packed(rows)

    return ranges.mapInArrow(read, schema)


def _row(fields: dict[str, str], http: dict[str, str], payload: bytes) -> tuple:
    kind = fields["warc-type"]
    digest, size, refers_to = fields["warc-payload-digest"].removeprefix("sha256:"), int(http["content-length"]), None
    if kind == "revisit":
        refers_to = _page_of(fields["warc-refers-to"])
    elif (len(payload), sha256(payload).hexdigest()) != (size, digest):
        raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
    return _page_of(fields["warc-record-id"]), kind, fields["warc-target-uri"], size, digest, refers_to, payload if kind == "response" else None


def archive_pages(pages: DataFrame, least_bytes: int = 100, archive_bytes: int = 64 << 20) -> DataFrame:
    """Write pages as WARC records into ZIP archives and read them back by ranges (see ``write_archives``, ``read_records``).

    Repeated rows are written one by one; those that repeat the smallest id of
    their payload are all responses. Other columns are ignored.
    """
    return read_records(record_ranges(write_archives(pages, least_bytes, archive_bytes)))
