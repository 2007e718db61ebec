"""Messages out of reassembled streams, however these were cut into segments and blocks."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Columns of a direction of a stream.
WAY = ["capture", "stream_id", "src", "sport", "dst", "dport"]
#: HTTP/1 methods, and codes whose responses have no body.
METHODS = ("GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH", "TRACE", "CONNECT")
BODILESS = (204, 304)
#: A head of more bytes is none.
MOST_HEAD = 1 << 16


class Places:
    """When the bytes at an offset were captured, by the marks of the blocks so far; older ones are forgotten."""

    def __init__(self):
        self.offsets, self.marks = [], []

    def add(self, marks: list[dict], oldest: int) -> None:
        first = max(bisect.bisect_right(self.offsets, oldest) - 1, 0)
        self.offsets, self.marks = self.offsets[first:], self.marks[first:]
        self.offsets += [m["offset"] for m in marks]
        self.marks += [(m["ts"], m["pkt_no"]) for m in marks]

    def at(self, offset: int) -> tuple[float | None, int | None]:
        n = bisect.bisect_right(self.offsets, offset) - 1
        return self.marks[n] if n >= 0 else (None, None)


class Prefixed:
    """Messages that tell their own length: ``size`` gives it from the first ``head`` bytes, or None if these begin no message.

    After bytes that begin none, or that weren't captured, the next message
    begins where a head stands whose message is followed by another head, or by
    the end of what is known.
    """

    def __init__(self, head: int, size: Callable[[bytes], int | None], most: int = 1 << 24):
        self.head, self.size, self.most = head, size, most
        self.held, self.start, self.lost = bytearray(), 0, False

    def _size(self, at: int) -> int | None:
        found = self.size(bytes(self.held[at : at + self.head]))
        return found if found is not None and self.head <= found <= self.most else None

    def feed(self, data: bytes) -> Iterator[tuple[int, bytes]]:
        self.held += data
        at = 0
        while len(self.held) - at >= self.head:
            size = self._size(at)
            if size is None:
                self.lost = True
                at += 1
                continue
            if len(self.held) - at < size:
                break
            if self.lost and len(self.held) - at - size >= self.head and self._size(at + size) is None:
                at += 1
                continue
            self.lost = False
            yield self.start + at, bytes(self.held[at : at + size])
            at += size
        del self.held[:at]
        self.start += at

    def skip(self, missing: int) -> None:
        """So many bytes weren't captured; what is held of a message is given up."""
        self.start += len(self.held)
        self.held.clear()
        self.lost = True

    def finish(self) -> Iterator[tuple[int, bytes]]:
        return iter(())

    def oldest(self) -> int:
        """The first offset that a message still to come may begin at."""
        return self.start


class HttpMessage(dict):
    """One message while its body is read."""

    def __init__(self, offset: int, **columns):
        super().__init__(offset=offset, body_bytes=0, complete=True, **columns)
        self.kept, self.digest = bytearray(), sha256()

    def add(self, data: bytes, most: int) -> None:
        self["body_bytes"] += len(data)
        self.digest.update(data)
        if len(self.kept) < most:
            self.kept += data[: most - len(self.kept)]

    def done(self) -> dict:
        return dict(self) | {"body": bytes(self.kept), "body_sha256": self.digest.hexdigest()}


class Http:
    """HTTP/1 messages of one direction: heads, and bodies by length, by chunks or up to the end.

    Of a body the first ``body_bytes`` are kept, and the length and SHA-256 of
    all of it. ``methods`` are those of the requests of the other direction, if
    these were read before: a response to HEAD has no body. A body with bytes
    that weren't captured isn't ``complete``; a head with such is given up, and
    the next one searched for.
    """

    REQUEST = re.compile(rb"(" + "|".join(METHODS).encode() + rb") (\S+) HTTP/(1\.[01])\r?\n")
    RESPONSE = re.compile(rb"HTTP/(1\.[01]) (\d{3})(?: ([^\r\n]*))?\r?\n")
    START = re.compile(rb"(?:" + "|".join(METHODS).encode() + rb") \S+ HTTP/1\.[01]\r?\n|HTTP/1\.[01] \d{3}[ \r\n]")
    HEAD_END = re.compile(rb"\r?\n\r?\n")

    def __init__(self, methods: list[str] | None = None, body_bytes: int = 1 << 16):
        self.methods, self.body_bytes = list(methods or ()), body_bytes
        self.held, self.start, self.message, self.left, self.mode = bytearray(), 0, None, 0, "head"

    def feed(self, data: bytes) -> Iterator[tuple[int, dict]]:
        self.held += data
        moved = True
        while moved:
            moved = False
            for found in getattr(self, f"_{self.mode}")():
                moved = True
                if found is not None:
                    yield found["offset"], found

    def _take(self, size: int) -> bytes:
        data = bytes(self.held[:size])
        del self.held[:size]
        self.start += len(data)
        return data

    def _end(self) -> Iterator[dict]:
        message, self.message, self.mode = self.message, None, "head"
        yield message.done()

    def _head(self) -> Iterator[dict | None]:
        begin = self.START.search(self.held)
        if begin is None:
            line = self.held.rfind(b"\n") + 1  # what may yet become a start line
            self._take(max(line, len(self.held) - MOST_HEAD))
            return
        if begin.start():
            self._take(begin.start())
        end = self.HEAD_END.search(self.held)
        if end is None:
            if len(self.held) > MOST_HEAD:
                self._take(1)
                yield None
            return
        offset = self.start
        self._open(offset, self._take(end.end()))
        if self.mode == "head":
            yield from self._end()
        else:
            yield None

    def _open(self, offset: int, head: bytes) -> None:
        lines = head.decode("latin-1").splitlines()
        headers: dict[str, str] = {}
        for line in lines[1:]:
            name, colon, value = line.partition(":")
            if colon:
                name = name.strip().lower()
                headers[name] = f"{headers[name]}, {value.strip()}" if name in headers else value.strip()
        asked, told = self.REQUEST.match(head), self.RESPONSE.match(head)
        own: dict = {"kind": "request" if asked else "response", "method": None, "uri": None, "status": None, "headers": headers}
        bodiless = False
        if asked:
            own |= {"method": asked[1].decode(), "uri": asked[2].decode("latin-1")}
        elif told:
            own["status"] = int(told[2])
            if own["status"] >= 200:
                method = self.methods.pop(0) if self.methods else None
                bodiless = method == "HEAD" or own["status"] in BODILESS or (method == "CONNECT" and own["status"] < 300)
            else:
                bodiless = True
        self.message = HttpMessage(offset, **own)
        length = headers.get("content-length", "").split(",")[0].strip()
        if bodiless:
            self.mode = "head"
        elif "chunked" in headers.get("transfer-encoding", "").lower():
            self.mode = "size"
        elif length.isdigit():
            self.left, self.mode = int(length), "body" if int(length) else "head"
        else:
            self.mode = "head" if asked else "rest"

    def _body(self) -> Iterator[dict | None]:
        if self.held and self.left:
            data = self._take(self.left)
            self.left -= len(data)
            self.message.add(data, self.body_bytes)
        if not self.left:
            yield from self._end()

    def _rest(self) -> Iterator[dict | None]:
        self.message.add(self._take(len(self.held)), self.body_bytes)
        return iter(())

    def _size(self) -> Iterator[dict | None]:
        end = self.held.find(b"\n")
        if end < 0:
            return
        digits = self._take(end + 1).split(b";")[0].strip()
        try:
            self.left = int(digits, 16)
        except ValueError:
            self.message["complete"] = False
            yield from self._end()
            return
        self.mode = "chunk" if self.left else "trailer"
        yield None

    def _chunk(self) -> Iterator[dict | None]:
        if self.held and self.left:
            data = self._take(self.left)
            self.left -= len(data)
            self.message.add(data, self.body_bytes)
        end = self.held.find(b"\n") if not self.left else -1
        if end >= 0:
            self._take(end + 1)
            self.mode = "size"
            yield None

    def _trailer(self) -> Iterator[dict | None]:
        end = self.held.find(b"\n")
        if end < 0:
            return
        if self._take(end + 1).strip():
            yield None
        else:
            yield from self._end()

    def skip(self, missing: int) -> None:
        """So many bytes weren't captured: a body by length goes on behind them, all else is given up or cut short."""
        if self.message is None:
            self._take(len(self.held))
            return
        self.message["complete"] = False
        if self.mode in ("body", "chunk"):
            self.left = max(self.left - missing, 0)
        elif self.mode != "rest":
            self.left, self.mode = 0, "body"  # ends with what is read next

    def oldest(self) -> int:
        return self.start if self.message is None else self.message["offset"]

    def finish(self) -> Iterator[tuple[int, dict]]:
        if self.message is not None:
            if self.mode != "rest":
                self.message["complete"] = False
            for found in self._end():
                yield found["offset"], found


def _ways(blocks: DataFrame) -> DataFrame:
    """Blocks in the order of their stream and direction; the direction from the larger port comes first."""
    keys = ["capture", "stream_id", F.col("sport").desc(), "src", "block"]
    return blocks.select(*WAY, "block", "data", "gaps", "marks").repartition("capture", "stream_id").sortWithinPartitions(*keys)


def blocks_of(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` blocks, and of about ``size`` bytes unless one block is longer."""
    for batch in batches:
        start, held = 0, 0
        for at, own in enumerate(pc.binary_length(batch.column("data")).to_pylist()):
            if at > start and (at - start >= rows or held + (own or 0) > size):
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += own or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def read_ways(blocks: DataFrame, framer: Callable[[tuple, dict], object], columns: str, row: Callable[[object], tuple]) -> DataFrame:
    """Messages of all directions: the columns of a direction, offset, ts and pkt_no of a message's first byte, and ``columns``.

    ``framer(way, before)`` makes what reads one direction; ``before`` is the
    reader of the other one, if that came first. A stream's blocks go through
    one task in order, which holds a block and what is left of a message; readers bound that.
    """
    names = [c.split(" ", 1)[0] for c in columns.split(", ")]
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    types = [kinds[c.split(" ", 1)[1]] for c in columns.split(", ")]
    own_kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema if f.name in WAY)
    own_names = [f.split()[0] for f in own_kinds.split(", ")]
    own_types = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    lead = [own_types[f.split()[1]] for f in own_kinds.split(", ")] + [pa.int64(), pa.float64(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = way = reader = places = None
        before, own, made, held = None, (), [], 0
        sized = [n for n, kind in enumerate(types) if kind == pa.binary()]

        def take(found: Iterator) -> None:
            nonlocal held
            for offset, message in found:
                values = row(message)
                made.append((*own, offset, *places.at(offset), *values))
                for n in sized:
                    held += len(values[n] or b"")

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), lead + types, strict=True)], [*own_names, "offset", "ts", "pkt_no", *names])

        for batch in blocks_of(batches):
            for *ends, _, data, gaps, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ends != way:
                    if reader is not None:
                        take(reader.finish())
                    before = reader if stream == ends[:2] else None
                    stream, way, reader, places, read_to = ends[:2], ends, framer(tuple(ends), before), Places(), 0
                    own = tuple(way[WAY.index(n)] for n in own_names)
                places.add(marks, reader.oldest())
                done = 0
                for gap in gaps or ():
                    cut = min(max(gap["offset"] - read_to, 0), len(data))
                    take(reader.feed(data[done:cut]))
                    reader.skip(gap["gap"])
                    done = cut
                take(reader.feed(data[done:]))
                read_to += len(data)
                if len(made) >= 1_024 or held >= 1 << 22:
                    yield packed()
                    made, held = [], 0
        if reader is not None:
            take(reader.finish())
        if made:
            yield packed()

    return _ways(blocks).mapInArrow(read, f"{own_kinds}, offset bigint, ts double, pkt_no bigint, {columns}")


def prefixed_messages(blocks: DataFrame, head: int, size: Callable[[bytes], int | None], most: int = 1 << 24) -> DataFrame:
    """Messages that tell their own length (see ``Prefixed``): the direction's columns, offset, ts, pkt_no, message."""
    return read_ways(blocks, lambda way, before: Prefixed(head, size, most), "message binary", lambda m: (m,))


HTTP_COLUMNS = "kind string, method string, uri string, status int, headers map<string,string>, body binary, body_bytes bigint, body_sha256 string, complete boolean"


def http_messages(blocks: DataFrame, body_bytes: int = 1 << 16) -> DataFrame:
    """HTTP/1 requests and responses of all streams (see ``Http``), whatever their ports and segments; header names are in lower case."""

    class Reader(Http):
        """Keeps the methods it read, for the responses."""

        def __init__(self, methods):
            super().__init__(methods, body_bytes)
            self.asked: list[str] = []

        def _open(self, offset, head):
            super()._open(offset, head)
            if self.message["method"]:
                self.asked.append(self.message["method"])

    names = [c.split(" ", 1)[0] for c in HTTP_COLUMNS.split(", ")]
    return read_ways(blocks, lambda way, before: Reader(before.asked if before else None), HTTP_COLUMNS, lambda m: tuple(m[n] if n != "headers" else list(m[n].items()) for n in names))


def http_exchanges(messages: DataFrame) -> DataFrame:
    """Requests with their responses: on a connection the n-th final response answers the n-th request.

    Returns capture, stream_id, nth, client, client_port, server, server_port,
    request and response (structs; either is null if it wasn't captured).
    Responses below 200 are announcements of the one to come and are left out.
    """
    rows = messages.where("kind = 'request' OR status >= 200")
    nth = F.row_number().over(W.partitionBy("capture", "stream_id", "kind").orderBy("src", "sport", "offset"))
    rows = rows.withColumn("nth", nth)
    is_asked = F.col("kind") == "request"
    own = F.struct("offset", "ts", "pkt_no", "method", "uri", "status", "headers", "body", "body_bytes", "body_sha256", "complete")
    ends = {"client": ("src", "dst"), "client_port": ("sport", "dport"), "server": ("dst", "src"), "server_port": ("dport", "sport")}
    return rows.groupBy("capture", "stream_id", "nth").agg(
        *(F.first(F.when(is_asked, F.col(a)).otherwise(F.col(b))).alias(name) for name, (a, b) in ends.items()),
        F.first(F.when(is_asked, own), ignorenulls=True).alias("request"), F.first(F.when(~is_asked, own), ignorenulls=True).alias("response"),
    )
