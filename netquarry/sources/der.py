"""Tag-length-value data (BER and DER), and what is written in them: certificates, SNMP, LDAP and Kerberos messages.

Reading is bounded: an element lies within the one around it, elements are
nested ``MOST_DEPTH`` deep at most, and there are ``MOST_ELEMENTS`` at most.
Damaged data give no row.
"""

from __future__ import annotations

import calendar
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha1, sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_DEPTH, MOST_ELEMENTS = 32, 20_000
#: Universal tags.
BOOLEAN, INTEGER, BITS, OCTETS, OBJECT, UTF8, SEQUENCE, SET, PRINTABLE, IA5, UTC_TIME, TIME, GENERAL, BMP = 1, 2, 3, 4, 6, 12, 0x30, 0x31, 19, 22, 23, 24, 27, 30
#: Parts of a name, kinds of keys with their curves, and extensions, by object identifier.
NAME_PARTS = {"2.5.4.3": "CN", "2.5.4.6": "C", "2.5.4.7": "L", "2.5.4.8": "ST", "2.5.4.10": "O", "2.5.4.11": "OU"}
KEYS = {"1.2.840.113549.1.1.1": "rsa", "1.2.840.10045.2.1": "ec", "1.2.840.10040.4.1": "dsa", "1.3.101.112": "ed25519", "1.3.101.113": "ed448"}
CURVES = {"1.2.840.10045.3.1.7": 256, "1.3.132.0.34": 384, "1.3.132.0.35": 521, "1.3.132.0.33": 224, "1.3.132.0.10": 256}
ALTERNATIVE_NAMES, BASIC_CONSTRAINTS = "2.5.29.17", "2.5.29.19"


class Damaged(ValueError):
    """Data that aren't what they claim."""


@dataclass
class Element:
    """A value with its tag's first byte (class and form with it), and where it lies."""

    tag: int
    data: bytes
    start: int
    stop: int
    whole_start: int
    whole_stop: int

    @property
    def value(self) -> bytes:
        return self.data[self.start : self.stop]

    @property
    def whole(self) -> bytes:
        return self.data[self.whole_start : self.whole_stop]


class Reader:
    """Elements of one piece of data; counts them, so that a small input can't make much work."""

    def __init__(self, data: bytes):
        self.data, self.left = data, MOST_ELEMENTS

    def at(self, place: int, end: int, depth: int = 0) -> Element:
        """The element at a place; one of indefinite length ends at its end mark."""
        self.left -= 1
        if self.left < 0 or depth > MOST_DEPTH or place + 2 > end:
            raise Damaged("an element is cut short, or there are too many")
        tag, at = self.data[place], place + 1
        if tag & 31 == 31:
            while at < end and self.data[at] & 128:
                at += 1
            at += 1
        if at >= end:
            raise Damaged("a tag is cut short")
        first, at = self.data[at], at + 1
        if first == 128:
            if not tag & 32:
                raise Damaged("a plain value has no length")
            inner = at
            while self.data[inner : inner + 2] != b"\0\0":
                inner = self.at(inner, end, depth + 1).whole_stop
            if inner + 2 > end:
                raise Damaged("an end mark is cut short")
            return Element(tag, self.data, at, inner, place, inner + 2)
        size = first
        if first > 128:
            count = first & 127
            if count > 8 or at + count > end:
                raise Damaged("a length is cut short")
            size, at = int.from_bytes(self.data[at : at + count], "big"), at + count
        if at + size > end:
            raise Damaged("a value is cut short")
        return Element(tag, self.data, at, at + size, place, at + size)

    def parts(self, of: Element | None = None, depth: int = 0) -> list[Element]:
        """The elements within another one, or of all the data."""
        at, end = (of.start, of.stop) if of else (0, len(self.data))
        found = []
        while at < end:
            found.append(self.at(at, end, depth))
            at = found[-1].whole_stop
        return found


def object_id(value: bytes) -> str:
    """An object identifier in dots."""
    if not value or value[-1] & 128:
        raise Damaged("an object identifier is cut short")
    numbers, n = [], 0
    for byte in value:
        n = n << 7 | byte & 127
        if not byte & 128:
            numbers.append(n)
            n = 0
    first = min(numbers[0] // 40, 2)
    return ".".join(map(str, (first, numbers[0] - 40 * first, *numbers[1:])))


def text(element: Element) -> str:
    """A string of any of the usual types."""
    if element.tag == BMP:
        return element.value.decode("utf-16-be", "replace")
    return element.value.decode("utf-8" if element.tag == UTF8 else "latin-1", "replace")


def number(element: Element, tag: int | None = INTEGER) -> int:
    if (tag is not None and element.tag != tag) or not element.value:
        raise Damaged("no number")
    return int.from_bytes(element.value, "big", signed=True)


def seconds(element: Element) -> int:
    """A time as seconds from the epoch."""
    digits = {UTC_TIME: b"2", TIME: b"4"}.get(element.tag, b"0")
    found = re.fullmatch(rb"(\d{%s})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)?(?:\.\d+)?(Z|[+-]\d{4})?" % digits, element.value)
    if not found or digits == b"0":
        raise Damaged("no time")
    year, month, day, hour, minute, second = (int(g or 0) for g in found.groups()[:6])
    if element.tag == UTC_TIME:
        year += 1900 if year >= 50 else 2000
    if not (1 <= month <= 12 and 1 <= day <= 31 and hour < 24 and minute < 60 and second < 61):
        raise Damaged("no time")
    zone = found[7] or b"Z"
    shift = 0 if zone == b"Z" else int(zone[:1] + b"1") * (int(zone[1:3]) * 3600 + int(zone[3:5]) * 60)
    return calendar.timegm((year, month, day, hour, minute, second)) - shift


def _name(reader: Reader, element: Element) -> tuple[str, str | None]:
    """A distinguished name as text, and its common name."""
    parts, common = [], None
    for group in reader.parts(element):
        for pair in reader.parts(group):
            kind, value = reader.parts(pair)[:2]
            known = NAME_PARTS.get(object_id(kind.value), object_id(kind.value))
            parts.append(f"{known}={text(value)}")
            common = text(value) if known == "CN" else common
    return ", ".join(parts), common


def _key(reader: Reader, element: Element) -> tuple[str, int | None]:
    """The kind and bits of a public key."""
    algorithm, key = reader.parts(element)[:2]
    named = reader.parts(algorithm)
    kind = KEYS.get(object_id(named[0].value), object_id(named[0].value))
    bits = key.value[1:]
    if kind == "rsa":
        inner = Reader(bits)
        return kind, number(inner.parts(inner.parts()[0])[0]).bit_length()
    if kind == "dsa" and len(named) > 1:
        return kind, number(reader.parts(named[1])[0]).bit_length()
    if kind == "ec" and len(named) > 1 and named[1].tag == OBJECT:
        return kind, CURVES.get(object_id(named[1].value))
    return kind, {"ed25519": 256, "ed448": 456}.get(kind)


CERTIFICATE_COLUMNS = (
    "version int, serial string, signature string, issuer string, issuer_cn string, subject string, subject_cn string, not_before bigint, not_after bigint, "
    "key_type string, key_bits int, names array<string>, is_ca boolean, self_issued boolean, sha256 string, sha1 string"
)


def certificate(data: bytes) -> dict | None:
    """An X.509 certificate; None if the data are none, or go on after it."""
    try:
        reader = Reader(data)
        (outer,) = reader.parts()
        body, _, _ = reader.parts(outer)
        if outer.tag != SEQUENCE or body.tag != SEQUENCE:
            return None
        parts = reader.parts(body)
        version = 1
        if parts[0].tag == 0xA0:
            version = number(reader.parts(parts.pop(0))[0]) + 1
        serial, signature, issuer, validity, subject, key = parts[:6]
        begins, ends = reader.parts(validity)
        names, is_ca = [], False
        for extra in parts[6:]:
            if extra.tag != 0xA3:
                continue
            for extension in reader.parts(reader.parts(extra)[0]):
                own = reader.parts(extension)
                kind, inner = object_id(own[0].value), Reader(own[-1].value)
                if kind == ALTERNATIVE_NAMES:
                    names = [n.value.decode("latin-1").lower() for n in inner.parts(inner.parts()[0]) if n.tag == 0x82]
                elif kind == BASIC_CONSTRAINTS:
                    is_ca = any(p.tag == BOOLEAN and p.value != b"\0" for p in inner.parts(inner.parts()[0]))
        issued_by, issuer_cn = _name(reader, issuer)
        issued_to, subject_cn = _name(reader, subject)
        key_type, key_bits = _key(reader, key)
        if serial.tag != INTEGER or not serial.value:
            return None
        return {
            "version": version, "serial": serial.value.hex(), "signature": object_id(reader.parts(signature)[0].value), "issuer": issued_by, "issuer_cn": issuer_cn, "subject": issued_to,
            "subject_cn": subject_cn, "not_before": seconds(begins), "not_after": seconds(ends), "key_type": key_type, "key_bits": key_bits, "names": names, "is_ca": is_ca,
            "self_issued": issuer.whole == subject.whole, "sha256": sha256(data).hexdigest(), "sha1": sha1(data, usedforsecurity=False).hexdigest(),
        }
    except (Damaged, ValueError, IndexError):
        return None


def chain(message: bytes) -> Iterator[bytes]:
    """The certificates of a TLS certificate message (up to version 1.2), the server's own first; those before damage."""
    at, end = 3, min(3 + int.from_bytes(message[:3], "big"), len(message))
    while at + 3 <= end:
        size = int.from_bytes(message[at : at + 3], "big")
        if at + 3 + size > end:
            return
        yield message[at + 3 : at + 3 + size]
        at += 3 + size


SNMP_COLUMNS = "version int, community string, operation int, request bigint, error int, objects array<string>"


def snmp_message(data: bytes) -> dict | None:
    """An SNMP message of version 1 or 2c: community, operation (its tag from 0 on), request, error and the objects it names."""
    try:
        reader = Reader(data)
        outer = reader.at(0, len(data))
        version, community, body = reader.parts(outer)[:3]
        if outer.tag != SEQUENCE or community.tag != OCTETS or body.tag & 0xE0 != 0xA0 or number(version) not in (0, 1):
            return None
        operation, parts = body.tag & 31, reader.parts(body)
        if operation == 4:  # the traps of version 1 have a head of their own
            return {"version": 1, "community": text(community), "operation": 4, "request": None, "error": None, "objects": [object_id(parts[0].value)]}
        objects = [object_id(reader.parts(pair)[0].value) for pair in reader.parts(parts[3])]
        return {"version": number(version) + 1, "community": text(community), "operation": operation, "request": number(parts[0]), "error": number(parts[1]), "objects": objects}
    except (Damaged, ValueError, IndexError):
        return None


LDAP_COLUMNS = "message bigint, operation int, name string, method string, password string, result int"


def ldap_message(data: bytes) -> dict | None:
    """An LDAP message: its number and operation (tag from 0 on); of binds the name, and the password if it is a simple one; of answers the result."""
    try:
        reader = Reader(data)
        outer = reader.at(0, len(data))
        ident, body = reader.parts(outer)[:2]
        if outer.tag != SEQUENCE or body.tag & 0xC0 != 0x40:
            return None
        row: dict = {"message": number(ident), "operation": body.tag & 31, "name": None, "method": None, "password": None, "result": None}
        parts = reader.parts(body) if body.tag & 32 else []
        if row["operation"] == 0:
            row |= {"name": text(parts[1]), "method": {0x80: "simple", 0xA3: "sasl"}.get(parts[2].tag, "other")}
            row["password"] = parts[2].value.decode("utf-8", "replace") if parts[2].tag == 0x80 else None
        elif row["operation"] == 3:
            row["name"] = text(parts[0])
        elif parts and parts[0].tag == 10:
            row |= {"result": number(parts[0], 10), "name": text(parts[1])}
        return row
    except (Damaged, ValueError, IndexError):
        return None


KERBEROS_COLUMNS = "kind int, realm string, client string, service string, ciphers array<int>, cipher int, error int"


def kerberos_message(data: bytes) -> dict | None:
    """A Kerberos request (10, 12), answer (11, 13) or error (30): realm, names, the ciphers asked for, that of the ticket or the error's code."""
    try:
        reader = Reader(data)
        outer = reader.at(0, len(data))
        kind = outer.tag & 31
        if outer.tag & 0xE0 != 0x60 or kind not in (10, 11, 12, 13, 30):
            return None
        tagged = lambda e: {p.tag & 31: reader.parts(p)[0] for p in reader.parts(e) if p.tag & 0xE0 == 0xA0}
        name = lambda e: "/".join(text(s) for s in reader.parts(tagged(e)[1]))
        fields = tagged(reader.parts(outer)[0])
        row: dict = {"kind": kind, "realm": None, "client": None, "service": None, "ciphers": None, "cipher": None, "error": None}
        if kind in (10, 12):
            body = tagged(fields[4])
            row |= {"realm": text(body[2]), "client": name(body[1]) if 1 in body else None, "service": name(body[3]) if 3 in body else None, "ciphers": [number(e) for e in reader.parts(body[8])]}
        elif kind == 30:
            row |= {"error": number(fields[6]), "realm": text(fields[9]), "service": name(fields[10]), "client": name(fields[8]) if 8 in fields else None}
        else:
            ticket = tagged(reader.parts(reader.at(fields[5].whole_start, fields[5].whole_stop))[0])
            row |= {"realm": text(fields[3]), "client": name(fields[4]), "service": name(ticket[2]), "cipher": number(tagged(ticket[3])[0])}
        return row
    except (Damaged, ValueError, IndexError, KeyError):
        return None


def decoded(rows: DataFrame, data: str, decoder: Callable[[bytes], dict | None], columns: str) -> DataFrame:
    """The rows whose data a decoder understands, with its columns instead of ``data``; nothing is shuffled, and rows of nulls or damage go."""
    kept = [c for c in rows.columns if c != data]
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
    fields = [c.split() for c in columns.split(", ")]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != data), columns])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1_024):
                batch = whole.slice(start, 1_024)
                found = [decoder(d) for d in batch.column(len(kept)).to_pylist()]
                own = batch.select(kept).take(pa.array([n for n, row in enumerate(found) if row is not None], pa.int32()))
                good = [row for row in found if row is not None]
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array([row[n] for row in good], kinds[k]) for n, k in fields)], [*kept, *(n for n, _ in fields)])

    return rows.where(F.col(data).isNotNull()).select(*kept, data).mapInArrow(decode, schema)


def certificates(messages: DataFrame) -> DataFrame:
    """Certificates of TLS certificate messages (``tls.handshakes``), with their place in the chain and ``CERTIFICATE_COLUMNS``."""
    kept = ["capture", "src", "sport", "dst", "dport", "ts", "certificates"]
    rows = messages.where("certificates IS NOT NULL").select(*kept)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "certificates")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, message in enumerate(batch.column(len(kept) - 1).to_pylist()):
                own = list(chain(message))
                place = batch.select(kept[:-1]).take(pa.array([at] * len(own), pa.int32()))
                yield pa.RecordBatch.from_arrays([*place.columns, pa.array(range(len(own)), pa.int32()), pa.array(own, pa.binary())], [*kept[:-1], "place", "der"])

    return decoded(rows.mapInArrow(split, f"{kinds}, place int, der binary"), "der", certificate, CERTIFICATE_COLUMNS)


# Writing, for messages of one's own.


def element(tag: int, *parts: bytes) -> bytes:
    """An element of parts that are already written."""
    value = b"".join(parts)
    size = len(value)
    length = bytes([size]) if size < 128 else bytes([128 | (n := (size.bit_length() + 7) // 8)]) + size.to_bytes(n, "big")
    return bytes([tag]) + length + value


def integer(n: int) -> bytes:
    return element(INTEGER, n.to_bytes(n.bit_length() // 8 + 1, "big", signed=True))


def oid(dotted: str) -> bytes:
    first, second, *rest = map(int, dotted.split("."))
    out = b""
    for n in (40 * first + second, *rest):
        piece = bytes([n & 127])
        while n := n >> 7:
            piece = bytes([128 | n & 127]) + piece
        out += piece
    return element(OBJECT, out)
