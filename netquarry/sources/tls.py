"""TLS handshakes out of streams: hellos with their fingerprints, and certificates."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import md5, sha256

from pyspark.sql import DataFrame

from ..operators.framing import read_ways
from .protocols import is_grease

#: Content types, handshake types and extensions that are read.
CHANGE_CIPHER, HANDSHAKE = 20, 22
CLIENT_HELLO, SERVER_HELLO, CERTIFICATE = 1, 2, 11
SERVER_NAME, GROUPS, FORMATS, SIGNATURES, ALPN, VERSIONS = 0, 10, 11, 13, 16, 43
#: Versions as the fingerprints name them.
VERSION_NAMES = {0x0304: "13", 0x0303: "12", 0x0302: "11", 0x0301: "10", 0x0300: "s3", 0x0002: "s2"}
COLUMNS = "kind string, version int, server_name string, alpn string, ja3 string, ja3_md5 string, ja4 string, certificates binary"


class Handshakes:
    """Handshake messages of one direction, across records, segments and blocks, until it is encrypted; nothing after damage or missing bytes."""

    def __init__(self, most: int = 1 << 20):
        self.held, self.inner, self.inner_at, self.start, self.most, self.ended = bytearray(), bytearray(), [], 0, most, False

    def feed(self, data: bytes) -> Iterator[tuple[int, tuple[int, bytes]]]:
        if self.ended:
            return
        self.held += data
        at = 0
        while len(self.held) - at >= 5:
            kind, version, size = struct.unpack_from(">BHH", self.held, at)
            if kind not in range(20, 25) or version >> 8 != 3 or size > 16_384 + 2_048 or kind == CHANGE_CIPHER:
                self._stop()
                return
            if len(self.held) - at < 5 + size:
                break
            if kind == HANDSHAKE:
                self.inner_at.append((len(self.inner), self.start + at))
                self.inner += self.held[at + 5 : at + 5 + size]
            at += 5 + size
            yield from self._messages()
            if self.ended:
                return
        del self.held[:at]
        self.start += at

    def _messages(self) -> Iterator[tuple[int, tuple[int, bytes]]]:
        while len(self.inner) >= 4:
            size = int.from_bytes(self.inner[1:4], "big")
            if size > self.most:
                self._stop()
                return
            if len(self.inner) < 4 + size:
                return
            yield max(o for p, o in self.inner_at if p <= 0), (self.inner[0], bytes(self.inner[4 : 4 + size]))
            del self.inner[: 4 + size]
            self.inner_at = [(p - 4 - size, o) for p, o in self.inner_at]
            past = [x for x in self.inner_at if x[0] <= 0]
            self.inner_at = past[-1:] + [x for x in self.inner_at if x[0] > 0]

    def _stop(self) -> None:
        self.ended = True
        self.held.clear()
        self.inner.clear()

    def skip(self, missing: int) -> None:
        self._stop()

    def finish(self) -> Iterator:
        return iter(())

    def oldest(self) -> int:
        return self.inner_at[0][1] if self.inner_at else self.start


def _extensions(body: bytes, at: int) -> Iterator[tuple[int, bytes]]:
    if at + 2 > len(body):
        return
    end = min(at + 2 + struct.unpack_from(">H", body, at)[0], len(body))
    at += 2
    while at + 4 <= end:
        kind, size = struct.unpack_from(">2H", body, at)
        yield kind, body[at + 4 : at + 4 + size]
        at += 4 + size


def _numbers(data: bytes, skip: int) -> list[int]:
    return [n for n in struct.unpack_from(f">{max(len(data) - skip, 0) // 2}H", data, skip) if not is_grease(n)]


def _list_of(numbers: list[int]) -> str:
    return ",".join(f"{n:04x}" for n in numbers)


def _short(text: str) -> str:
    return sha256(text.encode()).hexdigest()[:12] if text else "0" * 12


def _alpn_ends(alpn: str | None) -> str:
    return alpn[0] + alpn[-1] if alpn else "00"


def _hashed(ja3: str) -> dict:
    return {"ja3": ja3, "ja3_md5": md5(ja3.encode(), usedforsecurity=False).hexdigest()}


def client_hello(body: bytes) -> dict | None:
    """A ClientHello's name and protocol, and its two fingerprints; None if it is damaged."""
    try:
        version, at = struct.unpack_from(">H", body)[0], 34
        at += 1 + body[at]
        size = struct.unpack_from(">H", body, at)[0]
        ciphers = _numbers(body[at + 2 : at + 2 + size], 0)
        at += 2 + size
        at += 1 + body[at]
        kinds, groups, formats, signatures, name, alpn, best = [], [], [], [], None, None, version
        for kind, data in _extensions(body, at):
            if is_grease(kind):
                continue
            kinds.append(kind)
            if kind == SERVER_NAME and len(data) >= 5:
                name = data[5 : 5 + struct.unpack_from(">H", data, 3)[0]].decode("latin-1").lower()
            elif kind == GROUPS:
                groups = _numbers(data, 2)
            elif kind == FORMATS:
                formats = list(data[1:])
            elif kind == SIGNATURES:
                signatures = _numbers(data, 2)
            elif kind == ALPN and len(data) >= 3:
                alpn = data[3 : 3 + data[2]].decode("latin-1")
            elif kind == VERSIONS and data:
                best = max(_numbers(data, 1), default=version)
    except (struct.error, IndexError):
        return None
    ja3 = ",".join([str(version), *("-".join(map(str, x)) for x in (ciphers, kinds, groups, formats))])
    counted = f"t{VERSION_NAMES.get(best, '00')}{'d' if SERVER_NAME in kinds else 'i'}{min(len(ciphers), 99):02}{min(len(kinds), 99):02}{_alpn_ends(alpn)}"
    others = _list_of(sorted(k for k in kinds if k not in (SERVER_NAME, ALPN)))
    ja4 = f"{counted}_{_short(_list_of(sorted(ciphers)))}_{_short(others + '_' + _list_of(signatures) if signatures else others)}"
    return {"kind": "client_hello", "version": best, "server_name": name, "alpn": alpn, "ja4": ja4} | _hashed(ja3)


def server_hello(body: bytes) -> dict | None:
    """A ServerHello's choices and its two fingerprints; None if it is damaged."""
    try:
        version, at = struct.unpack_from(">H", body)[0], 34
        at += 1 + body[at]
        cipher = struct.unpack_from(">H", body, at)[0]
        kinds, alpn, chosen = [], None, version
        for kind, data in _extensions(body, at + 3):
            kinds.append(kind)
            if kind == ALPN and len(data) >= 3:
                alpn = data[3 : 3 + data[2]].decode("latin-1")
            elif kind == VERSIONS and len(data) >= 2:
                chosen = struct.unpack_from(">H", data)[0]
    except (struct.error, IndexError):
        return None
    ja4 = f"t{VERSION_NAMES.get(chosen, '00')}{min(len(kinds), 99):02}{_alpn_ends(alpn)}_{cipher:04x}_{_short(_list_of(kinds))}"
    return {"kind": "server_hello", "version": chosen, "server_name": None, "alpn": alpn, "ja4": ja4} | _hashed(f"{version},{cipher},{'-'.join(map(str, kinds))}")


def _row(message: tuple[int, bytes]) -> tuple:
    kind, body = message
    found = {CLIENT_HELLO: client_hello, SERVER_HELLO: server_hello}.get(kind, lambda b: None)(body) or {}
    if kind == CERTIFICATE:
        found = {"kind": "certificate", "certificates": body}
    return tuple(found.get(c.split()[0]) for c in COLUMNS.split(", "))


def handshakes(blocks: DataFrame) -> DataFrame:
    """Hellos and certificate messages of all streams: the direction's columns, offset, ts, pkt_no, and ``COLUMNS``.

    A certificate message's chain is in ``certificates``, as it was sent (see ``certificates.certificate_chains``).
    """
    return read_ways(blocks, lambda way, before: Handshakes(), COLUMNS, _row).where("kind IS NOT NULL")
