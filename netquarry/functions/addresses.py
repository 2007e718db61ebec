"""IPv4 and IPv6 addresses as keys that order and prefixes can be taken of."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .network import ipv4_number

#: An IPv4 address stands as the IPv6 one of the same meaning; so 96 bits come before its own.
MAPPED, MAPPED_BITS = "0" * 20 + "ffff", 96


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed, and written in the plan, once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def address_key(address: Column) -> Column:
    """128 bits as 32 hexadecimal digits, which order as the addresses do; null for what is no address. Zones (%eth0) are left out."""

    def with_hex_tail(own: Column) -> Column:
        """The IPv6 address with a dotted end written as two groups."""
        pair = lambda n: F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(0xFFFF))))
        tail = ipv4_number(F.regexp_extract(own, r"([0-9.]+)$", 1))
        return F.when(own.contains("."), F.concat(F.regexp_replace(own, r"[0-9.]+$", ""), _bound(tail, pair))).otherwise(own)

    def groups(v6: Column) -> Column:
        """The eight groups of an IPv6 address, those that :: leaves out filled in."""
        some = lambda half: F.filter(F.split(half, ":"), lambda x: x != "")
        filled = lambda left, right: F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0))), right)
        halves = lambda h: F.when(F.size(h) == 2, _bound(some(h[0]), lambda left: _bound(some(h[1]), lambda right: filled(left, right)))).when(F.size(h) == 1, some(h[0]))
        return F.when(~v6.rlike(":::|^:[^:]|[^:]:$"), _bound(F.split(v6, "::", -1), halves))

    def joined(whole: Column) -> Column:
        sound = (F.size(whole) == 8) & F.forall(whole, lambda x: x.rlike("^[0-9a-f]{1,4}$"))
        return F.when(sound, F.array_join(F.transform(whole, lambda x: F.lpad(x, 4, "0")), ""))

    v6 = lambda own: _bound(_bound(with_hex_tail(own), groups), joined)
    v4 = lambda own: F.concat(F.lit(MAPPED), F.lpad(F.lower(F.hex(ipv4_number(own))), 8, "0"))
    return _bound(F.regexp_replace(F.lower(F.trim(address)), "%.*$", ""), lambda own: F.when(own.contains(":"), v6(own)).otherwise(v4(own)))


def prefix_of(network: str) -> tuple[str, int]:
    """A network (a.b.c.d/n or x::/n) as its key and the number of its leading bits that count, of 128."""
    own = ipaddress.ip_network(network, strict=False)
    if own.version == 4:
        return MAPPED + f"{int(own.network_address):08x}", MAPPED_BITS + own.prefixlen
    return f"{int(own.network_address):032x}", own.prefixlen


def leading_bits(key: Column, bits: int) -> Column:
    """The key with all but so many leading bits set to zero; 32 digits again."""
    digits, rest = divmod(bits, 4)
    head = F.substring(key, 1, digits)
    if rest:
        step = 1 << (4 - rest)
        head = F.concat(head, F.translate(F.substring(key, digits + 1, 1), "0123456789abcdef", "".join(f"{n - n % step:x}" for n in range(16))))
    return F.rpad(head, 32, "0")


def within(address: Column, network: str) -> Column:
    """Whether an address lies in a network; false for what is no address."""
    key, bits = prefix_of(network)
    digits, rest = divmod(bits, 4)
    own = address_key(address)
    found = own.startswith(key[:digits])
    if rest:
        first = int(key[digits], 16)
        found &= F.substring(own, digits + 1, 1).isin([f"{first + k:x}" for k in range(1 << (4 - rest))])
    return F.coalesce(found, F.lit(False))


def prefixes_between(low: str, high: str) -> list[tuple[str, int]]:
    """The networks that make up a range of addresses, ends included: keys and leading bits."""
    first, last = ipaddress.ip_address(low), ipaddress.ip_address(high)
    return [prefix_of(str(n)) for n in ipaddress.summarize_address_range(first, last)]
