"""Scalar derivations for hosts, sizes, intervals and exported cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ceilings of packet-size buckets.
SIZE_CEILINGS = (19, 39, 79, 159, 319, 639, 1279, 2559, 5119)
#: Cadence families by interval in seconds, first match wins.
CADENCES = ((15, "very_fast"), (60, "fast"), (300, "medium"), (1800, "slow"))


def size_bucket(size: Column) -> Column:
    """The bucket's range as text; sizes above the last ceiling are open-ended."""
    low, found = 0, None
    for high in SIZE_CEILINGS:
        found = F.when(size <= high, f"{low}-{high}") if found is None else found.when(size <= high, f"{low}-{high}")
        low = high + 1
    return found.otherwise(f">{SIZE_CEILINGS[-1]}")


def cadence_family(seconds: Column) -> Column:
    """The family of a mean gap; unknown without one, or if it isn't positive."""
    found = F.when(seconds.isNull() | (seconds <= 0), "unknown")
    for limit, name in CADENCES:
        found = found.when(seconds < limit, name)
    return found.otherwise("very_slow")


def url_host(url: Column) -> Column:
    """The host in lower case, without user, port and trailing dot; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*?)\.?(?:[:/?#]|$)", 1))


def base_domain(host: Column) -> Column:
    """The last two labels that aren't empty."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    return F.when(F.size(labels) <= 2, F.array_join(labels, ".")).otherwise(F.array_join(F.slice(labels, -2, 2), "."))


def csv_safe(cell: Column) -> Column:
    """A cell that no spreadsheet takes for a formula: quoted if it starts with =, +, - or @ after white space."""
    return F.when(cell.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def ipv4_number(address: Column) -> Column:
    """An IPv4 address as a number; null if it is none."""
    parts = F.split(address, r"\.")
    number = sum((F.get(parts, F.lit(i)).try_cast("long") * (256 ** (3 - i)) for i in range(4)), F.lit(0).cast("long"))
    return F.when(address.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?!$)|$)){4}$"), number)


def ip_scope(address: Column) -> Column:
    """Zone of an address: loopback, link-local, multicast, internal or public, the first that fits; unknown for none or an unspecified one."""
    own = F.lower(F.trim(address))
    v4 = ipv4_scope(own)
    named = {"link_local": "link-local", "private": "internal", "unspecified": "unknown", "broadcast": "public"}
    found = v4
    for name, other in named.items():
        found = F.when(v4 == name, other).otherwise(found)
    is_v6 = own.rlike("^(?=.*:.*:)[0-9a-f:]+(?:[.][0-9.]+)?(?:%[a-z0-9]+)?$")
    v6 = (
        F.when(own.rlike("^[0:]+1$"), "loopback")
        .when(own.rlike("^fe[89ab][0-9a-f]:"), "link-local")
        .when(own.startswith("ff"), "multicast")
        .when(own.rlike("^f[cd][0-9a-f]{2}:"), "internal")
        .when(own.rlike("^[0:]+$"), "unknown")
        .otherwise("public")
    )
    return F.when(is_v6, v6).otherwise(F.coalesce(found, F.lit("unknown")))


def ipv4_scope(address: Column) -> Column:
    """unknown, unspecified, loopback, link_local, multicast, broadcast, private or public; the first that fits."""
    n = ipv4_number(address)

    def within(network: int, bits: int) -> Column:
        return F.shiftright(n, 32 - bits) == network >> (32 - bits)

    return (
        F.when(n.isNull(), "unknown")
        .when(n == 0, "unspecified")
        .when(within(127 << 24, 8), "loopback")
        .when(within(169 << 24 | 254 << 16, 16), "link_local")
        .when(n == 0xFFFFFFFF, "broadcast")
        .when(within(224 << 24, 4), "multicast")
        .when(within(10 << 24, 8) | within(172 << 24 | 16 << 16, 12) | within(192 << 24 | 168 << 16, 16), "private")
        .otherwise("public")
    )
