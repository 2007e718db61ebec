"""Capture filter expressions as predicates: over packet columns, and over decoded packets in the source.

``[tcp|udp|icmp|icmp6|arp|ip|ip6|vlan] [src|dst] [host|net|port|portrange] value``
with ``and``, ``or``, ``not`` and parentheses; a bare value takes the qualifiers
before it, as in ``port 80 or 443``. ``less n`` and ``greater n`` compare the length on the wire.
"""

from __future__ import annotations

import ipaddress
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .addresses import address_key, within

#: Protocols by the column that tells them and its value.
PROTOCOLS = {
    "tcp": ("transport", "TCP"), "udp": ("transport", "UDP"), "icmp": ("ip_proto", 1), "icmp6": ("ip_proto", 58), "ip": ("ip_version", 4), "ip6": ("ip_version", 6), "arp": ("ethertype", 0x0806),
}
SIDES = {"src": ("src",), "dst": ("dst",), None: ("src", "dst")}
PORTS = {"src": "sport", "dst": "dport"}
_TOKEN = re.compile(r"\s*(\(|\)|!|&&|\|\||[^\s()!&|]+)")


class BadFilter(ValueError):
    """An expression that is none."""


def parsed(expression: str) -> tuple:
    """The expression as nested tuples: (and|or, parts), (not, part), or a test (kind, side, value)."""
    tokens, at = [], 0
    while at < len(expression.rstrip()):
        found = _TOKEN.match(expression, at)
        if not found:
            raise BadFilter(f"not understood: {expression[at:]!r}")
        tokens.append({"&&": "and", "||": "or", "!": "not"}.get(found[1], found[1]))
        at = found.end()
    tokens.reverse()
    last: list = [None, None]  # side and kind that a bare value takes
    tree = _either(tokens, last)
    if tokens:
        raise BadFilter(f"not understood: {tokens[-1]!r}")
    return tree


def _either(tokens: list[str], last: list) -> tuple:
    parts = [_all(tokens, last)]
    while tokens and tokens[-1] == "or":
        tokens.pop()
        parts.append(_all(tokens, last))
    return parts[0] if len(parts) == 1 else ("or", parts)


def _all(tokens: list[str], last: list) -> tuple:
    parts = [_one(tokens, last)]
    while tokens and tokens[-1] == "and":
        tokens.pop()
        parts.append(_one(tokens, last))
    return parts[0] if len(parts) == 1 else ("and", parts)


def _one(tokens: list[str], last: list) -> tuple:
    if not tokens:
        raise BadFilter("the expression ends too early")
    token = tokens.pop()
    if token == "not":
        return ("not", _one(tokens, last))
    if token == "(":
        tree = _either(tokens, last)
        if not tokens or tokens.pop() != ")":
            raise BadFilter("a parenthesis isn't closed")
        return tree
    tests = []
    if token in PROTOCOLS:
        tests.append(("protocol", None, token))
        if not tokens or tokens[-1] not in (*PORTS, "host", "net", "port", "portrange"):
            return tests[0]
        token = tokens.pop()
    if token == "vlan":
        return ("vlan", None, int(tokens.pop()) if tokens and tokens[-1].isdigit() else None)
    if token in ("less", "greater"):
        return (token, None, _number(tokens.pop() if tokens else ""))
    side, kind = None, None
    if token in PORTS:
        side, kind, token = token, "host", tokens.pop() if tokens else ""
    if token in ("host", "net", "port", "portrange"):
        kind, token = token, tokens.pop() if tokens else ""
    if kind is None:
        side, kind = last
    if kind is None:
        raise BadFilter(f"not understood: {token!r}")
    last[:] = side, kind
    tests.append((kind, side, _value(kind, token)))
    return tests[0] if len(tests) == 1 else ("and", tests)


def _number(text: str) -> int:
    if not text.isdigit():
        raise BadFilter(f"no number: {text!r}")
    return int(text)


def _value(kind: str, text: str) -> object:
    try:
        if kind == "host":
            return str(ipaddress.ip_address(text))
        if kind == "net":
            return str(ipaddress.ip_network(text, strict=False))
    except ValueError as problem:
        raise BadFilter(str(problem)) from None
    low, _, high = text.partition("-")
    return (_number(low), _number(high if kind == "portrange" else low))


def column(tree: tuple | str) -> Column:
    """The predicate over packet columns; never null, and simple comparisons where a data source can take them."""
    kind, *rest = parsed(tree) if isinstance(tree, str) else tree
    if kind in ("and", "or"):
        return reduce((lambda a, b: a & b) if kind == "and" else (lambda a, b: a | b), map(column, rest[0]))
    if kind == "not":
        return ~column(rest[0])
    side, value = rest
    own = lambda test: F.coalesce(test, F.lit(False))
    any_of = lambda tests: reduce(lambda a, b: a | b, tests)
    if kind == "protocol":
        name, wanted = PROTOCOLS[value]
        return own(F.col(name) == wanted)
    if kind == "vlan":
        return own(F.size("vlan_ids") > 0) if value is None else own(F.array_contains("vlan_ids", value))
    if kind in ("less", "greater"):
        return own(F.col("orig_len") <= value) if kind == "less" else own(F.col("orig_len") >= value)
    if kind == "host":
        same = (lambda c: F.col(c) == value) if "." in value else (lambda c: address_key(F.col(c)) == f"{int(ipaddress.ip_address(value)):032x}")
        return any_of([own(same(c)) for c in SIDES[side]])
    if kind == "net":
        return any_of([within(F.col(c), value) for c in SIDES[side]])
    return any_of([own(F.col(PORTS[c]).between(*value)) for c in SIDES[side]])


def matches(tree: tuple, row: dict) -> bool:
    """The same of one decoded packet."""
    kind, *rest = tree
    if kind == "and":
        return all(matches(t, row) for t in rest[0])
    if kind == "or":
        return any(matches(t, row) for t in rest[0])
    if kind == "not":
        return not matches(rest[0], row)
    side, value = rest
    if kind == "protocol":
        return row.get(PROTOCOLS[value][0]) == PROTOCOLS[value][1]
    if kind == "vlan":
        return bool(row.get("vlan_ids")) if value is None else value in (row.get("vlan_ids") or ())
    if kind in ("less", "greater"):
        return row["orig_len"] <= value if kind == "less" else row["orig_len"] >= value
    if kind == "host":
        return any(row.get(c) == value for c in SIDES[side])
    if kind == "net":
        network = ipaddress.ip_network(value)
        return any(row.get(c) is not None and ipaddress.ip_address(row[c]) in network for c in SIDES[side])
    return any(row.get(PORTS[c]) is not None and value[0] <= row[PORTS[c]] <= value[1] for c in SIDES[side])


def needed_addresses(tree: tuple) -> frozenset[bytes] | None:
    """Addresses of which a matching packet must hold one, as bytes; None if the expression asks for none."""
    kind, *rest = tree
    if kind == "host":
        return frozenset([ipaddress.ip_address(rest[1]).packed])
    if kind == "and":
        return min((n for n in map(needed_addresses, rest[0]) if n is not None), key=len, default=None)
    if kind == "or":
        own = [needed_addresses(t) for t in rest[0]]
        return None if None in own else frozenset().union(*own)
    return None
