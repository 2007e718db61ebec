"""Names for what packets, texts and certificates show: services, sides, systems, stages, keys, contents and simple decodings."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: UDP ports whose services can amplify.
AMPLIFIERS = (19, 53, 123, 161, 389, 1900, 5353, 11211)
#: The last well-known port, the last that services register, and the first that clients may take.
WELL_KNOWN, REGISTERED, CLIENTS = 1024, 49151, 32768
#: Types of contents that can be run, and the extensions that say so.
EXECUTABLE_TYPES = ("EXE/DLL", "ELF")
EXECUTABLE_EXTENSIONS = ("exe", "dll", "sys", "scr", "cpl", "ocx", "com", "elf", "so", "bin", "o", "out", "axf")
#: Services by port.
SERVICES = {
    20: "FTP-DATA", 21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP", 53: "DNS", 67: "DHCP", 68: "DHCP", 69: "TFTP", 80: "HTTP", 88: "Kerberos", 110: "POP3", 123: "NTP",
    135: "RPC", 137: "NetBIOS", 139: "NetBIOS", 143: "IMAP", 161: "SNMP", 389: "LDAP", 443: "HTTPS", 445: "SMB", 502: "Modbus", 514: "Syslog", 636: "LDAPS", 1433: "MSSQL",
    1900: "SSDP",
}
#: Words of the stages of an attack, in the order they are tried.
STAGE_WORDS = (
    ("recon", ("scan", "recon", "sweep", "probe", "probing", "enumeration")),
    ("credential", ("credential", "creds", "password", "kerberos", "ntlm", "auth")),
    ("c2", ("beacon", "c2", "command and control", "check-in")),
    ("exfil", ("exfil", "tunnel", "http post", "file exfil", "outbound", "data transfer", "large outbound")),
    ("lateral", ("smb", "rdp", "winrm", "ssh", "lateral")),
    ("secrets", ("secret", "token", "api key")),
)
#: First bytes, in hex, of contents that are dense by design.
DENSE_MAGIC = (
    "1F8B", "7801", "789C", "78DA", "89504E47", "FFD8FF", "474946383761", "474946383961", "424D", "504B0304", "504B0506", "52617221", "377ABCAF", "52494646", "4F676753",
    "494433", "FFFB", "664C6143", "000001BA", "000001B3", "774F4646", "774F4632", "00010000", "425A68", "FD377A585A",
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def starts_exchange(sport: Column, dport: Column, amplifiers: tuple[int, ...] = AMPLIFIERS) -> Column:
    """Whether a datagram goes from the asking to the answering side, by the first kind of port that just one side has."""
    found = dport != sport
    tiers = [lambda p: p <= REGISTERED, lambda p: p <= WELL_KNOWN, lambda p: p.isin(*amplifiers)]
    for served in tiers:
        found = F.when(served(dport) & ~served(sport), True).when(served(sport) & ~served(dport), False).otherwise(found)
    return found


def to_service(sport: Column, dport: Column, ports: list[int]) -> Column:
    """Whether one of ``ports`` is the server's: the target, or the source of an answer to a client's port."""
    return dport.isin(*ports) | (sport.isin(*ports) & (dport >= CLIENTS))


def service_name(sport: Column, dport: Column, names: dict[int, str] = SERVICES) -> Column:
    """The service of the source's port, else of the target's; null if neither has one."""
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(known, sport.cast("int")), F.try_element_at(known, dport.cast("int")))


def system_hint(ttl: Column) -> Column:
    """What kind of system sends packets of this time to live; - for none."""
    kind = F.when(ttl <= 64, "Linux/Unix-like").when(ttl <= 128, "Windows-like").otherwise("Network/embedded device")
    return F.when(ttl > 0, F.concat(kind, F.lit(" (TTL~"), ttl.cast("string"), F.lit(")"))).otherwise("-")


def mac_address(text: Column) -> Column:
    """A hardware address as six pairs of lower-case digits with colons; null if it has not twelve digits."""
    digits = F.regexp_replace(F.lower(F.trim(text)), "[:.-]", "")
    return F.when(digits.rlike("^[0-9a-f]{12}$"), F.regexp_replace(digits, "(..)(?=.)", "$1:"))


def attack_stage(text: Column) -> Column:
    """The first stage of an attack that a word of the text stands for, else other."""
    lowered, found = F.lower(F.coalesce(text, F.lit(""))), F.lit("other")
    for stage, words in reversed(STAGE_WORDS):
        found = F.when(reduce(or_, [F.contains(lowered, F.lit(w)) for w in words]), stage).otherwise(found)
    return found


def weak_key(kind: Column, bits: Column) -> Column:
    """Whether a public key is too short for its kind; never without a size."""
    name = F.upper(F.coalesce(kind, F.lit("")))
    least = (
        F.when(name.rlike("ED25519|ED448"), 0)
        .when(name.rlike("ELLIPTIC|ECPUBLIC|ECDSA"), 256)
        .when(name.rlike("RSA|DSA|DH"), 2048)
        .otherwise(1024)
    )
    return F.coalesce((bits > 0) & (bits < least), F.lit(False))


def validity(start: Column, end: Column, as_of: Column) -> Column:
    """inverted, not_yet_valid, expired or valid at a given time; unknown without both ends."""
    known = F.when(start > end, "inverted").when(start > as_of, "not_yet_valid").when(end < as_of, "expired").otherwise("valid")
    return F.when(start.isNull() | end.isNull(), "unknown").otherwise(known)


def printable_share(content: Column) -> Column:
    """The share of printable ASCII, tabs and line ends among the bytes; 0 if there are none."""
    text = F.decode(F.coalesce(content, F.lit(b"")), "ISO-8859-1")
    kept = F.length(F.regexp_replace(text, r"[^\x20-\x7E\t\r\n]", ""))
    return F.when(F.length(text) > 0, kept / F.length(text)).otherwise(0.0)


def dense_by_design(content: Column) -> Column:
    """Whether contents start as compressed data, media or fonts do."""
    head = F.hex(F.substring(content, 1, 8))
    starts = reduce(or_, [head.startswith(m) for m in DENSE_MAGIC]) | (F.substring(head, 9, 8) == "66747970")
    return F.coalesce((F.octet_length(content) >= 4) & starts, F.lit(False))


def encoded_runs(text: Column, least: int = 80) -> Column:
    """How many runs of base64 letters of such a length a text has."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[A-Za-z0-9+/]{{{least},}}={{0,2}}"))


def shifted(text: Column, by: int) -> Column:
    """Letters moved on by so many places, in both cases; 13 is its own inverse."""
    turn = lambda s: s[by % 26 :] + s[: by % 26]
    return F.translate(text, _UPPER + _LOWER, turn(_UPPER) + turn(_LOWER))


def mirrored(text: Column) -> Column:
    """A for Z, B for Y and so on, in both cases."""
    return F.translate(text, _UPPER + _LOWER, _UPPER[::-1] + _LOWER[::-1])


def without_grease(values: Column) -> Column:
    """A list of TLS numbers without the reserved ones, which have two equal bytes that end in A."""
    return F.filter(values, lambda v: ~((v.bitwiseAND(0xFF) == F.shiftright(v, 8).bitwiseAND(0xFF)) & (v.bitwiseAND(0x0F) == 0x0A)))


def masquerade(filename: Column, file_type: Column, executable: tuple[str, ...] = EXECUTABLE_TYPES, extensions: tuple[str, ...] = EXECUTABLE_EXTENSIONS) -> Column:
    """Whether executable contents come under the name of something else; not if the name has no extension."""
    extension = F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"[^/\\.][^/\\]*\.([^./\\]+)$|^[^/\\.]+\.([^./\\]+)$", 1))
    return F.coalesce(F.upper(file_type).isin(*executable) & (extension != "") & ~extension.isin(*extensions), F.lit(False))
