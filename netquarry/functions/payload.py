"""What payloads and requests hold: file types, strings, key-value secrets, parts and risks of urls."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First bytes of file types, in hex, in the order they are tried.
MAGIC = (
    ("4D5A", "EXE/DLL"), ("25504446", "PDF"), ("504B0304", "ZIP/Office"), ("7F454C46", "ELF"), ("89504E47", "PNG"), ("FFD8FF", "JPG"), ("47494638", "GIF"),
    ("1F8B", "GZIP"), ("D0CF11E0A1B11AE1", "OLE2/Office"), ("526172211A07", "RAR"), ("377ABCAF271C", "7Z"), ("4D534346", "CAB"), ("CFFAEDFE", "MACHO"),
    ("CEFAEDFE", "MACHO"), ("CAFEBABE", "MACHO"), ("4C00000001140200", "LNK"), ("3C21444F43545950452068746D6C", "HTML"), ("3C68746D6C", "HTML"),
)
#: Names of parameters that carry credentials.
CREDENTIAL_KEYS = ("password", "passwd", "pwd", "pass", "token", "secret", "api_key", "apikey")
#: Patterns of attacks in requests, in lower case, each with its points.
REQUEST_RISKS = (
    ("sql", r"union\s+select|\bor\s+1\s*=\s*1|'\s*--|information_schema", 3),
    ("traversal", r"\.\./|\.\.\\|%2e%2e", 3),
    ("command", r";\s*(cat|wget|curl|bash|sh)\b|\|\s*(nc|sh|bash)\b|cmd\.exe|/bin/sh", 3),
    ("internal_target", r"169\.254\.169\.254|localhost|127\.0\.0\.1|file://|gopher://", 3),
    ("encoded", r"[a-z0-9+/]{80,}={0,2}", 2),
)


def file_type(payload: Column) -> Column:
    """The type of binary contents by their first bytes; the first that fits, else BINARY."""
    head = F.hex(F.substring(payload, 1, 16))
    found = F.when(F.ltrim(F.decode(F.substring(payload, 1, 64), "ISO-8859-1")).startswith("{\\rtf"), "RTF").otherwise("BINARY")
    for magic, name in reversed(MAGIC):
        found = F.when(head.startswith(magic), name).otherwise(found)
    return found


def ascii_strings(text: Column, least: int = 4, most: int = 200) -> Column:
    """All runs of printable ASCII characters of a length, each cut to ``most``."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[\\x20-\\x7E]{{{least},}}"), F.lit(0))
    return F.transform(found, lambda s: F.substring(s, 1, most))


def key_values(text: Column) -> Column:
    """Secrets given as ``key = value`` or ``key: value``."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)(password|passwd|secret|token|api_?key)[ ]*[:=][ ]*[^ \t\r\n]{6,}"), F.lit(0))


def url_query(url: Column) -> Column:
    """What is between ? and #, empty if there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)


def url_path(url: Column) -> Column:
    """The path of a url with a scheme, up to ? or #; empty if there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def top_level_domain(host: Column) -> Column:
    """The last label that isn't empty, in lower case; - if there is none."""
    labels = F.filter(F.split(F.lower(F.coalesce(host, F.lit(""))), r"\."), lambda x: x != "")
    return F.coalesce(F.try_element_at(labels, F.lit(-1)), F.lit("-"))


def request_score(url: Column) -> Column:
    """The risk of a request by its url: points of each attack pattern, and three for each kind of credential among its parameters."""
    lowered = F.lower(F.coalesce(url, F.lit("")))
    points = [F.when(lowered.rlike(pattern), value).otherwise(0) for _, pattern, value in REQUEST_RISKS]
    names = [F.when(lowered.rlike(f"[?&]{key}=[^&#]"), 3).otherwise(0) for key in CREDENTIAL_KEYS]
    return reduce(add, points + names)


def risk_level(score: Column) -> Column:
    return F.when(score >= 6, "high").when(score >= 3, "medium").otherwise("low")


def found_with_context(text: Column, word: str, around: int = 20) -> Column:
    """Where a word first stands in a text, without regard to case, with so many characters on both sides; null if nowhere."""
    at = F.locate(word.lower(), F.lower(F.coalesce(text, F.lit(""))))
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.struct(at.alias("at"), F.substring(text, start, at - start + len(word) + around).alias("context")))
