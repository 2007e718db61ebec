"""A search for what an encoded text says, over chains of decoders."""

from __future__ import annotations

import base64
import binascii
import heapq
import html
import math
import re
import urllib.parse
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Decoded texts of more characters are given up, so that nothing small grows without bound.
MOST_CHARACTERS = 1 << 22
#: What a flag or a credential looks like.
MARKED = re.compile(r"(?i)\b(?:flag|ctf|htb|picoctf)\{[^}]{1,200}\}|\b(?:passphrase|password|passwd|pwd|psk)=")
_SAMPLE = 4_096


def _text(data: bytes) -> str | None:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return None


def _inflated(data: bytes) -> str | None:
    for bits in (31, 15, -15):
        try:
            made = zlib.decompressobj(bits)
            out = made.decompress(data, MOST_CHARACTERS)
            if out and not made.unconsumed_tail and made.eof:
                return _text(out)
        except zlib.error:
            continue
    return None


def _binary(data: bytes) -> str | None:
    """Bytes as text, or what they are when inflated."""
    return _inflated(data) if data[:2] in (b"\x1f\x8b", b"\x78\x9c", b"\x78\x01", b"\x78\xda") else _text(data)


def _base64(value: str, letters: str, decode: Callable[[str], bytes]) -> str | None:
    bare = re.sub(r"\s", "", value)
    if len(bare) < 8 or not re.fullmatch(f"[A-Za-z0-9{letters}]+=*", bare):
        return None
    return _binary(decode(bare.rstrip("=") + "=" * (-len(bare.rstrip("=")) % 4)))


def _base32(value: str) -> str | None:
    bare = re.sub(r"\s", "", value)
    return _binary(base64.b32decode(bare)) if len(bare) >= 8 and re.fullmatch("[A-Z2-7]+=*", bare) and len(bare) % 8 == 0 else None


def _hex(value: str) -> str | None:
    bare = re.sub(r"[\s:]|0x|\\x", "", value)
    return _binary(bytes.fromhex(bare)) if len(bare) >= 8 and len(bare) % 2 == 0 and re.fullmatch("[0-9a-fA-F]+", bare) else None


def _bits(value: str) -> str | None:
    bare = re.sub(r"\s", "", value)
    return _text(bytes(int(bare[k : k + 8], 2) for k in range(0, len(bare), 8))) if len(bare) >= 16 and len(bare) % 8 == 0 and re.fullmatch("[01]+", bare) else None


def _rot13(value: str) -> str:
    return value.translate(_TURNED)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TURNED = str.maketrans(_UPPER + _LOWER, _UPPER[13:] + _UPPER[:13] + _LOWER[13:] + _LOWER[:13])
#: Decoders by name; each gives None, or what it was given, if it has nothing to do.
DECODERS: dict[str, Callable[[str], str | None]] = {
    "url": lambda v: (urllib.parse.unquote if " " in v else urllib.parse.unquote_plus)(v) if "%" in v else None,
    "html": lambda v: html.unescape(v) if "&" in v else None,
    "base64": lambda v: _base64(v, "+/", base64.b64decode),
    "base64url": lambda v: _base64(v, "_-", base64.urlsafe_b64decode) if "_" in v or "-" in v else None,
    "base32": _base32,
    "hex": _hex,
    "bits": _bits,
    "rot13": _rot13,
    "reverse": lambda v: v[::-1],
}
#: What a step costs: a decoder that only fits encoded text costs little, one that fits any text much.
COSTS = {"rot13": 3.0, "reverse": 3.0}


def plausibility(value: str) -> float:
    """How much a text looks like one: letters and spaces in words of usual length, vowels among the letters, marks of flags and credentials."""
    sample = value[:_SAMPLE]
    if not sample:
        return -10.0
    letters = sum(c.isalpha() for c in sample)
    printable = sum(c.isprintable() or c in "\t\r\n" for c in sample) / len(sample)
    spaces = sum(c.isspace() for c in sample) / len(sample)
    vowels = sum(c in "aeiouyAEIOUYäöüáéíóúàèâêîôû" for c in sample) / max(letters, 1)
    usual = sum(c in "etaoinsrhdluETAOINSRHDLU" for c in sample) / max(letters, 1)
    score = 4 * printable + 2 * letters / len(sample) + 12 * usual - 12 * abs(vowels - 0.38) - 20 * abs(min(spaces, 0.17) - 0.17)
    return score + (6 if MARKED.search(sample) else 0)


def best_decoding(value: str, most_steps: int = 3, most_tries: int = 64) -> tuple[str, tuple[str, ...], float]:
    """The most plausible text that chains of decoders make of a value: (text, names of the chain, score).

    Values are tried in the order of their score less what their chain costs;
    each is tried once, ``most_tries`` in all.
    """
    start = plausibility(value)
    queue, seen = [(-start, 0, value, ())], {value}
    best = (start, 0, value, ())
    for _ in range(most_tries):
        if not queue:
            break
        _, _, own, chain = heapq.heappop(queue)
        if len(chain) == most_steps:
            continue
        for name, decoder in DECODERS.items():
            if chain and chain[-1] == name and name in COSTS:
                continue
            try:
                made = decoder(own)
            except (ValueError, binascii.Error):
                continue
            if not made or made in seen or len(made) > MOST_CHARACTERS:
                continue
            seen.add(made)
            steps = (*chain, name)
            score = plausibility(made) - sum(COSTS.get(s, 0.1) for s in steps)
            heapq.heappush(queue, (-score, len(seen), made, steps))
            if score > best[0] + 1e-9 and not math.isnan(score):
                best = (score, len(seen), made, steps)
    return best[2], best[3], best[0]


def decoded(rows: DataFrame, column: str, **options) -> DataFrame:
    """The rows with ``decoded`` (null if nothing is more plausible than the value itself) and ``chain`` of its decoders, joined by >."""
    kept = [c for c in rows.columns if c != column]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != column), "decoded string, chain string"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                found = [best_decoding(v, **options) if v else ("", (), 0.0) for v in batch.column(len(kept)).to_pylist()]
                texts, chains = [f[0] if f[1] else None for f in found], [">".join(f[1]) if f[1] else None for f in found]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(chains, pa.string())], [*kept, "decoded", "chain"])

    return rows.select(*kept, F.col(column)).mapInArrow(search, schema)
