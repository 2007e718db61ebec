"""Byte-pair encoding by dynamic programming over prefixes, and decoding."""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import CACHES, blocks, leanly, small_batches, text_of

#: Unicode White_Space, as the vocabulary's patterns mean it; str.split() also cuts at the four code points of NOT_SPACE.
SPACE_CLASS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Contractions that the vocabulary's split pattern cuts off as pieces.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
PIECE = "|".join(CONTRACTIONS) + r"|\p{L}+|\p{N}|[^" + SPACE_CLASS + r"\p{L}\p{N}]+"
#: A mark after a letter or digit: there a piece always ends, so what stands before it may be looked up without it.
MARK = r"[.,;:!?](?<=[a-z0-9ß-öø-ÿ].)"
#: Added to the last code point of a word, which so is another symbol than the same one within a word.
WORD_END_OFFSET = 0x20000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PrefixEncoder:
    """Encodes words with a vocabulary of ranked merges.

    The encoding of every prefix of a word ends in exactly one token. A token
    that ends at a prefix is that one if its own text encodes to itself and the
    pair of it and the last token of the prefix before it encodes to that pair.
    """

    def __init__(self, vocabulary: str, cached_words: int = 200_000):
        spec = json.loads(vocabulary)
        model = spec["model"]
        self.word_end = model.get("end_of_word_suffix") or ""
        ids, merges = model["vocab"], model["merges"]
        self.tokens = {i: t for t, i in ids.items()} | {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        symbols: dict[int, str] = {}
        for c in byte_symbols():
            for text, symbol in ((c, c), (c + self.word_end, chr(ord(c) + WORD_END_OFFSET))):
                if text in ids:
                    symbols[ids[text]], self.rank[ids[text]] = symbol, -1
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, made = ids[left], ids[right], ids[left + right]
            self.pairs[a, b] = rank
            if made not in symbols:
                symbols[made], self.rank[made], self.parts[made] = symbols[a] + symbols[b], rank, (a, b)
        reached = {i for i, r in self.rank.items() if r < 0}
        self.suffixes = ahocorasick.Automaton()
        for i, symbol in symbols.items():
            if i in self.parts:
                a, b = self.parts[i]
                rank = self.rank[i]
                if not (a in reached and b in reached and self.rank[a] < rank and self.rank[b] < rank and self._apart(a, b, rank)):
                    continue
                reached.add(i)
            self.suffixes.add_word(symbol, (i, len(symbol)))
        self.suffixes.make_automaton()
        self._apart_known = _Pairs(self, cached_words)
        self.of_byte = dict(enumerate(byte_symbols()))
        self.piece = regex.compile(PIECE)
        self.spaced = regex.compile(f"[^{SPACE_CLASS}]+")
        self.mark = re.compile(MARK)
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.words = _Words(self, cached_words)

    def _apart(self, a: int, b: int, before: float = float("inf")) -> bool:
        """Whether no merge across the boundary of a and b comes before the merges that made them (and before ``before``)."""
        while True:
            across = self.pairs.get((a, b))
            if across is not None and across < before:
                return False
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # the later merge is undone first; of equal merges the right one is the later
                before, a = ra, self.parts[a][1]
            else:  # a merge across of the same rank stands further left and comes first
                before, b = rb + 1, self.parts[b][0]

    def piece_ids(self, piece: str) -> list[int]:
        """The token ids of one piece, by back-pointers from the last token of the whole."""
        text = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.of_byte)
        if self.word_end:
            text = text[:-1] + chr(ord(text[-1]) + WORD_END_OFFSET)
        tokens, starts = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        apart = self._apart_known
        for at, (token, size) in self.suffixes.iter(text):
            end = at + 1
            if tokens[end] < 0:
                start = end - size
                if start == 0 or (tokens[start] >= 0 and apart[tokens[start] << 32 | token]):
                    tokens[end], starts[end] = token, start
        found, end = [], len(text)
        while end:
            found.append(tokens[end])
            end = starts[end]
        return found[::-1]

    def word_ids(self, word: str) -> bytes:
        """The ids of a stretch without white space: special tokens as they stand, then pieces of the normal form."""
        parts = self.special.split(word) if self.special else [word]
        return b"".join([self._id(p) if p in self.added else self.words[_lowered(unicodedata.normalize("NFC", p))] for p in parts if p])

    def _id(self, special: str) -> bytes:
        return array("I", [self.added[special]]).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if any(t in text for t in self.added) or not (text.isascii() or unicodedata.is_normalized("NFC", text)):
            return b"".join(map(self.word_ids, self._split(text)))
        return b"".join(map(self.words.__getitem__, self._split(self.mark.sub(r" \g<0>", _lowered(text)))))

    def _split(self, text: str) -> list[str]:
        return self.spaced.findall(text) if any(c in text for c in NOT_SPACE) else text.split()

    def decode(self, ids: bytes) -> str:
        """The tokens joined by spaces, as the vocabulary has no decoder of its own."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Kept(dict):
    """What was made of keys, and before that what was kept of those made earlier: half is forgotten when there is too much."""

    def __init__(self, encoder: PrefixEncoder, most: int):
        super().__init__()
        self.encoder, self.most, self.earlier = encoder, most // 2, {}

    def keep(self, key, value):
        if len(self) >= self.most:
            self.earlier = dict(self)
            self.clear()
        self[key] = value
        return value


class _Words(_Kept):
    """Ids of stretches in their normal form without white space and special tokens."""

    def __missing__(self, word: str) -> bytes:
        ids = self.earlier.get(word)
        if ids is None:
            of = self.encoder.piece_ids
            ids = array("I", [i for piece in self.encoder.piece.findall(word) for i in of(piece)]).tobytes()
        return self.keep(word, ids) if len(word) <= 64 else ids


class _Pairs(_Kept):
    """Whether the tokens of a pair (the left one's id in the upper bits) stay apart."""

    def __missing__(self, pair: int) -> bool:
        known = self.earlier.get(pair)
        return self.keep(pair, self.encoder._apart(pair >> 32, pair & 0xFFFFFFFF) if known is None else known)


def _lowered(text: str) -> str:
    """Lower case, with each capital sigma lowered alone, where str.lower() looks at its place in the word."""
    return text.lower() if text.isascii() else text.replace("Σ", "σ").lower()


_ENCODERS: dict[str, PrefixEncoder] = {}
CACHES["bpe"] = _ENCODERS.clear


def _encoder(vocabulary: str) -> PrefixEncoder:
    """One encoder a Python worker, kept from task to task."""
    if vocabulary not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary] = PrefixEncoder(vocabulary)
    return _ENCODERS[vocabulary]


def bpe_encode(documents: DataFrame, tokenizer_path: str, rows_at_once: int = 256) -> DataFrame:
    """Encode whole texts and decode the ids again.

    Returns doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit ids)
    and decoded. Null and empty texts have no tokens and decode to "". Repeated
    rows are encoded one by one; other columns are ignored. The vocabulary file
    (a word-level BPE in JSON, of fixed size) is read by the driver and
    broadcast. Rows are never shuffled, and no text is cut; a worker holds the
    ids of about a megabyte of texts, or of one longer text, at once.
    """
    small_batches(documents.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = documents.sparkSession.sparkContext.broadcast(file.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in blocks(batches, rows_at_once):
            ids = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array([encoder.decode(x) for x in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", text_of().alias("text")).mapInArrow(
        leanly("bpe", encode), f"doc_id {kind}, n_tokens bigint, ids binary, decoded string"
    )
