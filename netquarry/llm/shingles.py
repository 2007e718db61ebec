"""Word shingles as sorted sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import CACHES

#: Odd multipliers of the places within a shingle.
_PLACE = np.random.default_rng(5).integers(1 << 62, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words, forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = WordHashes()
CACHES["shingles"] = _HASHES.clear


def lower_words(text: bytes) -> list[bytes]:
    """Words of UTF-8 text: A-Z lower-cased, cut at space and 0x09 to 0x0D."""
    return text.lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    rolled = np.full(len(hashes) - size + 1, size, np.uint64)
    for i in range(size):
        rolled += hashes[i : len(hashes) - size + 1 + i] * _PLACE[i]
    return mixed(rolled)


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """For each whole text its distinct shingles, sorted; with fewer words the whole sequence is the one shingle."""
    found = [lower_words(t) for t in texts]
    ends = np.cumsum([len(w) for w in found]).tolist()
    hashes = word_hashes([w for own in found for w in own])
    rolled = _rolled(hashes, words) if len(hashes) >= words else hashes[:0]
    sets, start = [], 0
    for end in ends:
        if end - start >= words:
            own = np.sort(rolled[start : end - words + 1])
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        else:
            sets.append(_rolled(hashes[start:end], end - start) if end > start else hashes[:0])
        start = end
    return sets
