"""Benchmark decontamination: random-walk embeddings of item-sized windows, bit-sampling LSH, exact edit distance."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, blocks, leanly, text_of

_NO_WORD = re.compile(r"[\W_]+")
#: Characters of scripts that set no spaces between words (Thai, Lao, Burmese, Khmer, kana, Han); each counts as a word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
#: Steps of the walk for each word of an item; as the pointer moves half the time, few walks pass the item's end by then.
STRETCH = 1.5


#: Words of windows that are compared at once, which bounds the memory whatever the length of items and texts.
WINDOW_WORDS = 2_000_000


def plain_word(token: str) -> str:
    """A token as it is compared: lower case, letters and digits only; empty if it has none."""
    lowered = token.lower()
    return lowered if lowered.isalnum() else _NO_WORD.sub("", lowered)


def tokens_of(text: str) -> list[str]:
    """The parts of a text between white space; characters of scripts without spaces stand alone."""
    if not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \g<0> ", text)
    return text.split()


@dataclass
class Items:
    """A block of benchmark items as arrays of word numbers from 1, by length in words, with their LSH tables."""

    numbers: dict[str, int]
    by_length: dict[int, list[tuple[object, np.ndarray]]]
    share: float
    repetitions: int
    sampled: int
    seed: int
    tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = field(default_factory=dict)
    vocabularies: dict[int, np.ndarray] = field(default_factory=dict)

    @property
    def longest(self) -> int:
        return max(self.by_length, default=0)

    def edits(self, length: int) -> int:
        return math.floor(self.share * length + 1e-9)

    def prepare(self) -> Items:
        """Build each length's vocabulary and, for each repetition, its places, sorted keys and the items behind them."""
        for length, own in self.by_length.items():
            most = np.zeros(len(self.numbers) + 1, np.int32)
            words = np.stack([w for _, w in own])
            for item in words:
                found, counts = np.unique(item, return_counts=True)
                most[found] = np.maximum(most[found], counts)
            self.vocabularies[length] = most
            keys = self.keys(words.ravel(), np.arange(len(own)) * length, length)
            orders = [np.argsort(k, kind="stable") for k in keys]
            self.tables[length] = [(k[order], order) for k, order in zip(keys, orders, strict=True)]
        return self

    def keys(self, words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        """LSH keys of windows, a row for each repetition: the sampled places of their embeddings.

        The embedding of x writes x[i] at each step and moves i on if a random
        bit, drawn from the step and the word written, is 1; past the end it
        writes 0. Sequences few edits apart soon write the same words at the
        same steps again. A key is the words written at ``sampled`` random
        steps; repetitions have walks and samples of their own.
        """
        steps, salts = self._draws(length)
        at = np.zeros((self.repetitions, len(starts)), np.int64)
        keys = np.zeros(at.shape, np.uint64)
        for step in range(int(steps.max()) + 1):
            written = np.where(at < length, words[starts + np.minimum(at, length - 1)], 0).astype(np.uint64) + np.uint64(1)
            taken = (steps == step).any(axis=1)
            if taken.any():
                keys[taken] = keys[taken] * np.uint64(0x9E3779B97F4A7C15) + written[taken]
            written *= salts[:, step, None]
            written ^= written >> np.uint64(29)
            written *= np.uint64(0xBF58476D1CE4E5B9)
            at += (written >> np.uint64(63)).astype(np.int64)
        return keys

    def _draws(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The sampled steps and the walk's multipliers of each repetition."""
        rng = np.random.default_rng((self.seed, length))
        reach = max(math.ceil(STRETCH * length), self.sampled)
        steps = np.stack([rng.choice(reach, self.sampled, replace=False) for _ in range(self.repetitions)])
        return steps, rng.integers(1, 1 << 63, size=(self.repetitions, reach), dtype=np.uint64) | np.uint64(1)

    def candidates(self, words: np.ndarray) -> dict[tuple[int, int], set[int]]:
        """Starts of windows by (length, item) whose key equals the item's in some repetition.

        Windows are taken at every word. Those that can't be within the allowed
        edits, as they have too few words in common with any item of the length
        (before the keys) or with the item itself (after), are left out; as an
        edit takes one common word away at most, this loses nothing.
        """
        found: dict[tuple[int, int], set[int]] = {}
        inside = np.concatenate([[0], np.cumsum(words > 0, dtype=np.int32)])
        most_of_item = np.zeros(len(self.numbers) + 1, np.int32)
        for length, most in self.vocabularies.items():
            least = length - self.edits(length)
            starts = np.flatnonzero(inside[length:] - inside[:-length] >= least)
            if not len(starts):
                continue
            kept = []
            for part in np.array_split(starts, -(-len(starts) * length // WINDOW_WORDS)):
                windows = words[part[:, None] + np.arange(length)]
                may = (most[windows] > 0).sum(axis=1) >= least
                may[may] = common_words(windows[may], most) >= least
                kept.append(part[may])
            starts = np.concatenate(kept)
            if not len(starts):
                continue
            pairs: dict[int, list[np.ndarray]] = {}
            for keys, (ordered, order) in zip(self.keys(words, starts, length), self.tables[length], strict=True):
                low, high = np.searchsorted(ordered, keys, "left"), np.searchsorted(ordered, keys, "right")
                hit = np.flatnonzero(high > low)
                for k in np.unique(np.concatenate([low[hit], high[hit] - 1])) if len(hit) else []:
                    for item in order[ordered == ordered[k]].tolist():
                        pairs.setdefault(item, []).append(hit[keys[hit] == ordered[k]])
            for item, own in pairs.items():
                own = starts[np.unique(np.concatenate(own))]
                found_words, counts = np.unique(self.by_length[length][item][1], return_counts=True)
                most_of_item[found_words] = counts
                parts = np.array_split(own, -(-len(own) * length // WINDOW_WORDS))
                near = np.concatenate([p[common_words(words[p[:, None] + np.arange(length)], most_of_item) >= least] for p in parts])
                most_of_item[found_words] = 0
                if len(near):
                    found[length, item] = set(near.tolist())
        return found

    def matches(self, words: np.ndarray, spans: list[tuple[int, int]]) -> Iterator[tuple[int, object, int, int, int, int]]:
        """Verified matches: text number, item, its words, edits, first and last word of the place of fewest edits."""
        begins = np.array([a for a, _ in spans])
        for (length, item), starts in self.candidates(words).items():
            name, own = self.by_length[length][item]
            slack = self.edits(length)
            best: dict[int, tuple[int, int, int]] = {}
            ordered = np.array(sorted(starts))
            texts = np.searchsorted(begins, ordered, "right") - 1
            apart = np.flatnonzero((np.diff(ordered) > length) | (np.diff(texts) > 0)) + 1
            for near, of in zip(np.split(ordered, apart), np.split(texts, apart), strict=True):
                text = int(of[0])
                low, high = max(spans[text][0], int(near[0]) - slack), min(spans[text][1], int(near[-1]) + length + slack)
                edits, a, b = closest(own, words[low:high])
                if edits <= slack:
                    best[text] = min(best.get(text, (slack + 1, 0, 0)), (edits, low + a - spans[text][0], low + b - spans[text][0]))
            for text, (edits, a, b) in best.items():
                yield text, name, length, edits, a, b


def common_words(windows: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each window (a row) how many of its words count, where each word counts as often as ``most`` says."""
    ordered = np.sort(windows, axis=1)
    at = np.arange(windows.shape[1])
    first = np.zeros(windows.shape, np.int64)
    first[:, 1:] = np.where(ordered[:, 1:] != ordered[:, :-1], at[1:], 0)
    return (at - np.maximum.accumulate(first, axis=1) < most[ordered]).sum(axis=1)


def _row(item: np.ndarray, region: np.ndarray, free_start: bool) -> np.ndarray:
    """Edits from the item to the region's part that ends before each place, and starts anywhere or at 0."""
    ramp = np.arange(len(region) + 1)
    row = ramp * 0 if free_start else ramp
    for k, word in enumerate(item, 1):
        following = np.empty_like(row)
        following[0] = k
        following[1:] = np.minimum(row[1:] + 1, row[:-1] + (region != word))
        row = np.minimum.accumulate(following - ramp) + ramp
    return row


def closest(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """The fewest word edits from the item to any part of the region, and that part."""
    row = _row(item, region, True)
    end = int(row.argmin())
    back = _row(item[::-1], region[:end][::-1], False)
    return int(row[end]), end - int(back.argmin()), end


class _Numbers(dict):
    """Word numbers of tokens: 0 if no item has the word, -1 if the token has no letter or digit."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, token: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        word = plain_word(token)
        number = self[token] = self.numbers.get(word, 0) if word else -1
        return number


_CACHED: list[tuple[Items, _Numbers]] = []
CACHES["decontaminate"] = _CACHED.clear


def _numbers(items: Items) -> _Numbers:
    if not _CACHED or _CACHED[0][0] is not items:
        _CACHED[:] = [(items, _Numbers(items.numbers))]
    return _CACHED[0][1]


def _found(texts: list[str | None], items: Items) -> Iterator[tuple[int, object, int, int, int, int]]:
    """Matches of a block of whole texts; texts are set apart by a window of no words."""
    numbers = _numbers(items)
    gap = np.zeros(items.longest, np.int32)
    parts, spans, at = [], [], 0
    for text in texts:
        tokens = tokens_of(text) if text else []
        own = np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens))
        own = own[own >= 0]
        parts += [own, gap]
        spans.append((at, at + len(own)))
        at += len(own) + len(gap)
    if items.by_length and texts:
        yield from items.matches(np.concatenate(parts), spans)


def item_blocks(
    benchmark: DataFrame, share: float = 0.2, recall: float = 0.99, agreement: float = 0.4, sampled: int = 2, block_bytes: int = 4 << 20, seed: int = 11
) -> Iterator[Items]:
    """Benchmark items (item_id, text) in blocks of about ``block_bytes`` of text, each small enough to broadcast.

    As many repetitions as reach ``recall`` for windows that agree with the item
    in ``agreement`` of their embedding. Items without a word are left out; equal
    items count once for each id.
    """
    repetitions = max(1, math.ceil(math.log(1 - recall) / math.log(1 - agreement**sampled)))
    block, held = Items({}, {}, share, repetitions, sampled, seed), 0
    for row in benchmark.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        words = [w for w in map(plain_word, tokens_of(row["text"])) if w]
        if not words:
            continue
        if held > block_bytes:
            yield block.prepare()
            block, held = Items({}, {}, share, repetitions, sampled, seed), 0
        numbers = [block.numbers.setdefault(w, len(block.numbers) + 1) for w in words]
        block.by_length.setdefault(len(words), []).append((row["item_id"], np.array(numbers, np.int32)))
        held += len(row["text"])
    if block.by_length:
        yield block.prepare()


def find_contaminated(documents: DataFrame, benchmark: DataFrame, rows_at_once: int = 256, **options) -> DataFrame:
    """Benchmark items in whole texts: doc_id, item_id, item_words, edits, first_word, end_word.

    An item occurs if some part of the text is within ``share`` (0.2) of the
    item's words in insertions, deletions and replacements of words; words are
    compared without case and signs, and each character of a script without
    spaces is a word. Only documents with an item have rows, one
    for each item: its place of fewest edits, as words of the text. Items are
    broadcast in blocks of bounded size, a pass over the texts for each; texts are
    never shuffled. Copies with no edit are always found, whatever their length,
    others with the ``recall`` aimed at. Items of fewer than five words allow no edit.

    Null and empty texts have no item. Repeated rows are searched one by one;
    other columns are ignored.
    """
    spark = documents.sparkSession
    texts = documents.select("doc_id", text_of().alias("text"))
    kind, of = (frame.schema[name].dataType.simpleString() for frame, name in ((documents, "doc_id"), (benchmark, "item_id")))
    schema = f"doc_id {kind}, item_id {of}, item_words int, edits int, first_word int, end_word int"
    found = None
    for block in item_blocks(benchmark, **options):
        found_here = texts.mapInArrow(_search(spark.sparkContext.broadcast(block), rows_at_once), schema)
        found = found_here if found is None else found.unionByName(found_here)
    return found if found is not None else spark.createDataFrame([], schema)


def _search(shared, rows_at_once: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "item_id", "item_words", "edits", "first_word", "end_word"]
        for batch in blocks(batches, rows_at_once):
            rows = list(_found(batch.column(1).to_pylist(), shared.value))
            if rows:
                text, item, *numbers = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(item), *(pa.array(n, pa.int32()) for n in numbers)], names)

    return leanly("decontaminate", search)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, rows_at_once: int = 256, **options) -> DataFrame:
    """The rows, with all their columns, whose text has no benchmark item (see ``find_contaminated``); nothing is shuffled."""
    spark, schema = documents.sparkSession, documents.schema
    place = schema.fieldNames().index("text")
    for block in item_blocks(benchmark, **options):
        documents = documents.mapInArrow(_clean(spark.sparkContext.broadcast(block), rows_at_once, place), schema)
    return documents


def _clean(shared, rows_at_once: int, place: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, rows_at_once, column=place):
            keep = np.ones(batch.num_rows, bool)
            keep[[text for text, *_ in _found(batch.column(place).to_pylist(), shared.value)]] = False
            yield batch.filter(pa.array(keep))

    return leanly("decontaminate", clean)
