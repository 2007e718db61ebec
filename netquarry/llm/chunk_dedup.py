"""Substring deduplication by content-defined chunks with a gear rolling hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import blocks, staged, text_of, utf8
from .ngram_join import SKETCH_BITS, frequency_sketch

#: Bytes that the rolling hash looks back over: each shift doubles, and 32 shifts empty a 32-bit hash.
REACH = 32
#: Random numbers of the bytes; that of 0, which also stands before a text's start, is 0.
GEAR = np.concatenate([[0], np.random.default_rng(17).integers(1, 1 << 32, size=255, dtype=np.uint32)]).astype(np.uint32)
#: A cut is where the hash is the least within so many bytes on both sides; so chunks have more bytes than this, and 23 on average.
AROUND = 11
#: Longest chunk; longer stretches without a cut, as runs of one byte, are cut at every so many bytes.
LONGEST = 96
#: Successive chunks that are compared as one, some 92 bytes: enough not to meet by chance.
CHUNKS = 4


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: the sum of the last 32 bytes' numbers, each shifted by its distance."""
    hashes = GEAR[data]
    reach = 1
    while reach < REACH:
        before = hashes[:-reach] << np.uint32(reach)
        hashes = hashes.copy()
        hashes[reach:] += before
        reach *= 2
    return hashes


def _least_of(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` successive numbers, by doubling."""
    low, have = x, 1
    while have * 2 <= size:
        low, have = np.minimum(low[:-have], low[have:]), have * 2
    rest = size - have
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def chunk_cuts(texts: list[bytes]) -> list[np.ndarray]:
    """Of each text the places where its chunks begin, and its end.

    Cuts depend on the bytes around them alone, so that copies of a passage have
    the same cuts from ``REACH`` bytes after its start to ``AROUND`` before its
    end, whatever stands before and behind.
    """
    gap = b"\0" * (REACH + AROUND)
    raw = np.frombuffer(gap.join([b"", *texts, b""]), np.uint8)
    hashes = gear_hashes(raw).astype(np.int64)
    starts = np.cumsum([len(gap)] + [len(t) + len(gap) for t in texts])[:-1]
    lengths = np.array([len(t) for t in texts], np.int64)
    inside = np.zeros(len(raw) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + lengths, -1)
    hashes[np.cumsum(inside[:-1]) == 0] = 1 << 32
    least = _least_of(hashes, AROUND)  # least[i] is that of places i to i + AROUND - 1
    middle = hashes[AROUND:-AROUND]
    cut = (middle < least[: len(middle)]) & (middle <= least[AROUND + 1 :][: len(middle)]) & (middle < 1 << 32)
    at = np.flatnonzero(cut) + AROUND
    first = np.searchsorted(at, starts, "left")
    last = np.searchsorted(at, starts + lengths, "left")
    found = []
    for start, length, a, b in zip(starts.tolist(), lengths.tolist(), first.tolist(), last.tolist(), strict=True):
        own = np.concatenate([[0], at[a:b] - start, [length]]) if length else np.zeros(1, np.int64)
        own = own[np.concatenate([[True], own[1:] > own[:-1]])]
        more = (np.diff(own) - 1) // LONGEST
        if more.any():
            own = np.concatenate([own, *(own[i] + LONGEST * np.arange(1, more[i] + 1) for i in np.flatnonzero(more))])
            own.sort()
        found.append(own)
    return found


def window_digests(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """The cuts of each text, and 128-bit digests of all windows of ``CHUNKS`` chunks, text by text, as rows of two numbers."""
    cuts = chunk_cuts(texts)
    digests = [
        xxhash.xxh3_128_digest(text[a:b]) for text, own in zip(texts, cuts, strict=True) for a, b in zip(own[:-CHUNKS].tolist(), own[CHUNKS:].tolist(), strict=True)
    ]
    return cuts, np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def word_places(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of byte ranges: where their first whole word starts and their last one ends (code points), that word's number, and their words."""
    raw = np.frombuffer(b" " + text + b" ", np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    begin, end = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    points = np.cumsum(np.concatenate([(raw[1:] & 0xC0) != 0x80, [True]])) - 1
    first, last = np.searchsorted(begin, starts, "left"), np.searchsorted(end, ends, "right")
    none = last <= first
    first, last = np.minimum(first, max(len(begin) - 1, 0)), np.maximum(last, 1)
    if not len(begin):
        return starts * 0, starts * 0, starts * 0, starts * 0
    return points[begin[first]], points[end[np.minimum(last, len(end)) - 1]], first, np.where(none, 0, last - first)


def chunk_windows(documents: DataFrame, rows_at_once: int = 512) -> DataFrame:
    """Every window of ``CHUNKS`` chunks of the whole texts: doc_id, other_id, seq, hi, lo, start, end, word, words.

    Rows without an id have the hash of their text as ``other_id``, so equal ones are one document.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    other = F.when(F.col("doc_id").isNull(), F.xxhash64(text_of()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "other_id", "seq", "hi", "lo", "start", "end", "word", "words"]
        for batch in blocks(batches, rows_at_once):
            texts = batch.column(1).to_pylist()
            cuts, digests = window_digests(texts)
            sizes = [max(len(c) - CHUNKS, 0) for c in cuts]
            if not sum(sizes):
                continue
            places = [word_places(t, c[:-CHUNKS], c[CHUNKS:]) for t, c, n in zip(texts, cuts, sizes, strict=True) if n]
            places = [pa.array(np.concatenate(p), pa.int32()) for p in zip(*places, strict=True)]
            row = pa.array(np.repeat(np.arange(len(texts)), sizes))
            seq = pa.array(np.concatenate([np.arange(n) for n in sizes]), pa.int32())
            hashes = [pa.array(np.ascontiguousarray(digests[:, k]).view(np.int64)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(2).take(row), seq, *hashes, *places], names)

    rows = documents.select("doc_id", utf8().alias("text"), other.alias("other_id"))
    return rows.mapInArrow(cut, f"doc_id {kind}, other_id bigint, seq int, hi bigint, lo bigint, start int, `end` int, word int, words int")


def _frequent(windows: DataFrame, texts: DataFrame, most_frequent: int = 100_000, least: int = 50_000) -> DataFrame | None:
    """The few windows that very many rows have: hi, lo, and the documents that their rows span; None if there are none.

    A sketch of fixed size tells which may be frequent; only these are counted,
    partially where they are read. There are ``2 * most_frequent`` at most.
    """
    sketch = frequency_sketch(texts, lambda own: window_digests(own)[1][:, 0])
    least = max(least, int(sketch.sum()) // most_frequent)
    hot = np.flatnonzero(sketch > least)
    if not len(hot):
        return None
    counters = windows.sparkSession.createDataFrame([(int(c),) for c in hot], "counter int")
    counter = F.shiftrightunsigned("hi", 64 - SKETCH_BITS).cast("int")
    rows = windows.withColumn("counter", counter).join(F.broadcast(counters), "counter", "left_semi")
    return staged(rows.groupBy("hi", "lo").agg(*_span(), F.count(F.lit(1)).alias("rows")).where(F.col("rows") > least // 2).drop("rows"), "frequent")


def _span() -> list[Column]:
    return [f(c).alias(f"{name}_{c}") for c in ("doc_id", "other_id") for name, f in (("first", F.min), ("last", F.max))]


def repeated_passages(documents: DataFrame, least_words: int = 20) -> DataFrame:
    """Passages that stand in several documents: doc_id, start, end (code points), n_words, keep_doc_id, kept.

    Whole texts are cut into chunks where a gear rolling hash is least around,
    so that an insertion changes the chunks at its place alone. Windows of
    ``CHUNKS`` successive chunks are compared by 128-bit digests. Successive
    windows that other documents have, of ``least_words`` whole words or more in
    all, are a passage; where the smallest id that has them changes, it is
    returned in parts, which overlap. That document keeps the part
    (``keep_doc_id``, ``kept``). A part begins and ends with whole words of its
    chunks, thus lies up to some 60 bytes within the exact repeat: repeats of 50
    words or more hold several windows and are found; shorter ones of less than
    some 40 may not be.

    Cutting out all parts that aren't kept loses no chunk: each stands in a
    document of smaller id, and so on down to one that keeps it. Every window
    is one row and shuffled once; those that very many rows have are known
    beforehand, broadcast, and spread. Texts are never shuffled.

    Null and empty texts have no window; rows without an id, alike if their
    texts are, come last in the order (``keep_doc_id`` null if only such have a
    part). Repeated rows of an id are one document, and so are repeats within
    one. Other columns are ignored.
    """
    texts = documents.select("doc_id", utf8().alias("text"))
    windows = chunk_windows(documents)
    frequent = _frequent(windows, texts)
    salt = F.lit(0)
    if frequent is not None:
        known = frequent.select("hi", "lo", *(F.col(c).alias(f"known_{c}") for c in frequent.columns[2:]), F.lit(True).alias("known"))
        windows = windows.join(F.broadcast(known), ["hi", "lo"], "left")
        salt = F.when(F.col("known"), F.pmod(F.xxhash64("doc_id", "other_id", "seq"), F.lit(1024))).otherwise(0)
    same = W.partitionBy("hi", "lo", "salt")
    spans = {c.split("_", 1)[0] + "_" + col: f(col).over(same) for col in ("doc_id", "other_id") for c, f in (("first_", F.min), ("last_", F.max))}
    if frequent is not None:
        spans = {name: F.when(F.col("known"), F.col(f"known_{name}")).otherwise(value) for name, value in spans.items()}
    shared = windows.withColumn("salt", salt).select("doc_id", "other_id", "seq", "start", "end", "word", "words", *(v.alias(n) for n, v in spans.items()))
    several = (F.col("first_doc_id") < F.col("last_doc_id")) | (F.col("first_other_id") < F.col("last_other_id"))
    mixed = F.col("first_doc_id").isNotNull() & F.col("first_other_id").isNotNull()
    shared = shared.where(F.coalesce(several, F.lit(False)) | mixed).select(
        "doc_id", "other_id", "seq", "start", "end", "word", "words", "first_doc_id", F.when(F.col("first_doc_id").isNull(), F.col("first_other_id")).alias("first_other_id")
    )

    document = ["doc_id", "other_id"]
    order = W.partitionBy(*document).orderBy("seq")
    follows = F.col("seq") <= F.lag("seq").over(order) + 1
    same_first = F.lag("first_doc_id").over(order).eqNullSafe(F.col("first_doc_id")) & F.lag("first_other_id").over(order).eqNullSafe(F.col("first_other_id"))
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    numbered = shared.select("*", (~F.coalesce(follows, F.lit(False))).alias("apart"), (~same_first).alias("other_first"))
    numbered = numbered.select(
        "*", F.sum(F.col("apart").cast("int")).over(so_far).alias("run"), F.sum((F.col("apart") | F.col("other_first")).cast("int")).over(so_far).alias("part")
    )
    parts = numbered.groupBy(*document, "run", "part").agg(
        F.min(F.when(F.col("words") > 0, F.col("start"))).alias("start"), F.max(F.when(F.col("words") > 0, F.col("end"))).alias("end"),
        F.min(F.when(F.col("words") > 0, F.col("word"))).alias("word"), F.max(F.when(F.col("words") > 0, F.col("word") + F.col("words"))).alias("after"),
        F.first("first_doc_id").alias("keep_doc_id"), F.first("first_other_id").alias("keep_other_id"),
    )
    run = W.partitionBy(*document, "run")
    whole = F.max("after").over(run) - F.min("word").over(run)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_doc_id")) & F.col("other_id").eqNullSafe(F.col("keep_other_id"))
    found = parts.withColumn("whole", whole).where((F.col("whole") >= least_words) & F.col("start").isNotNull())
    return found.select("doc_id", "start", "end", (F.col("after") - F.col("word")).cast("long").alias("n_words"), "keep_doc_id", kept.alias("kept"))


def drop_repeated_passages(documents: DataFrame, least_words: int = 20) -> DataFrame:
    """The rows, with all their columns, without the passages that another document keeps.

    What stood around a cut is joined as it is. Rows without an id stay as they
    are, as do nulls. Texts with a passage to cut meet their places by doc_id.
    """
    cuts = repeated_passages(documents, least_words).where("NOT kept AND doc_id IS NOT NULL")
    cuts = staged(cuts.groupBy(F.col("doc_id").alias("cut_id")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts")), "cuts")
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").alias("row_id"), F.col("text").alias("row_text"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("pieces"))

    def step(a: Column, cut: Column) -> Column:
        piece = F.substring(F.col("row_text"), a["at"] + 1, F.greatest(cut["start"] - a["at"], F.lit(0)))
        return F.struct(F.greatest(a["at"], cut["end"]).alias("at"), F.array_append(a["pieces"], piece).alias("pieces"))

    rest = lambda a: F.concat(F.array_join(a["pieces"], ""), F.substring(F.col("row_text"), a["at"] + 1, F.char_length("row_text")))
    text = F.when(F.col("cuts").isNull(), F.col("row_text")).otherwise(F.aggregate("cuts", zero, step, rest))
    joined = rows.join(cuts, F.col("row_id") == F.col("cut_id"), "left")
    return joined.select(F.col("row").withField("text", text).alias("row")).select("row.*")
