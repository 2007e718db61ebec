"""Toxic passages as maximum-scoring segments of token log-odds."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, blocks, held_out, staged, text_of

WORD = re.compile(r"\w+")
#: Step of the histograms of scores.
STEP = 0.25
#: Letters of a stem, whose score is the prior of its words' scores.
STEM = 5


@dataclass(frozen=True)
class ToxicityModel:
    """Scores by word and by stem, the step between them, the extreme-value law of clean texts, and the logistic link."""

    scores: dict[str, float]
    stems: dict[str, float]
    gap: float
    decay: float
    rate: float
    intercept: float
    slope: float

    def evidence(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The sum of the significant passages' calibrated scores, and each as (start, end, score) in code points.

        Segments of score s or more have expectation rate * words * exp(-decay * s)
        in a clean text; the calibrated score is the negative log of that. Segments
        that are expected less than once are significant.
        """
        scores = list(map(_word_scores(self).__getitem__, WORD.findall(text.lower())))
        found = maximal_segments(np.array(scores)) if scores and max(scores) > 0 else []
        if not found:
            return 0.0, []
        base = math.log(max(self.rate * len(scores), 1e-9))
        strong = [(a, b, self.decay * s - base) for a, b, s in found if self.decay * s > base]
        if not strong:
            return 0.0, []
        lowered = text.lower()
        places = [m.span() for m in WORD.finditer(text)] if len(lowered) == len(text) else []
        if len(places) != len(scores):
            places = [m.span() for m in WORD.finditer(lowered)]
        return sum(s for *_, s in strong), [(places[a][0], places[b - 1][1], s) for a, b, s in strong]

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.intercept + self.slope * evidence))))


class _WordScores(dict):
    """Scores of whole words, less the gap; forgotten when there are too many. A word that wasn't seen has its stem's."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.scores, self.stems, self.gap = model.scores, model.stems, model.gap

    def __missing__(self, word: str) -> float:
        if len(self) >= 200_000:
            self.clear()
        own = self.scores.get(word)
        score = self[word] = (self.stems.get(word[:STEM], 0.0) if own is None else own) - self.gap
        return score


_CACHED: list[tuple[ToxicityModel, _WordScores]] = []
CACHES["toxicity"] = _CACHED.clear


def _word_scores(model: ToxicityModel) -> _WordScores:
    if not _CACHED or _CACHED[0][0] is not model:
        _CACHED[:] = [(model, _WordScores(model))]
    return _CACHED[0][1]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time.

    A segment is maximal if every proper part scores less and no segment that
    contains it has that property. Runs of positive scores enter as wholes; each
    looks back along the segments whose left sum is larger, and joins with what
    lies between if its right sum is the larger.
    """
    before = np.concatenate([[0.0], np.cumsum(scores)])
    positive = np.concatenate([[False], scores > 0, [False]])
    starts = np.flatnonzero(positive[1:-1] & ~positive[:-2])
    ends = np.flatnonzero(positive[1:-1] & ~positive[2:]) + 1
    kept: list[tuple[int, int, float, float, int]] = []  # start, end, left sum, right sum, the last one with a smaller left sum
    for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
        left, right = before[start], before[end]
        while True:
            at = len(kept) - 1
            while at >= 0 and kept[at][2] >= left:
                at = kept[at][4]
            if at < 0 or kept[at][3] >= right:
                kept.append((start, end, left, right, at))
                break
            start, left = kept[at][0], kept[at][2]
            del kept[at:]
    return [(s, e, float(r - x)) for s, e, x, r, _ in kept]


def word_scores(counted: DataFrame, prior: float, own: float, doubt: float) -> tuple[dict[str, float], dict[str, float]]:
    """Log-odds by word and by stem, from rows (word, clean, toxic, clean_texts, toxic_texts) of its tokens and of the texts that have it.

    Two levels of Dirichlet priors: a stem (a word's first letters) has ``prior``
    tokens in the classes' shares of all tokens, and a word has ``own`` tokens in
    its stem's shares, as compounds of a word are many and each is rare. What
    differs at a level is held back by ``doubt`` standard errors, which count
    texts rather than tokens, as tokens of one text come together. A word's
    score is its stem's and what is left of its own difference, so rare words
    have their stem's. Nothing else drops a word.
    """
    pairs = ("clean", "toxic", "clean_texts", "toxic_texts")
    stems = staged(counted.groupBy(F.substring("word", 1, STEM).alias("stem")).agg(*(F.sum(c).alias(f"stem_{c}") for c in pairs)), "toxicity-stems")
    total = stems.agg(*(F.coalesce(F.sum(f"stem_{c}"), F.lit(0)).alias(c) for c in pairs)).first()
    shares = {c: max(total[c], 1) / max(total[c] + total[d], 2) for c, d in zip(pairs, ("toxic", "clean", "toxic_texts", "clean_texts"), strict=True)}
    held = lambda odds, x, y: F.signum(odds) * F.greatest(F.abs(odds) - F.lit(doubt) * F.sqrt(1 / x + 1 / y), F.lit(0.0))
    of_stem = {c: F.col(f"stem_{c}") + F.lit(prior * shares[c]) for c in pairs}
    odds = F.log(of_stem["toxic"] / of_stem["clean"]) - F.lit(math.log(shares["toxic"] / shares["clean"]))
    part = of_stem["toxic"] / (of_stem["toxic"] + of_stem["clean"])
    stems = stems.select("stem", held(odds, of_stem["clean_texts"], of_stem["toxic_texts"]).alias("stem_score"), part.alias("part"))
    toxic, clean = F.lit(own) * F.col("part"), F.lit(own) * (1 - F.col("part"))
    differs = F.log((F.col("toxic") + toxic) / (F.col("clean") + clean)) - F.log(toxic / clean)
    words = counted.join(stems, F.substring("word", 1, STEM) == F.col("stem")).select(
        "word", "stem_score", held(differs, F.col("clean_texts") + clean, F.col("toxic_texts") + toxic).alias("differs")
    )
    by_word = words.where("differs <> 0").select("word", (F.col("stem_score") + F.col("differs")).alias("score")).collect()  # words of the bounded sample
    by_stem = stems.where("stem_score <> 0").select("stem", "stem_score").collect()
    return {r["word"]: r["score"] for r in by_word}, {r["stem"]: r["stem_score"] for r in by_stem}


def fit_toxicity(
    documents: DataFrame, labels: DataFrame, train_rows: int = 50_000, prior: float = 5.0, own: float = 2.0, doubt: float = 3.0, gap: float = 0.1, tail: float = 0.1, rows_at_once: int = 256
) -> ToxicityModel:
    """Learn word scores, the law of clean texts' segments and the link from labelled rows.

    Fits on about ``train_rows`` labelled documents, chosen by a hash of doc_id
    so that their ids can be broadcast; two thirds of them give the scores (see
    ``word_scores``), the rest the law and the link, which so aren't of texts
    that the scores have seen. A document is toxic if any of its labels says so;
    null ids and labels are left out. Each word costs ``gap``, so that segments end.
    The law is that of the clean texts' segments beyond the score that the
    share ``tail`` of them exceeds.
    """
    spark = documents.sparkSession
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    share = train_rows / max(known.count(), 1)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = known.where(place < F.lit(int(min(share, 1.0) * (1 << 30)))).withColumn("scoring", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(3)) > 0)
    train = staged(documents.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select("toxic", "text", "scoring"), "toxicity-train")
    rest = train.where("NOT scoring").select("toxic", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            words = list(tokens[0].keys() | tokens[1].keys())
            columns = [pa.array([c[w] for w in words], pa.int64()) for c in (*tokens, *texts)]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *columns], ["word", "clean", "toxic", "clean_texts", "toxic_texts"])

        tokens, texts = (Counter(), Counter()), (Counter(), Counter())
        for batch in blocks(batches, rows_at_once):
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = Counter(WORD.findall(text.lower()))
                tokens[toxic].update(found)
                texts[toxic].update(found.keys())
            if len(tokens[0]) + len(tokens[1]) > 500_000:
                yield rows()
                tokens, texts = (Counter(), Counter()), (Counter(), Counter())
        yield rows()

    counted = train.where("scoring").select("toxic", "text").mapInArrow(count, "word string, clean bigint, toxic bigint, clean_texts bigint, toxic_texts bigint")
    counted = counted.groupBy("word").agg(*(F.sum(c).alias(c) for c in counted.columns[1:]))
    scores, stems = word_scores(staged(counted, "toxicity-words"), prior, own, doubt)
    plain = spark.sparkContext.broadcast(ToxicityModel(scores, stems, gap, 1.0, 1.0, 0.0, 0.0))

    def exceed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, words = Counter(), 0
        for batch in blocks(batches, rows_at_once):
            for text in batch.column(1).to_pylist():
                each = np.array(list(map(_word_scores(plain.value).__getitem__, WORD.findall(text.lower()))))
                words += len(each)
                if len(each) and each.max() > 0:
                    bins.update(int(s / STEP) for *_, s in maximal_segments(each))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *bins], pa.int64()), pa.array([words, *bins.values()], pa.int64())], ["bin", "n"])

    found = rest.where("toxic = 0").mapInArrow(exceed, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    decay, rate = tail_law({r["bin"]: r["n"] for r in found}, tail)
    model = ToxicityModel(scores, stems, gap, decay, rate, 0.0, 0.0)
    scored = spark.sparkContext.broadcast(model)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Counter()
        for batch in blocks(batches, rows_at_once):
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bins[label, min(int(scored.value.evidence(text)[0] / STEP), 4_000)] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in bins], pa.int32()), pa.array([b for _, b in bins], pa.int64()), pa.array(list(bins.values()), pa.int64())],
            ["toxic", "bin", "n"],
        )

    binned = rest.mapInArrow(evidence, "toxic int, bin bigint, n bigint").groupBy("toxic", "bin").agg(F.sum("n").alias("n")).collect()
    intercept, slope = _logistic([(r["bin"] * STEP, r["toxic"], r["n"]) for r in binned])
    return ToxicityModel(scores, stems, gap, decay, rate, intercept, slope)


def tail_law(bins: dict[int, int], tail: float) -> tuple[float, float]:
    """Decay and rate of the law rate * words * exp(-decay * score) of clean texts' segments.

    From a histogram of scores by steps of ``STEP``, with the number of words at
    -1. Excesses over the threshold that the share ``tail`` of the segments
    reaches are exponential; the decay is the inverse of their mean, and the rate
    is such that the law gives their number at the threshold.
    """
    words, segments = bins.get(-1, 0), sum(n for b, n in bins.items() if b >= 0)
    if not words or not segments:
        return 1.0, 1e-6
    beyond, threshold = 0, 0
    for b in sorted((b for b in bins if b >= 0), reverse=True):
        beyond, threshold = beyond + bins[b], b
        if beyond >= tail * segments:
            break
    excess = sum((b - threshold + 0.5) * STEP * n for b, n in bins.items() if b >= threshold)
    decay = min(beyond / excess, 5.0)
    return decay, beyond / words * math.exp(decay * threshold * STEP)


def _logistic(points: list[tuple[float, int, int]], ridge: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope of a logistic link by Newton's method, over (value, class, count)."""
    if not points:
        return -1.0, 1.0
    x, y, n = (np.array(v, float) for v in zip(*points, strict=True))
    x = np.minimum(x, 40.0)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(b[0] + b[1] * x, -30, 30)))
        gradient = np.array([(n * (y - p)).sum(), (n * (y - p) * x).sum()]) - ridge * b
        w = n * p * (1 - p)
        hessian = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum()]]) + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(max(b[1], 0.0))


def score_toxicity(documents: DataFrame, model: ToxicityModel, rows_at_once: int = 256) -> DataFrame:
    """Score every whole text: doc_id, score (0 to 1) and its significant passages as (start, end, score).

    Null and empty texts have no evidence and get the score of none; repeated
    rows are scored one by one, and other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in blocks(batches, rows_at_once):
            found = [own.evidence(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([own.probability(e) for e, _ in found], pa.float64()),
                    pa.array([[{"start": a, "end": b, "score": s} for a, b, s in p] for _, p in found], passage),
                ],
                ["doc_id", "score", "passages"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", text_of().alias("text")).mapInArrow(
        score, f"doc_id {kind}, score double, passages array<struct<start: bigint, end: bigint, score: double>>"
    )


def find_toxic(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Fit on labels outside the held-out fold, then score all: doc_id, held_out, score, predicted, passages."""
    model = fit_toxicity(documents, labels.where(~held_out()), **options)
    return score_toxicity(documents, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages"
    )
