"""Language identification with hyperdimensional letter n-gram profiles."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, blocks, held_out, leanly, text_of

UNDETERMINED = "und"
#: Different trigrams whose vectors are held at once, which bounds the memory whatever the texts: some 10 MB with 1,024 dimensions.
CODES_AT_ONCE = 2_048
_LETTERS: list[np.ndarray] = []
CACHES["langid"] = _LETTERS.clear


@dataclass(frozen=True)
class LanguageModel:
    """Unit prototype vectors, one row a language, and the code points of the letters that these use, in order."""

    languages: list[str]
    prototypes: np.ndarray
    seed: int
    letters: np.ndarray

    @property
    def dimensions(self) -> int:
        return self.prototypes.shape[1]


def letter_table() -> np.ndarray:
    """The lower-case letter of every code point, 0 for all that aren't letters."""
    if not _LETTERS:
        table = np.zeros(sys.maxunicode + 1, np.int32)
        for c in range(sys.maxunicode + 1):
            if unicodedata.category(chr(c))[0] == "L":
                table[c] = ord(chr(c).lower()[0])
        _LETTERS.append(table)
    return _LETTERS[0]


def letter_vectors(letters: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """Pseudorandom vectors of +1 and -1, drawn from the letter's code point and the seed alone."""
    x = letters.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, dimensions // 64 + 1, dtype=np.uint64) * np.uint64(
        0xD1B54A32D192ED03
    ) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little")
    return (bits.astype(np.int8) * 2 - 1).astype(np.int8)


def letters_of(text: str) -> np.ndarray:
    """The lower-case letter of each of the text's characters, 0 for all that aren't letters."""
    return letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct letter trigrams of a whole text and their counts; stretches of other characters count as one space."""
    letters = np.concatenate([[0], letters_of(text), [0]])
    letters = letters[np.concatenate([[True], (letters[1:] != 0) | (letters[:-1] != 0)])].astype(np.int64)
    if len(letters) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.sort((letters[:-2] << 42) | (letters[1:-1] << 21) | letters[2:])
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[starts], np.diff(np.append(starts, len(codes)))


def bundle(texts: list[str], dimensions: int, seed: int) -> np.ndarray:
    """A unit vector for each text (zeros where it has no letter): the sum of its n-gram vectors by count.

    An n-gram's vector binds (multiplies) its letters' vectors, each permuted
    (rolled) by its distance from the n-gram's end. Vectors are made and summed in
    slices of ``CODES_AT_ONCE`` n-grams.
    """
    found = [trigrams(t) for t in texts]
    all_codes = np.unique(np.concatenate([np.empty(0, np.int64), *(c for c, _ in found)]))
    bundled = np.zeros((len(texts), dimensions), np.float32)
    for at in range(0, len(all_codes), CODES_AT_ONCE):
        codes = all_codes[at : at + CODES_AT_ONCE]
        parts = [(codes >> shift) & 0x1FFFFF for shift in (42, 21, 0)]
        letters = np.unique(np.concatenate(parts))
        vectors = letter_vectors(letters, dimensions, seed)
        bound = np.ones((len(codes), dimensions), np.int8)
        for roll, part in zip((2, 1, 0), parts, strict=True):
            bound *= np.roll(vectors, roll, axis=1)[np.searchsorted(letters, part)]
        counts = np.zeros((len(texts), len(codes)), np.float32)
        for row, (own, n) in enumerate(found):
            low, high = np.searchsorted(own, codes[0], "left"), np.searchsorted(own, codes[-1], "right")
            counts[row, np.searchsorted(codes, own[low:high])] = n[low:high]
        bundled += counts @ bound.astype(np.float32)
    norms = np.linalg.norm(bundled, axis=1, keepdims=True)
    return np.divide(bundled, norms, out=np.zeros_like(bundled), where=norms > 0)


def fit_languages(
    labelled: DataFrame, dimensions: int = 1024, per_language: int = 5_000, seed: int = 7, rows_at_once: int = 128, least_use: float = 1e-4
) -> LanguageModel:
    """Bundle the texts of each language into a prototype, and list the letters that are ``least_use`` of some language's or more.

    Fits on about ``per_language`` rows of each language at most, chosen by a
    hash of doc_id. Rows without language or text are left out.
    """
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(float(per_language << 30)) / F.col("rows")
    sample = labelled.join(F.broadcast(sizes), "lang").where(chosen).select("lang", "text")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        used: dict[str, dict[int, int]] = {}
        for batch in blocks(batches, rows_at_once):
            vectors = bundle(batch.column(1).to_pylist(), dimensions, seed)
            for language, vector in zip(batch.column(0).to_pylist(), vectors, strict=True):
                total[language] = total.get(language, 0) + vector.astype(np.float64)
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = used.setdefault(language, {})
                for letter, n in zip(*(x.tolist() for x in np.unique(letters_of(text), return_counts=True)), strict=True):
                    own[letter] = own.get(letter, 0) + n
        for language, vector in total.items():
            letters = np.array([x for x in used[language] if x], np.int32)
            at = np.concatenate([np.arange(dimensions, dtype=np.int32), dimensions + letters])
            value = np.concatenate([vector, [used[language][x] for x in letters.tolist()]])
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(at)), pa.array(at), pa.array(value)], ["lang", "at", "value"])

    summed = sample.mapInArrow(leanly("langid", sums), "lang string, at int, value double").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    rows = summed.orderBy("lang", "at").collect()  # languages x (dimensions and letters)
    languages = sorted({r["lang"] for r in rows})
    of_language = {x: sum(r["value"] for r in rows if r["lang"] == x and r["at"] >= dimensions) for x in languages}
    letters = sorted({r["at"] - dimensions for r in rows if r["at"] >= dimensions and r["value"] >= least_use * of_language[r["lang"]]})
    prototypes = np.array([r["value"] for r in rows if r["at"] < dimensions]).reshape(len(languages), dimensions)
    norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return LanguageModel(languages, (prototypes / np.maximum(norms, 1e-12)).astype(np.float32), seed, np.array(letters, np.int32))


def predict_language(documents: DataFrame, model: LanguageModel, rows_at_once: int = 128) -> DataFrame:
    """Compare every whole text with the prototypes by cosine.

    Returns doc_id, lang_pred and score, the cosine held to 0 and up. Texts that
    are null or have no letter get "und" and 0, as does every text if the model
    knows no language; equal cosines go to the first language by name.
    """
    languages, prototypes, seed = model.languages, model.prototypes, model.seed

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, rows_at_once):
            vectors = bundle(batch.column(1).to_pylist(), prototypes.shape[1], seed)
            known = vectors.any(axis=1) if languages else np.zeros(len(vectors), bool)
            cosine = vectors @ prototypes.T if languages else np.zeros((len(vectors), 1))
            best = cosine.argmax(axis=1)
            named = [languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
            score = np.where(known, np.clip(cosine.max(axis=1), 0, 1), 0).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", text_of().alias("text")).mapInArrow(leanly("langid", predict), f"doc_id {kind}, lang_pred string, score double")


def identify_language(documents: DataFrame, **options) -> DataFrame:
    """Fit on the rows outside the held-out fold, then predict all: doc_id, held_out, lang_pred, score."""
    model = fit_languages(documents.where(~held_out()), **options)
    return predict_language(documents, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known_languages(documents: DataFrame, model: LanguageModel, deviations: float = 4.0, telling: int = 64, rows_at_once: int = 128) -> DataFrame:
    """The rows, with all their columns, whose text is in one of the model's languages.

    Cosines of unrelated texts are chance, with a deviation of 1 / sqrt(dimensions).
    A text stays if its largest cosine is ``deviations`` of these or more and it has a
    letter of the model. With less, it stays only if it has fewer than ``telling``
    different trigrams, thus may be too short to tell, and at least half of its letters are the model's.
    Texts without a letter go, as do those in foreign scripts, whatever their
    length. If the model knows no language, all texts go.
    """
    schema = documents.schema
    place = schema.fieldNames().index("text")
    prototypes, seed, known = model.prototypes, model.seed, model.letters
    least = deviations / max(prototypes.shape[1], 1) ** 0.5

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, rows_at_once, column=place):
            texts = [t or "" for t in batch.column(place).to_pylist()]
            near = (bundle(texts, prototypes.shape[1], seed) @ prototypes.T).max(axis=1, initial=0.0) >= least
            letters = [x[x != 0] for x in map(letters_of, texts)]
            own = np.array([np.isin(x, known).mean() if len(x) else 0.0 for x in letters])
            short = np.array([not n and len(trigrams(t)[0]) < telling for t, n in zip(texts, near, strict=True)])
            yield batch.filter(pa.array((own > 0) & (near | (short & (own >= 0.5)))))

    return documents.mapInArrow(leanly("langid", keep), schema)
