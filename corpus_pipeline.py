"""The corpus pipeline: stages that each read what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.llm.bpe import bpe_encode
from netquarry.llm.common import held_out, small_batches, staged, utf8, without
from netquarry.llm.decontaminate import drop_contaminated
from netquarry.llm.exact_dedup import drop_copies
from netquarry.llm.langid import fit_languages, keep_known_languages
from netquarry.llm.ngram_join import near_duplicate_components
from netquarry.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; null, letterless and foreign texts go."""
    small_batches(spark)
    return keep_known_languages(docs, fit_languages(docs.where(~held_out())))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies. Rows without an id, and repeated rows of one that stays, stay.

    Rows of one id with different texts are told apart by a hash of the text.
    """
    dropped = near_duplicate_components(docs).where("doc_id <> component_id").select(F.struct("doc_id", "text_hash").alias("dropped_key")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.struct("doc_id", F.xxhash64(utf8()).alias("text_hash")).alias("row_key"))
    return without(rows, F.col("row_key"), staged(dropped, "dropped")).select("row.*")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded of each document."""
    return bpe_encode(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("ngram_jaccard_join", near),
    ("benchmark_decontamination", clean),
    ("bpe_encoding", encode),
]

#: Neither the language model, nor the edit distances, nor the encoding can be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
