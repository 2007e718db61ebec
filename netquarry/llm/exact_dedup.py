"""Exact deduplication behind a two-pass Bloom filter, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SIEVE_ROW, SPACES, join_groups, scratch, sieve_mask, split_by_sieve, staged, text_of


def digest_of_text():
    """SHA-256 of the text without white space, in lower-case hex; null counts as empty."""
    return F.sha2(F.regexp_replace(text_of(), SPACES, ""), 256)


def twice_set(keyed: DataFrame) -> DataFrame:
    """First pass over rows (word, mask): the cells of each word that two rows or more set, as (word, bits).

    Three bit aggregates tell them: cells that any row set, cells that an odd
    number of rows set, and the number of rows. Those of the first that aren't of
    the second were set twice or more. If the rows set more cells than one for
    each odd and two for each even cell, some cell was set three times or more,
    and all set cells of the word count as repeated. So no repeat is missed.
    """
    sums = keyed.groupBy("word").agg(F.bit_or("mask").alias("some"), F.bit_xor("mask").alias("odd"), F.count(F.lit(1)).alias("rows"))
    even = F.col("some").bitwiseAND(F.bitwise_not("odd"))
    told = F.bit_count("odd") + 2 * F.bit_count(even) == 2 * F.col("rows")
    return sums.select("word", F.when(told, even).otherwise(F.col("some")).alias("bits")).where("bits <> 0")


def tested_rows(hashed: DataFrame, rows: int, bits_per_row: int, broadcast_bytes: int) -> DataFrame:
    """Both passes: rows (doc_id, chars, text_sha256) with ``maybe``, whether a Bloom filter holds their digest for repeated.

    The filter is broadcast, and rows aren't shuffled. What would exceed
    ``broadcast_bytes`` is done in rounds over ranges of the digests' hashes,
    each with a filter of its own; a round reads the digests again, never texts.
    """
    words = max(-(-rows * bits_per_row // 64), 1)
    rounds = -(-words // max(broadcast_bytes // SIEVE_ROW, 256))
    words = -(-words // rounds)
    place = F.pmod("key", F.lit(rounds * words))
    path = scratch(hashed.sparkSession, "tested")
    for n in range(rounds):
        own = hashed.where(place.between(n * words, n * words + words - 1)).withColumn("word", place)
        repeated = staged(twice_set(own.select("word", sieve_mask(F.col("key")).alias("mask"))), "repeat-filter")
        tested = own.join(F.broadcast(repeated), "word", "left")
        mask = sieve_mask(F.col("key"))
        maybe = F.coalesce(F.col("bits").bitwiseAND(mask) == mask, F.lit(False))
        tested.select("doc_id", "chars", "text_sha256", maybe.alias("maybe")).write.mode("append").parquet(path)
    kind = hashed.schema["doc_id"].dataType.simpleString()
    return hashed.sparkSession.read.schema(f"doc_id {kind}, chars bigint, text_sha256 string, maybe boolean").parquet(path)


def exact_dedup(documents: DataFrame, bits_per_row: int = 16, broadcast_bytes: int = 128 << 20) -> DataFrame:
    """Group equal texts and choose the row of each group that stays.

    Texts are equal when identical without white space (space, 0x09 to 0x0D).
    Pass one builds a Bloom filter of the digests that are set twice. Pass two
    tests every row: rows it rejects are unique and pass straight through; only
    the others are shuffled by digest, as (id, length, digest) and never with
    their text. The filter has ``bits_per_row`` bits a row, in rounds of at most
    ``broadcast_bytes`` (see ``tested_rows``). Groups that are large meet their
    result by broadcast (``join_groups``).

    Null texts count as empty, and empty texts are equal to each other. Of a
    group stays the longest original, then the smallest id (null ids last).
    Rows that repeat an id with an equal text are one document: each such row
    is returned, all marked alike. Columns besides doc_id and text are ignored.
    """
    hashed = documents.select("doc_id", F.char_length(text_of()).cast("long").alias("chars"), digest_of_text().alias("text_sha256"))
    hashed = staged(hashed.withColumn("key", F.xxhash64("text_sha256")), "hashed")
    rows = hashed.count()
    tested = tested_rows(hashed, rows, bits_per_row, broadcast_bytes)
    alone = tested.where("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    shared = tested.where("maybe").select("doc_id", "chars", "text_sha256")
    best = F.min(F.struct((-F.col("chars")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id")))
    groups = staged(
        shared.groupBy("text_sha256").agg(best.getField("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups"
    )
    grouped = join_groups(shared, groups, ["text_sha256"], rows).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(grouped)


def drop_copies(documents: DataFrame, **options) -> DataFrame:
    """The documents that stay, with all their columns. Rows of one id with equal texts stay as one row.

    Only rows that a Bloom filter of the rows to drop lets through are
    shuffled, so unique documents never move.
    """
    marks = staged(exact_dedup(documents, **options).where("NOT kept OR group_size > 1"), "marks")
    per_row = marks.groupBy("doc_id", "text_sha256").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    touched = staged(per_row.where("NOT kept OR rows > 1").withColumn("key", F.xxhash64("doc_id", "text_sha256")), "touched")
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").alias("row_id"), digest_of_text().alias("row_sha256"))
    clear, maybe = split_by_sieve(rows, F.xxhash64("row_id", "row_sha256"), touched.select("key"))
    own = F.col("row_id").eqNullSafe(F.col("doc_id")) & (F.col("row_sha256") == F.col("text_sha256"))
    left = maybe.join(touched, own, "left").where("kept IS NULL OR kept")
    once = left.where("rows IS NULL").select("row")
    repeated = left.where("rows IS NOT NULL")
    if not touched.where("kept").isEmpty():
        once = once.unionByName(repeated.dropDuplicates(["row_id", "row_sha256"]).select("row"))
    return clear.select("row").unionByName(once).select("row.*")
