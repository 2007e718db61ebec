"""The queries of the corpus operators, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode
from .chunk_dedup import repeated_passages
from .conversations import damaged, repair_conversations
from .decontaminate import find_contaminated
from .exact_dedup import exact_dedup
from .filter_audit import audit_filters
from .langid import identify_language
from .ngram_join import near_duplicate_components
from .secrets import KINDS, base_only, find_secrets, joined
from .token_files import ids_crc32, read_places, record_places, write_token_files
from .toxicity import find_toxic
from .url_filter import judge_urls
from .warc_zip import archive_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: The rules of the URL filter.
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(_table(spark, sf_dir, "documents"))
    of_kind = lambda n: F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("long").alias(f"n_{KINDS[n]}")
    return found.select("doc_id", *map(of_kind, range(3)), F.sha2(joined(base_only(F.col("spans"))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_toxic(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(_table(spark, sf_dir, "conversations"))).digests()


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("filter")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return read_places(record_places(files)).select("doc_id", "start", "n_tokens", ids_crc32().alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_warc_zip": op2_warc_zip,
    "op3_url_filter": op3_url_filter,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_bpe": op5_bpe,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_language_id": op9_language_id,
    "op10_decontamination": op10_decontamination,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_filter_audit": op12_filter_audit,
    "op13_token_files": op13_token_files,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc_zip": """
        WITH pages_of AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        firsts AS (SELECT payload_digest AS digest, min(page_id) AS first_id FROM pages_of WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first_id < page_id THEN first_id END AS refers_to
        FROM pages_of LEFT JOIN firsts ON payload_digest = digest""",
    "op8_exact_dedup": r"""
        WITH hashed AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM (SELECT doc_id, text_sha256,
                     first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
                     count(*) OVER (PARTITION BY text_sha256) AS group_size
              FROM hashed)""",
    "op12_filter_audit": r"""
        WITH texts AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
        told AS (
            SELECT part, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
                   length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals,
                   coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), FALSE) AS copied
            FROM texts),
        flags AS (
            SELECT part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
                   100 * capitals > 5 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, copied AS e,
                   coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
            FROM told LEFT JOIN (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
                                        max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
        failing AS (
            SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
                   || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS failed, good, toxic FROM flags),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
        orders AS (
            SELECT v.f || w.f || x.f || y.f || z.f AS filter_order
            FROM letters v, letters w, letters x, letters y, letters z
            WHERE len(list_distinct([v.f, w.f, x.f, y.f, z.f])) = 5),
        fates AS (
            SELECT part, filter_order, failed, good, toxic,
                   len(regexp_extract(filter_order, CASE WHEN failed = '' THEN '^.*$' ELSE '^[^' || failed || ']*' END)) + 1 AS removed_at
            FROM failing, orders),
        steps AS (
            SELECT part, filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS f,
                   sum((removed_at > step)::INT) AS kept, sum((removed_at = step)::INT) AS removed,
                   sum((removed_at < step AND contains(failed, substr(filter_order, step::INT, 1)))::INT) AS redundant,
                   sum((failed = substr(filter_order, step::INT, 1))::INT) AS unique_fails,
                   sum((removed_at = step)::INT * good) AS good_lost, sum((removed_at = step)::INT * toxic) AS toxic_lost
            FROM fates, range(1, 6) r(step) GROUP BY ALL)
        SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
               unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
               (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
        FROM steps""",
}
