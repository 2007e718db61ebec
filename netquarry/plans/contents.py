"""Queries of carved files, host paths and decoded texts, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.decoding import decoded
from ..operators import carving
from ..operators.paths import host_paths
from ..operators.timing import micros
from .catalogue import _table
from .streams import _blocks, _text

#: Files of four kinds as hexadecimal digits before and after their contents.
_PNG, _GIF, _JPG, _PDF = ("89504E470D0A1A0A", "49454E44AE426082"), ("47494638", "003B"), ("FFD8FF", "FFD9"), ("255044462D", "2525454F46")


def _stream_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten pages a stream: of each a file around its html, every third within another one, with its url between them."""
    pages = _table(spark, sf_dir, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.hex(F.coalesce("html", F.lit("")).cast("binary")).alias("html"))
    n = F.col("page_id")
    around = lambda kind, inner: F.concat(F.lit(kind[0]), inner, F.lit(kind[1]))
    own = F.when(n % 4 == 0, around(_PNG, F.col("html"))).when(n % 4 == 1, around(_GIF, F.col("html"))).when(n % 4 == 2, around(_JPG, F.col("html"))).otherwise(around(_PDF, F.col("html")))
    whole = F.when(n % 3 == 0, around(_JPG, F.concat(_text(F.lit("outer")), own))).otherwise(own)
    rows = pages.select(
        F.lit("made").alias("capture"), F.lit("10.0.0.1").alias("src"), (20_000 + F.floor(n / 10)).cast("int").alias("sport"), F.lit("10.0.0.2").alias("dst"), F.lit(80).alias("dport"), n.alias("nth"),
        F.concat(_text(F.col("url")), whole).alias("hex"),
    )
    return _blocks(rows)


def _carved(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _stream_of_files(spark, sf_dir).persist()
    files = carving.extents(carving.marks(blocks))
    return carving.carved(blocks, files).groupBy("kind", "sha256").agg(F.count(F.lit(1)).alias("files"), F.max(F.octet_length("data")).alias("bytes"), F.count(F.when(F.col("inside"), 1)).alias("inside"))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and sign-ups as one of 600 hosts reaching another."""
    return _table(spark, sf_dir, "events").where("event_type IN ('signup', 'purchase')").select(
        F.concat(F.lit("h"), F.col("user_id") % 600).alias("src"), F.concat(F.lit("h"), F.col("event_id") * 7 % 600).alias("dst"), micros("ts").alias("at")
    )


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways of at most three hops from two hosts on a certain day."""
    steps = _steps(spark, sf_dir)
    origins = spark.createDataFrame([("h1", 1_704_153_600_000_000), ("h2", 1_704_153_600_000_000)], "host string, at long")
    found = host_paths(steps, origins, most_hops=3)
    return found.select("origin", "host", "hops", "arrived", F.array_join("path", ">").alias("path"))


def _decodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations under chains of up to three encodings, searched for the text."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("The answer to that is: "), F.coalesce("text", F.lit(""))).alias("text"))
    once = F.base64(F.col("text").cast("binary"))
    n = F.col("turn") % 4
    made = F.when(n == 0, once).when(n == 1, F.hex(once.cast("binary"))).when(n == 2, F.base64(F.hex(once.cast("binary")).cast("binary"))).otherwise(F.lower(F.hex(F.url_encode("text").cast("binary"))))
    found = decoded(rows.select("conv_id", "turn", made.alias("made")), "made")
    return found.select("conv_id", "turn", "chain", F.sha2("decoded", 256).alias("sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"carved_files": _carved, "host_paths": _paths, "decoded_chains": _decodings}

ORACLE_SQL: dict[str, str] = {
    "carved_files": """
        WITH p AS (SELECT page_id AS n, encode(coalesce(html, '')) AS html FROM pages),
        f AS (SELECT n, ['PNG', 'GIF', 'JPG', 'PDF'][n % 4 + 1] AS kind,
                     CASE n % 4 WHEN 0 THEN from_hex('89504E470D0A1A0A') || html || from_hex('49454E44AE426082') WHEN 1 THEN encode('GIF8') || html || from_hex('003B')
                                WHEN 2 THEN from_hex('FFD8FF') || html || from_hex('FFD9') ELSE encode('%PDF-') || html || encode('%%EOF') END AS data FROM p),
        g AS (SELECT kind, data, n % 3 = 0 AS inside FROM f UNION ALL SELECT 'JPG', from_hex('FFD8FF') || encode('outer') || data || from_hex('FFD9'), FALSE FROM f WHERE n % 3 = 0)
        SELECT kind, sha256(data) AS sha256, count(*) AS files, max(octet_length(data))::INTEGER AS bytes, count(CASE WHEN inside THEN 1 END) AS inside FROM g GROUP BY 1, 2""",
    "host_paths": """
        WITH RECURSIVE s AS (
            SELECT DISTINCT 'h' || user_id % 600 AS src, 'h' || event_id * 7 % 600 AS dst, epoch_us(ts) AS t FROM events WHERE event_type IN ('signup', 'purchase')),
        w AS (
            SELECT o AS origin, o AS host, 0 AS hops, 1704153600000000 AS arrived, [o] AS path FROM (VALUES ('h1'), ('h2')) v(o)
            UNION ALL
            SELECT origin, dst, hops + 1, t, list_append(path, dst) FROM w JOIN s ON src = host WHERE t > arrived AND NOT list_contains(path, dst) AND hops < 3)
        SELECT origin, host, hops, arrived, array_to_string(path, '>') AS path
        FROM (SELECT *, row_number() OVER (PARTITION BY origin, host ORDER BY hops, arrived, path) AS n FROM w WHERE hops > 0) WHERE n = 1""",
    "decoded_chains": """
        SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'base64' WHEN 1 THEN 'hex>base64' WHEN 2 THEN 'base64>hex>base64' ELSE 'hex>url' END AS chain,
               sha256('The answer to that is: ' || coalesce(text, '')) AS sha256 FROM conversations""",
}
