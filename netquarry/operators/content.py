"""Indicators in texts, domains and hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.network import base_domain, url_host

#: Patterns of indicators.
INDICATORS = {
    "emails": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "hashes": r"\b[0-9a-fA-F]{32,64}\b",
}


def indicator_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """How many indicators of each kind a text has; rows without any are left out."""
    counts = [F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(p), F.lit(0))).alias(name) for name, p in INDICATORS.items()]
    return rows.select(key, *counts).where(" OR ".join(f"{name} > 0" for name in INDICATORS))


def domains(rows: DataFrame, url: str = "url") -> DataFrame:
    """Hosts of urls with their base domain and how many rows have them."""
    host = url_host(F.col(url))
    return rows.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("hits")).withColumn("domain", base_domain(F.col("host")))


def watched_hosts(rows: DataFrame, watched: DataFrame, url: str = "url") -> DataFrame:
    """Hosts that are a watched domain or below it: host, value, hits.

    Each host's suffixes are joined with the list on equality, which Spark
    broadcasts where its statistics show it small and shuffles otherwise.
    """
    found = domains(rows, url)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return found.select("host", "hits", F.explode(suffixes).alias("value")).join(watched.select("value").distinct(), "value").select("host", "value", "hits")


def same_content(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Digests of contents that several rows have: artifacts seen again."""
    return rows.groupBy(F.sha2(F.col(text), 256).alias("sha256")).agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_seen")).where("copies > 1")
