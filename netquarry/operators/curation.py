"""Findings of many detectors as one list: united, thinned by what they tell, merged and ranked, and written."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.network import csv_safe
from .findings import severity, signal

#: Columns of a finding; what a detector doesn't tell is null.
FINDING = {
    "source": "string", "severity": "string", "summary": "string", "details": "string", "evidence": "array<string>", "peers": "array<struct<peer:string,count:bigint>>",
}
RANKS = {"critical": 0, "high": 1, "warning": 2, "info": 3}


@dataclass(frozen=True)
class Words:
    """Parts of summaries, in lower case, that tell findings of much value, of doubt and of reconnaissance; and whole summaries that are noise."""

    valued: tuple[str, ...] = ()
    doubtful: tuple[str, ...] = ()
    recon: tuple[str, ...] = ()
    noisy: tuple[str, ...] = ()


def united(findings: dict[str, DataFrame]) -> DataFrame:
    """Findings of several detectors, by name, as rows of ``FINDING`` and whatever other columns some of them have; with ``module``."""
    parts = []
    for name, df in findings.items():
        missing = {c: F.lit(None).cast(kind) for c, kind in FINDING.items() if c not in df.columns}
        parts.append(df.withColumns({"module": F.lit(name)} | missing))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def detail_count(details: Column) -> Column:
    """The greatest number of at most six digits that stands alone in the details; 0 if there is none."""
    numbers = F.regexp_extract_all(F.coalesce(details, F.lit("")), F.lit(r"(?<!\w)(\d{1,6})(?!\w)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(numbers, lambda n: n.cast("int"))), F.lit(0))


def _has(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(F.lower(text), F.lit(w)) for w in words], F.lit(False))


def _signal(words: Words) -> Column:
    summary, count = F.col("summary"), detail_count(F.col("details"))
    evidence, peers = F.size("evidence"), F.coalesce(F.array_max(F.transform("peers", lambda p: p["count"])), F.lit(0))
    return signal(F.col("severity"), evidence, peers, count, _has(summary, words.valued), summary.isin(*words.noisy), _has(summary, words.doubtful), _has(summary, words.recon))


def curated(findings: DataFrame, words: Words, most_evidence: int = 10, limit: int | None = None) -> DataFrame:
    """The findings that tell enough, those of one source, severity, summary and details as one: the columns of ``FINDING`` with signal and rank.

    Findings without a summary, and those that only inform, are left out. A
    warning must reach a signal of 4: 3 if it is of value or wide
    reconnaissance; one more if it is noise or of doubt, and one more if nothing stands
    behind it. Merged findings have the least ``most_evidence`` pieces of evidence,
    and peers with their counts added. Ranks go by signal, source and
    summary within a severity; what is of no known severity only informs.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    pieces = F.array_sort(F.array_distinct(F.filter(F.coalesce("evidence", F.array().cast("array<string>")), lambda e: F.trim(e) != "")))
    rows = findings.select(
        F.when(text("source") == "", "unknown").otherwise(text("source")).alias("source"), F.when(severity(F.col("severity")).isin(*RANKS), severity(F.col("severity"))).otherwise("info").alias("severity"), text("summary").alias("summary"), text("details").alias("details"),
        pieces.alias("evidence"), F.coalesce("peers", F.array().cast(FINDING["peers"])).alias("peers"),
    ).where("summary <> '' AND severity <> 'info'")
    summary = F.col("summary")
    some = (F.size("evidence") > 0) | (F.size("peers") > 0)
    wide = _has(summary, words.recon) & ((detail_count(F.col("details")) >= 10) | (F.size("peers") > 0))
    noise = summary.isin(*words.noisy) | _has(summary, words.doubtful)
    least = F.when(_has(summary, words.valued) | wide, 3).otherwise(4) + noise.cast("int") + (~some).cast("int")
    kept = rows.where((F.col("severity") != "warning") | (_signal(words) >= least))

    key = ["source", "severity", "summary", "details"]
    counted = kept.select(*key, F.explode("peers").alias("p")).groupBy(*key, "p.peer").agg(F.sum("p.count").alias("count"))
    peers = counted.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("peer", "count"))).alias("peers"))
    proofs = kept.select(*key, F.explode("evidence").alias("piece")).distinct()
    place = F.row_number().over(W.partitionBy(*key).orderBy("piece"))
    proofs = proofs.withColumn("n", place).where(F.col("n") <= most_evidence).groupBy(*key).agg(F.array_sort(F.collect_list("piece")).alias("evidence"))
    whole = kept.groupBy(*key).agg(F.count(F.lit(1)).alias("findings")).join(peers, key, "left").join(proofs, key, "left")
    empty = lambda c: F.coalesce(c, F.array().cast(FINDING[c])).alias(c)
    whole = whole.select(*key, "findings", empty("evidence"), empty("peers")).withColumn("signal", _signal(words))
    order = F.try_element_at(F.create_map(*(F.lit(x) for pair in RANKS.items() for x in pair)), F.col("severity"))
    if limit is not None:
        whole = whole.orderBy(order, F.col("signal").desc(), *key[0::2], "details").limit(limit)
    return whole.withColumn("rank", F.row_number().over(W.partitionBy("severity").orderBy(F.col("signal").desc(), "source", "summary", "details")))


def write_exports(findings: DataFrame, hosts: DataFrame, folder: str) -> None:
    """Write findings and hosts as JSON, as CSV whose cells no spreadsheet takes for formulas, and as tables, below a folder.

    CSV has the columns in the order of their names; lists and structs stand in it as JSON.
    """
    for name, df in (("findings", findings), ("hosts", hosts)):
        cell = lambda f: csv_safe(F.col(f.name) if f.dataType.typeName() not in ("array", "struct", "map") else F.to_json(F.col(f.name)))
        flat = df.select(*(cell(f).alias(f.name) if f.dataType.typeName() in ("string", "array", "struct", "map") else F.col(f.name) for f in sorted(df.schema, key=lambda f: f.name)))
        df.write.json(f"{folder}/{name}.json")
        flat.write.option("header", "true").option("escape", '"').csv(f"{folder}/{name}.csv")
        df.write.parquet(f"{folder}/{name}.parquet")
