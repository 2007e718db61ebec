"""Findings as rows: mapping to techniques, scores of findings and hosts, stages, duplicates, and presence across captures."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Weights of severities in a host's score, and bases of a finding's signal.
HOST_WEIGHTS = {"critical": 8, "high": 5, "warning": 3}
SIGNAL_BASES = {"critical": 5, "high": 4, "warning": 2}
#: Parts of the risk posture and the most it can be.
RISK_WEIGHTS = {"public_flows": 30, "control": 25, "anomaly": 15, "each_anomaly": 3, "high_control": 10, "high_general": 5, "most": 100}


def by_value(column: Column, values: dict[str, int], otherwise: int) -> Column:
    found = F.lit(otherwise)
    for name, value in values.items():
        found = F.when(column == name, value).otherwise(found)
    return found


def severity(column: Column) -> Column:
    """A severity in lower case without space around; empty for null."""
    return F.lower(F.trim(F.coalesce(column, F.lit(""))))


def techniques(findings: DataFrame, rules: list[dict], text: str) -> DataFrame:
    """Each finding's best rule: rule, technique and score; findings without a keyword have none.

    A rule scores three points for each keyword in the text and one for each
    word of its context, and is vetoed by an excluded word. Of equal scores the
    earlier rule wins. Rules are columns of one pass, nothing is joined.
    """
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    has = lambda words: reduce(add, [F.contains(lowered, F.lit(w)).cast("int") for w in words], F.lit(0))
    scored = []
    for n, rule in enumerate(rules):
        keywords = has(rule["keywords"])
        good = (keywords > 0) & (has(rule.get("excluded", [])) == 0)
        score = 3 * keywords + has(rule.get("context", []))
        scored.append(F.when(good, F.struct((-score).alias("less"), F.lit(n).alias("place"), F.lit(rule["technique"]).alias("technique"))))
    best = F.array_min(F.array_compact(F.array(*scored)))
    return findings.withColumns({"technique": best["technique"], "score": -best["less"]})


def signal(level: Column, evidence: Column, peers: Column, count: Column, valued: Column, noisy: Column, doubtful: Column, recon: Column) -> Column:
    """How much a finding tells: its severity's base; a point each for evidence, peers, count and a valued kind; two less if its kind is noisy.

    A warning has one less if its kind is doubtful and little is behind it, and
    one less if nothing is; reconnaissance has one more if it is wide.
    """
    warning = severity(level) == "warning"
    few = doubtful & (evidence <= 1) & (peers <= 2)
    bare = (evidence == 0) & (peers <= 1) & (count < 5)
    wide = recon & ((count >= 10) | (peers >= 5))
    points = [
        (evidence >= 2).cast("int"), (peers >= 3).cast("int"), (count >= 5).cast("int"), valued.cast("int"), -2 * noisy.cast("int"),
        -(warning & few).cast("int"), -(warning & bare).cast("int"), wide.cast("int"),
    ]
    return reduce(add, points, by_value(severity(level), SIGNAL_BASES, 0))


def host_scores(findings: DataFrame, host: str, level: str, kind: str) -> DataFrame:
    """Each host's weighted score, findings, kinds and worst severity."""
    weight = by_value(severity(F.col(level)), HOST_WEIGHTS, 1)
    rows = findings.groupBy(host, kind, level).agg(F.count(F.lit(1)).alias("n"))
    worst = F.max_by(severity(F.col(level)), F.struct(weight, severity(F.col(level))))
    return rows.groupBy(host).agg(F.sum(weight * F.col("n")).alias("score"), F.sum("n").alias("findings"), F.count_distinct(kind).alias("kinds"), worst.alias("worst"))


def risk_posture(public_flows: Column, control: Column, anomalies: Column, high_control: Column, high_general: Column) -> Column:
    """The risk of a control network from what was counted, 0 to 100."""
    w = RISK_WEIGHTS
    some = lambda count, points: F.when(count > 0, points).otherwise(0)
    score = some(public_flows, w["public_flows"]) + some(control, w["control"]) + F.least(F.lit(w["anomaly"]), w["each_anomaly"] * anomalies)
    return F.least(F.lit(w["most"]), score + some(high_control, w["high_control"]) + some(high_general, w["high_general"]))


def multi_stage(findings: DataFrame, host: str, stage: Column, least: int = 3) -> DataFrame:
    """Hosts with findings of ``least`` different stages or more; null stages don't count."""
    rows = findings.select(host, stage.alias("stage")).where("stage IS NOT NULL").groupBy(host, "stage").agg(F.count(F.lit(1)).alias("n"))
    found = rows.groupBy(host).agg(F.count(F.lit(1)).alias("stages"), F.array_join(F.array_sort(F.collect_list("stage")), ",").alias("which"), F.sum("n").alias("findings"))
    return found.where(F.col("stages") >= least)


def collapsed(findings: DataFrame, key: list[str], ts: Column) -> DataFrame:
    """Findings of equal keys as one: how many there are, and the first and last time."""
    return findings.groupBy(*key).agg(F.count(F.lit(1)).alias("times"), F.min(ts).alias("first_micros"), F.max(ts).alias("last_micros"))


def present(rows: DataFrame, capture: str, item: Column, name: str, least: int = 2) -> DataFrame:
    """Items seen in ``least`` captures or more, in how many and how often."""
    pairs = rows.groupBy(item.alias(name), capture).agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(name).agg(F.count(F.lit(1)).alias("captures"), F.sum("n").alias("seen")).where(F.col("captures") >= least)


def failed_then_succeeded(events: DataFrame, key: str, kind: str, failed: str, succeeded: str, unit: str, attempts: int, failures: int, ts: str = "ts") -> DataFrame:
    """Brute force by calendar bucket: keys with so many attempts and failures, and whether a success came in the same bucket."""
    rows = events.where(F.col(kind).isin(failed, succeeded)).groupBy(key, F.date_trunc(unit, ts).cast("timestamp_ntz").alias("bucket"))
    found = rows.agg(F.count(F.lit(1)).alias("attempts"), F.count(F.when(F.col(kind) == failed, 1)).alias("failures"))
    found = found.withColumn("succeeded", F.col("failures") < F.col("attempts"))
    return found.where((F.col("attempts") >= attempts) & (F.col("failures") >= failures))


def first_of_each(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the first in the order given."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
