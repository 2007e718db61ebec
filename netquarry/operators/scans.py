"""Probes, scanners, handshakes and who talks with whom, over flow rows or events.

Distinct peers are counted by aggregating the pairs first, so that a busy source
is merged where it is read and no task holds all rows of one source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .timing import micros


def probed(flows: DataFrame, by: list[str], target: str, least: int, name: str) -> DataFrame:
    """Groups with ``least`` different targets or more, and their packets: vertical scans by (src, dst), horizontal ones by (src, dport)."""
    pairs = flows.groupBy(*by, target).agg(F.count(F.lit(1)).alias("packets"))
    return pairs.groupBy(*by).agg(F.count(target).alias(name), F.sum("packets").alias("packets")).where(F.col(name) >= least)


def scanner_sources(
    flows: DataFrame, src: str = "src", dst: str = "dst", port: str = "dport", most_ports: int = 20, targets: int = 10, few_targets: int = 8, probes: int = 25, ports: int = 30, syns: int = 150, few_ports: int = 10
) -> DataFrame:
    """Sources that look like scanners, and why: the first of five tests that holds.

    Ports on one target, targets, many probes of fewer targets, ports, and very
    many probes of fewer ports.
    """
    triples = flows.groupBy(src, dst, port).agg(F.count(F.lit(1)).alias("n"))
    per_target = triples.groupBy(src, dst).agg(F.count(port).alias("ports"), F.sum("n").alias("n"))
    found = per_target.groupBy(src).agg(F.count(dst).alias("targets"), F.max("ports").alias("most_ports"), F.sum("n").alias("probes"))
    wide = triples.groupBy(src, port).count().groupBy(src).agg(F.count(port).alias("ports"))
    tests = (
        F.when(F.col("most_ports") >= most_ports, "ports_of_one_target")
        .when(F.col("targets") >= targets, "targets")
        .when((F.col("probes") >= probes) & (F.col("targets") >= few_targets), "probes_and_targets")
        .when(F.col("ports") >= ports, "ports")
        .when((F.col("probes") >= syns) & (F.col("ports") >= few_ports), "probes_and_ports")
    )
    return found.join(wide, src).withColumn("reason", tests).where("reason IS NOT NULL")


def unanswered(probes: DataFrame, answers: DataFrame, key: list[str], by: str) -> DataFrame:
    """How many of each source's probes have an answer of the same key: probes, answered, ratio."""
    known = answers.select(*key).distinct().withColumn("answered", F.lit(1))
    rows = probes.join(known, key, "left").groupBy(by).agg(F.count(F.lit(1)).alias("probes"), F.count("answered").alias("answered"))
    return rows.withColumn("ratio", F.col("answered") / F.col("probes"))


def handshakes(events: DataFrame, key: list[str], kind: str, syn: str, synack: str, ack: str, reset: str, ts: str = "ts") -> DataFrame:
    """The state that each key's handshake reached, by the order of its first steps.

    established: an acknowledgement follows the answer, which follows the
    request; half-open: an answer follows; refused: a reset follows; syn-only;
    else no-handshake. One pass of conditional minima and maxima, no sort.
    """
    of = lambda f, k: f(F.when(F.col(kind) == k, micros(ts)))
    times = events.groupBy(*key).agg(of(F.min, syn).alias("syn"), of(F.max, synack).alias("synack"), of(F.max, ack).alias("ack"), of(F.max, reset).alias("rst"))
    state = (
        F.when((F.col("synack") > F.col("syn")) & (F.col("ack") > F.col("synack")), "established")
        .when(F.col("synack") > F.col("syn"), "half-open")
        .when(F.col("rst") > F.col("syn"), "refused")
        .when(F.col("syn").isNotNull(), "syn-only")
        .otherwise("no-handshake")
    )
    return times.select(*key, state.alias("state"))


def orphan_answers(events: DataFrame, key: str, kind: str, asked: str, answered: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Answers of a key that no request of it came before."""
    first = events.where(F.col(kind) == asked).groupBy(key).agg(F.min(micros(ts)).alias("first_request"))
    rows = events.where(F.col(kind) == answered).select(key, tie, micros(ts).alias("at")).join(first, key, "left")
    return rows.where("first_request IS NULL OR at <= first_request").select(key, tie)


def fan_in_out(flows: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """How many different hosts each host sends to, and receives from."""
    pairs = flows.groupBy(src, dst).count()
    out = pairs.groupBy(F.col(src).alias("host")).agg(F.count(dst).alias("fan_out"))
    into = pairs.groupBy(F.col(dst).alias("host")).agg(F.count(src).alias("fan_in"))
    return out.join(into, "host", "full_outer").select("host", F.coalesce("fan_out", F.lit(0)).alias("fan_out"), F.coalesce("fan_in", F.lit(0)).alias("fan_in"))


def concentration(flows: DataFrame, least_share: float, src: str = "src", dst: str = "dst", size: str = "bytes") -> DataFrame:
    """Sources that send ``least_share`` of their bytes or more to one host: that host (the least of equals) and its share."""
    pairs = flows.groupBy(src, dst).agg(F.sum(size).alias("size"))
    best = F.min(F.struct((-F.col("size")).alias("less"), F.col(dst).alias("dst")))
    found = pairs.groupBy(src).agg(best.alias("best"), F.sum("size").alias("bytes"))
    share = -F.col("best.less") / F.col("bytes")
    return found.where("bytes > 0").select(src, F.col("best.dst").alias("dst"), "bytes", share.alias("share")).where(F.col("share") >= least_share)


def zone_flows(flows: DataFrame, zones: DataFrame, src: str = "src", dst: str = "dst", size: str = "bytes") -> DataFrame:
    """Packets and bytes between zones; ``zones`` has (host, role, zone) with role src or dst."""
    pairs = flows.groupBy(src, dst).agg(F.count(F.lit(1)).alias("packets"), F.sum(size).alias("bytes"))
    side = lambda role, col, name: zones.where(F.col("role") == role).select(F.col("host").alias(col), F.col("zone").alias(name))
    found = pairs.join(side("src", src, "src_zone"), src).join(side("dst", dst, "dst_zone"), dst)
    found = found.groupBy("src_zone", "dst_zone").agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"))
    return found.withColumn("crosses", F.col("src_zone") != F.col("dst_zone"))


def amplification(flows: DataFrame, key: str, role: str, asked: str, answered: str, least_bytes: int, least_ratio: float, size: str = "bytes") -> DataFrame:
    """Servers whose answers are ``least_ratio`` times what was asked or more, and ``least_bytes`` in all."""
    sums = flows.groupBy(key).agg(*(F.coalesce(F.sum(F.when(F.col(role) == r, F.col(size))), F.lit(0)).alias(n) for r, n in ((asked, "asked"), (answered, "answered"))))
    ratio = F.col("answered") / F.greatest("asked", F.lit(1))
    return sums.withColumn("ratio", ratio).where((F.col("answered") >= least_bytes) & (F.col("ratio") >= least_ratio))


def ranked(rows: DataFrame, group: list[str], by: str, k: int, *ties: str) -> DataFrame:
    """The k largest rows of each group, with their rank; ties in the order of further columns."""
    place = F.row_number().over(W.partitionBy(*group).orderBy(F.desc(by), *ties))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)
