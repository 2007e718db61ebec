"""Sessions and hosts: transfers, request-response pairs, cadence of peers, addresses that move, and verdicts on hosts.

A key's rows are either aggregated where they are read or ordered by one window,
which Spark spills; where only a first few rows count, the window keeps a rank
limit, so that a busy key leaves no more than these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .timing import micros


def selected(flows: DataFrame, first=None, last=None, host=None, port=None, src: str = "src", dst: str = "dst", dport: str = "dport", ts: str = "ts") -> DataFrame:
    """Rows within a time, both ends included, of a host on either side, and to a port; what is None doesn't restrict. All are predicates of the scan."""
    tests = [
        first is not None and (F.col(ts) >= F.lit(first)), last is not None and (F.col(ts) <= F.lit(last)),
        host is not None and ((F.col(src) == host) | (F.col(dst) == host)), port is not None and (F.col(dport) == port),
    ]
    for test in tests:
        flows = flows if test is False else flows.where(test)
    return flows


def of_categories(rows: DataFrame, category: str, names: list[str], invert: bool = False) -> DataFrame:
    """Rows of the categories named, or of all others; case, spaces, - and _ in names don't count, and null is in no category."""
    plain = lambda s: s.lower().replace(" ", "").replace("-", "").replace("_", "")
    own = F.regexp_replace(F.lower(F.coalesce(F.col(category), F.lit(""))), "[ _-]", "")
    within = own.isin(*map(plain, names))
    return rows.where(~within if invert else within)


def transfers(flows: DataFrame, key: list[str], upward: Column, size: str = "bytes") -> DataFrame:
    """Bytes of each session in both directions: sent, received."""
    part = lambda test, name: F.coalesce(F.sum(F.when(test, F.col(size))), F.lit(0)).alias(name)
    return flows.groupBy(*key).agg(part(upward, "sent"), part(~upward, "received"))


def uploads(sessions: DataFrame, least: int = 50 * 2**20, times: float = 3.0) -> DataFrame:
    """Sessions that send so much, and more than ``times`` what they receive."""
    return sessions.where((F.col("sent") >= least) & (F.col("sent") > times * F.col("received")))


def response_heavy(sessions: DataFrame, least: int = 50_000, times: float = 5.0) -> DataFrame:
    """Sessions that receive more than so much, and more than ``times`` what they send."""
    return sessions.where((F.col("received") > least) & (F.col("received") > times * F.col("sent")))


def control_ratios(events: DataFrame, key: str, control: Column, least: int = 20, share: float = 0.3) -> DataFrame:
    """Sources with so many control messages that are such a share of theirs."""
    n = F.count(F.when(control, 1))
    rows = events.groupBy(key).agg(n.alias("controls"), F.count(F.lit(1)).alias("messages"), (n / F.count(F.lit(1))).alias("ratio"))
    return rows.where((F.col("controls") >= least) & (F.col("ratio") >= share))


def transactions(events: DataFrame, key: list[str], kind: str, asked: str, answered: str, seconds: float = 900, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Pairs of an answer and the latest open request of its key, if that isn't older than ``seconds``.

    A later request replaces an open one and an answer closes it, so an answer
    has a request just if one is its key's row before.
    """
    order = W.partitionBy(*key).orderBy(ts, tie)
    before = lambda c: F.lag(c).over(order)
    rows = events.where(F.col(kind).isin(asked, answered))
    rows = rows.select(*key, F.col(kind).alias("kind"), F.col(tie).alias("answer"), before(kind).alias("kind_before"), before(tie).alias("request"), (micros(ts) - before(micros(ts))).alias("waited"))
    return rows.where((F.col("kind") == answered) & (F.col("kind_before") == asked) & (F.col("waited") <= int(seconds * 1_000_000))).select(*key, "request", "answer", "waited")


def answered_challenges(events: DataFrame, key: list[str], kind: str, challenge: str, answer: str, length: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Each answer with its key's latest challenge before it, and its version: v2 if longer than 24 bytes, else v1. Answers without a challenge are left out."""
    order = W.partitionBy(*key).orderBy(ts, tie)
    latest = F.last(F.when(F.col(kind) == challenge, F.col(tie)), ignorenulls=True).over(order)
    rows = events.where(F.col(kind).isin(challenge, answer)).select(*key, F.col(kind).alias("kind"), tie, latest.alias("challenge"), F.when(F.col(length) > 24, "v2").otherwise("v1").alias("version"))
    return rows.where((F.col("kind") == answer) & F.col("challenge").isNotNull()).drop("kind")


def first_gap_beacons(events: DataFrame, key: list[str], size: str, gaps: int = 25, least: int = 6, variation: float = 0.2, most_size: float = 1024, external: Column | None = None, bounds: tuple[float, float] = (1.0, float("inf")), ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Keys whose first gaps are regular and whose events are small: gaps, mean_gap, variation, mean_size.

    ``external`` restricts the keys to those of targets outside, ``bounds`` the mean gap in seconds.
    """
    rows = events if external is None else events.where(external)
    order = W.partitionBy(*key).orderBy(ts, tie)
    rows = rows.select(*key, size, F.row_number().over(order).alias("n"), ((micros(ts) - F.lag(micros(ts)).over(order)) / F.lit(1e6)).alias("gap")).where(F.col("n") <= gaps + 1)
    found = rows.groupBy(*key).agg(F.count("gap").alias("gaps"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("deviation"), F.avg(size).alias("mean_size"))
    found = found.withColumn("variation", F.when(F.col("mean_gap") > 0, F.col("deviation") / F.col("mean_gap"))).drop("deviation")
    return found.where((F.col("gaps") >= least) & (F.col("variation") < variation) & (F.col("mean_size") <= most_size) & F.col("mean_gap").between(*bounds))


def synchronized(peers: DataFrame, src: str, mean: str, within: float = 0.2) -> DataFrame:
    """Sources with two peers or more whose mean interval is near the source's median: close, center. ``peers`` has a row for each pair."""
    rows = peers.where(F.col(mean) > 0)
    centers = rows.groupBy(src).agg(F.median(mean).alias("center"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    near = F.abs(F.col(mean) - F.col("center")) / F.greatest("center", F.lit(1.0)) <= within
    return rows.join(centers, src).groupBy(src, "center").agg(F.count(F.when(near, 1)).alias("close")).where("close >= 2")


def owners(rows: DataFrame, key: str, value: str) -> DataFrame:
    """How many values each key was seen with, and the commonest (the least of equals): addresses of hosts, and hosts of addresses."""
    pairs = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(value, F.struct(-F.col("n"), F.col(value)))
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias("values"), best.alias("commonest"), F.sum("n").alias("seen"))


def flips(events: DataFrame, key: str, value: str, least: int = 3, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """How often each key's value is another than before, ``least`` times at least, and the microseconds from the first to the last time."""
    before = F.lag(value).over(W.partitionBy(key).orderBy(ts, tie))
    rows = events.where(F.col(value).isNotNull()).select(key, micros(ts).alias("at"), (before != F.col(value)).alias("flipped")).where("flipped")
    found = rows.groupBy(key).agg(F.count(F.lit(1)).alias("flips"), (F.max("at") - F.min("at")).alias("spread"))
    return found.where(F.col("flips") >= least)


def newcomers(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Keys of now that weren't there before, once each."""
    return now.select(key).join(before.select(key), key, "left_anti").distinct()


def commonest(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's commonest value, the least of equals."""
    return owners(rows, key, value).select(key, F.col("commonest").alias(value))


def criticality(flows: DataFrame, host: str, port: str, directory: list[int] = [88, 389, 445, 464, 636, 3268, 3269], admin: list[int] = [22, 3389, 5985, 5986]) -> DataFrame:  # noqa: B006
    """Points for hosts by their open ports: three for a directory's, one for an administrator's."""
    has = lambda ports: F.coalesce(F.bool_or(F.col(port).isin(*ports)), F.lit(False)).cast("int")
    return flows.groupBy(host).agg((3 * has(directory) + has(admin)).alias("boost"))


def intrusion_verdict(objectives: Column, tactics: Column, confident: Column, corroborated: Column, control: Column, implausible: Column) -> tuple[Column, Column]:
    """Points and verdict for mapped techniques.

    Two or more objective tactics count three points, one two; four tactics or
    more two, two or three one; three confident techniques or more two, fewer one;
    two corroborated ones or more two, one one; an effect on control one more, an
    implausible order one less.
    """
    step = lambda c, many, points, few, fewer: F.when(c >= many, points).when(c >= few, fewer).otherwise(0)
    score = step(objectives, 2, 3, 1, 2) + step(tactics, 4, 2, 2, 1) + step(confident, 3, 2, 1, 1) + step(corroborated, 2, 2, 1, 1) + (control > 0).cast("int") - (implausible > 0).cast("int")
    verdict = F.when(tactics == 0, "NO MAPPED TTPs").when(score >= 6, "LIKELY INTRUSION").when(score >= 3, "POSSIBLE INTRUSION").otherwise("LOW-CONFIDENCE SIGNAL")
    return score, verdict


def exfiltration_verdict(points: Column) -> Column:
    """yes, likely, potential or none by the points of the signals."""
    return F.when(points >= 7, "yes").when(points >= 5, "likely").when(points >= 3, "potential").otherwise("none")


def evidence(rows: DataFrame, key: list[str], item: str, most: int = 12) -> DataFrame:
    """The first different items of each key, in order; what a report shows. A key's list is never longer than ``most``."""
    pairs = rows.where(F.col(item).isNotNull()).groupBy(*key, item).agg(F.count(F.lit(1)).alias("n"))
    total = F.count(F.lit(1)).over(W.partitionBy(*key))
    placed = pairs.withColumn("place", F.row_number().over(W.partitionBy(*key).orderBy(item))).withColumn("different", total).where(F.col("place") <= most)
    return placed.groupBy(*key, "different").agg(F.array_join(F.array_sort(F.collect_list(item)), "; ").alias("sample"))


def exported(rows: DataFrame, module: str) -> DataFrame:
    """Findings as rows of a table (module, data), the data one JSON object each; null fields are left out."""
    return rows.select(F.lit(module).alias("module"), F.to_json(F.struct("*")).alias("data"))
