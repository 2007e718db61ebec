"""What is usual, as sketches that are stored by capture and merged, and what has changed since."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size parameters: of the distinct counts, whose relative error is about 1.04 / 2^(n / 2), and of the quantiles, whose rank error is about 2.3 / k^0.9.
DISTINCT_BITS, QUANTILE_K = 12, 200


def baseline(packets: DataFrame, host: str, peer: str, size: str, capture: str = "capture") -> DataFrame:
    """A row for each capture and host: packets, bytes, a sketch of distinct peers and one of sizes. To be stored, and merged with others by ``merged``.

    Rows with a null host are left out; a null peer or size isn't counted.
    """
    own = packets.where(F.col(host).isNotNull())
    return own.groupBy(F.col(capture).alias("capture"), F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("packets"), F.coalesce(F.sum(size), F.lit(0)).cast("double").alias("bytes"),
        F.hll_sketch_agg(F.col(peer).cast("string"), F.lit(DISTINCT_BITS)).alias("peers"), F.kll_sketch_agg_double(F.col(size).cast("double"), F.lit(QUANTILE_K)).alias("sizes"),
    )


def merged(baselines: DataFrame) -> DataFrame:
    """One row for each host of several captures' baselines: packets, bytes, peers and sizes (sketches). Captures that were stored before aren't read again."""
    return baselines.groupBy("host").agg(
        F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"), F.hll_union_agg("peers").alias("peers"), F.kll_merge_agg_double("sizes").alias("sizes")
    )


def figures(whole: DataFrame) -> DataFrame:
    """The numbers of merged baselines: host, packets, bytes, peers, median_size, high_size (the 95th of a hundred)."""
    some = F.kll_sketch_get_n_double("sizes") > 0
    at = lambda share: F.when(some, F.kll_sketch_get_quantile_double("sizes", F.lit(share)))
    return whole.select("host", "packets", "bytes", F.hll_sketch_estimate("peers").alias("peers"), at(0.5).alias("median_size"), at(0.95).alias("high_size"))


def drift(before: DataFrame, now: DataFrame, least: float = 5.0, share: float = 0.5) -> DataFrame:
    """Hosts of two merged baselines that are new, missing or changed: host, state, and each figure before and now.

    Changed is a host whose packets or peers differ by ``least`` and by
    ``share`` of what they were, or whose median size differs by that share.
    """
    names = ("packets", "bytes", "peers", "median_size", "high_size")
    side = lambda df, name: figures(df).select("host", *(F.col(c).alias(f"{c}_{name}") for c in names), F.lit(True).alias(name))
    both = side(before, "before").join(side(now, "now"), "host", "full")
    moved = lambda c, floor: (F.abs(F.col(f"{c}_now") - F.col(f"{c}_before")) >= F.greatest(F.lit(floor), share * F.col(f"{c}_before")))
    changed = F.coalesce(moved("packets", least) | moved("peers", least) | moved("median_size", 1e-9), F.lit(False))
    state = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "missing").when(changed, "changed")
    return both.withColumn("state", state).where("state IS NOT NULL").select("host", "state", *(f"{c}_{s}" for c in names for s in ("before", "now")))
