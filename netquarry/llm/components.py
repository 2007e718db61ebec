"""Connected components of a links table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """The smallest id that each linked id reaches: (id, component_id), from rows (a, b).

    Alternates two steps until nothing changes: every id links its larger
    neighbours, then itself and its smaller ones, to the smallest of all. Rounds
    grow with the logarithm of the ids; each is written to the shared folder.
    Links of an id to itself, repeated links and nulls are dropped; ids without
    another are not returned.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))
        larger = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        smallest = larger.groupBy("u").agg(F.min("v").alias("least"))
        smaller = larger.join(smallest, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("least").alias("v"))
        edges = staged(smaller.where("u <> v").distinct(), "links")
        after = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(
        roots.select(F.col("v").alias("id"), F.col("v").alias("component_id"))
    )
