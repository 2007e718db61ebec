"""Ways from host to host that time allows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import shared_path


def host_paths(steps: DataFrame, origins: DataFrame, most_hops: int = 4) -> DataFrame:
    """Of each origin and host the way of fewest hops on which every step comes later than the one before: origin, host, hops, arrived, path.

    ``steps`` (src, dst, at) are what was seen of one host reaching another,
    ``origins`` (host, at) where and from when on to start. Of ways of as many
    hops the one that arrives first counts, then the least path. A way comes by
    no host twice. Each round keeps, of every origin and host, the earliest
    arrival with so many hops, which is all that later hops need; it is written to
    the shared folder. Rows with nulls are left out.
    """
    spark = steps.sparkSession
    whole = steps.where("src IS NOT NULL AND dst IS NOT NULL AND at IS NOT NULL AND src <> dst").select("src", "dst", F.col("at").alias("step_at")).distinct()
    at = lambda df: df.sparkSession.read.schema(df.schema).parquet(_written(df))

    def _written(df: DataFrame) -> str:
        path = shared_path(spark, "paths")
        df.write.parquet(path)
        return path

    begun = origins.where("host IS NOT NULL AND at IS NOT NULL").groupBy("host").agg(F.min("at").alias("arrived"))
    reached = at(begun.select(F.col("host").alias("origin"), "host", F.lit(0).alias("hops"), "arrived", F.array("host").alias("path")))
    front = reached
    for hop in range(1, most_hops + 1):
        # A host may be reached again by more hops but earlier, on which others depend; so all of the last round go on.
        met = front.join(whole, F.col("host") == F.col("src")).where((F.col("step_at") > F.col("arrived")) & ~F.array_contains("path", F.col("dst")))
        own = met.select("origin", F.col("dst").alias("host"), F.lit(hop).alias("hops"), F.col("step_at").alias("arrived"), F.concat("path", F.array("dst")).alias("path"))
        first = own.groupBy("origin", "host", "hops").agg(F.min(F.struct("arrived", "path")).alias("first"))
        front = at(first.select("origin", "host", "hops", "first.*"))
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    best = F.row_number().over(W.partitionBy("origin", "host").orderBy("hops"))
    return reached.where("hops > 0").withColumn("n", best).where("n = 1").drop("n")
