"""The streaming operators over the events table, read as a stream, against the same table at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from netquarry.streaming.windows import bursts, rates, sessions

SF = "/root/testdata/sf0.001"


def drained(stream, tmp_path, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return {tuple(r) for r in stream.sparkSession.table(name).collect()}


def test_streams_give_what_the_table_gives(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    end = table.agg(F.max("ts")).first()[0]
    table.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    failed = F.col("event_type") == "error"
    for name, make in {
        "rates": lambda e: rates(e, ["user_id"], "1 day"),
        "bursts": lambda e: bursts(e, ["user_id"], 5, "2 days", "1 day"),
        "sessions": lambda e: sessions(e, ["user_id"], "12 hours", failed),
    }.items():
        expected = {tuple(r) for r in make(table).collect()}
        got = drained(make(stream), tmp_path, name)
        assert got <= expected and len(got) > 10 and all(r[2] > end.replace(hour=0, minute=0, second=0, microsecond=0) for r in expected - got)
