"""TCP streams, retransmissions and reassembly over packet rows (``sources.captures``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bits of the TCP flags.
SYN, RST, ACK = 2, 4, 16
STREAM = ["capture", "a", "a_port", "b", "b_port"]


def _has(flag: int) -> Column:
    return F.col("tcp_flags").bitwiseAND(flag) != 0


def directed(packets: DataFrame) -> DataFrame:
    """TCP packets with both directions under one key: the smaller end is a; ``ab`` tells the way."""
    one, two = F.struct(F.col("src").alias("ip"), F.col("sport").alias("port")), F.struct(F.col("dst").alias("ip"), F.col("dport").alias("port"))
    rows = packets.where("transport = 'TCP'").withColumn("ab", one <= two)
    low, high = F.least(one, two), F.greatest(one, two)
    return rows.withColumns({"a": low["ip"], "a_port": low["port"], "b": high["ip"], "b_port": high["port"]})


def stream_id() -> Column:
    return F.substring(F.sha1(F.concat("a", F.lit(":"), "a_port", F.lit("<->"), "b", F.lit(":"), "b_port")), 1, 12)


def streams(packets: DataFrame) -> DataFrame:
    """One row a TCP stream: ends, client and server, state, packets, bytes and times. One partial aggregation and one shuffle.

    The client sent the SYN; without one it is the end of the larger port. A
    connection is established if its client acknowledged after the SYN-ACK.
    """
    size, ab = F.coalesce(F.octet_length("payload"), F.lit(0)), F.col("ab")
    ack = _has(ACK) & ~_has(SYN)
    found = (
        directed(packets)
        .groupBy(*STREAM)
        .agg(
            F.count(F.lit(1)).alias("packets"),
            F.sum("caplen").alias("bytes"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            F.min_by("ab", F.when(_has(SYN) & ~_has(ACK), F.col("pkt_no"))).alias("syn_ab"),
            F.min(F.when(_has(SYN) & _has(ACK), F.col("pkt_no"))).alias("synack"),
            F.max(F.when(ack & ab, F.col("pkt_no"))).alias("ack_ab"),
            F.max(F.when(ack & ~ab, F.col("pkt_no"))).alias("ack_ba"),
            F.bool_or(_has(RST)).alias("reset"),
            F.sum(F.when(ab, size).otherwise(0)).alias("payload_ab"),
            F.sum(F.when(ab, 0).otherwise(size)).alias("payload_ba"),
        )
    )
    client_is_a = F.coalesce("syn_ab", F.col("a_port") >= F.col("b_port"))
    last_ack = F.when(F.col("syn_ab"), F.col("ack_ab")).when(~F.col("syn_ab"), F.col("ack_ba"))
    syn = F.col("syn_ab").isNotNull()
    state = (
        F.when(last_ack > F.col("synack"), "established")
        .when(F.col("synack").isNotNull(), "half-open")
        .when(syn & F.col("reset"), "refused")
        .when(syn, "syn-only")
        .when((F.col("payload_ab") > 0) & (F.col("payload_ba") > 0), "active")
        .when(F.col("reset"), "reset")
        .otherwise("no-handshake")
    )
    end = lambda name, x, y: F.when(client_is_a, F.col(x)).otherwise(F.col(y)).alias(name)
    return found.select(
        "capture", stream_id().alias("stream_id"), end("client", "a", "b"), end("client_port", "a_port", "b_port"), end("server", "b", "a"), end("server_port", "b_port", "a_port"),
        state.alias("state"), "packets", "bytes", "first_ts", "last_ts", end("client_bytes", "payload_ab", "payload_ba"), end("server_bytes", "payload_ba", "payload_ab"),
    )


def retransmissions(packets: DataFrame) -> DataFrame:
    """Segments with payload that a directed flow sent more than once, and how often."""
    key = ["capture", "src", "sport", "dst", "dport", "tcp_seq", F.octet_length("payload").alias("size")]
    sent = packets.where("transport = 'TCP' AND octet_length(payload) > 0").groupBy(*key).agg(F.count(F.lit(1)).alias("sent"))
    return sent.where("sent > 1")


def placed(packets: DataFrame) -> DataFrame:
    """Segments with payload, with their place in what their direction sent: offset, overlap with bytes sent before, gap before it.

    Sequence numbers are unwrapped by their signed distance from the segment
    captured before, so that streams of any length stay in order. Rows of a
    direction are sorted in one task, which spills.
    """
    way = [*STREAM, "ab"]
    size = F.octet_length("payload")
    rows = directed(packets).where("octet_length(payload) > 0")
    captured = W.partitionBy(*way).orderBy("pkt_no")
    apart = F.pmod(F.col("tcp_seq") - F.lag("tcp_seq").over(captured) + (1 << 31), F.lit(1 << 32)) - (1 << 31)
    rows = rows.withColumn("apart", F.coalesce(apart, F.lit(0))).withColumn("at", F.sum("apart").over(captured.rowsBetween(W.unboundedPreceding, 0)))
    before = W.partitionBy(*way).orderBy("at", "pkt_no").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("end", F.max(F.col("at") + size).over(before))
    rows = rows.withColumn("overlap", F.greatest(F.coalesce(F.col("end") - F.col("at"), F.lit(0)), F.lit(0)))
    rows = rows.where(F.col("overlap") < size).withColumn("gap", F.greatest(F.coalesce(F.col("at") - F.col("end"), F.lit(0)), F.lit(0)))
    return rows.withColumn("offset", F.coalesce(F.sum(size - F.col("overlap")).over(before), F.lit(0)))


def reassembled_blocks(packets: DataFrame, block_bytes: int = 1 << 20) -> DataFrame:
    """The bytes that each direction of a stream sent, whole, in rows of ``block_bytes``: block, data, gap_bytes, gaps, marks.

    ``marks`` tells at which offset each packet's part of the block begins, its time and number. Bytes sent again are dropped. What is missing is closed up: its bytes are
    counted in ``gap_bytes`` of the block that follows it, and ``gaps`` tells the
    offsets where it was and how much. A segment across a boundary is cut there.
    """
    way = [*STREAM, "ab"]
    rows = placed(packets).withColumn("part", F.expr("substring(payload, CAST(overlap + 1 AS INT))"))
    last = F.col("offset") + F.octet_length("part") - 1
    rows = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("offset") / block_bytes), F.floor(last / block_bytes))))
    skip = F.greatest(F.col("block") * block_bytes - F.col("offset"), F.lit(0))
    piece = F.struct((F.col("offset") + skip).alias("place"), F.hex(F.substring("part", (skip + 1).cast("int"), (F.lit(block_bytes) - F.pmod(F.col("offset") + skip, F.lit(block_bytes))).cast("int"))).alias("part"))
    whole = F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda p: p["part"]), ""))
    first = skip == 0
    gap = F.when(first & (F.col("gap") > 0), F.struct("offset", "gap"))
    mark = F.struct((F.col("offset") + skip).alias("offset"), "ts", "pkt_no")
    found = rows.groupBy(*way, "block").agg(
        whole.alias("data"), F.sum(F.when(first, F.col("gap")).otherwise(0)).alias("gap_bytes"), F.sort_array(F.collect_list(gap)).alias("gaps"), F.sort_array(F.collect_list(mark)).alias("marks")
    )
    end = lambda x, y: F.when(F.col("ab"), F.col(x)).otherwise(F.col(y))
    return found.select("capture", stream_id().alias("stream_id"), end("a", "b").alias("src"), end("a_port", "b_port").alias("sport"), end("b", "a").alias("dst"), end("b_port", "a_port").alias("dport"), "block", "data", "gap_bytes", "gaps", "marks")


def reassembled(packets: DataFrame, most_bytes: int = 1 << 20) -> DataFrame:
    """The first ``most_bytes`` of each direction of a stream, and what is missing there; see ``reassembled_blocks`` for all of it."""
    return reassembled_blocks(packets, most_bytes).where("block = 0").select("capture", "stream_id", "src", "sport", "data", "gap_bytes")
