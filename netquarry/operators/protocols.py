"""What protocol extracts show together: DNS exchanges, clients' names, requests, fingerprints and control-network traffic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import CLIENTS
from ..functions.network import base_domain, ip_scope
from .statistics import entropy

#: Ports of control-network services.
CONTROL_PORTS = {
    102: "s7", 502: "modbus", 789: "crimson", 1089: "ff_hse", 1911: "niagara_fox", 1962: "pcworx", 2222: "enip_io", 2404: "iec104", 2455: "codesys", 4712: "synchrophasor", 4840: "opcua",
    4911: "niagara_foxs", 5006: "melsec", 5007: "melsec", 5094: "hart_ip", 9600: "fins", 18245: "srtp", 20000: "dnp3", 20547: "proconos", 34962: "profinet", 44818: "enip", 47808: "bacnet",
}
#: Modbus functions that write.
MODBUS_WRITES = (5, 6, 15, 16, 22, 23)


def dns_exchanges(messages: DataFrame) -> DataFrame:
    """Queries with their answers: client, server, txid, qname, asked_ts, answered_ts, rcode.

    Of a client, server and number one query is open at a time: a new one takes
    the place of the last, and an answer closes it. Answers while none is open
    have no asked_ts; those of number 0 are left out, as multicast ones have it.
    """
    is_response = F.col("is_response")
    rows = messages.select(
        "capture", F.when(is_response, F.col("dst")).otherwise(F.col("src")).alias("client"), F.when(is_response, F.col("src")).otherwise(F.col("dst")).alias("server"),
        "txid", "qname", "is_response", "ts", "rcode", "pkt_no",
    )
    order = W.partitionBy("capture", "client", "server", "txid").orderBy("ts", "pkt_no")
    row = rows.withColumns({"last": F.lag("is_response").over(order), "next": F.lead(F.struct("is_response", "ts", "rcode")).over(order)})
    answered = F.col("next.is_response")
    asked = row.where("NOT is_response").select(
        "capture", "client", "server", "txid", "qname", F.col("ts").alias("asked_ts"), F.when(answered, F.col("next.ts")).alias("answered_ts"), F.when(answered, F.col("next.rcode")).alias("rcode")
    )
    orphans = row.where("is_response AND coalesce(last, TRUE) AND txid <> 0")
    return asked.unionByName(orphans.select("capture", "client", "server", "txid", "qname", F.lit(None).cast(messages.schema["ts"].dataType).alias("asked_ts"), F.col("ts").alias("answered_ts"), "rcode"))


def dns_clients(messages: DataFrame, least: int = 20, least_unique: float = 0.75, long_label: int = 35, high_entropy: float = 3.6) -> DataFrame:
    """Clients' names, and whether they look like a tunnel: many, mostly different, with long or random labels."""
    label = F.substring_index("qname", ".", 1)
    asked = messages.where("NOT is_response AND qname IS NOT NULL").select(F.col("src").alias("client"), "qname", label.alias("label"))
    names = asked.groupBy("client", "qname", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("label_entropy", entropy(F.col("label")))
    found = names.groupBy("client").agg(
        F.sum("n").alias("queries"), F.count(F.lit(1)).alias("names"), F.count_distinct(base_domain(F.col("qname"))).alias("domains"),
        F.avg("label_entropy").alias("label_entropy"), F.max(F.char_length("label")).alias("longest_label"),
    )
    tunnel = (F.col("queries") >= least) & (F.col("names") >= least_unique * F.col("queries")) & ((F.col("longest_label") >= long_label) | (F.col("label_entropy") >= high_entropy))
    return found.withColumn("tunnel", tunnel)


def control_traffic(packets: DataFrame) -> DataFrame:
    """Packets and bytes of control-network services by client and server, and whether an end is public.

    A service's port counts on the server's side alone: as the destination, or
    as the source if the destination's port is an ephemeral one.
    """
    service = F.create_map(*(F.lit(x) for pair in CONTROL_PORTS.items() for x in pair))
    to, back = F.try_element_at(service, F.col("dport")), F.when(F.col("dport") >= CLIENTS, F.try_element_at(service, F.col("sport")))
    rows = packets.where(F.col("sport").isNotNull()).select(
        "capture", F.coalesce(to, back).alias("service"), F.when(to.isNotNull(), F.col("src")).otherwise(F.col("dst")).alias("client"),
        F.when(to.isNotNull(), F.col("dst")).otherwise(F.col("src")).alias("server"), "caplen",
    )
    found = rows.where("service IS NOT NULL").groupBy("capture", "service", "client", "server").agg(F.count(F.lit(1)).alias("packets"), F.sum("caplen").alias("bytes"))
    public = (ip_scope(F.col("client")) == "public") | (ip_scope(F.col("server")) == "public")
    return found.withColumn("public", public)


def modbus_writers(messages: DataFrame, least: int = 20, share: float = 0.3) -> DataFrame:
    """Sources of requests with their writes, exceptions they were given, and whether writes are a burst: many, and a large share."""
    asked = messages.where("dport = 502").groupBy(F.col("src").alias("client")).agg(F.count(F.lit(1)).alias("requests"), F.count(F.when(F.col("function").isin(*MODBUS_WRITES), 1)).alias("writes"))
    refused = messages.where("sport = 502 AND is_exception").groupBy(F.col("dst").alias("client")).agg(F.count(F.lit(1)).alias("exceptions"))
    found = asked.join(refused, "client", "left").withColumn("exceptions", F.coalesce("exceptions", F.lit(0)))
    return found.withColumn("burst", (F.col("writes") >= least) & (F.col("writes") >= share * F.col("requests")))


def fingerprints(hellos: DataFrame) -> DataFrame:
    """TLS fingerprints with how many clients and server names have each."""
    pairs = hellos.groupBy("ja3_md5", "src", "server_name").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("ja3_md5").agg(F.sum("n").alias("hellos"), F.count_distinct("src").alias("clients"), F.count_distinct("server_name").alias("server_names"))
