"""Indicators of compromise: addresses, networks, ranges, domains and digests, met in traffic by equal keys."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.addresses import address_key, leading_bits, prefix_of, prefixes_between

#: A run of labels as it may stand in a payload.
LABELS = r"[a-z0-9-]+(?:\.[a-z0-9-]+)*"
_PARTS = "struct<value:string,indicator:string,ioc:string,type:string,kind:string,source:string,confidence:double,tags:array<string>>"


def kind_of(value: Column) -> Column:
    """ip, network, range, domain or hash, by the value's form; null for none of them."""
    own = F.lower(F.trim(value))
    return (
        F.when(own.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"), "hash")
        .when(address_key(own).isNotNull(), "ip")
        .when(own.rlike(r"^[0-9a-f.:]+/\d{1,3}$") & address_key(F.split(own, "/")[0]).isNotNull(), "network")
        .when(own.rlike(r"^[0-9a-f.:]+\s*-\s*[0-9a-f.:]+$") & address_key(F.split(own, "-")[0]).isNotNull(), "range")
        .when(own.rlike(rf"^{LABELS}$") & own.rlike("[a-z]"), "domain")
    )


def read_indicators(spark: SparkSession, path: str) -> DataFrame:
    """A list of indicators: value, kind, source, confidence (0 to 100), tags.

    ``.json`` files hold an array of objects or strings, or an object with such
    ``indicators``; others a value a line, where # begins a remark. What has no known form is left out.
    """
    if path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("text"))
        listed = F.when(F.col("text").startswith("{"), F.get_json_object("text", "$.indicators")).otherwise(F.col("text"))
        items = whole.select(F.explode(F.from_json(listed, "array<string>")).alias("item"))
        read = items.select(F.from_json("item", _PARTS).alias("i"), "item")
        rows = read.select(
            F.coalesce("i.value", "i.indicator", "i.ioc", F.when(~F.col("item").startswith("{"), F.col("item"))).alias("value"), "i.source",
            F.when(F.col("i.confidence") <= 1, F.col("i.confidence") * 100).otherwise(F.col("i.confidence")).alias("confidence"), "i.tags",
        )
    else:
        lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"(^|\s)#.*$", "")).alias("value"))
        rows = lines.select("value", F.lit(None).cast("string").alias("source"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("array<string>").alias("tags"))
    return rows.withColumn("value", F.lower(F.trim("value"))).withColumn("kind", kind_of(F.col("value"))).where("kind IS NOT NULL").select("value", "kind", "source", "confidence", "tags")


def indicator_keys(indicators: DataFrame) -> DataFrame:
    """What indicators (value, kind) are met by: value, kind, type (net, domain or hash), size (bits or labels), key. A range becomes the networks that make it up."""
    own = indicators.select(F.lower(F.trim("value")).alias("value"), "kind").where("value IS NOT NULL").distinct()
    schema = "value string, kind string, type string, size int, key string"

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for value, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    if kind == "range":
                        made += [(value, kind, "net", bits, key) for key, bits in prefixes_between(*(p.strip() for p in value.split("-", 1)))]
                    elif kind in ("ip", "network"):
                        key, bits = prefix_of(value)
                        made.append((value, kind, "net", bits, key))
                    elif kind == "domain":
                        made.append((value, kind, "domain", value.count(".") + 1, value))
                    elif kind == "hash":
                        made.append((value, kind, "hash", 0, value))
                except (ValueError, TypeError, ipaddress.AddressValueError):
                    pass  # no address, or a range whose end comes first: it matches nothing
            columns = zip(*made, strict=True) if made else [[]] * 5
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in schema.split(", ")])

    return own.mapInArrow(keys, schema)


def label_windows(text: Column, sizes: list[int]) -> Column:
    """All runs of so many labels in lower-cased text: a domain stands in it, not as part of a longer label, if and only if it is one of them."""
    chains = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({LABELS})"), F.lit(1))), lambda c: F.split(c, r"\."))
    def runs_of(n: int) -> Column:
        windows = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda at: F.array_join(F.slice(c, at, F.lit(n)), "."))
        return F.flatten(F.transform(F.filter(chains, lambda c: F.size(c) >= n), windows))

    runs = [runs_of(n) for n in sizes]
    return F.array_distinct(F.concat(*runs)) if runs else F.array().cast("array<string>")


def name_suffixes(name: Column, sizes: list[int]) -> Column:
    """The last labels of a name, of so many, as far as it has them."""
    labels = F.split(F.lower(F.rtrim(name, F.lit("."))), r"\.")
    return F.array_compact(F.array(*(F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), ".")) for n in sizes)))


def indicator_hits(observed: DataFrame, indicators: DataFrame, addresses: tuple[str, ...] = ("src", "dst"), texts: tuple[str, ...] = (), names: tuple[str, ...] = (), digests: tuple[str, ...] = (), ts: str = "ts") -> DataFrame:
    """How often each indicator is met: value, kind, place (the column), hits, first_ts, last_ts.

    ``observed`` rows have columns of addresses, of texts (payloads in latin-1 or strings, in
    which a domain counts between characters that no label has), of decoded names
    (the domain itself or a name below it) and of digests. A row counts once for an indicator and column.

    What is observed is counted first, by address, label run, name or digest, so
    that rows move once at most; an address then meets networks by its leading
    bits, of only so many as some indicator has. The list may be of any length:
    each of its keys is joined by equality. Nulls are met by nothing.
    """
    keys = indicator_keys(indicators).persist()
    sizes: dict[str, list[int]] = {}
    for row in keys.select("type", "size").distinct().collect():  # as many as there are lengths of networks and of domains
        sizes.setdefault(row["type"], []).append(row["size"])
    counted = []

    def count(column: str, of: Column, explode: bool) -> None:
        own = F.explode(of) if explode else of
        rows = observed.select(own.alias("own"), F.col(ts).alias("ts")).where("own IS NOT NULL")
        counted.append((column, rows.groupBy("own").agg(F.count(F.lit(1)).alias("hits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))))

    met = []
    figures = ["hits", "first_ts", "last_ts"]

    def meet(kind: str, keyed: Column, by_size: bool = False) -> None:
        for column, rows in counted:
            if by_size:
                rows = rows.select(address_key(F.col("own")).alias("own"), *figures).where("own IS NOT NULL")
            own = rows.select(F.lit(column).alias("place"), F.explode(keyed).alias("at"), *figures)
            own = own.select("place", *([F.col("at.size").alias("size"), F.col("at.key").alias("key")] if by_size else [F.col("at").alias("key")]), *figures)
            met.append(own.join(keys.where(F.col("type") == kind).drop("type", *([] if by_size else ["size"])), ["size", "key"] if by_size else ["key"]).select("value", "kind", "place", *figures))
        counted.clear()

    if "net" in sizes:
        for column in addresses:
            count(column, F.col(column), False)
        meet("net", F.array(*(F.struct(F.lit(n).alias("size"), leading_bits(F.col("own"), n).alias("key")) for n in sorted(sizes["net"]))), by_size=True)
    if "domain" in sizes:
        for column in texts:
            text = F.decode(column, "ISO-8859-1") if observed.schema[column].dataType.typeName() == "binary" else F.col(column)
            count(column, label_windows(F.lower(text), sizes["domain"]), True)
        meet("domain", F.array("own"))
        for column in names:
            count(column, F.lower(F.col(column)), False)
        meet("domain", name_suffixes(F.col("own"), sizes["domain"]))
    if "hash" in sizes:
        for column in digests:
            count(column, F.lower(F.col(column)), False)
        meet("hash", F.array("own"))
    if not met:
        none = observed.select(F.lit("").alias("value"), F.lit("").alias("kind"), F.lit("").alias("place"), F.lit(0).cast("long").alias("hits"), F.col(ts).alias("first_ts"), F.col(ts).alias("last_ts"))
        return none.where(F.lit(False))
    found = reduce(DataFrame.unionByName, met)
    return found.groupBy("value", "kind", "place").agg(F.sum("hits").alias("hits"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
