"""Files out of streams: where signatures stand, how far the files reach, and their contents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Kinds of files by the bytes that begin them.
SIGNATURES = (
    ("PDF", b"%PDF-"), ("ZIP", b"PK\x03\x04"), ("ELF", b"\x7fELF"), ("PNG", b"\x89PNG\r\n\x1a\n"), ("JPG", b"\xff\xd8\xff"), ("GIF", b"GIF8"), ("GZIP", b"\x1f\x8b\x08"), ("RAR", b"Rar!\x1a\x07"),
)
#: Bytes that end files of a kind, and how many more follow them.
ENDS = (("PDF", b"%%EOF", 0), ("ZIP", b"PK\x05\x06", 18), ("PNG", b"IEND\xaeB`\x82", 0), ("JPG", b"\xff\xd9", 0), ("GIF", b"\x00;", 0))
WAY = ["capture", "stream_id", "src", "sport"]
#: Kinds whose files may stand in others of their kind, as a picture's small version in it; of the others a file ends at the first end.
NESTING = ("JPG", "PDF", "ZIP")


def marks(blocks: DataFrame, signatures: tuple = SIGNATURES, ends: tuple = ENDS) -> DataFrame:
    """All places where a file of some kind begins or ends: the direction's columns, offset, kind, is_end, size (of the mark with what follows it).

    ``blocks`` are those of ``reassembled_blocks``, of at least as many bytes as
    the longest mark has less one. Each block is searched with the end of the
    one before it, so that marks across their edge are found, once.
    """
    longest = max(len(m) for _, m, *_ in (*signatures, *ends)) - 1
    size = F.octet_length("data")
    tail = blocks.select(*(F.col(c).alias(f"tail_{c}") for c in WAY), (F.col("block") + 1).alias("tail_block"), F.expr(f"substring(data, greatest(octet_length(data) - {longest - 1}, 1))").alias("tail"))
    same = F.col("block") == F.col("tail_block")
    for c in WAY:
        same &= F.col(c).eqNullSafe(F.col(f"tail_{c}"))
    whole = W.partitionBy(*WAY).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select(*WAY, "block", size.alias("size")).withColumn("start", F.coalesce(F.sum("size").over(whole), F.lit(0))).drop("size")
    rows = blocks.select(*WAY, "block", "data").join(starts, [*WAY, "block"]).join(tail, same, "left").select(*WAY, "start", "tail", "data")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in WAY)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                start, before, data = (batch.column(len(WAY) + k)[at].as_py() for k in range(3))
                before = before or b""
                searched, found = before + data, []
                for end, group in ((False, [(k, m, 0) for k, m in signatures]), (True, ends)):
                    for kind, mark, more in group:
                        place = searched.find(mark)
                        while place >= 0:
                            if place + len(mark) > len(before):
                                found.append((start - len(before) + place, kind, end, len(mark) + more))
                            place = searched.find(mark, place + 1)
                if found:
                    own = batch.select(WAY).take(pa.array([at] * len(found), pa.int32()))
                    columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.int64(), pa.string(), pa.bool_(), pa.int32()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*own.columns, *columns], [*WAY, "offset", "kind", "is_end", "size"])

    return rows.mapInArrow(search, f"{kinds}, offset bigint, kind string, is_end boolean, size int")


def extents(found: DataFrame, kinds: tuple[str, ...] = tuple(k for k, *_ in ENDS), nesting: tuple[str, ...] = NESTING) -> DataFrame:
    """Files with a beginning and an end: the direction's columns, kind, offset, end, inside (whether within another file).

    A beginning belongs to the end that closes it, like brackets, where a kind
    may nest; else to the first end behind it. Of a kind that doesn't nest the last
    beginning before an end counts. Ends without a beginning are left out, as
    are beginnings without an end.
    """
    rows = found.where(F.col("kind").isin(*kinds))
    order = W.partitionBy(*WAY, "kind").orderBy("offset", "is_end")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    step = F.when(F.col("is_end"), -1).otherwise(1)
    rows = rows.withColumn("sum", F.sum(step).over(so_far)).withColumn("lowest", F.least(F.min("sum").over(so_far), F.lit(0)))
    depth = F.col("sum") - F.col("lowest")  # of what is open after the mark; ends with nothing open don't count
    closes = F.col("is_end") & (F.col("lowest") == F.coalesce(F.lag("lowest").over(order), F.lit(0)))
    rows = rows.withColumns({"level": F.when(F.col("is_end"), depth + 1).otherwise(depth), "counts": ~F.col("is_end") | closes})
    rows = rows.where("counts").withColumn("level", F.when(F.col("kind").isin(*nesting), F.col("level")).otherwise(0))
    paired = W.partitionBy(*WAY, "kind", "level").orderBy("offset", "is_end")
    ended = F.lead(F.struct("is_end", "offset", "size")).over(paired)
    pairs = rows.withColumn("next", ended).where("NOT is_end AND next.is_end").select(*WAY, "kind", "offset", (F.col("next.offset") + F.col("next.size")).alias("end"))
    before = W.partitionBy(*WAY).orderBy("offset", F.col("end").desc()).rowsBetween(W.unboundedPreceding, -1)
    return pairs.withColumn("inside", F.coalesce(F.max("end").over(before) >= F.col("end"), F.lit(False)))


def carved(blocks: DataFrame, files: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """The contents of extents of ``most_bytes`` at most (longer ones are left out): the extent's columns, data, sha256. ``end`` may lie behind the stream's end."""
    whole = W.partitionBy(*WAY).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    placed = blocks.select(*WAY, "block", "data").withColumn("start", F.coalesce(F.sum(F.octet_length("data")).over(whole), F.lit(0)))
    piece = F.max(F.octet_length("data")).alias("block_bytes")
    size = blocks.agg(piece).withColumn("block_bytes", F.coalesce("block_bytes", F.lit(1)))  # all but a direction's last block have this size
    wanted = files.where(F.col("end") - F.col("offset") <= most_bytes).join(F.broadcast(size))  # size is one row
    wanted = wanted.withColumn("block", F.explode(F.sequence(F.floor(F.col("offset") / F.col("block_bytes")), F.floor((F.col("end") - 1) / F.col("block_bytes"))))).drop("block_bytes")
    rows = wanted.join(placed, [*WAY, "block"])
    first = F.greatest(F.col("offset") - F.col("start"), F.lit(0))
    count = F.least(F.col("end") - F.col("start"), F.octet_length("data").cast("long")) - first
    part = F.hex(F.substring("data", (first + 1).cast("int"), F.greatest(count, F.lit(0)).cast("int")))
    keys = [*WAY, "kind", "offset", "end", "inside"]
    joined = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("block", part.alias("part")))).alias("parts"))  # of one file
    data = F.unhex(F.array_join(F.transform("parts", lambda p: p["part"]), ""))
    return joined.select(*keys, data.alias("data")).withColumn("sha256", F.sha2("data", 256))
