"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters of the contracts: space and 0x09 to 0x0D.
SPACES = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may lack the setting; it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/netquarry/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What Spark allows an Arrow batch by default, which is a whole partition of texts in the JVM and in its Python worker.
ARROW_BYTES, ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Lets the session hand texts to Python in batches of about ``size``, unless the user has set another one."""
    if spark.conf.get(ARROW_BYTES, ARROW_DEFAULT) == ARROW_DEFAULT:
        spark.conf.set(ARROW_BYTES, size)


#: How to empty the caches that operators keep in a Python worker, by operator.
CACHES: dict[str, Callable[[], None]] = {}


def claim_worker(name: str) -> None:
    """Empties what other operators left in this worker, which Spark keeps from stage to stage, and gives its memory back."""
    for other, clear in CACHES.items():
        if other != name:
            clear()
    if name != _CLAIMED.get("by"):
        _CLAIMED["by"] = name
        gc.collect()
        give_back()


def give_back() -> None:
    """Gives the memory that this worker has freed back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def leanly(name: str, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The step of an operator, in a worker that holds nothing of other operators meanwhile, nor freed memory after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker(name)
        yield from step(batches)
        give_back()

    return run


#: The operator that claimed this worker last.
_CLAIMED: dict[str, str] = {}


#: Bytes that a row (word, bits) takes in a broadcast table.
SIEVE_ROW = 24


def sieve_mask(key: Column) -> Column:
    """Two different cells of a 64-bit word, chosen by the key's hash."""
    cells = F.xxhash64(key, F.lit(1))
    one = F.pmod(cells, F.lit(64))
    two = F.pmod(one + 1 + F.pmod(F.shiftright(cells, 6), F.lit(63)), F.lit(64))
    bit = lambda cell: F.call_function("shiftleft", F.lit(1).cast("long"), cell.cast("int"))
    return bit(one).bitwiseOR(bit(two))


def split_by_sieve(rows: DataFrame, key: Column, keys: DataFrame, broadcast_bytes: int = 128 << 20) -> tuple[DataFrame, DataFrame]:
    """The rows that surely have none of ``keys`` (one column of 64-bit hashes), and those that may have one.

    A Bloom filter of the keys, 16 bits each but ``broadcast_bytes`` at most, is
    broadcast, so that rows without a key never move. A filter too small for
    the keys lets more rows through to the second table, and loses none.
    """
    name = keys.columns[0]
    words = max(min(-(-keys.count() // 4), broadcast_bytes // SIEVE_ROW), 1)
    place = lambda c: F.pmod(c, F.lit(words))
    sieve = staged(keys.groupBy(place(F.col(name)).alias("sieve_word")).agg(F.bit_or(sieve_mask(F.col(name))).alias("sieve_bits")), "sieve")
    tested = rows.withColumn("sieve_key", key).withColumn("sieve_word", place(F.col("sieve_key"))).join(F.broadcast(sieve), "sieve_word", "left")
    mask = sieve_mask(F.col("sieve_key"))
    hit = F.coalesce(F.col("sieve_bits").bitwiseAND(mask) == mask, F.lit(False))
    own = ["sieve_word", "sieve_bits", "sieve_key"]
    return tested.where(~hit).drop(*own), tested.where(hit).drop(*own)


def without(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows whose key, never null for those to go, isn't in the table of keys (one column); those that surely stay never move."""
    name = keys.columns[0]
    clear, maybe = split_by_sieve(rows, F.xxhash64(key), keys.select(F.xxhash64(name).alias("key")))
    return clear.unionByName(maybe.join(keys, key == F.col(name), "left_anti"))


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], total: int, size: str = "group_size", most_hot: int = 100_000) -> DataFrame:
    """Rows with what their group has, so that no large group meets in one task.

    Groups of more than ``total / most_hot`` rows can be ``most_hot`` at most; they
    are broadcast, and only rows of the others are shuffled.
    """
    least = max(total // most_hot, 20_000)
    hot = groups.where(F.col(size) > least)
    if hot.isEmpty():
        return rows.join(groups, key)
    others = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(groups.where(F.col(size) <= least), key)
    return rows.join(F.broadcast(hot), key).unionByName(others)


def text_of(column: str = "text") -> Column:
    """The text, or the empty string for null."""
    return F.coalesce(F.col(column), F.lit(""))


def utf8(column: str = "text") -> Column:
    """The text's UTF-8 bytes; empty for null."""
    return text_of(column).cast("binary")


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether a row is in the held-out fold: crc32 of the id as text, modulo ``folds``, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def blocks(batches: Iterator[pa.RecordBatch], rows: int, size: int = 1 << 20, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, and of about ``size`` bytes of text unless one text is longer."""
    for whole in batches:
        start, held = 0, 0
        for at, own in enumerate(pc.binary_length(whole.column(column)).to_pylist()):
            if at > start and (at - start >= rows or held + (own or 0) > size):
                yield whole.slice(start, at - start)
                start, held = at, 0
            held += own or 0
        if start < whole.num_rows:
            yield whole.slice(start)
