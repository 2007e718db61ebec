"""Exact Jaccard self-join on word shingles with adaptive multi-match prefixes, as components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import blocks, join_groups, leanly, small_batches, split_by_sieve, staged, utf8
from .components import connected_components
from .shingles import shingle_sets

#: The similarity 0.8 as a ratio of whole numbers: 100 * shared >= 80 * union.
NUMERATOR, DENOMINATOR = 80, 100
#: Counters of the frequency sketch, and how many of them make a row of it.
SKETCH_BITS, SKETCH_ROW = 20, 4_096
#: Words of 64 bits in a set's parity map.
PARITY_WORDS = 16
#: Bits of the finer parity map: for each element of the set, rounded up to a power of two, and at most.
FINE_BITS, MOST_FINE_BITS = 4, 1 << 16
MOST_MATCHES = 4
#: Entries of a list that are compared with each other in one task; longer lists are split and met part by part.
LIST = 8_000
#: Entries of a list up to which all its pairs meet in the neighbour pass, so that none is left for later.
SHORT_LIST = 4
#: Entries of a list that are sorted in one task for the neighbour pass.
SORTED_LIST = 50_000
#: Class from which on a shingle is hot: its counter stands out by more than 512.
HOT_CLASS = 10
#: Groups before it in a list that a group of equal hot parts is held against first.
NEIGHBOURS = 6
#: Tokens by which a pair of sets is found once rather than once for each token they share.
LOW_TOKENS = 8


def _least_shared(n: Column, m: Column) -> Column:
    """The smallest intersection of sets of n and m elements that links them."""
    return F.ceil(F.lit(NUMERATOR) * (n + m) / F.lit(DENOMINATOR + NUMERATOR)).cast("int")


def frequency_sketch(texts: DataFrame, hashes: Callable[[list[bytes]], np.ndarray], rows_at_once: int = 256) -> np.ndarray:
    """Counts of all hashes of texts, the second column, by the hashes' top bits: an array of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in blocks(batches, rows_at_once):
            found = hashes(batch.column(1).to_pylist())
            total += np.bincount((found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        yield from _sketch_rows({k: r for k, r in enumerate(total.reshape(-1, SKETCH_ROW)) if r.any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[row] = total.get(row, 0) + np.frombuffer(counts, np.int64)
        yield from _sketch_rows(total)

    rows = texts.mapInArrow(leanly("shingles", count), "row int, counts binary").repartition("row").mapInArrow(leanly("shingles", add), "row int, counts binary").collect()
    sketch = np.zeros(((1 << SKETCH_BITS) // SKETCH_ROW, SKETCH_ROW), np.int64)
    for r in rows:  # as many as the sketch has, whatever the input
        sketch[r["row"]] += np.frombuffer(r["counts"], np.int64)
    return sketch.ravel()


def _sketch_rows(rows: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(rows), pa.int32()), pa.array([r.tobytes() for r in rows.values()], pa.binary())], ["row", "counts"]
    )


def frequency_classes(sketch: np.ndarray) -> np.ndarray:
    """0 for counters no larger than chance makes them, else the logarithm of what stands out."""
    load = sketch.mean()
    chance = load + 6 * np.sqrt(load) + 8
    return np.where(sketch <= chance, 0, np.ceil(np.log2(np.maximum(sketch - load, 1)))).astype(np.uint8)


def in_global_order(own: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set's elements in the global order (rare classes first, then by hash), and their classes."""
    of = classes[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    order = np.lexsort((own, of))
    return own[order], of[order]


def prefix(order: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, int]:
    """A set's first elements in the global order, and the matches they must have.

    With one match asked for, the prefix has n - least + 1 elements; each further
    one lengthens it by one. The number is that of least estimated cost: the
    entries the prefix meets, plus a verification for each candidate, which a
    further match makes rarer.
    """
    n = len(order)
    least = -(-n * NUMERATOR // DENOMINATOR)
    most = min(MOST_MATCHES, least)
    met = np.cumsum(np.exp2(of[: n - least + most].astype(float)) - 1)
    costs = [met[n - least + k - 1] * (1 + 8 / k**2) + k for k in range(1, most + 1)]
    matches = int(np.argmin(costs)) + 1
    return order[: n - least + matches], matches


def hot_part(order: np.ndarray, of: np.ndarray, hot_class: int) -> tuple[int, np.ndarray | None]:
    """How many of a set's elements aren't hot, and those that are, if they alone may link it with another set."""
    rare = int((of < hot_class).sum())
    n = len(order)
    return rare, order[rare:] if n and DENOMINATOR * (n - rare) >= NUMERATOR * n else None


def parity_map(own: np.ndarray, bits: int = PARITY_WORDS * 64) -> np.ndarray:
    """Bits that tell whether an odd number of elements fell there: two sets differ in at least as many elements as bits."""
    at = (own & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def fine_map(own: np.ndarray) -> bytes:
    """A parity map that grows with the set, as a map of 1,024 bits says little of sets of thousands."""
    bits = 1 << max(FINE_BITS * len(own) - 1, PARITY_WORDS * 64 - 1).bit_length()
    return parity_map(own, min(bits, MOST_FINE_BITS)).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """In how many elements two sets differ at least, by their fine maps; the longer map is folded to the shorter."""
    a, b = sorted((np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _profiles(texts: DataFrame, classes: np.ndarray, words: int, hot_class: int, rows_at_once: int = 256) -> DataFrame:
    """One row a text: its set's size, digest, parity maps, prefix and matches, the number of rare elements, and the hot part if it may link alone."""
    shared = texts.sparkSession.sparkContext.broadcast(classes)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, rows_at_once):
            rows = [_profile(own, shared.value, hot_class) for own in shingle_sets(batch.column(1).to_pylist(), words)]
            longs = pa.list_(pa.int64())
            kinds = [pa.int32(), pa.binary(), longs, pa.binary(), longs, pa.int32(), pa.int32(), pa.binary(), pa.int32(), longs, longs]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["doc_id", "text_hash", *PROFILE])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        leanly("shingles", profile),
        f"doc_id {kind}, text_hash bigint, n int, digest binary, parity array<bigint>, fine binary, prefix array<bigint>, matches int, "
        "rare int, hot_digest binary, hot_n int, hot_prefix array<bigint>, hot_parity array<bigint>",
    )


PROFILE = ["n", "digest", "parity", "fine", "prefix", "matches", "rare", "hot_digest", "hot_n", "hot_prefix", "hot_parity"]


def _profile(own: np.ndarray, classes: np.ndarray, hot_class: int) -> tuple:
    order, of = in_global_order(own, classes)
    found, matches = prefix(order, of) if len(own) else (own, 0)
    rare, hot = hot_part(order, of, hot_class)
    told: tuple = (None, None, None, None)
    if hot is not None:
        first = len(hot) - -(-len(hot) * NUMERATOR // DENOMINATOR) + 1
        told = xxhash.xxh3_128_digest(np.sort(hot).tobytes()), len(hot), hot[:first].view(np.int64), parity_map(hot)
    return (len(own), xxhash.xxh3_128_digest(own.tobytes()), parity_map(own), fine_map(own), found.view(np.int64), matches, rare, *told)


def _sizes_allow(a: str, b: str) -> Column:
    """Whether sets of such sizes can link."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (n * DENOMINATOR >= m * NUMERATOR) & (m * DENOMINATOR >= n * NUMERATOR)


def _places_allow(a: str, b: str) -> Column:
    """Whether the places of a shared entry are within the pair's own prefixes."""
    col = lambda side, name: F.col(f"{side}.{name}")
    least = _least_shared(col(a, "n"), col(b, "n"))
    matches = F.least(col(a, "matches"), col(b, "matches"))
    return (col(a, "at") < col(a, "n") - least + matches) & (col(b, "at") < col(b, "n") - least + matches)


def _differing_bits(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}.parity")[i].bitwiseXOR(F.col(f"{b}.parity")[i])) for i in range(PARITY_WORDS)), F.lit(0))


def _parity_allows(a: str, b: str) -> Column:
    """False only if the parity maps prove that two sets differ in too many elements."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return _differing_bits(a, b) <= n + m - 2 * _least_shared(n, m)


def _finely_allowed(pairs: DataFrame, maps: DataFrame, rows_at_once: int = 256) -> DataFrame:
    """The pairs (a, b) whose sets the fine maps don't prove to differ too much, with a document of each (a_doc, b_doc); ``maps`` has id, doc_id, n and fine."""

    def allow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, rows_at_once, column=4):
            keep = []
            for n, m, x, y in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                least = -(-NUMERATOR * (n + m) // (DENOMINATOR + NUMERATOR))
                keep.append(least_difference(x, y) <= n + m - 2 * least)
            yield batch.select([0, 1, 6, 7]).filter(pa.array(keep, pa.bool_()))

    kind, of_doc = pairs.schema["a"].dataType.simpleString(), maps.schema["doc_id"].dataType.simpleString()
    own = lambda side: maps.select(*(F.col(c).alias(name) for c, name in (("id", side), ("n", f"n_{side}"), ("fine", f"fine_{side}"), ("doc_id", f"{side}_doc"))))
    rows = pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", "n_a", "n_b", "fine_a", "fine_b", "a_doc", "b_doc")
    return rows.mapInArrow(leanly("shingles", allow), f"a {kind}, b {kind}, a_doc {of_doc}, b_doc {of_doc}")


def _most_sizes(shared: Column) -> Column:
    """The largest sum of two sets' sizes that so many shared elements link."""
    return F.floor(F.lit(NUMERATOR + DENOMINATOR) * shared / F.lit(NUMERATOR)).cast("int")


def _hot_parts_may(a: str, b: str) -> Column:
    """Whether the smallest sets of two groups may link by their hot parts, of sizes n, whose parity maps bound what they share."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    shared = F.floor((n + m - _differing_bits(a, b)) / 2)
    return _sizes_allow(a, b) & _places_allow(a, b) & (F.col(f"{a}.least_n") + F.col(f"{b}.least_n") <= _most_sizes(F.least(n, m, shared)))


def _shared(pairs: DataFrame, groups: DataFrame, texts: DataFrame, classes: np.ndarray, words: int, hot_class: int) -> DataFrame:
    """Pairs (g, h) of groups with their smallest sets (one, two) and the number of hot elements that they share."""
    leasts = groups.select("g", "least")
    pairs = staged(pairs.join(leasts.select("g", F.col("least").alias("one")), "g").join(leasts.select(F.col("g").alias("h"), F.col("least").alias("two")), "h"), "hot-pairs")
    if pairs.isEmpty():
        return pairs.select("g", "h", "one", "two", F.lit(0).cast("bigint").alias("shared"))
    ids = pairs.select(F.col("one.id").alias("a"), F.col("two.id").alias("b"), F.col("one.doc_id").alias("a_doc"), F.col("two.doc_id").alias("b_doc"))
    counted = _counted(ids.distinct(), texts, words, (classes, hot_class)).select("a", "b", "common")
    return pairs.join(counted, (F.col("one.id") == F.col("a")) & (F.col("two.id") == F.col("b"))).select("g", "h", "one", "two", F.col("common").alias("shared"))


def _hot_links(sets: DataFrame, parts: DataFrame, texts: DataFrame, classes: np.ndarray, words_of: int, hot_class: int) -> DataFrame:
    """Links (a, b) by hot elements alone that join all sets which hot elements alone link, from rows (id, doc_id, n, hot_digest, hot_n, hot_prefix, hot_parity).

    Sets with the same hot part are one group, however many; what two groups
    share links their sets up to a sum of sizes. So each set is held against one
    set only: the smallest of the group with which it may be largest (of its own
    group, or of one of those that share enough with it). The smallest sets of
    the groups are held against each other. Links so grow with the sets; what is
    compared are groups. First those are that stand beside each other in lists
    in the order of some words of their parity maps, which joins a large number
    of similar groups by linearly many pairs; then those of different components.
    Groups with sets of several components keep a part of their own.
    """
    own = sets.where("hot_digest IS NOT NULL").join(parts, "id", "left").withColumn("part", F.coalesce("component_id", "id")).drop("component_id")
    own = staged(own.select("id", "doc_id", "n", "part", "hot_digest", "hot_n", "hot_prefix", "hot_parity"), "hot-sets")
    groups = own.groupBy(F.col("hot_digest").alias("g"), F.col("hot_n").alias("n")).agg(
        F.min(F.struct("n", "id", "doc_id")).alias("least"), F.count(F.lit(1)).alias("sets"), F.min("part").alias("low"), F.max("part").alias("high"),
        F.first("hot_prefix").alias("prefix"), F.first("hot_parity").alias("parity"),
    )
    groups = staged(groups, "hot-groups")
    part = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("g"))  # groups within one component needn't meet
    entries = groups.select("g", "n", F.lit(1).alias("matches"), F.col("least.n").alias("least_n"), part.alias("part"), (F.col("low") == F.col("high")).alias("sure"), "parity", F.posexplode("prefix").alias("at", "token"))

    def listed_parts(entries: DataFrame) -> DataFrame:
        """Tokens that entries of different components have: the component of most of them, and how many entries."""
        by_part = entries.groupBy("token", "part").agg(F.count(F.lit(1)).alias("own"))
        lists = by_part.groupBy("token").agg(F.max_by("part", F.struct("own", "part")).alias("main"), F.min("part").alias("first"), F.max("part").alias("last"), F.sum("own").alias("df"))
        return staged(lists.where("first < last").select("token", "main", "df"), "hot-lists")

    lists = listed_parts(entries)
    entries = staged(join_groups(entries, lists, ["token"], lists.agg(F.sum("df")).first()[0] or 0, "df"), "hot-entries")
    mine = F.struct("g", "n", "at", "matches", "least_n", "part", "parity", "sure")
    words = [F.col("parity")[F.pmod(F.col("token") + k, F.lit(PARITY_WORDS)).cast("int")] for k in range(3)]
    listed = W.partitionBy("token", F.pmod(F.xxhash64("g"), F.ceil(F.col("df") / SORTED_LIST))).orderBy(*words, "g")
    beside = entries.select(mine.alias("x"), F.array(*(F.lag(mine, k).over(listed) for k in range(1, NEIGHBOURS + 1))).alias("ys"))
    beside = beside.select("x", F.explode("ys").alias("y")).where("y IS NOT NULL AND x.part <> y.part AND x.sure AND y.sure")
    beside = staged(beside.where(_hot_parts_may("x", "y")).select(F.least("x.g", "y.g").alias("g"), F.greatest("x.g", "y.g").alias("h")).distinct(), "hot-near")
    near = _shared(beside, groups, texts, classes, words_of, hot_class)
    near = staged(near.where(F.col("one.n") + F.col("two.n") <= _most_sizes(F.col("shared"))), "hot-near-links")
    of_group = groups.select("g", part.alias("part"))
    joined = near.join(of_group.select("g", F.col("part").alias("a")), "g").join(of_group.select(F.col("g").alias("h"), F.col("part").alias("b")), "h")
    wider = connected_components(joined.select("a", "b")).select(F.col("id").alias("part"), F.col("component_id").alias("wider"))
    entries = entries.drop("main", "df").join(wider, "part", "left").withColumn("part", F.coalesce("wider", "part")).drop("wider")
    lists = listed_parts(entries)
    entries = staged(join_groups(entries, lists, ["token"], lists.agg(F.sum("df")).first()[0] or 0, "df"), "hot-entries")
    x, y = entries.where("part <> main").alias("x"), entries.alias("y")  # so the largest component of a list doesn't meet itself
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.part") != F.col("y.part")) & _hot_parts_may("x", "y"))
    pairs = met.select(F.least("x.g", "y.g").alias("g"), F.greatest("x.g", "y.g").alias("h")).distinct()
    common = staged(_shared(staged(pairs, "hot-pairs"), groups, texts, classes, words_of, hot_class), "hot-common")
    most = _most_sizes(F.col("shared"))
    between = common.where(F.col("one.n") + F.col("two.n") <= most).select(F.col("one.id").alias("a"), F.col("two.id").alias("b"))
    reach = lambda g, to: common.select(F.col(g).alias("g"), (most - F.col(f"{to}.n")).alias("most_n"), F.col(f"{to}.id").alias("to"))
    reaches = groups.select("g", (_most_sizes(F.col("n")) - F.col("least.n")).alias("most_n"), F.col("least.id").alias("to")).unionByName(reach("g", "two")).unionByName(reach("h", "one"))
    best = reaches.groupBy("g").agg(F.max(F.struct("most_n", "to")).alias("best")).join(groups.select("g", "sets"), "g")
    best = staged(best.select(F.col("g").alias("hot_digest"), "best.*", "sets"), "hot-best")
    members = join_groups(own.select("id", "n", "hot_digest"), best, ["hot_digest"], own.count(), "sets").where("n <= most_n AND id <> to")
    return between.unionByName(near.select(F.col("one.id").alias("a"), F.col("two.id").alias("b"))).unionByName(members.select(F.col("id").alias("a"), F.col("to").alias("b")))


def _counted(pairs: DataFrame, texts: DataFrame, words: int, hot: tuple[np.ndarray, int] | None = None, least_bits: int = 1 << 23, most_bits: int = 1 << 30, rows_at_once: int = 256, broadcast_pairs: int = 500_000) -> DataFrame:
    """Pairs (a, b, a_doc, b_doc) of sets with n_a, n_b and common, counted on the whole sets, or on their hot parts.

    Sets are known by their digest; a text with that of ``a`` is that of the
    document ``a_doc``. Only texts in a pair are shingled again: a bitmap of 16
    bits for each pair, 128 MB at most, picks them, and the joins drop those it
    let through by chance. The table of pairs holds digests alone; it is
    broadcast to the sets up to ``broadcast_pairs`` rows, so that sets move once, with their pair.
    """
    spark, n_pairs = texts.sparkSession, pairs.count()
    filter_bits = min(max(least_bits, 1 << (16 * n_pairs).bit_length()), most_bits)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(filter_bits))
    wanted = pairs.select(F.explode(F.array("a_doc", "b_doc")).alias("id")).select(place("id").alias("at")).distinct()
    bits = wanted.groupBy(F.floor(F.col("at") / 32_768).cast("int").alias("row")).agg(F.bitmap_construct_agg(F.col("at") % 32_768).alias("bits"))
    bitmap = np.zeros(filter_bits // 8, np.uint8)
    for r in bits.collect():  # at most filter_bits / 32768 rows
        bitmap[r["row"] * 4_096 : (r["row"] + 1) * 4_096] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(bitmap)
    classes = spark.sparkContext.broadcast(hot[0]) if hot else None
    hot_class = hot[1] if hot else None

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chosen() -> Iterator[pa.RecordBatch]:
            for whole in batches:
                at = whole.column(2).to_numpy()
                yield whole.filter(pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

        for batch in blocks(chosen(), rows_at_once):
            found = shingle_sets(batch.column(1).to_pylist(), words)
            kept = found if classes is None else [own[classes.value[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] >= hot_class] for own in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary()), pa.array([s.tobytes() for s in kept], pa.binary())], ["id", "elements"]
            )

    found = texts.where("doc_id IS NOT NULL").withColumn("at", place("doc_id")).mapInArrow(leanly("shingles", sets), "id binary, elements binary")
    found = staged(found, "sets")
    narrow = pairs.select("a", "b")
    narrow = F.broadcast(narrow) if n_pairs <= broadcast_pairs else narrow

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, rows_at_once, column=2):
            sizes = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                sizes.append((len(x), len(y), int((both[1:] == both[:-1]).sum())))
            columns = zip(*sizes, strict=True) if sizes else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns)], ["a", "b", "n_a", "n_b", "common"])

    joined = found.select(F.col("id").alias("a"), F.col("elements").alias("x")).join(narrow, "a").join(
        found.select(F.col("id").alias("b"), F.col("elements").alias("y")), "b"
    )
    return joined.select("a", "b", "x", "y").mapInArrow(leanly("shingles", count), "a binary, b binary, n_a bigint, n_b bigint, common bigint").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b, a_doc, b_doc) whose whole sets link."""
    return _counted(pairs, texts, words).where(F.col("common") * DENOMINATOR >= (F.col("n_a") + F.col("n_b") - F.col("common")) * NUMERATOR).select("a", "b")


def near_duplicate_components(documents: DataFrame, words: int = 5, hot_class: int = HOT_CLASS) -> DataFrame:
    """Link documents whose shingle sets have a Jaccard similarity of 0.8 or more: doc_id, n_shingles, component_id, text_hash.

    Words are cut at space and 0x09 to 0x0D with A-Z lower-cased. The links
    returned are whole: no cap, no sampling.

    1. A sketch of fixed size counts all shingles; it only fixes a global order,
       rare first. Texts with the same set become one class.
    2. Each class lists its prefix, longer where the estimated candidates are
       many, in which case more shared entries are asked for. Entries shared by
       no one else are dropped.
    3. Neighbours in each entry's list (by size, and in a random order) are
       verified and joined into components, so that a large group of near copies
       collapses by linearly many pairs. Of lists of ``SHORT_LIST`` entries, which
       are most of them, all pairs are; step 4 can leave these lists out.
    4. Every pair of classes from different components that still has the
       matches asked for within its own prefixes, and that the parity maps
       can't rule out, is verified. This finds all that step 3 left. A pair
       that shares some of its lowest remaining tokens, as all very similar
       ones do, is found at the lowest of these alone and needs no more matches.
       Hot shingles, those of ``hot_class`` or more, have no list here: a pair
       either shares a rarer one in its prefixes, or what it shares is all hot.
       Such pairs are joined by groups of the same hot part (``_hot_links``),
       so that documents of a template, which share most of it and differ too
       much to link, are never held against each other. Lists of more than
       ``LIST`` entries are split over tasks. What is left that may take time by
       a square are different hot parts that share hot shingles.

    Null and empty texts have no shingle and link with nothing. Repeated rows of
    an id are returned one by one; where their texts differ, each has the
    component of its own text. A row with a null id gets the component of its
    class, null if all of it are null. Other columns are ignored. ``text_hash``
    (xxhash64 of the text in UTF-8) tells rows of one id apart.
    """
    small_batches(documents.sparkSession)
    texts = documents.select("doc_id", utf8().alias("text"))
    sketch = frequency_sketch(texts, lambda own: np.concatenate([np.empty(0, np.uint64), *shingle_sets(own, words)]))
    classes = frequency_classes(sketch)
    profiles = staged(_profiles(texts, classes, words, hot_class), "profiles")
    own = F.struct(*(c for c in PROFILE if c not in ("n", "digest")))
    sets = profiles.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest", "n").agg(F.min("doc_id").alias("doc_id"), F.min_by(own, "doc_id").alias("own"))
    sets = staged(sets.select(F.col("digest").alias("id"), "doc_id", "n", "own.*"), "sets")
    docs_of = sets.select("id", "doc_id")
    hot = F.greatest(F.size("prefix") - F.col("rare"), F.lit(0))  # entries of hot shingles in the prefix
    entries = sets.select("id", "n", "matches", hot.alias("hot"), "rare", F.posexplode("prefix").alias("at", "token"))
    lists = staged(entries.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "lists")
    total = lists.agg(F.sum("df")).first()[0] or 0
    _, entries = split_by_sieve(entries, F.xxhash64("token"), lists.select(F.xxhash64("token").alias("key")), 64 << 20)  # most entries have no list, and so don't move
    entries = staged(join_groups(entries, lists, ["token"], total, "df"), "entries")
    by_token = W.partitionBy("token", F.pmod(F.xxhash64("id"), F.ceil(F.col("df") / SORTED_LIST)))

    # Step 3: neighbours in the lists.
    mine = F.struct("id", "n", "at", "matches")
    by_size, at_random = by_token.orderBy("n", "id"), by_token.orderBy(F.xxhash64("id"), "id")
    others = [F.lag(mine).over(by_size), F.when(F.col("df") > SHORT_LIST, F.lag(mine).over(at_random))]
    others += [F.when(F.col("df") <= SHORT_LIST, F.lag(mine, k).over(by_size)) for k in range(2, SHORT_LIST)]  # so all pairs of a short list meet here
    near = entries.select(mine.alias("x"), F.array(*others).alias("ys")).select("x", F.explode("ys").alias("y")).where("y IS NOT NULL").where(_sizes_allow("x", "y") & _places_allow("x", "y"))
    near = near.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    maps = sets.select("id", "n", "parity")
    possible = (
        near.distinct()
        .join(maps.select(F.col("id").alias("a"), F.struct("n", "parity").alias("x")), "a")
        .join(maps.select(F.col("id").alias("b"), F.struct("n", "parity").alias("y")), "b")
        .where(_parity_allows("x", "y"))
        .select("a", "b")
    )
    possible = staged(possible, "near")
    fine = sets.select("id", "doc_id", "n", "fine")
    first = staged(_verified(staged(_finely_allowed(possible, fine), "near"), texts, words), "first-links")
    parts = connected_components(first)

    # Step 4: all other pairs that may link, across components; first those that share hot shingles alone.
    by_hot = staged(_hot_links(sets, parts, texts, classes, words, hot_class), "hot-links")
    entries = entries.where((F.col("at") < F.col("rare")) & (F.col("df") > SHORT_LIST)).drop("df", "rare")
    entries = entries.join(parts, "id", "left").withColumn("part", F.coalesce("component_id", "id")).drop("component_id")
    mixed_lists = entries.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("df"))
    mixed_lists = staged(mixed_lists.where("low < high").select("token", "df"), "mixed-lists")
    across = staged(join_groups(entries, mixed_lists, ["token"], total, "df"), "across")
    low = across.groupBy("id").agg(F.slice(F.sort_array(F.collect_set("token")), 1, LOW_TOKENS).alias("low"))  # of one set's prefix
    narrow = across.withColumn("blocks", F.ceil(F.col("df") / LIST).cast("int")).drop("df")
    across = narrow.join(low, "id").join(maps.drop("n"), "id")
    lowest = F.array_min(F.array_intersect("x.low", "y.low"))

    def met(x: DataFrame, y: DataFrame, on: Column) -> DataFrame:
        may = (F.col("x.id") < F.col("y.id")) & (F.col("x.part") != F.col("y.part")) & _sizes_allow("x", "y") & _parity_allows("x", "y")
        rows = x.alias("x").join(y.alias("y"), on & may & F.coalesce(lowest == F.col("x.token"), _places_allow("x", "y")))
        asked = F.when(lowest.isNull(), F.least("x.matches", "y.matches") - F.least("x.hot", "y.hot")).otherwise(1)  # of the matches asked for so many may be hot
        return rows.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), asked.alias("asked"))

    short = across.where("blocks = 1").drop("blocks")  # both sides of the join are the same rows, which so are shuffled once
    pairs = met(short, short, F.col("x.token") == F.col("y.token"))
    if not mixed_lists.where(F.col("df") > LIST).isEmpty():
        long = across.where("blocks > 1")
        one = long.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        all_of = long.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pairs = pairs.unionByName(met(one, all_of, (F.col("x.token") == F.col("y.token")) & (F.col("x.block") == F.col("y.block"))))
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.first("asked").alias("asked")).where("shared >= asked").select("a", "b")
    pairs = pairs.join(possible, ["a", "b"], "left_anti")
    second = _verified(staged(_finely_allowed(staged(pairs, "pairs"), fine), "pairs"), texts, words)
    parts = connected_components(first.unionByName(by_hot).unionByName(second))

    # Digests tell the sets apart so far; a component's name is its smallest document.
    linked = staged(parts.join(docs_of, "id"), "linked")
    named = staged(linked.groupBy("component_id").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("sets")), "named")
    renamed = join_groups(linked.select("id", "component_id"), named, ["component_id"], linked.count(), "sets").select("id", "class_id")
    alone = docs_of.join(parts, "id", "left_anti").select("id", F.col("doc_id").alias("class_id"))
    classes_of = staged(renamed.unionByName(alone).withColumnRenamed("id", "digest"), "classes")
    return profiles.select("doc_id", "text_hash", "n", "digest").join(classes_of, "digest", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("component_id"), "text_hash"
    )
