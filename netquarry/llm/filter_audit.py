"""What filters remove in every order: survivors of all subsets of filters from one CUBE, in DataFrame functions only."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_of

#: What is counted of documents: all, those of good quality, toxic ones.
COUNTS = ("docs", "good", "toxic")


def text_failures(text: Column, least_words: int = 50, least_distinct: int = 65, most_capitals: int = 5, symbols: str = "[#$%&*|]") -> dict[str, Column]:
    """The failure conditions A to D of a text that isn't null; words are parts between space and 0x09 to 0x0D."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return {
        "A": F.size(words) < least_words,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * least_distinct,
        "C": F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.char_length(text) * most_capitals,
        "D": text.rlike(symbols),
    }


def failures(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by part and the filters that they fail: part, A to E, docs, good, toxic; one row for each combination.

    E fails where a smaller doc_id has an equal text anywhere in the table, so
    of each text only the rows of its smallest id pass. Rows of one text,
    document and part are counted together first; thus a text of which there are
    very many copies moves as one row a document, and meets its smallest id by
    text and document, never by text alone.
    """
    text = text_of()
    flags = text_failures(F.col("text"))
    rows = documents.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", F.sha2("text", 256).alias("digest"), *(c.alias(n) for n, c in flags.items()))
    rows = staged(rows.groupBy("doc_id", "part", "digest", *flags).agg(F.count(F.lit(1)).alias("docs")), "audit")
    firsts = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.lit(True).alias("is_first"))
    of_label = lambda name: F.max(F.when(F.col(name) == 1, 1).otherwise(0)).alias(name)
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(of_label("quality"), of_label("toxic"))
    told = rows.join(firsts, ["doc_id", "digest"], "left").join(known, "doc_id", "left")
    counted = lambda name: F.sum(F.when(F.col(name) == 1, F.col("docs")).otherwise(0))
    later = F.col("is_first").isNull() & F.col("doc_id").isNotNull()
    return told.groupBy("part", *flags, later.alias("E")).agg(F.sum("docs").alias("docs"), counted("quality").alias("good"), counted("toxic").alias("toxic"))


def subset_survivors(failing: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """How many documents pass all filters of each subset: part, subset (bit k for the k-th filter), docs, good, toxic.

    From one CUBE over the flags and the part: of the grouping set that keeps
    the part and a subset's flags, the row whose flags are all false. Subsets
    that nobody survives have no row.
    """
    names = list(filters)
    cube = failing.cube("part", *names).agg(F.grouping_id().alias("grouping"), *(F.sum(c).alias(c) for c in COUNTS))
    left_out = F.col("grouping").cast("int")  # the first column is the highest bit
    bit = len(names) - 1
    subset = sum(((1 - F.shiftright(left_out, bit - k).bitwiseAND(1)) * (1 << k) for k in range(len(names))), F.lit(0))
    passing = F.shiftright(left_out, len(names)) == 0
    for name in names:
        passing &= ~F.coalesce(F.col(name), F.lit(False))
    return cube.where(passing).select("part", subset.cast("int").alias("subset"), *COUNTS)


def filter_orders(filters: str = "ABCDE") -> list[tuple]:
    """(filter_order, step, filter, subset before, subset after) of each step of every order; a fixed number."""
    found = []
    for order in permutations(filters):
        before = 0
        for step, name in enumerate(order, 1):
            after = before | 1 << filters.index(name)
            found.append(("".join(order), step, name, before, after))
            before = after
    return found


def audit_filters(documents: DataFrame, labels: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """What each filter removes at each step of every order, by part of the corpus.

    Returns part, filter_order, step, filter, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost and shapley (removed by the filter,
    summed over all orders), zeros included: 600 rows a part for five filters.

    Documents are read once and counted by part and failures; the CUBE over
    those few counts gives the survivors of all subsets, and every step is the
    difference of two of them: its rows are joined to the survivors of the subset
    before and after it, by part and subset.

    Null text is empty text, a null source the part "", like an empty one.
    Documents with null ids have no label and are no copies, nor are others
    copies of them; repeated rows of an id are counted one by one and aren't copies of each other.
    Of repeated labels of an id, any 1 counts. An empty table has no part and gives no row. Other columns are ignored.
    """
    spark = documents.sparkSession
    failing = staged(failures(documents, labels), "failures")
    found = staged(subset_survivors(failing, filters), "survivors")
    parts = failing.select("part").distinct()
    subsets = parts.select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("subset"))
    whole = subsets.join(found, ["part", "subset"], "left").select("part", "subset", *(F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS))
    whole = staged(whole, "subsets")
    at = lambda side: whole.select("part", *(F.col(c).alias(f"{c}_{side}") for c in COUNTS), F.col("subset").alias(side))
    steps = spark.createDataFrame(filter_orders(filters), "filter_order string, step int, filter string, before int, after int")
    # One row for each filter and subset without it: what it removes there, and in how many orders it stands there.
    full = (1 << len(filters)) - 1
    pairs = [(name, before, before | 1 << k, factorial(before.bit_count()) * factorial(len(filters) - 1 - before.bit_count()))
             for k, name in enumerate(filters) for before in range(full + 1) if not before >> k & 1]
    pairs_of = spark.createDataFrame(pairs, "filter string, before int, after int, orders long")
    removed = at("before").join(F.broadcast(pairs_of), "before").join(at("after"), ["part", "after"])
    removed = removed.select("part", "filter", "before", "after", F.col("docs_after").alias("kept"), "orders",
                             *(F.expr(f"{c}_before - {c}_after").alias(c) for c in COUNTS))
    removed = staged(removed, "removed")
    of_filter = removed.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("docs"))).alias("fails"),
        F.sum(F.when(F.col("after") == full, F.col("docs"))).alias("unique_fails"),
        F.sum(F.col("docs") * F.col("orders")).alias("shapley"),
    )
    return (
        removed.join(F.broadcast(steps), ["filter", "before", "after"])
        .join(of_filter, ["part", "filter"])
        .select(
            "part", "filter_order", "step", "filter", "kept", F.col("docs").alias("removed"), (F.col("fails") - F.col("docs")).alias("redundant"),
            "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley",
        )
    )
