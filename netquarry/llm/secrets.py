"""Secrets in texts: fixed patterns and a randomness test battery, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_of

#: Kind, pattern, group whose length counts, and its least length.
PATTERNS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]{32,}", 0, 32),
)
KINDS = (*(kind for kind, *_ in PATTERNS), "random")
#: Encodings from narrow to wide, each with the pattern of its strings, the case they are folded to, and its letters in order of value.
ENCODINGS = (
    ("[0-9a-f]+|[0-9A-F]+", F.lower, "0123456789abcdef"),
    ("[A-Z2-7]+", F.upper, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("[0-9a-z]+|[0-9A-Z]+", F.lower, "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("[0-9A-Za-z]+", lambda c: c, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    (".*", lambda c: c, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
#: Characters of the base-64 alphabets, whose stretches go to the battery.
STRETCH = "[A-Za-z0-9+/_=-]"
#: Matches whose places are summed up at once.
BLOCK = 256
#: Steps of a p-value's logarithm in the histogram that sets the threshold, and the bin of the smallest.
BINS, LAST_BIN = 16, 16 * 300


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _matches(text: Column, pattern: str, group: int, least: int, keep_text: bool = False) -> Column:
    """Leftmost non-overlapping matches whose group has ``least`` characters, as (start, end, token) in code points.

    The text split at the matches, beside the matches themselves, gives their
    places. They are summed up in blocks, then the blocks, as a fold that appends
    to one array takes time by the square of its length.
    """
    pieces = F.arrays_zip(
        F.split(text, pattern, -1).alias("before"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    kind = "array<struct<start: bigint, end: bigint, token: string>>"
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("found"))

    def step(so_far: Column, piece: Column) -> Column:
        start = so_far["at"] + F.char_length(piece["before"])
        end = start + F.coalesce(F.char_length(piece["match"]), F.lit(0))
        token = piece["value"] if keep_text else F.lit(None).cast("string")
        one = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), token.alias("token"))
        good = F.coalesce(F.char_length(piece["value"]) >= least, F.lit(False))
        return F.struct(end.cast("long").alias("at"), F.when(good, F.array_append(so_far["found"], one)).otherwise(so_far["found"]).alias("found"))

    def in_blocks(all_pieces: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.ceil(F.size(all_pieces) / F.lit(BLOCK)).cast("int") - 1)
        return F.transform(numbers, lambda n: F.aggregate(F.slice(all_pieces, n * BLOCK + 1, F.lit(BLOCK)), zero, step))

    def shifted(blocks: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all"))
        bases = F.aggregate(blocks, start, lambda a, b: F.struct((a["at"] + b["at"]).alias("at"), F.array_append(a["all"], a["at"]).alias("all")))["all"]
        move = lambda base: lambda x: F.struct((x["start"] + base).alias("start"), (x["end"] + base).alias("end"), x["token"].alias("token"))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), bases.alias("base")), lambda z: F.transform(z["block"]["found"], move(z["base"]))))

    return F.when(text.rlike(pattern), _bound(_bound(pieces, in_blocks), shifted)).otherwise(F.array().cast(kind))


def _masked(text: Column, pattern: str, group: int, least: int) -> Column:
    """The text with spaces in the place of the matches that ``_matches`` reports; those it drops stay as they are."""
    pieces = F.arrays_zip(
        F.split(text, pattern, -1).alias("before"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )

    def part(piece: Column) -> Column:
        match = F.coalesce(piece["match"], F.lit(""))
        good = F.coalesce(F.char_length(piece["value"]) >= least, F.lit(False))
        return F.concat(piece["before"], F.when(good, F.repeat(F.lit(" "), F.char_length(match))).otherwise(match))

    return F.when(text.rlike(pattern), F.array_join(F.transform(pieces, part), "")).otherwise(text)


def _upper_tail(z: Column) -> Column:
    """The chance that a standard normal variable is above z, z not negative (absolute error below 1e-7)."""
    t = 1 / (1 + F.lit(0.2316419) * z)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.greatest(F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series, F.lit(1e-120))


def _tested(tokens: Column) -> Column:
    """Each (start, end, token) with its length and the combined p-value of the battery, under the hypothesis that it is random.

    The encoding is the narrowest that has all characters. Three tests: the
    chi-squared distance of the letters' counts from uniform, with the moments
    of the finite sample; the runs above and below the middle of the alphabet;
    and the correlation of neighbours. Fisher's method combines them.
    """
    bare = F.transform(tokens, lambda x: F.struct(x["start"], x["end"], F.translate(F.rtrim(x["token"], F.lit("=")), "-_", "+/").alias("body")))

    def encoding(body: Column) -> Column:
        found = None
        for pattern, fold, letters in reversed(ENCODINGS):
            own = F.struct(F.lit(letters).alias("letters"), fold(body).alias("folded"))
            found = own if found is None else F.when(body.rlike(f"^(?:{pattern})$"), own).otherwise(found)
        return found

    coded = F.transform(bare, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), encoding(x["body"]).alias("code")))
    valued = F.transform(
        coded,
        lambda x: F.struct(
            x["start"].alias("start"),
            x["end"].alias("end"),
            F.char_length(x["code"]["letters"]).cast("double").alias("k"),
            F.transform(F.split(x["code"]["folded"], ""), lambda c: F.instr(x["code"]["letters"], c).cast("double") - 1).alias("v"),
        ),
    )

    def sums(x: Column) -> Column:
        names = ("prev", "runs", "high", "s1", "s2", "s12", "n")
        zero = F.struct(*(F.lit(-1.0 if name == "prev" else 0.0).alias(name) for name in names))

        def step(a: Column, v: Column) -> Column:
            is_high = v >= x["k"] / 2
            fresh = (a["prev"] < 0) | (is_high != (a["prev"] >= x["k"] / 2))
            pair = F.when(a["prev"] < 0, F.lit(0.0)).otherwise(a["prev"] * v)
            values = (v, a["runs"] + fresh.cast("double"), a["high"] + is_high.cast("double"), a["s1"] + v, a["s2"] + v * v, a["s12"] + pair, a["n"] + 1.0)
            return F.struct(*(value.alias(name) for name, value in zip(names, values, strict=True)))

        return F.aggregate(x["v"], zero, step)

    def squares(x: Column) -> Column:
        return F.aggregate(F.array_distinct(x["v"]), F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter(x["v"], lambda v: v == c)).cast("double"), F.lit(2.0)))

    summed = F.transform(
        valued,
        lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["k"].alias("k"), sums(x).alias("s"), squares(x).alias("c2"), F.element_at(x["v"], 1).alias("v1")
        ),
    )

    def scores(x: Column) -> Column:
        n, k, s = x["s"]["n"], x["k"], x["s"]
        scale = (n - 1) / n
        chi, freedom = (x["c2"] * k / n - n) / scale, (k - 1) / scale
        spread = 2 / (9 * freedom)
        z_chi = (F.pow(F.greatest(chi / freedom, F.lit(0.0)), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
        low = n - s["high"]
        mean = 2 * s["high"] * low / n + 1
        variance = (mean - 1) * (mean - 2) / (n - 1)
        z_runs = F.when(variance > 0, (s["runs"] - mean) / F.sqrt(F.greatest(variance, F.lit(1e-9)))).otherwise(F.sqrt(n))
        centre = s["s1"] / n
        power = s["s2"] - n * centre * centre
        lagged = s["s12"] - centre * (2 * s["s1"] - x["v1"] - s["prev"]) + (n - 1) * centre * centre
        z_serial = F.when(power > 0, (lagged / F.greatest(power, F.lit(1e-9)) + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), n.alias("n"), z_chi.alias("chi"), F.abs(z_runs).alias("runs"), F.abs(z_serial).alias("serial"))

    scored = F.transform(summed, scores)

    def combined(x: Column) -> Column:
        chi = F.when(x["chi"] >= 0, _upper_tail(F.abs(x["chi"]))).otherwise(1 - _upper_tail(F.abs(x["chi"])))
        half = -F.log(chi) - F.log(F.least(2 * _upper_tail(x["runs"]), F.lit(1.0))) - F.log(F.least(2 * _upper_tail(x["serial"]), F.lit(1.0)))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["n"].alias("n"), (half - F.log(1 + half + half * half / 2)).alias("evidence"))

    return F.transform(scored, combined)


def _span_of(kind: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"))


def find_secrets(documents: DataFrame, least_random: int = 20, false_discovery: float = 0.05) -> DataFrame:
    """Secrets in whole texts: doc_id and spans as (start, kind, end), sorted; kind is a place in ``KINDS``.

    Three kinds are fixed patterns. The fourth, random, are stretches of
    ``least_random`` characters or more of the base-64 alphabets, without the
    places of the others, that the randomness battery doesn't take for ordinary
    text. The battery's p-values, over all documents,
    are held against the false-discovery rate aimed at by the step-up rule, each
    weighted by the length of its string, as long ones tell more: of those taken
    for ordinary text at most that share is random. The threshold comes from a
    histogram of fixed size; nothing else leaves the executors, and texts are
    never shuffled. Places are code points, the end exclusive.

    Null texts count as empty and have no span. Repeated rows are searched one
    by one; other columns are ignored.
    """
    text = F.col("text")
    own = documents.select("doc_id", text_of().alias("text"))
    base = F.concat(
        *(
            F.transform(_matches(text, pattern, group, least), _span_of(kind))
            for kind, (_, pattern, group, least) in enumerate(PATTERNS)
        )
    )
    own = own.select("doc_id", base.alias("base"), text)
    for _, pattern, group, least in PATTERNS:
        own = own.withColumn("text", _masked(text, pattern, group, least))
    own = own.select("doc_id", "base", _matches(text, f"{STRETCH}{{{least_random},}}+", 0, least_random, keep_text=True).alias("stretches"))
    free = F.filter("stretches", lambda x: F.char_length(F.rtrim(x["token"], F.lit("="))) > 1)
    tested = staged(own.select("doc_id", "base", _tested(free).alias("tested")), "tested")

    each = tested.select(F.explode("tested").alias("t")).select("t.*")
    mean = each.agg(F.avg("n")).first()[0] or 1.0

    def weighted(x: Column) -> Column:
        return F.least(F.greatest(F.floor((x["evidence"] + F.log(x["n"] / F.lit(mean))) * BINS), F.lit(0)), F.lit(LAST_BIN)).cast("int")

    counts = {r["bin"]: r["count"] for r in each.select(weighted(F.struct("*")).alias("bin")).groupBy("bin").count().collect()}  # LAST_BIN rows at most
    rejected_from = step_up(counts, false_discovery)
    random = F.transform(
        F.filter("tested", lambda x: weighted(x) < rejected_from),
        _span_of(len(PATTERNS)),
    )
    return tested.select("doc_id", F.array_sort(F.concat("base", random)).alias("spans"))


def step_up(counts: dict[int, int], rate: float) -> int:
    """The lowest bin of p-values (bin b: exp(-b / BINS) and less) that the step-up rule rejects at a false-discovery rate."""
    total, so_far, lowest = sum(counts.values()), 0, LAST_BIN + 1
    for b in sorted(counts, reverse=True):
        so_far += counts[b]
        if math.exp(-b / BINS) <= rate * so_far / total:
            lowest = b
    return lowest


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def base_only(spans: Column) -> Column:
    """The spans of the fixed patterns."""
    return F.filter(spans, lambda s: s["kind"] < len(PATTERNS))
