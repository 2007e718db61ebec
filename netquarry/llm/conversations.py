"""Repair of the turn structure of conversations by cheapest paths through composed weighted automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import blocks, staged

#: The six white-space characters of the contracts.
BLANK = " \t\n\x0b\x0c\r"
#: Role initials that may follow each other.
LEGAL = frozenset(("su", "ua", "au"))
#: The role grammar (s?(ua)+)? as an acceptor: states, and the state after each role initial.
START, SYSTEM, USER, ASSISTANT = range(4)
GRAMMAR = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: What the cheapest inserts to an accepting state cost, by state: nothing, user and assistant, assistant, nothing.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
FINAL = (0, 2 * INSERT, INSERT, 0)
#: Inserts in a row that can be of use; more of them come back to a state of the grammar at a cost.
MOST_INSERTS = 2
UNREACHED = 1 << 40
FULL_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Rows, and bytes of text, of a piece of a long conversation.
PIECE_ROWS, PIECE_BYTES = 1_024, 1 << 20


def kind_of(role: str, text: str) -> str:
    """A row as a symbol of the input: its role's initial (- for others), in capitals (or _) if the text is truncated, x if blank."""
    rest = text.rstrip(BLANK)
    if not rest:
        return "x"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "-"
    return initial if rest[-1] in ".!?" else initial.upper().replace("-", "_")


@lru_cache(maxsize=None)
def edits(kind: str) -> tuple[tuple[str, str, int], ...]:
    """The edit transducer's arcs that read a symbol: (label, role initial written or empty, cost). x can only be deleted."""
    if kind == "x":
        return (("D", "", DELETE),)
    extra = TRUNCATED if kind.isupper() or kind == "_" else 0
    keep = (("K", kind.lower(), KEEP + extra),) if kind.isalpha() else ()
    return (("D", "", DELETE), *keep, ("R", "u", REROLE + extra), ("R", "a", REROLE + extra))


def arcs(kinds: str, row: int, inserts: int, state: int) -> Iterator[tuple[tuple[int, int, int], str, int]]:
    """Arcs (next state, label, cost) of the composition at (rows read, inserts since, state of the grammar), made when they are asked for."""
    if row == len(kinds):
        return
    if inserts < MOST_INSERTS:
        for role in "ua":
            if (state, role) in GRAMMAR:
                yield (row, inserts + 1, GRAMMAR[state, role]), "I", INSERT
    for label, role, cost in edits(kinds[row]):
        after = GRAMMAR.get((state, role)) if role else state
        if after is not None:
            yield (row + 1, 0, after), label, cost


@lru_cache(maxsize=20_000)
def cheapest(kinds: str, ends: tuple[int, ...] = FINAL, starts: tuple[int, ...] = (START,)) -> tuple[tuple[int, str, int], ...]:
    """From each start the least weight through all symbols: (cost, labels, state of the grammar reached).

    ``ends`` is what the states reached cost further on. States of the
    composition are made in topological order (rows read, then inserts), and
    weights taken in the reverse order: the least by cost, then by the labels'
    string. A label leads from a state to one state only, and the last label
    reads a row, so no path's labels begin with all of another's; the order of
    two paths so never depends on what follows.
    """
    steps: dict[tuple[int, int, int], list] = {(0, 0, state): [] for state in starts}
    layers: list[list[tuple[int, int, int]]] = [list(steps)]
    for level in range(len(kinds) * (MOST_INSERTS + 1) + 1):
        for one in layers[level] if level < len(layers) else ():
            for after, label, cost in arcs(kinds, *one):
                steps[one].append((after, label, cost))
                if after not in steps:
                    steps[after] = []
                    own = after[0] * (MOST_INSERTS + 1) + after[1]
                    layers += [[] for _ in range(own + 1 - len(layers))]
                    layers[own].append(after)
    weights: dict[tuple[int, int, int], tuple[int, str, int]] = {}
    for layer in reversed(layers):
        for one in layer:
            best = (ends[one[2]], "", one[2]) if one[0] == len(kinds) else (UNREACHED, "", START)
            for after, label, cost in steps[one]:
                far, labels, reached = weights[after]
                if far < UNREACHED:
                    best = min(best, (cost + far, label + labels, reached))
            weights[one] = best
    return tuple(weights[0, 0, state] for state in starts)


STATES = (START, SYSTEM, USER, ASSISTANT)


@lru_cache(maxsize=None)
def _costs_of(kind: str) -> np.ndarray:
    """Costs of one symbol between states of the grammar."""
    only = [tuple(0 if state == end else UNREACHED for state in STATES) for end in STATES]
    return np.array([[w[0] for w in cheapest(kind, ends, STATES)] for ends in only], np.int64).T


def costs_through(kinds: str) -> np.ndarray:
    """Least costs through all symbols, from each state (row) to each state (column)."""
    costs = np.where(np.eye(len(STATES), dtype=bool), 0, UNREACHED)
    for kind in kinds:
        costs = np.minimum((costs[:, :, None] + _costs_of(kind)[None]).min(axis=1), UNREACHED)
    return costs


def finished(labels: str, reached: int) -> str:
    """The labels with the inserts that end a conversation."""
    return labels + "I" * (FINAL[reached] // INSERT)


def repaired(labels: str, roles: list[str], texts: list[str], state: int = START) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits, from a state of the grammar on."""
    new_roles, new_texts, at = [], [], 0
    for label in labels:
        if label in "IR":
            state = USER if state != USER else ASSISTANT
            role, text = FULL_ROLE[state], "" if label == "I" else texts[at]
        elif label == "K":
            role, text = roles[at], texts[at]
            state = GRAMMAR[state, role[0]]
        at += label != "I"
        if label != "D":
            new_roles.append(role)
            new_texts.append(text)
    return new_roles, new_texts


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, dropped) with a fault by the CRC-32 of ``conv_id:turn`` modulo 20; nulls in role, text and this key count as one space.

    0 drops the row (it stays as one with ``dropped``, so that its conversation
    is known), 1 empties the text, 2 removes its full stops, exclamation and
    question marks, 3 repeats the row, 4 makes its role user.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault").isin(0, 1), "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault") == 3, F.array(F.lit(False), F.lit(False))).otherwise(F.array(F.col("fault") == 0))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("dropped"))


def in_order(rows: DataFrame) -> DataFrame:
    """Rows dealt and sorted by conversation and turn (nulls first); of one turn by role, then text.

    Of the text its first 200 characters and its hash are the key. A last key, different for each row, lets a long conversation spread over many tasks.
    """
    keyed = rows.withColumns({"text_start": F.substring("text", 1, 200), "text_hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text_start", "text_hash", "row"]
    return keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turn", "role", "text", "dropped")


class _Piece:
    """Rows of one conversation in a task, in order."""

    def __init__(self, conv_id: object, seen: set[bytes]):
        self.conv_id, self.seen = conv_id, seen
        self.roles, self.texts, self.kinds, self.turns = [], [], [], []
        self.blank = self.duplicate = self.truncated = self.illegal = self.held = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        kind = kind_of(role, text)
        if kind == "x":
            self.blank += 1
        else:
            digest = xxhash.xxh3_128_digest(f"{len(role)}:{role}{text}".encode())
            if digest in self.seen:
                kind = "x"
                self.duplicate += 1
            else:
                self.seen.add(digest)
                self.truncated += kind.isupper() or kind == "_"
        if self.roles:
            self.illegal += self.roles[-1][:1] + role[:1] not in LEGAL
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.kinds.append(kind)
        self.held += len(text)

    def row(self, part: int, piece: int, whole: bool) -> tuple:
        kinds, roles, texts = "".join(self.kinds), self.roles, self.texts
        cost = labels = None
        first, last = (roles[0][:1], roles[-1][:1]) if roles else (None, None)
        if whole:
            cost, labels, reached = cheapest(kinds)[0]
            labels = finished(labels, reached)
            roles, texts = repaired(labels, roles, texts)
        low, high = (self.turns[0], self.turns[-1]) if self.turns else (None, None)
        return (self.conv_id, part, piece, whole, len(kinds), low, high, len(self.turns), self.blank, self.duplicate, self.truncated, self.illegal,
                first, last, kinds, cost, labels, roles, texts)


def _piece_schema(id_type: str) -> str:
    return (
        f"conv_id {id_type}, part int, piece int, whole boolean, rows bigint, low bigint, high bigint, turns bigint, blank bigint, duplicate bigint, "
        "truncated bigint, illegal bigint, first string, last string, kinds string, cost bigint, audit string, roles array<string>, texts array<string>"
    )


def _arrow(rows: list[tuple], schema: str, id_type: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64())}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def pieces_of(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Pieces of conversations, in order by (part, piece).

    A conversation that a task surely has whole is one piece, and is repaired at
    once. The first and the last of a task may go on in another, and those of
    more than ``piece_rows`` rows or about ``piece_bytes`` of text are cut: these
    pieces hold the rows as they are.
    """
    id_type = rows.schema["conv_id"].dataType.simpleString()
    schema = _piece_schema(id_type)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), [], 0
        own: _Piece | None = None
        number, is_open = 0, True  # the first may have begun in another task

        def done(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, held, made
            made.append(own.row(part, number, whole))
            number, held = number + 1, held + own.held
            if len(made) >= 256 or held >= piece_bytes:
                yield _arrow(made, schema, id_type)
                made, held = [], 0

        for batch in blocks(batches, 1_024, column=3):
            for conv_id, turn, role, text, dropped in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own is None or conv_id != own.conv_id:
                    if own is not None:
                        yield from done(not is_open)
                        is_open = False
                    own = _Piece(conv_id, set())
                elif len(own.roles) >= piece_rows or own.held >= piece_bytes:
                    is_open = True
                    yield from done(False)
                    own = _Piece(conv_id, own.seen)
                if not dropped:
                    own.add(turn, role, text)
        if own is not None:
            yield from done(False)  # the last may go on in another task
        if made:
            yield _arrow(made, schema, id_type)

    return in_order(rows).mapInArrow(cut, schema)


def _seen_before(pieces: DataFrame) -> DataFrame:
    """Rows of open pieces that an earlier task has seen: part, piece, later (their places in the piece).

    A task marks its own repeats, so a conversation's role and text meet here once for each task at most.
    """
    rows = pieces.select("conv_id", "part", "piece", "kinds", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "row")).where("substring(kinds, at + 1, 1) <> 'x'")
    place = F.struct("part", "piece", "at").alias("place")
    rows = staged(rows.select("conv_id", place, F.col("row.roles").alias("role"), F.sha2("row.texts", 256).alias("digest")), "open-rows")
    firsts = rows.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = firsts.select(F.col("conv_id").alias("first_id"), F.col("role").alias("first_role"), F.col("digest").alias("first_digest"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("first_id")) & (F.col("role") == F.col("first_role")) & (F.col("digest") == F.col("first_digest"))
    return rows.join(firsts, same).where("place <> first").groupBy("place.part", "place.piece").agg(F.collect_list("place.at").alias("later"))


def _marked(pieces: DataFrame, id_type: str) -> DataFrame:
    """Open pieces without their texts, with repeats of other tasks marked, and the costs through them."""
    schema = f"conv_id {id_type}, part int, piece int, kinds string, duplicate bigint, truncated bigint, costs array<bigint>"

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for conv_id, part, piece, kinds, duplicate, truncated, later in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                symbols = list(kinds)
                for at in later or ():
                    truncated -= symbols[at].isupper() or symbols[at] == "_"
                    symbols[at] = "x"
                kinds = "".join(symbols)
                made.append((conv_id, part, piece, kinds, duplicate + len(later or ()), truncated, costs_through(kinds).ravel().tolist()))
            if made:
                yield _arrow(made, schema, id_type)

    rows = pieces.join(_seen_before(pieces), ["part", "piece"], "left")
    return staged(rows.select("conv_id", "part", "piece", "kinds", "duplicate", "truncated", "later").mapInArrow(mark, schema), "marked")


def _costs_beyond(own: pd.DataFrame) -> pd.DataFrame:
    """What the states at the end of each piece of a conversation cost further on."""
    own, beyond = own.sort_values(["part", "piece"]), np.array(FINAL, np.int64)
    ends = []
    for costs in own["costs"].iloc[::-1]:
        ends.append(beyond)
        beyond = np.minimum((np.array(costs).reshape(len(STATES), -1) + beyond).min(axis=1), UNREACHED)
    return pd.DataFrame({"part": own["part"], "piece": own["piece"], "ends": ends[::-1], "is_last": np.arange(len(own)) == len(own) - 1})


def _states_at(own: pd.DataFrame) -> pd.DataFrame:
    """The state in which the cheapest path enters each piece of a conversation."""
    own, state, states = own.sort_values(["part", "piece"]), START, []
    for reached in own["reached"]:
        states.append(state)
        state = int(reached[state])
    return pd.DataFrame({"part": own["part"], "piece": own["piece"], "state": states, "is_first": np.arange(len(own)) == 0})


def _paths(marked: DataFrame, id_type: str) -> DataFrame:
    """The cheapest path through each open piece: conv_id, part, piece, state (before it), labels, cost (of the whole, at the first piece).

    Costs through pieces are made side by side. Of each conversation one task
    adds them from its end, at 16 numbers a piece; then each piece finds its
    cheapest labels from every state, side by side again; and one task follows the states from piece to piece.
    """
    schema = f"conv_id {id_type}, part int, piece int, labels array<string>, reached array<bigint>, costs array<bigint>"

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for conv_id, part, piece, kinds, ends, is_last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = cheapest(kinds, tuple(ends), STATES)
                labels = [finished(w[1], w[2]) if is_last else w[1] for w in found]
                made.append((conv_id, part, piece, labels, [w[2] for w in found], [w[0] for w in found]))
            if made:
                yield _arrow(made, schema, id_type)

    ends = marked.select("conv_id", "part", "piece", "costs").groupBy("conv_id").applyInPandas(_costs_beyond, "part int, piece int, ends array<bigint>, is_last boolean")
    chosen = marked.join(ends, ["part", "piece"]).select("conv_id", "part", "piece", "kinds", "ends", "is_last").mapInArrow(choose, schema)
    chosen = staged(chosen, "chosen")
    states = chosen.select("conv_id", "part", "piece", "reached").groupBy("conv_id").applyInPandas(_states_at, "part int, piece int, state int, is_first boolean")
    own = lambda c: F.element_at(c, F.col("state") + 1)
    return staged(chosen.join(states, ["part", "piece"]).select("conv_id", "part", "piece", "state", own("labels").alias("labels"), F.when(F.col("is_first"), own("costs")).alias("cost")), "paths")


def _pieces_repaired(pieces: DataFrame, paths: DataFrame, id_type: str) -> DataFrame:
    schema = f"conv_id {id_type}, part int, piece int, roles array<string>, texts array<string>"

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                conv_id, part, piece, roles, texts, labels, state = (c[at].as_py() for c in batch.columns)
                yield _arrow([(conv_id, part, piece, *repaired(labels, roles, texts, state))], schema, id_type)

    rows = pieces.join(paths.drop("conv_id"), ["part", "piece"])
    return staged(rows.select("conv_id", "part", "piece", "roles", "texts", "labels", "state").mapInArrow(repair, schema), "repaired")


#: Columns of a conversation's summary.
SUMMARY = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


@dataclass
class Repair:
    """Repaired conversations: ``whole`` ones with their turns, and ``long`` ones (or those that lay in two tasks), whose turns are in ``pieces``."""

    whole: DataFrame
    long: DataFrame
    pieces: DataFrame

    def conversations(self) -> DataFrame:
        """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
        return self.whole.select(*SUMMARY).unionByName(self.long.select(*SUMMARY))

    def turns(self) -> DataFrame:
        """The repaired turns: conv_id, part, piece, place (in order by these three), role, text."""
        own = ["conv_id", "part", "piece", "roles", "texts"]
        both = self.whole.select(*own).unionByName(self.pieces.select(*own))
        return both.select("conv_id", "part", "piece", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "turn")).select(
            "conv_id", "part", "piece", "place", F.col("turn.roles").alias("role"), F.col("turn.texts").alias("text"))

    def digests(self) -> DataFrame:
        """The summary with repaired_sha256: SHA-256 of the repaired ``role:text``, joined by newlines.

        A long conversation's pieces go through one task in order, which holds one
        piece at a time, as the digest of a text can't be made from those of its parts.
        """
        lines = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda t: F.concat(t["roles"], F.lit(":"), t["texts"])), "\n")
        id_type = self.pieces.schema["conv_id"].dataType.simpleString()
        schema = f"hashed_id {id_type}, repaired_sha256 string"

        def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, hasher, begun, made = None, None, False, []
            for batch in batches:
                for conv_id, text, turns in zip(*(batch.column(k) for k in (0, 3, 4)), strict=True):
                    conv_id = conv_id.as_py()
                    if hasher is None or conv_id != own:
                        if hasher is not None:
                            made.append((own, hasher.hexdigest()))
                        own, hasher, begun = conv_id, hashlib.sha256(), False
                    if turns.as_py():
                        hasher.update((b"\n" if begun else b"") + text.as_py().encode())
                        begun = True
            if hasher is not None:
                made.append((own, hasher.hexdigest()))
                yield _arrow(made, schema, id_type)

        keys = ["conv_id", "part", "piece"]
        pieces = self.pieces.select(*keys, lines.alias("lines"), F.size("roles").alias("n"))
        hashed = pieces.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "piece").mapInArrow(digest, schema)
        long = self.long.join(hashed, F.col("conv_id").eqNullSafe(F.col("hashed_id")))
        return self.whole.select(*SUMMARY, F.sha2(lines, 256).alias("repaired_sha256")).unionByName(long.select(*SUMMARY, "repaired_sha256"))


def repair_conversations(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> Repair:
    """Make each conversation's roles follow ``(s?(ua)+)?`` by the cheapest edits.

    ``rows``: conv_id, turn, role, text, dropped. Dropped rows don't count, but
    their conversation is known. Rows are taken by turn, nulls first, those of
    one turn by role and text. Keep costs 0, Rerole 3, Delete 4 (a must for blank
    and repeated rows), Insert of an empty turn 3, a truncated row that stays 3
    more. Of equally cheap edits those whose initials are least stand.

    The rows as an acceptor, the edits as a transducer and the grammar of roles
    as an acceptor are composed as far as paths reach. Rows move once, by ranges
    of conversation and turn; a conversation of any length so spreads over
    tasks, and its pieces are weighed side by side (``_paths``).

    Null roles and texts count as one space. Rows with a null conv_id are one
    conversation. A conversation without rows has zeros, no edits and no turns.
    Other columns are ignored; an empty table gives no row.
    """
    spaced = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *spaced, "dropped")
    id_type = rows.schema["conv_id"].dataType.simpleString()
    cut = staged(pieces_of(rows, piece_rows, piece_bytes), "pieces")
    gaps = lambda low, high, turns: F.coalesce(high - low + 1 - turns, F.lit(0).cast("long")).alias("gaps")
    whole = cut.where("whole").withColumn("gaps", gaps(F.col("low"), F.col("high"), F.col("turns")))

    pieces = cut.where("NOT whole")
    marked = _marked(pieces, id_type)
    paths = _paths(marked, id_type)
    before = W.partitionBy("conv_id").orderBy("part", "piece").rowsBetween(W.unboundedPreceding, -1)
    last = lambda c: F.last(c, ignorenulls=True).over(before)
    counts = pieces.drop("kinds", "roles", "texts", "duplicate", "truncated", "cost", "audit").withColumns({"last_before": last("last"), "high_before": last("high")})
    pair = F.concat("last_before", "first")
    counts = counts.withColumns({
        "illegal": F.col("illegal") + F.when(~pair.isin(*LEGAL), 1).otherwise(0),
        "turns": F.col("turns") - F.when(F.col("low") == F.col("high_before"), 1).otherwise(0),
    })
    told = counts.join(marked.select("part", "piece", "duplicate", "truncated"), ["part", "piece"]).join(paths.drop("conv_id"), ["part", "piece"])
    labels = F.transform(F.array_sort(F.collect_list(F.struct("part", "piece", "labels"))), lambda p: p["labels"])
    long = told.groupBy("conv_id").agg(
        gaps(F.min("low"), F.max("high"), F.sum("turns")),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.array_join(labels, "").alias("audit"),
    )
    return Repair(whole, long, _pieces_repaired(pieces, paths, id_type))
