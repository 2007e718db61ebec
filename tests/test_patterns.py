"""Event patterns against a walk over every way through the events."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from netquarry.operators import patterns
from netquarry.operators.patterns import Step, sequences, spread, unprepared

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    own = [(n, rng.choice([1, 1, 1, 2, None]), START + dt.timedelta(seconds=rng.randrange(4_000)), rng.choice(["a", "b", "c", "x", None])) for n in range(900)]
    return own + [(1_000 + n, 1, None, "a") for n in range(3)]


@pytest.fixture(scope="module")
def events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, kind string").repartition(4)


def ways(rows, steps):
    """For each event that completes the steps, by (key, event): the starts of all ways to it."""
    found = {}
    by = {}
    for event, key, ts, kind in rows:
        if ts is not None:
            by.setdefault(key, []).append((ts, event, kind))
    for key, own in by.items():
        own.sort()
        reach = [{n: {(own[n][1], own[n][0])} for n in range(len(own)) if own[n][2] == steps[0][0]}]
        for kind, within, unless in steps[1:]:
            after = {}
            for n, (ts, _, own_kind) in enumerate(own):
                if own_kind != kind:
                    continue
                for m, starts in reach[-1].items():
                    if m < n and (within is None or (ts - own[m][0]).total_seconds() <= within) and not any(unless and own[k][2] == unless for k in range(m + 1, n)):
                        after.setdefault(n, set()).update(starts)
            reach.append(after)
        for n, starts in reach[-1].items():
            found[key, own[n][1]] = (own[n][0], starts)
    return found


SEQUENCES = [
    [("a", None, None), ("b", 60, None)],
    [("a", None, None), ("b", 30, "x"), ("c", 45, "x")],
    [("a", None, None), ("a", 20, None), ("a", 20, "b")],
    [("a", None, None), ("b", None, "x"), ("c", None, None)],
]


def as_steps(steps):
    return [Step(f"kind = '{k}'", within, unless and f"kind = '{unless}'") for k, within, unless in steps]


@pytest.mark.parametrize("steps", SEQUENCES)
@pytest.mark.parametrize("span", [86_400_000_000, 1])
def test_sequences(spark, rows, events, steps, span, monkeypatch):
    monkeypatch.setattr(patterns, "spread", lambda *a: spread(*a, least_span=span))
    want = ways(rows, steps)
    got = {(r.user_id, r.event): (r.start, r.micros) for r in sequences(events, ["user_id"], as_steps(steps)).collect()}
    assert got.keys() == want.keys() and want
    for own, (start, micros) in got.items():
        ts, starts = want[own]
        assert start in {s for s, _ in starts}
        assert micros == (ts - dict(starts)[start]) // dt.timedelta(microseconds=1)
        if len(steps) == 2:
            assert micros == min((ts - at) // dt.timedelta(microseconds=1) for _, at in starts)


@pytest.mark.parametrize("span", [86_400_000_000, 1])
def test_unprepared(spark, rows, events, span, monkeypatch):
    monkeypatch.setattr(patterns, "spread", lambda *a: spread(*a, least_span=span))
    steps = SEQUENCES[1]
    *before, last = as_steps(steps)
    got = [(r.user_id, r.event) for r in unprepared(events, ["user_id"], before, last).collect()]
    every = {(key, event) for event, key, ts, kind in rows if kind == "c" and ts is not None}
    assert len(got) == len(set(got)) and set(got) == every - ways(rows, steps).keys()


def test_spans_keep_every_row_once(spark, events):
    placed, parts = spread(events.withColumn("at", patterns.micros("ts")).where("at IS NOT NULL"), ["user_id"], "at", 10_000_000, least_span=1)
    assert parts == ["user_id", "span"]
    assert placed.where("own").count() == 900
    assert placed.where("NOT own").count() < 900 and placed.select("span").distinct().count() > 50


def test_no_events(spark, events):
    assert sequences(events.limit(0), ["user_id"], as_steps(SEQUENCES[0])).count() == 0
