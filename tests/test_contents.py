"""Carving across block edges, ways in time, and the decoding search, against brute force."""

from __future__ import annotations

import base64
import gzip
import itertools
import random
from hashlib import sha256

import pytest

from netquarry.functions.decoding import DECODERS, best_decoding, decoded
from netquarry.operators.carving import ENDS, SIGNATURES, carved, extents, marks
from netquarry.operators.paths import host_paths


def blocks_of(spark, streams, size):
    rows = [(f"c{n}", "s", "a", 1, k, data[k * size : (k + 1) * size]) for n, data in enumerate(streams) for k in range(-(-len(data) // size))]
    return spark.createDataFrame(rows, "capture string, stream_id string, src string, sport int, block long, data binary").repartition(3)


@pytest.fixture(scope="module")
def streams():
    rng = random.Random(4)
    bits = [m for _, m, *_ in (*SIGNATURES, *ENDS)] + [b"PK\x03\x04", b"\xff", b"\x89PN", b"text", b"\0" * 30, b"%%", b"GIF8GIF8"]
    return [b"".join(rng.choice(bits) + bytes(rng.randrange(256) for _ in range(rng.randrange(6))) for _ in range(120)) for _ in range(6)]


@pytest.mark.parametrize("size", [8, 13, 100, 1 << 20])
def test_marks_are_all_found_once(spark, streams, size):
    got = [(int(r.capture[1:]), r.offset, r.kind, r.is_end, r.size) for r in marks(blocks_of(spark, streams, size)).collect()]
    want = []
    for n, data in enumerate(streams):
        for end, group in ((False, [(k, m, 0) for k, m in SIGNATURES]), (True, ENDS)):
            want += [(n, at, kind, end, len(mark) + more) for kind, mark, more in group for at in range(len(data)) if data.startswith(mark, at)]
    assert sorted(got) == sorted(want)


def test_extents_like_brackets(spark, streams):
    found = marks(blocks_of(spark, streams, 64)).persist()
    got = sorted((int(r.capture[1:]), r.kind, r.offset, r.end) for r in extents(found).collect())
    want = []
    for (capture, kind), own in itertools.groupby(sorted(found.where("kind NOT IN ('ELF', 'GZIP', 'RAR')").collect(), key=lambda r: (r.capture, r.kind, r.offset, r.is_end)), key=lambda r: (r.capture, r.kind)):
        opened: list[int] = []
        for r in own:
            if not r.is_end:
                opened.append(r.offset)
            elif opened:
                want.append((int(capture[1:]), kind, opened.pop(), r.offset + r.size))
                if kind not in ("JPG", "PDF", "ZIP"):
                    opened.clear()
    assert got == sorted(want) and len(got) > 30
    inside = {(r.capture, r.kind, r.offset): r.inside for r in extents(found).collect()}
    for r in extents(found).collect():
        assert inside[r.capture, r.kind, r.offset] == any(int(r.capture[1:]) == n and (o < r.offset and e >= r.end or o == r.offset and e > r.end) for n, _, o, e in got)


@pytest.mark.parametrize("size", [8, 50, 1 << 20])
def test_contents_of_extents(spark, streams, size):
    blocks = blocks_of(spark, streams, size)
    files = extents(marks(blocks_of(spark, streams, 64))).persist()
    got = carved(blocks, files, most_bytes=400).collect()
    assert len(got) == files.where("end - offset <= 400").count() > 20
    for r in got:
        data = streams[int(r.capture[1:])][r.offset : r.end]
        assert bytes(r.data) == data and r.sha256 == sha256(data).hexdigest()


def test_no_blocks(spark):
    blocks = blocks_of(spark, [b"", b"nothing here"], 8)
    assert marks(blocks).count() == 0 and carved(blocks, extents(marks(blocks))).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_paths_against_all_ways(spark, seed):
    rng = random.Random(seed)
    hosts = "abcdefgh"
    steps = [(rng.choice([*hosts, None]), rng.choice(hosts), rng.choice([None, *range(30)])) for _ in range(60)]
    origins = [("a", 3), ("b", 10), ("a", 0), (None, 1), ("z", 1)]
    got = {(r.origin, r.host): (r.hops, r.arrived, tuple(r.path)) for r in host_paths(spark.createDataFrame(steps, "src string, dst string, at long"), spark.createDataFrame(origins, "host string, at long"), 4).collect()}
    want = {}
    ways = [(("a",), 0), (("b",), 10), (("z",), 1)]
    for hops in range(1, 5):
        ways = [((*path, dst), at) for path, arrived in ways for src, dst, at in steps if src == path[-1] and at is not None and at > arrived and dst not in path]
        for path, arrived in ways:
            key, own = (path[0], path[-1]), (hops, arrived, path)
            want[key] = min(want.get(key, own), own)
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    for (origin, host), (hops, _, path) in got.items():
        assert path[0] == origin and path[-1] == host and len(path) == hops + 1


TEXT = "The password for the old server is under the third stone from the left"


def test_chains_of_decoders():
    enc = {
        "base64": lambda v: base64.b64encode(v.encode()).decode(), "hex": lambda v: v.encode().hex(), "base32": lambda v: base64.b32encode(v.encode()).decode(), "reverse": lambda v: v[::-1],
        "bits": lambda v: "".join(f"{b:08b}" for b in v.encode()), "rot13": DECODERS["rot13"],
    }
    for chain in itertools.product(enc, repeat=2):
        if chain[0] in ("reverse", "rot13") and chain[1] in ("reverse", "rot13"):
            continue
        if chain[0] == "reverse":
            continue  # letters alone do not tell which way a text runs
        value = TEXT
        for name in chain:
            value = enc[name](value)
        text, found, _ = best_decoding(value)
        assert text == TEXT, (chain, found, text[:80])
    packed = base64.b64encode(gzip.compress(TEXT.encode() * 50)).decode()
    assert best_decoding(packed)[:2] == (TEXT * 50, ("base64",))
    assert best_decoding(TEXT)[1] == () and best_decoding("flag%7Bsome_thing%7D")[0] == "flag{some_thing}"


def test_search_is_bounded():
    bomb = base64.b64encode(gzip.compress(b"a" * (1 << 24))).decode()
    assert best_decoding(bomb)[1] == () or len(best_decoding(bomb)[0]) <= 1 << 22
    best_decoding("A" * 200_000)
    best_decoding("%41" * 100_000)


def test_rows_of_odd_values(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, TEXT), (4, TEXT.encode().hex())], "id long, v string")
    assert sorted((r.id, r.decoded, r.chain) for r in decoded(rows, "v").collect()) == [(1, None, None), (2, None, None), (3, None, None), (4, TEXT, "hex")]
