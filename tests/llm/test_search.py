"""Operators 4 and 10 and the pipeline against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from netquarry.llm.chunk_dedup import GEAR, chunk_cuts, drop_repeated_passages, gear_hashes, repeated_passages
from netquarry.llm.decontaminate import closest, drop_contaminated, find_contaminated, plain_word

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ITEMS = "item_id bigint, text string"


def docs(spark, texts, first=1):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts, first)], DOCS)


def prose(rng, n, letters="abcdefghijklmnop"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(n))


# ---- operator 4


def test_gear_hash_matches_its_recurrence():
    data = np.frombuffer(random.Random(2).randbytes(500), np.uint8)
    h, expected = 0, []
    for b in data.tolist():
        h = ((h << 1) + int(GEAR[b])) & 0xFFFFFFFF
        expected.append(h)
    assert gear_hashes(data).tolist() == expected


def brute_cuts(text, around=11, longest=96):
    """Chunk boundaries by their definition, byte by byte."""
    hashes, h = [], 0
    for b in text:
        h = ((h << 1) + int(GEAR[b])) & 0xFFFFFFFF
        hashes.append(h)
    at = lambda i: hashes[i] if 0 <= i < len(hashes) else 1 << 32
    cuts = [0]
    for i in range(1, len(text)):
        if all(at(i) < at(i - k) and at(i) <= at(i + k) for k in range(1, around + 1)):
            cuts.append(i)
    cuts = sorted({*cuts, len(text)})
    return sorted({*cuts, *(c for a, b in zip(cuts, cuts[1:], strict=False) for c in range(a + longest, b, longest))})


def brute_passages(texts, least=20, chunks=4):
    """(doc, start, end, words, keep) of each part, by the definition of cuts, windows, runs and parts."""
    windows, places = {}, {}
    for d, text in enumerate(texts):
        raw = (text or "").encode()
        cuts = brute_cuts(raw)
        words, points = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)], [len(raw[:i].decode(errors="ignore")) for i in range(len(raw) + 1)]
        for k in range(len(cuts) - chunks):
            a, b = cuts[k], cuts[k + chunks]
            inside = [n for n, (x, y) in enumerate(words) if x >= a and y <= b]
            places[d, k] = (points[words[inside[0]][0]], points[words[inside[-1]][1]], inside[0], inside[-1] + 1) if inside else None
            windows.setdefault(raw[a:b], []).append((d, k))
    first = {w: min(own)[0] for own in windows.values() if min(own)[0] < max(own)[0] for w in own}
    found, runs = set(), []
    for d, k in sorted(first):
        if (d, k - 1) in first:
            runs[-1].append((d, k))
        else:
            runs.append([(d, k)])
    for run in runs:
        own = [places[w] for w in run if places[w]]
        if not own or max(x[3] for x in own) - min(x[2] for x in own) < least:
            continue
        parts = [[run[0]]]
        for w in run[1:]:
            if first[w] == first[parts[-1][-1]]:
                parts[-1].append(w)
            else:
                parts.append([w])
        for part in parts:
            own = [places[w] for w in part if places[w]]
            if own:
                found.add((part[0][0], min(x[0] for x in own), max(x[1] for x in own), max(x[3] for x in own) - min(x[2] for x in own), first[part[0]]))
    return found


def test_cuts_match_their_definition():
    rng = random.Random(12)
    texts = [b"", b"a", b"\0" * 700, b"@" * 500, b"ab" * 300, prose(rng, 400).encode(), bytes(rng.choices(range(256), k=3000)), "é ñ ".encode() * 90]
    for text, own in zip(texts, chunk_cuts(texts), strict=True):
        assert own.tolist() == brute_cuts(text)


def passage_rows(frame, **options):
    return {(r.doc_id, r.start, r.end, r.n_words, r.keep_doc_id) for r in repeated_passages(frame, **options).collect()}


def test_passages_match_brute_force(spark):
    rng = random.Random(5)
    passages = [prose(rng, n, "abcdeé") for n in (25, 40, 60, 60, 90, 200)]
    texts = []
    for i in range(60):
        text = prose(rng, rng.randint(5, 120))
        if i % 3 == 0:
            text += "\n" + passages[i // 3 % 6] + " " + prose(rng, rng.randint(0, 30))
        if i % 10 == 0:
            text += passages[5] + passages[2]
        texts.append(text)
    texts += ["", None, passages[0], "x" * 5000, "x" * 4000]
    frame = docs(spark, texts, 0).selectExpr("*", "1 AS seq", "2 AS hi", "3 AS word", "4 AS other_id", "5 AS salt")
    expected = brute_passages(texts)
    assert len(expected) > 20 and passage_rows(frame.repartition(5)) == expected


@pytest.mark.parametrize("n", [51, 60, 120])
def test_long_passages_are_found_nearly_whole(spark, n):
    rng = random.Random(n)
    passages = [prose(rng, n) for _ in range(40)]
    texts = [f"{prose(rng, 9)} {i}é {p} ~{i} {prose(rng, 9)}" for i, p in enumerate(passages + passages)] + [prose(rng, 300) for _ in range(30)]
    rows = repeated_passages(docs(spark, texts, 0)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(80))
    for r in rows:
        p = passages[r.doc_id % 40]
        own = texts[r.doc_id][r.start : r.end]
        assert own in p and len(own) >= len(p) - 130 and r.keep_doc_id == r.doc_id % 40 and r.kept == (r.doc_id < 40)


def test_cutting_passages_loses_no_content(spark):
    rng = random.Random(11)
    p, q = prose(rng, 60), prose(rng, 50)
    mixed = [prose(rng, 12) for _ in range(6)]
    texts = [prose(rng, 9), prose(rng, 20) + " " + p, p + " " + q, prose(rng, 30) + " " + q + " " + prose(rng, 8), " ".join(mixed)]
    texts += [prose(rng, 12) + " " + m + "\t" + prose(rng, 12) for m in mixed]  # each part of document 4 stands elsewhere, the whole nowhere
    frame = docs(spark, texts + [None, p], 0).selectExpr("*", "1 AS cuts", "2 AS row")
    left = drop_repeated_passages(frame)
    assert left.columns == frame.columns
    found = {r.doc_id: r.text for r in left.collect()}
    assert [found[i] for i in (0, 1, *range(4, 12))] == [texts[i] for i in (0, 1, *range(4, 11))] + [None]
    assert q[60:-60] in found[2] and p[60:-60] not in found[2] and q[60:-60] not in found[3] and len(found[12]) < 100


def test_passages_without_ids_and_repeated_rows(spark):
    rng = random.Random(7)
    p, tail = prose(rng, 80), prose(rng, 20)
    one = spark.createDataFrame([(1, p + p), (1, p + p), (2, "")], "doc_id bigint, text string")
    assert repeated_passages(one).count() == 0 and drop_repeated_passages(one).count() == 3
    rows = spark.createDataFrame([(1, p), (None, p + " " + tail), (None, p + " " + tail), (None, tail + " " + p)], "doc_id bigint, text string")
    found = repeated_passages(rows).collect()
    assert {(r.doc_id, r.keep_doc_id, r.kept) for r in found} == {(1, 1, True), (None, 1, False)}
    found = repeated_passages(rows.where("doc_id IS NULL")).collect()
    assert {(r.doc_id, r.keep_doc_id) for r in found} == {(None, None)} and {r.kept for r in found} == {True, False}
    assert repeated_passages(docs(spark, [])).count() == 0


def test_frequent_windows_change_nothing(spark, monkeypatch):
    from netquarry.llm import chunk_dedup

    rng = random.Random(8)
    shared = prose(rng, 60)
    texts = [f"{prose(rng, rng.randint(1, 40))} {shared} {prose(rng, 9)}" for _ in range(200)]
    expected = passage_rows(docs(spark, texts, 0))
    assert len({r[0] for r in expected}) == 200 and 0 in {r[4] for r in expected}
    monkeypatch.setattr(chunk_dedup, "_frequent", lambda w, t, f=chunk_dedup._frequent: f(w, t, least=50))
    assert passage_rows(docs(spark, texts, 0)) == expected


def test_very_long_text_of_one_byte(spark):
    found = repeated_passages(docs(spark, ["z" * 5_000_000, "z" * 200, "a z"], 0)).collect()
    assert found == []


# ---- operator 10


def brute(item, text):
    """Fewest word edits from the item to any part of the text."""
    x, y = ([w for w in map(plain_word, t.split()) if w] for t in (item, text or ""))
    row = [0] * (len(y) + 1)
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_closest_matches_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(100):
        item, region = rng.integers(1, 4, rng.integers(1, 8)), rng.integers(0, 4, rng.integers(0, 12))
        edits, a, b = closest(item, region)
        text = " ".join(map(str, region))
        assert edits == brute(" ".join(map(str, item)), text) and brute(" ".join(map(str, item)), " ".join(map(str, region[a:b]))) == edits


def test_decontamination_reaches_its_recall(spark):
    rng = random.Random(9)
    items = [prose(rng, rng.randint(15, 60), "abcde") for _ in range(30)]
    texts = []
    for i in range(150):
        words = items[i % 30].split()
        for _ in range(i % 9):
            at, kind = rng.randrange(len(words)), rng.randrange(3)
            words[at : at + (kind != 0)] = [] if kind == 1 else [prose(rng, 1)]
        texts.append(prose(rng, rng.randint(0, 60)) + " " + " ".join(words).upper() + "!! " + prose(rng, 20))
    texts += [prose(rng, 300, "abcde") for _ in range(50)]
    found = find_contaminated(docs(spark, texts).repartition(3), spark.createDataFrame(list(enumerate(items)), ITEMS)).collect()
    got = {(r.doc_id, r.item_id): r.edits for r in found}
    expected = {}
    for d, t in enumerate(texts, 1):
        for i, item in enumerate(items):
            if (edits := brute(item, t)) <= 0.2 * len(item.split()):
                expected[d, i] = edits
    assert len(expected) > 90 and set(got) <= set(expected)
    assert len(got) >= 0.95 * len(expected)
    assert all(k in got and got[k] == 0 for k, e in expected.items() if e == 0)
    assert np.mean([got[k] == expected[k] for k in got]) > 0.95


@pytest.mark.parametrize("item", ["word " * 319, "word " * 400, "one", "two words", "日本語テキスト"])
def test_exact_copies_of_items_of_any_length(spark, item):
    items = spark.createDataFrame([(1, item)], ITEMS)
    texts = ["before, " + item + "  after", item, "before after", "wor x", item.upper().replace(" ", " !! ")]
    found = find_contaminated(docs(spark, texts, 0), items).collect()
    assert sorted((r.doc_id, r.edits) for r in found) == [(0, 0), (1, 0), (4, 0)]


def test_decontamination_edge_rows(spark):
    item = "one two three four five six"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "one"), (5, item)], ITEMS)
    frame = spark.createDataFrame([(1, item, 1), (1, item, 1), (2, None, 2), (3, "", 3), (None, "x " + item, 4), (5, "one two", 5)], "doc_id bigint, text string, item_id int")
    found = find_contaminated(frame, items)
    whole, short = [(0, 1, 1), (0, 5, 1), (1, 1, 0), (1, 1, 0), (1, 5, 0), (1, 5, 0)], [(0, 4, 1), (1, 4, 0), (1, 4, 0), (5, 4, 0)]
    assert sorted((r.doc_id or 0, r.item_id, r.first_word) for r in found.collect()) == sorted(whole + short)
    assert sorted(r.doc_id for r in drop_contaminated(frame, items).collect()) == [2, 3]
    assert find_contaminated(frame, items.limit(0)).count() == 0
    assert find_contaminated(frame.limit(0), items).count() == 0
    assert drop_contaminated(frame, items.limit(0)).count() == 6


# ---- the pipeline


def test_pipeline_keeps_what_it_should(spark, sf_dir):
    from tests.llm.test_existing import brute_components, library_ids

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in documents.collect()}
    left = {d: t for d, t in texts.items() if any(c.isalpha() for c in t)}
    by_text: dict[str, list] = {}
    for d, t in left.items():
        by_text.setdefault("".join(t.split()), []).append((-len(t), d))
    left = {min(own)[1]: texts[min(own)[1]] for own in by_text.values()}
    parts = brute_components(list(left.items()))
    left = {d: t for d, t in left.items() if parts[d][1] == d}
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(got) and set(got) <= set(left)
    for d in set(left) - set(got):
        assert any(brute(i, left[d]) <= 0.2 * len(i.split()) for i in items), d
    ids, decoded = library_ids([texts[d] for d in got])
    for r, own, text in zip(got.values(), ids, decoded, strict=True):
        assert r.n_tokens == len(own) and np.frombuffer(r.ids, "<u4").tolist() == own and r.decoded == text


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns(spark, sf_dir, stage):
    frame = docs(spark, ["some words here", None, "", "123"]).selectExpr("*", "1 AS row", "2 AS row_id", "3 AS dropped_id", "4 AS text_sha256", "5 AS n")
    kept = stage(spark, frame, sf_dir)
    assert kept.columns == frame.columns and kept.count() <= 4
    assert stage(spark, frame.limit(0), sf_dir).count() == 0


def test_language_stage_tells_foreign_scripts_from_short_texts(spark, sf_dir):
    from netquarry.llm.langid import fit_languages, keep_known_languages

    rng = random.Random(6)
    scripts = ["абвгдежзийклмнопрст", "αβγδεζηθικλμνξοπρστ", "אבגדהוזחטיכלמנסעפצ", "กขคงจฉชซญดตถทธนบปผ"]
    foreign = [prose(rng, rng.randint(1, 80), s) for s in scripts for _ in range(60)]
    clean = ["Avec.", "A.", "Über", "où?", "año 1999", "é", "the"]
    model = fit_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kept = keep_known_languages(docs(spark, foreign + clean + ["123", "", None], 0), model).collect()
    assert sorted(r.text for r in kept) == sorted(clean)
