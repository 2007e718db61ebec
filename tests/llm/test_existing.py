"""Operators 5, 6, 7, 8 and 9 against the tokenizers library, brute force and held-out labels."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from netquarry.llm.bpe import bpe_encode
from netquarry.llm.components import connected_components
from netquarry.llm.exact_dedup import drop_copies, exact_dedup
from netquarry.llm.langid import identify_language
from netquarry.llm.ngram_join import near_duplicate_components
from netquarry.llm.queries import QUERIES, tokenizer_path
from netquarry.llm.toxicity import find_toxic, maximal_segments

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, first=1):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts, first)], DOCS)


# ---- operator 5


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    found = t.encode_batch(texts, add_special_tokens=False)
    return [e.ids for e in found], [t.decode(e.ids, skip_special_tokens=False) for e in found]


HARD = [
    "", " ", "it's We'LL they'd 'S", "a" * 5000, "the " * 3000, "ÀÉÎ ñ ΣΑΣ σς İ ı ß ﬁ Ǆ", "é Å ẛ̣", "日本語 テキスト 123 ½ ²",
    "<|endoftext|>x<|startoftext|> <|endoftext|", "x\x1cy\x1dz \x85   q", "emoji 👩‍👩‍👧 🇩🇪", "tab\tnew\nline\r\n", "#$%&!?...--- 3.14e-10", "\u0000\u0001 ﻿ a​b",
]


def test_bpe_matches_library(spark, sf_dir):
    texts = HARD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    ids, decoded = library_ids(texts)
    rows = bpe_encode(docs(spark, texts, 0).repartition(3), tokenizer_path("word_bpe_49k.json")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.doc_id], texts[r.doc_id][:100]
        assert r.decoded == decoded[r.doc_id] and r.n_tokens == len(ids[r.doc_id])


def test_bpe_edge_rows(spark):
    rows = bpe_encode(docs(spark, [None, ""]), tokenizer_path("word_bpe_49k.json")).collect()
    assert [(r.n_tokens, r.decoded) for r in rows] == [(0, ""), (0, "")]
    assert bpe_encode(docs(spark, []), tokenizer_path("word_bpe_49k.json")).count() == 0


# ---- operator 6


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_ngram_join_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(60):
        base = list(rng.choice(vocabulary, rng.integers(1, 120)))
        texts.append(" ".join(base))
        for _ in range(rng.integers(0, 5)):
            own = list(base)
            for _ in range(rng.integers(0, 4)):
                own[rng.integers(len(own))] = str(rng.choice(vocabulary))
            texts.append(("  ".join(own)).upper())
    texts += ["", None, "  ", "one", "ONE", "one two", "one two"]
    found = near_duplicate_components(docs(spark, texts).repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(list(enumerate(texts, 1)))


def test_ngram_join_on_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = QUERIES["op6_ngram_jaccard"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows)


def test_ngram_join_edge_rows(spark):
    assert near_duplicate_components(docs(spark, [])).count() == 0
    rows = spark.createDataFrame([(None, "a b", 1), (4, "a b", 1), (4, "a b", 1)], "doc_id bigint, text string, component_id int")
    assert sorted((r.doc_id or 0, r.component_id) for r in near_duplicate_components(rows).collect()) == [(0, 4), (4, 4), (4, 4)]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7)], "a bigint, b bigint")
    found = {r.id: r.component_id for r in connected_components(links).collect()}
    assert found == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}


# ---- operator 7


def test_segments_match_definition():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = rng.normal(-0.3, 1, rng.integers(1, 12))
        found = maximal_segments(x)
        left, expected = [(0, len(x))], []
        while left:  # the highest-scoring segment, then what lies on both sides
            a, b = left.pop()
            best = max(((x[i:j].sum(), -i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
            if best[0] > 0:
                expected.append((-best[1], best[2], best[0]))
                left += [(a, -best[1]), (best[2], b)]
        assert sorted(s[:2] for s in found) == sorted(s[:2] for s in expected)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = find_toxic(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    rows = found.where("held_out").join(labels, "doc_id").select("score", "toxic").collect()
    s, y = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    pairs = s[y == 1][:, None] - s[y == 0][None, :]
    auc = (pairs > 0).mean() + (pairs == 0).mean() / 2
    assert len(y) > 100 and auc > 0.85
    assert ((s >= 0.5) == (y == 1)).mean() > max(y.mean(), 1 - y.mean())


def test_toxicity_edge_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id bigint, toxic int")
    found = find_toxic(docs(spark, ["bad bad", "good", None, ""]), labels).collect()
    assert len(found) == 4 and all(0 <= r.score <= 1 for r in found)
    assert find_toxic(docs(spark, []), labels.limit(0)).count() == 0


# ---- operator 8


def test_exact_dedup_matches_brute_force(spark):
    texts = ["a b", "ab", "a  b ", "AB", "", None, " \t", "x y", "xy", "ab"]
    rows = exact_dedup(docs(spark, texts).repartition(4)).collect()
    groups: dict[str, list] = {}
    for i, t in enumerate(texts, 1):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    expected = {}
    for key, own in groups.items():
        keep = min(own)[1]
        for _, i in own:
            expected[i] = (keep, len(own), i == keep, hashlib.sha256(key.encode()).hexdigest())
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows} == expected
    assert len(rows) == len(texts)


def test_drop_copies_keeps_columns_and_rows(spark):
    frame = docs(spark, ["a", "a ", "b", None, ""])
    kept = drop_copies(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert drop_copies(docs(spark, [])).count() == 0


def test_drop_copies_of_repeated_ids(spark):
    frame = spark.createDataFrame([(1, "a"), (1, "a"), (1, "other"), (None, "n"), (None, "n"), (None, "m")], "doc_id bigint, text string")
    assert sorted(r.text for r in drop_copies(frame).collect()) == ["a", "m", "n", "other"]


# ---- operator 9


def test_language_id_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    found = identify_language(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = found.where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 100 and np.mean([r.lang_pred == r.lang for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("texts", [[None, "", "123 !?"], []])
def test_language_id_without_letters(spark, texts):
    rows = identify_language(docs(spark, texts)).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)] * len(texts)
