"""Findings that once were lost: strings behind a dropped match, items in scripts without spaces, rows of repeated ids."""

from __future__ import annotations

import random
import re
import string

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from netquarry.llm.decontaminate import drop_contaminated, find_contaminated
from netquarry.llm.secrets import KINDS, PATTERNS, STRETCH, _masked, find_secrets

LETTERS = string.ascii_letters + string.digits


def random_string(rng, size):
    return "".join(rng.choice(LETTERS) for _ in range(size))


def test_strings_behind_dropped_matches_are_found(spark):
    rng = random.Random(3)
    rows = [
        (1, "password=token:" + random_string(rng, 40), [("random", 15, 55)]),
        (2, "api_key:secret='" + random_string(rng, 40), [("random", 16, 56)]),
        (3, "password=abcdefghij " + random_string(rng, 64), [("assign", 0, 19), ("random", 20, 84)]),
        (4, "\U0001f600 " + random_string(rng, 40), [("random", 2, 42)]),
    ]
    ordinary = [(k, "".join(rng.choice("etaoin") for _ in range(30)), []) for k in range(10, 60)]
    found = find_secrets(spark.createDataFrame([r[:2] for r in rows + ordinary], "doc_id long, text string")).where("doc_id < 10").collect()
    assert {r.doc_id: [(KINDS[s.kind], s.start, s.end) for s in r.spans] for r in found} == {n: spans for n, _, spans in rows}


def test_masks_cover_what_is_reported_and_nothing_else(spark):
    rng = random.Random(5)
    bits = ["password=", "token: ", "secret", "='", "AKIA", "A1B2C3D4E5F6", "0123456789abcdef", "fedcba98", " ", "x", "é", "\U0001f600", "abcdefgh", "_", ".", "\n"]
    texts = ["", *("".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(400))]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for _, pattern, group, least in PATTERNS:
        of_python = re.compile(pattern.replace("(?i:(password|passwd|secret|token|api_?key))", "((?i:password|passwd|secret|token|api_?key))"))

        def masked(text):
            return of_python.sub(lambda m: " " * len(m[0]) if len(m[group]) >= least else m[0], text)

        assert [r[0] for r in rows.select(_masked(F.col("text"), pattern, group, least)).collect()] == list(map(masked, texts))


def test_stretches_have_base64_letters():
    assert re.fullmatch(f"{STRETCH}+", "AZaz09+/_=-") and not re.search(STRETCH, " .:'\"é")


ITEM = "日本語テキストの試験問題はここにあります"


@pytest.mark.parametrize(("text", "edits"), [("これは例です。" + ITEM + "。終わり", 0), (ITEM, 0), (ITEM[:9] + "の" + ITEM[9:], 1), (ITEM.replace("試験", "日程"), 2), ("これは例です。全く関係のない文章がここにあるだけ", None)])
def test_items_in_scripts_without_spaces(spark, text, edits):
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    docs = spark.createDataFrame([(1, text, "x")], "doc_id long, text string, item_words string")
    assert [(r.item_id, r.edits) for r in find_contaminated(docs, items).collect()] == ([] if edits is None else [(7, edits)])
    assert drop_contaminated(docs, items).count() == (edits is None)


def test_near_stage_keeps_other_texts_of_an_id(spark, sf_dir):
    text, other = (" ".join(f"{c}{i}" for i in range(40)) for c in "wv")
    docs = spark.createDataFrame([(1, text, "a"), (2, text + " more", "b"), (2, other, "c"), (None, text, "d"), (4, None, "e")], "doc_id long, text string, source string")
    assert sorted(r.source for r in corpus_pipeline.near(spark, docs, sf_dir).collect()) == ["a", "c", "d", "e"]
