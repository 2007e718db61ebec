"""Which rows operator 6 moves."""

from __future__ import annotations

import random

from netquarry.llm import ngram_join

DOCS = "doc_id bigint, text string"


def words(seed, n):
    pick = random.Random(seed)
    return ["".join(pick.choices("abcdefghij", k=9)) for _ in range(n)]


def test_entries_without_a_list_stay_and_short_lists_end_in_the_neighbour_pass(spark, monkeypatch):
    moved = []
    real = ngram_join.join_groups

    def spied(rows, groups, key, *more):
        if key == ["token"]:
            moved.append(rows.count())
        return real(rows, groups, key, *more)

    monkeypatch.setattr(ngram_join, "join_groups", spied)
    texts = [words(k, 100) for k in range(40)]
    for k in (0, 2, 4):  # two texts that share half of their words, in lists of two, and don't link
        texts[k + 1] = texts[k][:50] + texts[k + 1][:50]
    texts += [texts[10][:98] + words(k, 2) for k in range(100, 103)]  # four near copies
    frame = spark.createDataFrame(list(enumerate(map(" ".join, texts))), DOCS)
    found = {r.doc_id: r.component_id for r in ngram_join.near_duplicate_components(frame).collect()}
    assert found == {k: 10 if k >= 40 else k for k in range(43)}
    assert moved[0] < 300  # of some 1,000 entries
    assert moved[-1] == 0
