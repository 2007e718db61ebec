"""The n-gram join on families of long texts whose similarity is about the limit, and its parity maps."""

from __future__ import annotations

import numpy as np
import pytest

from netquarry.llm.ngram_join import fine_map, least_difference, near_duplicate_components

from .test_existing import brute_components, docs


@pytest.mark.parametrize("size,family,most", [(150, 40, 0.0266), (1500, 24, 0.02), (4000, 16, 0.02)])
def test_families_near_the_limit(spark, size, family, most):
    rng = np.random.default_rng(size)
    vocabulary = [f"w{i}" for i in range(5_000)]
    texts = []
    for _ in range(3):
        base = list(rng.choice(vocabulary, size))
        for _ in range(family):
            own = list(base)
            for at in rng.choice(size, int(size * rng.uniform(0.0095, most)), replace=False):  # five shingles each; the limit is at 0.011
                own[at] = str(rng.choice(vocabulary))
            texts.append(" ".join(own))
    expected = brute_components(list(enumerate(texts, 1)))
    assert len({c for _, c in expected.values()}) > 3  # links and near misses
    found = near_duplicate_components(docs(spark, texts).repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected


def test_fine_maps_never_claim_too_much():
    rng = np.random.default_rng(1)
    for n, m, shared in [(0, 1, 0), (5, 5, 5), (300, 310, 290), (3_000, 2_500, 2_400), (20_000, 900, 100), (30_000, 30_000, 27_000)]:
        own = np.unique(rng.integers(0, 1 << 63, n + m - shared, dtype=np.uint64))
        x, y = own[:n], own[n - shared :]
        low = least_difference(fine_map(np.sort(x)), fine_map(np.sort(y)))
        assert low == least_difference(fine_map(np.sort(y)), fine_map(np.sort(x))) <= n + m - 2 * shared


@pytest.mark.parametrize("sizes", [(6, 16), (9, 40)])
@pytest.mark.parametrize("hot_class", [1, 5, 10])
def test_long_lists_are_whole(spark, monkeypatch, sizes, hot_class):
    """Templates that all documents share, so that every list is long: small sets, large ones and both."""
    from netquarry.llm import ngram_join

    monkeypatch.setattr(ngram_join, "LIST", 5)
    monkeypatch.setattr(ngram_join, "SORTED_LIST", 7)
    rng = np.random.default_rng(sizes[1])
    templates = [[f"t{k}{i}" for i in range(40)] for k in range(2)]
    texts = []
    for _ in range(260):
        n = int(rng.integers(*sizes))
        own = list(templates[int(rng.integers(2))][:n])
        for _ in range(int(rng.integers(0, 3))):
            at = int(rng.integers(0, 3))
            own[-at:] = [f"o{rng.integers(6)}" for _ in range(at)]
        if rng.random() < 0.3:
            own = [f"p{rng.integers(4)}", *own]
        texts.append(" ".join(own))
    expected = brute_components(list(enumerate(texts, 1)))
    found = near_duplicate_components(docs(spark, texts).repartition(4), hot_class=hot_class).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected


@pytest.mark.parametrize("seed", range(3))
def test_links_by_hot_shingles_alone(spark, monkeypatch, seed):
    """Documents of shared blocks and a few words of their own, about the limit; most of what links them is hot."""
    from netquarry.llm import ngram_join

    monkeypatch.setattr(ngram_join, "SORTED_LIST", 3)
    rng = np.random.default_rng(seed)
    blocks = [[f"b{k}x{i}" for i in range(int(rng.integers(6, 30)))] for k in range(5)]
    texts = []
    for n in range(300):
        own = [w for k in rng.choice(5, int(rng.integers(1, 4)), replace=False) for w in blocks[k]]
        own = own[int(rng.integers(0, 3)) : len(own) - int(rng.integers(0, 3))]
        texts.append(" ".join([*own, *(f"u{n}y{i}" for i in range(int(rng.integers(0, 9))))]))
    expected = brute_components(list(enumerate(texts, 1)))
    assert 20 < len({c for _, c in expected.values()}) < 300
    found = near_duplicate_components(docs(spark, texts).repartition(4), hot_class=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected


@pytest.mark.parametrize(("shared", "own"), [(12, 2), (18, 2), (57, 8)])
def test_templated_documents_take_linear_time(spark, shared, own):
    """Most of their shingles are everyone's, which links no two: no task compares all with all."""
    texts = [" ".join([*(f"t{i}" for i in range(shared)), *(f"a{k}b{i}" for k in range(own))]) for i in range(12_000)]
    found = near_duplicate_components(docs(spark, texts).repartition(8))
    assert found.where("component_id = doc_id").count() == len(texts)


def test_rows_of_one_id_with_different_texts(spark):
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(30))
    rows = spark.createDataFrame([(1, text), (2, text + " more"), (2, other), (3, other + " x"), (3, text + " more")], "doc_id long, text string")
    found = {(r.doc_id, r.n_shingles): r.component_id for r in near_duplicate_components(rows).collect()}
    assert found == {(1, 56): 1, (2, 57): 1, (2, 26): 2, (3, 27): 2, (3, 57): 1}


def test_a_large_family_meets_by_few_pairs(spark, monkeypatch):
    """Near copies of one text, of which about one pair in twenty links, as their hot parts do: one component, by pairs that grow with the documents."""
    from netquarry.llm import ngram_join

    rng = np.random.default_rng(7)
    base, texts = [f"w{i}" for i in range(150)], []
    for n in range(700):
        own = list(base)
        for at in rng.choice(150, rng.integers(2, 5), replace=False):
            own[at] = f"x{n}-{at}"
        texts.append(" ".join(own))
    expected, counted, verified = brute_components(list(enumerate(texts, 1))), ngram_join._counted, []
    monkeypatch.setattr(ngram_join, "_counted", lambda pairs, *own: (verified.append(pairs.count()), counted(pairs, *own))[1])
    found = near_duplicate_components(docs(spark, texts).repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected
    assert sum(verified) < 10 * len(texts), verified
