"""What operator 5 computes once, keeps and takes at once."""

from __future__ import annotations

import random

from netquarry.llm.bpe import PrefixEncoder, bpe_encode
from netquarry.llm.common import ARROW_BYTES, ARROW_DEFAULT
from netquarry.llm.queries import tokenizer_path

DOCS = "doc_id bigint, text string"


def words(seed, n):
    pick = random.Random(seed)
    return ["".join(pick.choices("abcdefghij", k=9)) for _ in range(n)]


def encoder(**options):
    with open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as file:
        return PrefixEncoder(file.read(), **options)


def test_forms_of_a_word_are_encoded_once(monkeypatch):
    made, own = [], encoder()
    real = PrefixEncoder.piece_ids
    monkeypatch.setattr(PrefixEncoder, "piece_ids", lambda self, piece: made.append(piece) or real(self, piece))
    own.encode("Thorinel thorinel, THORINEL. thorinel; thorinel! thorinel")
    assert made.count("thorinel") == 1
    assert own.encode("Éöü. éöü,") == own.encode("éöü .") + own.encode("Éöü ,")


def test_frequent_words_outlive_many_others(monkeypatch):
    made, own = [], encoder(cached_words=20)
    real = PrefixEncoder.piece_ids
    monkeypatch.setattr(PrefixEncoder, "piece_ids", lambda self, piece: made.append(piece) or real(self, piece))
    for word in words(1, 200):
        own.encode(f"frequentest {word}")
    assert made.count("frequentest") == 1 and len(own.words) <= 10


def test_texts_reach_python_in_small_batches(spark):
    spark.conf.set(ARROW_BYTES, ARROW_DEFAULT)
    bpe_encode(spark.createDataFrame([(1, "x")], DOCS), tokenizer_path("word_bpe_49k.json"))
    assert spark.conf.get(ARROW_BYTES) == "4m"
    spark.conf.set(ARROW_BYTES, "1m")
    bpe_encode(spark.createDataFrame([(1, "x")], DOCS), tokenizer_path("word_bpe_49k.json"))
    assert spark.conf.get(ARROW_BYTES) == "1m"
    spark.conf.set(ARROW_BYTES, ARROW_DEFAULT)


def test_each_operator_drops_what_others_left_in_a_worker(monkeypatch):
    """Language models and other steps without a cache of their own, too, run beside no encoder; freed memory goes back at the end."""
    import pyarrow as pa

    from netquarry.llm import common

    given, kept = [], {"words": 1}
    monkeypatch.setattr(common, "CACHES", {"bpe": kept.clear})
    monkeypatch.setattr(common, "_CLAIMED", {})
    monkeypatch.setattr(common, "give_back", lambda: given.append(dict(kept)))
    batch = pa.RecordBatch.from_pydict({"text": ["a"]})
    held = common.leanly("bpe", lambda batches: ((kept.setdefault("words", 1), b)[1] for b in batches))
    assert list(held(iter([batch]))) == [batch] and kept and len(given) == 2
    other = common.leanly("langid", lambda batches: (b for b in batches if not kept))
    assert list(other(iter([batch]))) == [batch] and len(given) == 4


def test_steps_of_the_pipeline_are_lean(spark):
    """No step of Python in the stages is handed to Spark without ``leanly``."""
    import inspect

    from netquarry.llm import bpe, decontaminate, langid, ngram_join

    for module in (bpe, decontaminate, langid, ngram_join):
        source = inspect.getsource(module)
        assert source.count("leanly(\"") == source.count(".mapInArrow("), module.__name__
