"""Conversation repair, filter audit and token files against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from netquarry.llm.conversations import FINAL, STATES, UNREACHED, cheapest, costs_through, damaged, repair_conversations
from netquarry.llm.filter_audit import audit_filters
from netquarry.llm.queries import ORACLE_SQL, op11_conversation_repair, op13_token_files, tokenizer_path
from netquarry.llm.token_files import LibraryEncoder, framed, ids_crc32, read_places, record_places, token_files, unframed, write_token_files

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def brute_repair(rows):
    """Whole (cost, labels, turns) of every state kept and compared, row by row."""
    out, by = {}, {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        own += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            left = re.sub("[\x20\x09-\x0d]", "", text)
            faults.append("b" if not left else "d" if (role, text) in seen else "t" if left[-1] not in ".!?" else "")
            seen.add((role, text))
        at = {"": (0, "", ())}

        def inserted(at):
            at = dict(at)
            for _ in range(4):
                for state, w in list(at.items()):
                    for role in "ua":
                        after = NEXT.get((state, role))
                        if after:
                            new = (w[0] + 3, w[1] + "I", (*w[2], ("user" if role == "u" else "assistant", "")))
                            at[after] = min(at.get(after, new), new)
            return at

        for (_, role, text), fault in zip(own, faults):
            after = {}
            for state, w in inserted(at).items():
                ways = [(state, 4, "D", ())]
                if fault not in ("b", "d"):
                    more = 3 * (fault == "t")
                    ways += [(NEXT.get((state, role[:1])), more, "K", ((role, text),))]
                    ways += [(NEXT.get((state, full[0])), 3 + more, "R", ((full, text),)) for full in ("user", "assistant")]
                for to, cost, label, turns in ways:
                    if to is not None:
                        new = (w[0] + cost, w[1] + label, w[2] + turns)
                        after[to] = min(after.get(to, new), new)
            at = after
        cost, labels, turns = min(w for state, w in inserted(at).items() if state in ("", "a"))
        times = [t for t, _, _ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        gaps = max(times) - min(times) + 1 - len(set(times)) if times else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, labels, digest)
    return out


RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.fixture(scope="module")
def odd_turns(spark):
    """Null ids, turns, roles and texts, ties, repeats, one long conversation, clashing columns."""
    rng, rows = random.Random(3), []
    for conv in [None, *range(40)]:
        for at in range(700 if conv == 7 else rng.choice([1, 2, 3, 5, 9, 30])):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "ux"])
            text = rng.choice(["Hi.", "Yes", "no?", " ", "", None, "Tell me. ", "ok!\n", f"A{at}.", f"B{rng.randrange(50)}"])
            rows.append((conv, rng.choice([None, at, at, at // 2]), role, text, "kept", 1, 2))
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, kinds string, part int, piece int").repartition(5)


@pytest.mark.parametrize("piece_rows", [1024, 7, 1])
def test_repair_equals_brute_force_however_conversations_are_cut(odd_turns, piece_rows):
    got = repair_conversations(damaged(odd_turns), piece_rows=piece_rows).digests().select(*RESULT).collect()
    want = brute_repair([tuple(r) for r in odd_turns.select("conv_id", "turn", "role", "text").collect()])
    assert len(got) == len(want)
    assert {r[0]: tuple(r[1:]) for r in got} == want


def test_repair_query_on_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert {r[0]: tuple(r[1:]) for r in op11_conversation_repair(spark, sf_dir).select(*RESULT).collect()} == brute_repair([tuple(r) for r in rows])


def test_repair_of_nothing_and_of_very_long_texts(spark):
    schema = "conv_id string, turn int, role string, text string"
    assert repair_conversations(damaged(spark.createDataFrame([], schema))).digests().count() == 0
    rows = [("a", t, "user" if t % 2 else "assistant", "w " * 400_000 + f"{t}.") for t in range(8)]
    got = repair_conversations(damaged(spark.createDataFrame(rows, schema))).digests().select(*RESULT).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute_repair(rows)


def test_turns_of_a_repair_follow_the_grammar(odd_turns):
    found = repair_conversations(damaged(odd_turns), piece_rows=7).turns()
    roles = found.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "piece", "place", "role"))).alias("turns"))
    for row in roles.collect():
        assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][0] for t in row["turns"]))


def test_costs_through_pieces_multiply():
    rng = random.Random(5)
    for _ in range(50):
        kinds = "".join(rng.choice("suaSUA-_x") for _ in range(rng.randrange(12)))
        cut = rng.randrange(len(kinds) + 1)
        a, b = costs_through(kinds[:cut]), costs_through(kinds[cut:])
        assert ((a[:, :, None] + b[None]).min(axis=1).clip(max=UNREACHED) == costs_through(kinds)).all()
        assert (costs_through(kinds) + FINAL).min(axis=1).tolist() == [min(w[0], UNREACHED) for w in cheapest(kinds, FINAL, STATES)]


# Filter audit


def brute_audit(docs, labels):
    good, toxic = {}, {}
    for doc_id, quality, bad in labels:
        if doc_id is not None:
            good[doc_id], toxic[doc_id] = good.get(doc_id) or quality == 1, toxic.get(doc_id) or bad == 1
    told = []
    for doc_id, text, source in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        failed = set()
        if len(words) < 50:
            failed.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            failed.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
            failed.add("C")
        if re.search("[#$%&*|]", text):
            failed.add("D")
        if doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in docs):
            failed.add("E")
        told.append((source or "", failed, bool(good.get(doc_id)), bool(toxic.get(doc_id))))
    out, shapley = {}, {}
    for part in {t[0] for t in told}:
        own = [t for t in told if t[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [t for t in left if f in t[1]]
                left = [t for t in left if f not in t[1]]
                fails = sum(f in t[1] for t in own)
                out[part, order, step] = [len(left), len(gone), fails - len(gone), sum(t[1] == {f} for t in own), sum(t[2] for t in gone), sum(t[3] for t in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audited(docs, labels):
    return {tuple(r[:3]): tuple(r[3:]) for r in audit_filters(docs, labels).select(*AUDIT).collect()}


def test_audit_equals_brute_force_on_odd_rows(spark):
    rng, rows = random.Random(2), []
    texts = [None, "", " ", "A", "x#", "word " * 60, " ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(60)) + " |", "BIG " * 55, "é" * 9, " ".join(f"W{k}" for k in range(80))]
    for at in range(300):
        rows.append((rng.choice([None, at, at, rng.randrange(20)]), rng.choice([*texts, f"own {at} $"]), rng.choice([None, "", "p", "q"]), True, 3, 4))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, A boolean, docs int, subset int").repartition(4)
    labels = spark.createDataFrame([(rng.choice([None, k % 40]), rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for k in range(120)], "doc_id long, quality int, toxic int, text string")
    got = audit_filters(docs, labels).select(*AUDIT)
    assert got.count() == 600 * 3
    assert audited(docs, labels) == brute_audit([r[:3] for r in rows], [tuple(r[:3]) for r in labels.collect()])


def test_audit_of_no_rows_and_of_a_very_long_text(spark):
    schema, none = "doc_id long, text string, source string", spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(spark.createDataFrame([], schema), none).count() == 0
    rows = [(1, "word " * 500_000, "p"), (2, "word " * 500_000, "p"), (3, "Ab " * 300_000, "p")]
    assert audited(spark.createDataFrame(rows, schema), none) == brute_audit(rows, [])


def test_audit_has_sql():
    assert "op12_filter_audit" in ORACLE_SQL


# Token files


def reference_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


BITS = ["a", "B", "'s", "'S", "don't", " ", "\n", "\x1c", " ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", ".", ",", "1", "23", "é", "é", "İ", "İ", "ΣΑΣ", "ß", "日本", "。", "a.",
        "...", "'ll", "'LL", "́", "x" * 70, "Ab1c2", ";:!?", "\xa0", "\x00", "_", "-", "😀", "ﬁ", "Å", "\U000e0001"]


def test_encoder_equals_the_library(library):
    rng = random.Random(1)
    encoder = LibraryEncoder(library.to_str(), most=40)
    for _ in range(3_000):
        text = "".join(rng.choice(BITS) for _ in range(rng.randrange(30)))
        assert struct.unpack(f"<{len(encoder.encode(text.encode())) // 2}H", encoder.encode(text.encode())) == tuple(reference_ids(library, text))
    long = "Ab1" * 3_000 + " " + "z9" * 9_000 + "q" * 6_000 + " " + "1" * 9_000
    assert encoder.encode(long.encode()) == struct.pack(f"<{len(reference_ids(library, long))}H", *reference_ids(library, long))


def test_encoder_cuts_at_all_signs_as_the_library(library):
    rng = random.Random(2)
    encoder = LibraryEncoder(library.to_str(), most=40)
    signs = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    bits = [*signs, *signs, "a", "b", "Z", "7", " ", "é", "\u0338", "\u0301", "'s", "'ll", "<|endoftext|>", "<|"]
    for _ in range(5_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(20)))
        assert encoder.encode(text.encode()) == struct.pack(f"<{len(reference_ids(library, text))}H", *reference_ids(library, text)), text


def test_encoder_keeps_the_words_it_meets_again(library, monkeypatch):
    """Common words aren't encoded again when the cache is full, nor with signs that follow them."""
    encoder = LibraryEncoder(library.to_str(), most=100)
    asked = []
    monkeypatch.setattr(encoder, "tokens", lambda own, ask=encoder.tokens: asked.append(own) or ask(own))
    letters = "abcdefghij"
    for k in range(1_000):
        rare = "x" + "".join(letters[int(d)] for d in str(k))
        text = f"common others$$$ {rare} common% others*** others_ common) don't"
        assert encoder.encode(text.encode()) == struct.pack(f"<{len(reference_ids(library, text))}H", *reference_ids(library, text))
    assert [asked.count(word) for word in ("common", "others", "don")] == [1, 1, 1]
    assert len(encoder) + len(encoder.earlier) <= 100


def check_files(spark, docs, library, **options):
    files = write_token_files(docs, tokenizer_path("word_bpe_49k.json"), **options)
    kind = docs.schema["doc_id"].dataType.simpleString()
    got = read_places(record_places(files), kind).select("doc_id", "start", "n_tokens", ids_crc32()).collect()
    want = []
    for doc_id, text in docs.select("doc_id", "text").collect():
        ids = [*reference_ids(library, text), 1]
        want.append((doc_id, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    assert sorted(((r[0], r[2], r[3]) for r in got), key=repr) == sorted(want, key=repr)
    got.sort(key=lambda r: r["start"])
    assert not got or got[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in itertools.pairwise(got))
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d if d is not None else type(ids[-1])()))
    return files


def test_files_hold_all_rows_in_order(spark, library, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice([None, 5, k, k]), rng.choice([None, "", "".join(rng.choice(BITS) for _ in range(rng.randrange(40)))]), "x", 1, 2) for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uri string, start long, row int").repartition(6)
    folder = f"file://{tmp_path}"
    files = check_files(spark, docs, library, file_bytes=3_000, folder=folder)
    assert files.count() > 5
    assert sorted(map(tuple, token_files(spark, folder).collect())) == sorted(map(tuple, files.collect()))
    check_files(spark, spark.createDataFrame([("b", "One two."), ("a", None), (None, "x")], "doc_id string, text string"), library)
    assert check_files(spark, docs.limit(0), library).count() == 0


def test_shuffled_reads_give_the_same_records(spark, library):
    docs = spark.createDataFrame([(k, f"text {k} of some words") for k in range(300)], "doc_id long, text string")
    places = record_places(write_token_files(docs, tokenizer_path("word_bpe_49k.json"), file_bytes=2_000))
    shuffled = read_places(places.orderBy(F.rand(7)))
    assert sorted(map(tuple, shuffled.collect())) == sorted(map(tuple, read_places(places).collect()))


def test_hot_id_spreads(spark, library):
    docs = spark.createDataFrame([(3 if k % 3 else k, f"text {k % 5}") for k in range(3_000)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as so few rows would be put together again
    try:
        files = check_files(spark, docs.repartition(8), library)
        assert files.agg(F.max("records")).first()[0] < 1_500
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("at", [0, 9, 13, 20, -1])
def test_damaged_records_are_errors(at):
    data = bytearray(framed(b"some bytes of a record"))
    assert unframed(bytes(data)) == b"some bytes of a record"
    data[at] ^= 1
    with pytest.raises(ValueError):
        unframed(bytes(data))


def test_token_file_query_on_the_table(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    start, want = 0, []
    for doc_id, text in docs:
        ids = [*reference_ids(library, text), 1]
        want.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(map(tuple, op13_token_files(spark, sf_dir).collect())) == want
