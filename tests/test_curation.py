"""Curation at its limits, and exports."""

from __future__ import annotations

import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from netquarry.operators.curation import Words, curated, detail_count, united, write_exports

WORDS = Words(valued=("credential",), doubtful=("maybe",), recon=("sweep",), noisy=("Noise",))
FINDINGS = "source string, severity string, summary string, details string, evidence array<string>, peers array<struct<peer:string,count:long>>"
#: A finding, and its signal if it stays.
CASES = [
    (("s", "critical", "x", None, None, None), 5),
    (("s", "info", "x", "99", ["a", "b"], [("p", 9)]), None),
    (("s", None, "x", "99", ["a", "b"], [("p", 9)]), None),
    (("s", "high", " ", "", None, None), None),
    (("", " HIGH ", "y", "", None, None), 4),
    (("s", "warning", "w1", "n 5", ["a", "b"], None), 4),
    (("s", "warning", "w2", "n 4", ["a", "b"], None), None),
    (("s", "warning", "w3", "n 5", ["a", " "], [("p", 3)]), 4),
    (("s", "warning", "w4", "n 5", ["a"], None), None),
    (("s", "warning", "Credential", "n 4", ["a"], None), 3),
    (("s", "warning", "Host sweep", "n 10", ["a"], None), 4),
    (("s", "warning", "maybe so", "n 5", ["a", "b"], [("p", 3)]), 5),
    (("s", "warning", "maybe not", "n 4", ["a", "b"], [("p", 3)]), None),
    (("s", "high", "Noise", "1234567 x12 12x", None, None), 2),
]


@pytest.mark.parametrize("n", range(len(CASES)))
def test_limits(spark, n):
    row, signal = CASES[n]
    found = curated(spark.createDataFrame([row], FINDINGS), WORDS).collect()
    assert [r.signal for r in found] == ([] if signal is None else [signal])


def test_merging_and_ranks(spark):
    rows = [("s", "high", "a", "d", [f"e{k % 12:02}"], [("p", k), ("q", 1)]) for k in range(30)] + [("s", "high", "b", "", None, None), ("s", "critical", "c", "", ["x"], None)]
    found = {r.summary: r for r in curated(spark.createDataFrame(rows, FINDINGS), WORDS).collect()}
    assert found["a"].findings == 30 and found["a"].evidence == [f"e{k:02}" for k in range(10)] and {p.peer: p["count"] for p in found["a"].peers} == {"p": 435, "q": 30}
    assert (found["a"]["rank"], found["b"]["rank"], found["c"]["rank"]) == (1, 2, 1)
    assert [r.summary for r in curated(spark.createDataFrame(rows, FINDINGS), WORDS, limit=2).orderBy("severity", "rank").collect()] == ["c", "a"]
    assert curated(spark.createDataFrame([], FINDINGS), WORDS).count() == 0


def test_union_of_different_shapes(spark):
    one = spark.createDataFrame([("s", "high", "a", 3)], "source string, severity string, summary string, port int")
    two = spark.createDataFrame([("b", "d")], "summary string, details string")
    rows = {r.summary: r for r in united({"one": one, "two": two}).collect()}
    assert (rows["a"].module, rows["a"].port, rows["a"].details) == ("one", 3, None) and (rows["b"].module, rows["b"].port, rows["b"].severity) == ("two", None, None)
    assert [r[0] for r in spark.createDataFrame([("7 of 42, 1234567 and x99",), (None,)], "d string").select(detail_count(F.col("d"))).collect()] == [42, 0]


def test_exports(spark, tmp_path):
    findings = curated(spark.createDataFrame([("s", "high", "=1+1", ' -x, "y"', ["@e"], [("p", 2)])], FINDINGS), WORDS)
    write_exports(findings, spark.createDataFrame([("10.0.0.1", 5)], "ip string, packets long"), str(tmp_path))
    (row,) = [r for name in glob.glob(f"{tmp_path}/findings.csv/*.csv") for r in csv.DictReader(open(name))]
    assert list(row) == sorted(row) and row["summary"] == "'=1+1" and row["details"] == "'-x, \"y\"" and json.loads(row["peers"]) == [{"peer": "p", "count": 2}]
    (told,) = [json.loads(line) for name in glob.glob(f"{tmp_path}/findings.json/*.json") for line in open(name)]
    assert told["summary"] == "=1+1" and told["evidence"] == ["@e"]
    assert spark.read.parquet(f"{tmp_path}/hosts.parquet").first().packets == 5
