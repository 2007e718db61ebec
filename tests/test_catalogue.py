"""Every query of the network operators against its SQL, and the scalar functions' edges."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import PLANS
from netquarry.functions.network import base_domain, cadence_family, csv_safe, ipv4_scope, size_bucket, url_host
from netquarry.functions.rules import condition, rule

QUERIES, ORACLE_SQL = ({name: own for plan in PLANS for name, own in getattr(plan, kind).items()} for kind in ("QUERIES", "ORACLE_SQL"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_matches_sql(spark, oracle, name):
    expected = oracle.sql(ORACLE_SQL[name])
    names = [d[0] for d in expected.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    rows = [tuple(r) for r in got.select(names).collect()]
    assert rows and sorted(map(repr, rows)) == sorted(map(repr, expected.fetchall()))


def one(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(f(F.col("x"))).collect()]


def test_scopes(spark):
    given = ["10.1.2.3", "172.31.0.1", "172.32.0.1", "192.168.1.1", "127.0.0.1", "169.254.1.1", "224.0.0.1", "255.255.255.255", "0.0.0.0", "8.8.8.8", "1.2.3", "1.2.3.256", "x", None]
    assert one(spark, ipv4_scope, *given) == [
        "private", "private", "public", "private", "loopback", "link_local", "multicast", "broadcast", "unspecified", "public", "unknown", "unknown", "unknown", "unknown"
    ]


def test_hosts_and_cells(spark):
    assert one(spark, url_host, "http://A.b.C/x", "https://u:p@h.net:80", "http://h.net.", "nothing", None) == ["a.b.c", "h.net", "h.net", "", None]
    assert one(spark, base_domain, "a.b.c", "b.c", "c", "") == ["b.c", "b.c", "c", ""]
    assert one(spark, csv_safe, "=1", "  +x", "a=1", "", None) == ["'=1", "'  +x", "a=1", "", None]
    assert one(spark, lambda c: size_bucket(c.cast("int")), "0", "19", "20", "5120") == ["0-19", "0-19", "20-39", ">5119"]
    assert one(spark, lambda c: cadence_family(c.cast("double")), "14", "15", "1800", None, "0") == ["very_fast", "fast", "very_slow", "unknown", "unknown"]


def test_conditions(spark):
    def held(test, *values):
        return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(test).collect()]

    assert held(condition("x", "gt", 3), "4", "3", "x", None) == [True, False, False, False]
    assert held(condition("x", "eq", 3), "3", "3.0", None) == [True, False, False]
    assert held(condition("x", "neq", 3), "3", "4", None) == [False, True, True]
    assert held(condition("x", "contains", ["AB", "z"]), "cabc", "Z", "", None) == [True, True, False, False]
    assert held(condition("x", "regex", "^a+$"), "AAA", "ab", None) == [True, False, False]
    assert held(condition("x", "in", [1, "b"]), "1", "b", "c", None) == [True, True, False, False]
    assert held(rule({}), "a") == [False] and held(rule({"any": [("x", "eq", "a"), ("x", "eq", "b")], "all": [("x", "neq", "b")]}), "a", "b") == [True, False]
    with pytest.raises(ValueError):
        condition("x", "like", "a")
