"""Queries on more users than their smaller tables have."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from netquarry.plans import captured, catalogue, plants


@pytest.fixture(scope="module")
def many_users(spark, tmp_path_factory):
    """Events of users 0, 3 and 30 and of others far from them, by the name of the users' step."""

    def write(step: int) -> str:
        folder = tmp_path_factory.mktemp("events")
        duckdb.sql(
            f"""copy (select range AS event_id, TIMESTAMP '2024-01-08 00:00:00' + INTERVAL (range) SECOND AS ts, [0, 3, 30][range % 3 + 1] + range // 3 % 2 * {step}::BIGINT AS user_id,
            ['view', 'click', 'signup', 'purchase', 'error'][(hash(range) % 5)::BIGINT + 1] AS event_type, 1.5::DOUBLE AS value, '{{"K": ' || range || '}}' AS props FROM range(600)) to '{folder}/events.parquet'"""
        )
        return str(folder)

    return write


def matches(spark, folder, plan, name):
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{folder}/events.parquet'")
    expected = c.sql(plan.ORACLE_SQL[name])
    names = [d[0] for d in expected.description]
    got = [tuple(r) for r in plan.QUERIES[name](spark, folder).select(names).collect()]
    assert got and sorted(map(repr, got)) == sorted(map(repr, expected.fetchall()))


@pytest.mark.parametrize("step", [64_000, 20_000_000, 3_000_000_000])
@pytest.mark.parametrize("name", captured.QUERIES)
def test_users_beyond_an_octet(spark, many_users, name, step):
    matches(spark, many_users(step), captured, name)


def test_users_of_one_outstation(spark, many_users):
    matches(spark, many_users(60_000), plants, "dnp3_unselected_operations")


def test_tasks_of_flows_hold_so_many_lines(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(catalogue, "TASK_LINES", 100)
    flows = catalogue._flows(spark, sf_dir)
    held = flows.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in held) == flows.count() and len(held) > 40 and max(r["count"] for r in held) < 300
