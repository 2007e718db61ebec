"""Queries of event patterns over ``events``, with their SQL as self-joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.patterns import Step, sequences, unprepared
from .catalogue import _table


def _operate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases that no view of the same user led to within six hours, or only one before an error."""
    return unprepared(_table(spark, sf_dir, "events"), ["user_id"], [Step("event_type = 'view'")], Step("event_type = 'purchase'", within=21_600, unless="event_type = 'error'"))


def _recon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views, then a click within a day, then a purchase within two, each without an error between."""
    steps = [Step("event_type = 'view'"), Step("event_type = 'click'", 86_400, "event_type = 'error'"), Step("event_type = 'purchase'", 172_800, "event_type = 'error'")]
    return sequences(_table(spark, sf_dir, "events"), ["user_id"], steps)


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three events of large value in a row of steps, of different kinds, with no limit of time."""
    steps = [Step("event_type = 'signup' AND value > 10"), Step("event_type = 'click' AND value > 20"), Step("event_type = 'error'", unless="event_type = 'purchase'")]
    return sequences(_table(spark, sf_dir, "events"), ["user_id"], steps)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "operations_without_selection": _operate,
    "discovery_then_control": _recon,
    "command_chains": _chain,
}

ORACLE_SQL: dict[str, str] = {
    "operations_without_selection": """
        SELECT p.user_id, p.event_id AS event, epoch_us(p.ts) AS at FROM events p
        WHERE p.event_type = 'purchase' AND NOT EXISTS (
            SELECT 1 FROM events v WHERE v.user_id = p.user_id AND v.event_type = 'view' AND (v.ts, v.event_id) < (p.ts, p.event_id)
            AND epoch_us(p.ts) - epoch_us(v.ts) <= 6 * 3600 * 1000000::BIGINT AND NOT EXISTS (
                SELECT 1 FROM events x WHERE x.user_id = p.user_id AND x.event_type = 'error' AND (x.ts, x.event_id) > (v.ts, v.event_id) AND (x.ts, x.event_id) < (p.ts, p.event_id)))""",
    "discovery_then_control": """
        WITH clicks AS (
            SELECT c.user_id, c.ts, c.event_id, max((v.ts, v.event_id)) AS view
            FROM events c JOIN events v ON v.user_id = c.user_id AND v.event_type = 'view' AND (v.ts, v.event_id) < (c.ts, c.event_id)
            WHERE c.event_type = 'click' AND epoch_us(c.ts) - epoch_us(v.ts) <= 86400 * 1000000::BIGINT
            AND NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = c.user_id AND x.event_type = 'error' AND (x.ts, x.event_id) > (v.ts, v.event_id) AND (x.ts, x.event_id) < (c.ts, c.event_id))
            GROUP BY ALL),
        bought AS (
            SELECT p.user_id, p.ts, p.event_id, max((c.ts, c.event_id, c.view)) AS click
            FROM events p JOIN clicks c ON c.user_id = p.user_id AND (c.ts, c.event_id) < (p.ts, p.event_id)
            WHERE p.event_type = 'purchase' AND epoch_us(p.ts) - epoch_us(c.ts) <= 172800 * 1000000::BIGINT
            AND NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = p.user_id AND x.event_type = 'error' AND (x.ts, x.event_id) > (c.ts, c.event_id) AND (x.ts, x.event_id) < (p.ts, p.event_id))
            GROUP BY ALL)
        SELECT user_id, click[3][2] AS start, event_id AS event, epoch_us(ts) - epoch_us(click[3][1]) AS micros FROM bought""",
    "command_chains": """
        WITH clicks AS (
            SELECT c.user_id, c.ts, c.event_id, max((s.ts, s.event_id)) AS signup
            FROM events c JOIN events s ON s.user_id = c.user_id AND s.event_type = 'signup' AND s.value > 10 AND (s.ts, s.event_id) < (c.ts, c.event_id)
            WHERE c.event_type = 'click' AND c.value > 20 GROUP BY ALL),
        failed AS (
            SELECT e.user_id, e.ts, e.event_id, max((c.ts, c.event_id, c.signup)) AS click
            FROM events e JOIN clicks c ON c.user_id = e.user_id AND (c.ts, c.event_id) < (e.ts, e.event_id)
            WHERE e.event_type = 'error'
            AND NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND (x.ts, x.event_id) > (c.ts, c.event_id) AND (x.ts, x.event_id) < (e.ts, e.event_id))
            GROUP BY ALL)
        SELECT user_id, click[3][2] AS start, event_id AS event, epoch_us(ts) - epoch_us(click[3][1]) AS micros FROM failed""",
}
