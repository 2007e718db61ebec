"""Rules as predicates: each condition becomes a column, so that Catalyst can push it down."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short forms of rules, the fields and the tests they stand for.
SHORT_FORMS = (("summary_contains", "summary", "contains"), ("details_regex", "details", "regex"), ("sources", "source", "in"))
NUMERIC = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}


def _number(value: object) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def _is_pattern(text: str) -> bool:
    try:
        re.compile(text)
    except re.error:
        return False
    return True


def condition(field: str, op: str, value: object) -> Column:
    """eq, neq, contains, regex, in, gt, gte, lt or lte; never null.

    Texts are compared as they are, ``contains`` and ``regex`` without regard to
    case, and ``in`` and ``eq`` as text; a list for ``contains`` or ``regex`` means any of it, and
    a single text for ``in`` is compared whole. Numeric conditions are false where the field or the
    value is no number. Null for ``contains`` or ``regex``, and patterns that aren't valid, never hold.
    """
    own = F.col(field)
    text = own.cast("string")
    if op in NUMERIC:
        number = _number(value)
        test = F.lit(False) if number is None else NUMERIC[op](text.try_cast("double"), F.lit(number))
    elif op == "eq":
        test = text == str(value)
    elif op == "neq":
        test = ~text.eqNullSafe(F.lit(str(value)))
    elif op == "in":
        test = text.isin([str(v) for v in value]) if isinstance(value, list | tuple | set) else text == str(value)
    elif op in ("contains", "regex"):
        each = [v for v in (value if isinstance(value, list | tuple) else [value]) if v is not None and (op == "contains" or _is_pattern(str(v)))]
        one = (lambda v: F.contains(F.lower(text), F.lit(str(v).lower()))) if op == "contains" else (lambda v: text.rlike("(?i)" + str(v)))
        test = reduce(or_, map(one, each), F.lit(False))
    else:
        raise ValueError(f"no such operator: {op}")
    return F.coalesce(test, F.lit(False))


def rule(conditions: dict) -> Column:
    """``all`` conditions hold, and one of ``any`` if there are some; a rule without conditions never holds.

    Without either, a rule may be one short form: ``field``, ``op`` and ``value``,
    or ``summary_contains``, ``details_regex`` or ``sources``.
    """
    if "field" in conditions:
        return condition(conditions["field"], conditions.get("op", "eq"), conditions.get("value"))
    if not conditions.get("all") and not conditions.get("any"):
        for key, field, op in SHORT_FORMS:
            if conditions.get(key):
                return condition(field, op, conditions[key])
    every, some = ([condition(*c) for c in conditions.get(k, [])] for k in ("all", "any"))
    return reduce(and_, every + ([reduce(or_, some)] if some else [])) if every or some else F.lit(False)


def rule_hits(rows: DataFrame, rules: list[dict]) -> DataFrame:
    """How many rows each rule matches, in one pass: rule, severity, hits; rules without hits have no row."""
    matched = [F.when(rule(r), F.struct(F.lit(r["name"]).alias("rule"), F.lit(r.get("severity", "info")).alias("severity"))) for r in rules]
    return rows.select(F.explode(F.array_compact(F.array(*matched))).alias("hit")).groupBy("hit.rule", "hit.severity").agg(F.count(F.lit(1)).alias("hits"))
