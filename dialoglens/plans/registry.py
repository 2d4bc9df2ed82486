"""Registered queries and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dialoglens.plans.adapters import AS_OF_SQL, SQL_VIEWS, load
from dialoglens.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register `build(db)` under `name`; `check` is the SQL that must give the same rows."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(load(spark, sf_dir))
        if check is not None:
            CHECKS[name] = with_views(check)
        return build

    return register


def with_views(sql: str) -> str:
    """Put the domain views that `sql` names in front of it."""
    used = [name for name in SQL_VIEWS if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql)]
    views = ", ".join(f"{name} AS ({SQL_VIEWS[name]})" for name in used)
    body = sql.strip()
    if not views:
        return body
    if re.match(r"(?i)with\s", body):
        return f"WITH {views}, {body[4:].lstrip()}"
    return f"WITH {views} {body}"


def recent(column: str, days: float) -> str:
    """SQL for `column` younger than `days`."""
    return f"{column} > {AS_OF_SQL} - INTERVAL {round(days * 86400)} SECOND"


def of_kind(kind: str, days: float, source_id: str = "source_id") -> str:
    """SQL condition: the call has a recent segment in a service or sales queue."""
    negate = "NOT " if kind == "service" else ""
    return (
        f"{source_id} IN (SELECT call_id FROM seg WHERE {recent('call_time', days)} "
        f"AND queue_name IS NOT NULL AND queue_name {negate}IN (SELECT queue_name FROM sales))"
    )
