"""All queries of the library, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from palimpsest.plans import archive, changes, history, reporting


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


MODULES = (history, changes, reporting, archive)


def _all() -> dict[str, Query]:
    return {name: Query(*pair) for module in MODULES for name, pair in module.QUERIES.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in _all().items() if q.sql}
