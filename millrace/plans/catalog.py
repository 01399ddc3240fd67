"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.views import Views, with_views

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Registers a function of Views under its name, with its SQL over the named views."""

    def add(f: Callable[[Views], DataFrame]):
        _QUERIES[f.__name__] = lambda spark, folder: f(Views(spark, folder))
        if sql:
            _SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
