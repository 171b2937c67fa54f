"""Registry of every operator id: the Spark query and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``f(spark, sf_dir)`` under ``name``, with the SQL that gives the same rows."""

    def put(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def queries() -> dict[str, Callable]:
    from . import queries as _  # noqa: F401  registers them

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
