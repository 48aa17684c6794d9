"""Registry of the catalogue's queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapegrid.functions.columns import rounded

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query, rounded to six digits, with its checking SQL if it has one."""

    def register(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: rounded(run(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def load() -> None:
    """Import the modules that register queries."""
    from tapegrid.plans import event_queries, line_queries  # noqa: F401
