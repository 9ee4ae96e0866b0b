"""Registry of named queries: a Spark plan and, where SQL can say it, the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def add(fn):
        from radiolake.plans.bindings import Tables

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def r(expr: str, digits: int) -> str:
    """SQL twin of ``functions.columns.rnd``."""
    return f"(round_even(({expr}) * {10 ** digits}.0, 0) / {10 ** digits}.0)"
