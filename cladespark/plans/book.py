"""Where queries are entered; it imports none of them, so workers can import any module that enters some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import workers_see_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    """Register a query and, where SQL can express it, its DuckDB text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        workers_see_package(spark)
        return query(spark, sf_dir)

    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql
