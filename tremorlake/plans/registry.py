"""Registered queries: a Spark plan over the given tables, and the same in DuckDB's SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of ``tables``, which gives the DataFrame of a table by name."""

    def add(plan: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[plan.__name__] = run
        if sql is not None:
            SQL[plan.__name__] = sql
        return plan

    return add
