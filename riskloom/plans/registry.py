"""Registry of named queries with the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.plans.data import RiskData, open_data, rounded
from riskloom.plans.oracle import sql as oracle_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, **views: str):
    """Registers ``body(data)``; doubles are rounded for the comparison."""

    def register(body: Callable[[RiskData], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, directory: str) -> DataFrame:
            return rounded(body(open_data(spark, directory)))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle_text(sql, **views)
        return body

    return register
