"""The operators applied to the relational test tables.

Each module registers queries with, where SQL can express them, an equivalent
SQL text for an independent check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from biblioweave.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``f(tables) -> DataFrame`` under a name with its SQL."""

    def wrap(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(Tables(tune(spark), folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return wrap


def load() -> None:
    """Import all query modules."""
    from biblioweave.catalog import files, keytables, landed, lookups, matching, reports, scalars  # noqa: F401
