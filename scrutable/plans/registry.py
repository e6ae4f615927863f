"""Where queries over the test tables are registered, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .adapter import Tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query over Tables, and its SQL."""

    def add(f):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(Tables(spark, folder))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add
