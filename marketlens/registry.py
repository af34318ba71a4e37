"""Registry of runnable queries and the SQL that states what each must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketlens.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SERVES: dict[str, str] = {}


def query(serves: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``serves`` lists the inventory ids the query covers."""

    def register(fn):
        name = fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        SERVES[name] = serves
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
