"""Name, query and SQL of every registered query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Queries over source code written from a table, apart from those that the bench times.
CODE_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CODE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, tables) under its own name; ``tables(name)`` reads one of the folder's tables."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


from fiberloom.plans import graphs, planted, policies, portfolio, ranks, relations, shapes  # noqa: E402, F401
