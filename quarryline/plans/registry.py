"""The register of queries: each a DataFrame plan and, where SQL can say it, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def both(name: str, tables: str, sql: str, oracle: str | None = None) -> None:
    """A report that is SQL in either engine; Catalyst plans it over the named tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables.split()})

    run.__name__ = name
    QUERIES[name] = run
    text = oracle or sql
    for t in tables.split():
        text = text.replace("{" + t + "}", t)
    ORACLE[name] = text
