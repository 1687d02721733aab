"""The table of registered queries and shared pieces of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLE_SQL[run.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_sql(text: str) -> str:
    """Whitespace words."""
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')"


def count_sql(text: str) -> str:
    """Number of whitespace words."""
    return f"len(regexp_extract_all({text}, '\\S+'))"


def fixed_sql(text: str, size: int = 300, step: int = 250) -> str:
    """Fixed windows of words."""
    w = words_sql(text)
    return f"[array_to_string(({w})[i+1:i+{size}], ' ') for i in range(0, len({w}), {step})]"
