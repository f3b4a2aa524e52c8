"""Queries over the test tables, each with the SQL it must agree with where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seriesloom.functions.stats import significant

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a table reader ``t(name) -> DataFrame``."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def shortened(df: DataFrame, *columns: str) -> DataFrame:
    """Nine significant digits, for columns that mix magnitudes."""
    return df.withColumns({c: significant(F.col(c)) for c in columns})


def logged(df: DataFrame, *columns: str) -> DataFrame:
    """On a log scale: averages of amounts in cents often lie halfway between two roundings, their logarithms do not."""
    return df.withColumns({c: F.round(F.log1p(c), 7) for c in columns})


def sig(expr: str) -> str:
    return f"CAST(printf('%.8e', CAST({expr} AS DOUBLE)) AS DOUBLE)"


def joined(c: Column | str) -> Column:
    return F.array_join(c, "|")


def load_all() -> None:
    from registered import associations, forecasting, modelling, profiles, reading, retrieval, scores, series  # noqa: F401
