"""Small helpers on schemas and joins used by all operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def col(name: str) -> Column:
    """A top-level column by its very name, which may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def time_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def categorical_columns(df: DataFrame) -> list[str]:
    """Everything neither numeric nor temporal."""
    skip = set(numeric_columns(df)) | set(time_columns(df))
    return [c for c in df.columns if c not in skip]


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*map(col, numeric_columns(df)))


def first_numeric(df: DataFrame) -> str:
    found = numeric_columns(df)
    if not found:
        raise ValueError("no numeric column")
    return found[0]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null, so that every aggregate skips it."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floats else col(c) for c in df.columns])


def attach(df: DataFrame, facts: DataFrame, keys: Sequence[str] = (), how: str = "left") -> DataFrame:
    """Join per-key facts to rows.

    Without keys ``facts`` is a single row and becomes a scalar subquery. With keys the side may have any number of rows, so the
    strategy is left to the planner; null keys match each other.
    """
    if not keys:
        packed = facts.select(F.struct(*facts.columns)).scalar().alias("_facts")
        return df.select("*", packed).select("*", "_facts.*").drop("_facts")
    renamed = facts
    on: Column | None = None
    for i, k in enumerate(keys):
        renamed = renamed.withColumnRenamed(k, f"_k{i}")
        test = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        on = test if on is None else on & test
    return df.join(renamed, on, how).drop(*[f"_k{i}" for i in range(len(keys))])


def named_rows(df: DataFrame, label: str, exprs: dict[str, dict[str, Column]]) -> DataFrame:
    """One wide aggregate over ``df`` turned into one row per name.

    ``exprs`` maps a name to its aggregates; every name has the same aggregate labels.
    """
    fields = list(next(iter(exprs.values())))
    wide = df.agg(*[
        F.struct(F.lit(name).alias(label), *[aggs[f].alias(f) for f in fields]).alias(f"_{i}")
        for i, (name, aggs) in enumerate(exprs.items())
    ])
    return wide.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(exprs))])))
