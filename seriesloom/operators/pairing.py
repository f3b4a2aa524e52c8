"""Alignments by position expressed as joins on keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from seriesloom.operators.frames import attach


def align_pairs(left: DataFrame, right: DataFrame, on: Sequence[str], left_value: str, right_value: str) -> DataFrame:
    """``on, left, right`` where both sides have a value."""
    a = left.where(F.col(left_value).isNotNull()).select(*on, F.col(left_value).alias("left"))
    b = right.where(F.col(right_value).isNotNull()).select(*on, F.col(right_value).alias("right"))
    return a.join(b, list(on), "inner")


def lag_self_pair(indexed: DataFrame, k: int, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """``keys, idx, value, earlier``: each value with the value k positions before, as an equi-join on the position."""
    earlier = indexed.select(*keys, (F.col("idx") + k).alias("idx"), F.col(value).alias("earlier"))
    return attach(indexed.select(*keys, "idx", value), earlier, [*keys, "idx"], "inner")


def broadcast_scalars(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Add the column's mean and population deviation (per key) to each row."""
    facts = df.groupBy(*keys).agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))
    return attach(df, facts, keys)


def lookup_timestamp(points: DataFrame, source: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Timestamp of each point from the series, joined on key and position."""
    return attach(points, source.select(*keys, "idx", "ts"), [*keys, "idx"])


def with_folds(indexed: DataFrame, folds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every row once per fold of its key, with the fold's bounds.

    There are at most five folds per key, so they are gathered into one array per key, attached, and unfolded on the row.
    """
    bounds = ["fold", "train_end", "test_start", "test_end"]
    packed = folds.groupBy(*keys).agg(F.collect_list(F.struct(*bounds)).alias("_folds"))
    rows = attach(indexed, packed, keys, "inner").withColumn("_f", F.explode("_folds"))
    return rows.select(*indexed.columns, *[F.col(f"_f.{b}").alias(b) for b in bounds])


def assign_fold(indexed: DataFrame, folds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows with ``fold`` and ``part`` (train or test): one copy per fold the row takes part in."""
    part = F.when(F.col("idx") < F.col("train_end"), "train").when(
        (F.col("idx") >= F.col("test_start")) & (F.col("idx") < F.col("test_end")), "test"
    )
    tagged = with_folds(indexed, folds, keys).withColumn("part", part).where("part is not null")
    return tagged.drop("train_end", "test_start", "test_end")


def zip_steps(left: DataFrame, right: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Forecast parts joined by key and step."""
    return attach(left, right, [*keys, "step"])


def merge_catalogs(first: DataFrame, *others: DataFrame) -> DataFrame:
    """One row per ``id``: the earliest source wins unless only a later one has a ``ref``.

    Grouped with ``min_by``, so many copies of one id are combined before the shuffle.
    """
    tagged = first.withColumn("_source", F.lit(0))
    for i, other in enumerate(others, 1):
        tagged = tagged.unionByName(other.withColumn("_source", F.lit(i)))
    row = F.struct(*[F.col(c) for c in first.columns])
    order = F.struct(F.col("ref").isNull().cast("int"), F.col("_source"))
    return tagged.groupBy("id").agg(F.min_by(row, order).alias("_row")).select("_row.*")


def latest_details(df: DataFrame, keys: Sequence[str], ts: str, tie: str) -> DataFrame:
    """The last record per key."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(ts, tie)).alias("_row")).select("_row.*")


def last_n_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], n: int) -> DataFrame:
    """The newest n rows per key with ``age`` (1 = newest); the rank is limited inside each task before the shuffle."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*[F.desc(c) for c in order_by])
    return df.withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)
