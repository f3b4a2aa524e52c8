"""Correlation and association between columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seriesloom.functions import names, stats
from seriesloom.operators.frames import attach, categorical_columns, named_rows, numeric_columns
from seriesloom.operators.rowindex import block_columns, block_window

SUMS = ("n", "x", "y", "xx", "yy", "xy")


def corr_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``feature1, feature2, correlation`` for every pair of numeric columns (first before second in column order).

    Rows with both values count. A first scan takes the means. The second multiplies each Arrow batch of distances from them with itself,
    one product for all pairs of however many columns; a task hands on one row per pair. Without variance the correlation is null.
    """
    columns = list(columns or numeric_columns(df))
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "feature1 string, feature2 string, correlation double")
    means = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    center = np.array([m if m is not None else 0.0 for m in means], float)
    above = np.triu_indices(len(columns), 1)

    def products(batches):
        total = np.zeros((4, len(center), len(center)))
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in batch.columns])
            there = ~np.isnan(values)
            values = np.where(there, values - center, 0.0)
            there = there.astype(float)
            total += np.stack((there.T @ there, values.T @ there, (values * values).T @ there, values.T @ values))
        n, x, xx, xy = total
        parts = (n[above], x[above], x.T[above], xx[above], xx.T[above], xy[above])
        arrays = [pa.array(a.astype(np.int32)) for a in above] + [pa.array(p) for p in parts]
        yield pa.RecordBatch.from_arrays(arrays, ["a", "b", *SUMS])

    numbers = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(f"c{i}") for i, c in enumerate(columns)])
    sums = numbers.mapInArrow(products, "a int, b int, " + ", ".join(f"{s} double" for s in SUMS))
    sums = sums.groupBy("a", "b").agg(*[F.sum(s).alias(s) for s in SUMS])
    part = lambda p, q: F.col(p + q) - F.try_divide(F.col(p) * F.col(q), F.col("n"))
    noise = F.array(*[F.lit((1e-13 * m) ** 2) for m in center.tolist()])  # rounding of the means themselves
    named = F.array(*[F.lit(c) for c in columns])
    ratio = _ratio(part("x", "y"), part("x", "x"), part("y", "y"), "n", F.element_at(noise, F.col("a") + 1), F.element_at(noise, F.col("b") + 1))
    return sums.select(F.element_at(named, F.col("a") + 1).alias("feature1"), F.element_at(named, F.col("b") + 1).alias("feature2"), ratio.alias("correlation"))


def _ratio(xy: Column | str, xx: Column | str, yy: Column | str, n: str, noise_x: Column | float, noise_y: Column | float) -> Column:
    xy, xx, yy = (F.col(f"`{c}`") if isinstance(c, str) else c for c in (xy, xx, yy))
    varies = (xx > F.col(f"`{n}`") * noise_x) & (yy > F.col(f"`{n}`") * noise_y)
    return F.when(varies, F.try_divide(xy, F.sqrt(F.greatest(xx, F.lit(0.0))) * F.sqrt(F.greatest(yy, F.lit(0.0)))))


def target_corr(df: DataFrame, target: str, top: int = 10) -> DataFrame:
    """``feature, correlation``: absolute correlation with the target, strongest first."""
    columns = [c for c in numeric_columns(df) if c != target]
    wide = df.agg(*[F.abs(stats.pearson(F.col(c), F.col(target))).alias(c) for c in columns])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("correlation")) for c in columns
    ]))).where("correlation is not null").orderBy(F.desc("correlation"), "feature").limit(top)


def strong_pairs(pairs: DataFrame, threshold: float = 0.85, top: int = 10) -> DataFrame:
    """Pairs beyond the threshold among the ``top`` strongest."""
    best = pairs.where("correlation is not null").orderBy(F.desc(F.abs("correlation")), "feature1", "feature2").limit(top)
    return best.where(F.abs("correlation") > threshold)


def redundant_pairs(pairs: DataFrame, threshold: float = 0.92, first: int | None = 8) -> DataFrame:
    """Pairs beyond the threshold by name, the ``first`` of them or (None) all."""
    found = pairs.where(F.abs("correlation") > threshold)
    return found if first is None else found.orderBy("feature1", "feature2").limit(first)


def mirror_matrix(pairs: DataFrame) -> DataFrame:
    """Square matrix rows ``feature1, feature2, correlation`` from pairs: both directions, diagonal 1, unknown 0."""
    both = pairs.select("feature1", "feature2", "correlation").unionByName(
        pairs.select(F.col("feature2").alias("feature1"), F.col("feature1").alias("feature2"), "correlation")
    )
    diagonal = both.select("feature1").distinct().select("feature1", F.col("feature1").alias("feature2"), F.lit(1.0).alias("correlation"))
    return both.withColumn("correlation", F.coalesce("correlation", F.lit(0.0))).unionByName(diagonal)


def diverse_features(df: DataFrame, target: str, pairs: DataFrame | None = None) -> DataFrame:
    """Target, its four strongest features and up to three more that are not redundant, all pairs in both directions.

    The greedy choice walks over the pair table, whose size is the square of the number of columns.
    """
    table = {}
    for r in (pairs or corr_matrix(df)).collect():  # one row per pair of columns
        if r["correlation"] is not None:
            table[r["feature1"], r["feature2"]] = table[r["feature2"], r["feature1"]] = r["correlation"]
    ranked = sorted((c for a, c in table if a == target), key=lambda c: (-abs(table[target, c]), c))
    chosen, extra = ranked[:4], []
    for c in ranked[4:]:
        if len(extra) < 3 and max(abs(table.get((c, o), 0.0)) for o in chosen + extra) < 0.85:
            extra.append(c)
    kept = [target, *chosen, *extra]
    rows = [(a, b, table[a, b]) for a in kept for b in kept if a != b and (a, b) in table]
    return df.sparkSession.createDataFrame(rows, "feature1 string, feature2 string, correlation double")


def predictive_signals(indexed: DataFrame, target: str, features: Sequence[str], strong: float = 0.45, keys: Sequence[str] = ()) -> DataFrame:
    """``feature, method, same_time, lag, role``: absolute correlation with the target at the same row and one row later."""
    w = block_window(keys)
    shifted = block_columns(indexed, keys, 1, {f"_prev{i}": F.lag(c).over(w) for i, c in enumerate(features)})
    rows = named_rows(shifted, "feature", {c: {
        "same_time": F.abs(stats.safe_corr(F.col(c).cast("double"), F.col(target))),
        "lag": F.abs(stats.safe_corr(F.col(f"_prev{i}").cast("double"), F.col(target))),
    } for i, c in enumerate(features)})
    return rows.select("feature", F.lit("pearson").alias("method"), "same_time", "lag", F.when(
        F.greatest("same_time", "lag") > strong, "strong_driver").otherwise("weak_or_contextual").alias("role"))


def eta_squared(df: DataFrame, target: str, features: Sequence[str] | None = None, strong: float = 0.06) -> DataFrame:
    """``feature, method, same_time, lag, role``: share of the target's variance explained by each text column.

    The columns are stacked and combined per (column, value); a null value is a group of its own.
    """
    features = list(features or [c for c in categorical_columns(df) if c != target])
    known = df.where(F.col(target).isNotNull())
    total = known.agg(F.var_pop(target).alias("_var"), F.avg(target).alias("_mean"), F.count(target).alias("_n"))
    stacked = known.select(F.col(target).cast("double").alias("y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v")) for c in features
    ])).alias("p")).select("y", "p.*")
    groups = stacked.groupBy("feature", "v").agg(F.count("*").alias("c"), F.avg("y").alias("m"))
    between = attach(groups, total).groupBy("feature").agg(
        F.try_divide(F.sum(F.col("c") * F.pow(F.col("m") - F.col("_mean"), 2)), F.max("_n") * F.max("_var")).alias("_eta")
    )
    eta = F.least(F.coalesce(F.nanvl("_eta", F.lit(None)), F.lit(0.0)), F.lit(1.0))
    return between.select(
        "feature", F.lit("eta_squared").alias("method"), eta.alias("same_time"), F.lit(0.0).alias("lag"),
        F.when(eta > strong, "strong_driver").otherwise("weak_or_contextual").alias("role"),
    )


def rank_signals(signals: DataFrame, top: int = 10) -> DataFrame:
    return signals.orderBy(F.desc(F.greatest("same_time", "lag")), "feature").limit(top)


def usable_features(df: DataFrame, target: str) -> tuple[list[str], list[str]]:
    """Numeric and text columns that may serve as features by name."""
    listed = [c for c in df.columns if c != target]
    if not listed:
        return [], []
    flags = df.sparkSession.createDataFrame([(c,) for c in listed], "column string").select(
        "column", names.excluded_feature(F.col("column")).alias("x")
    ).collect()  # one row per column
    kept = {r["column"] for r in flags if not r["x"]}
    return [c for c in numeric_columns(df) if c in kept], [c for c in categorical_columns(df) if c in kept]
