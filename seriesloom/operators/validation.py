"""Splits, walk-forward folds, error metrics and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seriesloom.operators.frames import attach
from seriesloom.operators.quantiles import exact_quantiles
from seriesloom.operators.rowindex import block_columns, block_window, with_row_index


def split_index(n: Column) -> Column:
    """Rows used for training: all but max(200, 2 %), but at least 80 %."""
    rest = F.greatest(F.lit(200), F.floor(n * 0.02))
    split = F.greatest(F.floor(n * 0.8), n - rest)
    return F.when(n <= 4, F.greatest(F.lit(1), n - 1)).otherwise(split).cast("long")


def temporal_split(indexed: DataFrame) -> DataFrame:
    """Add ``part``: train for the first rows of each key, test for the last."""
    return indexed.withColumn("part", F.when(F.col("idx") < split_index(F.col("n")), "train").otherwise("test"))


def walk_forward_folds(lengths: DataFrame, keys: Sequence[str] = (), preferred: int = 4) -> DataFrame:
    """``keys, fold, train_end, test_start, test_end`` from one row per key with ``n``.

    Below 80 rows there is one fold at the split; else 2 to 5 windows of equal size after a growing training part.
    """
    folds = max(2, min(preferred, 5))
    spread = lengths.select(*keys, "n", F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold"))
    train_end, test_end, holds = fold_bounds(F.col("n"), F.col("fold"), preferred)
    return spread.where(holds).select(
        *keys, "fold", train_end.alias("train_end"), train_end.alias("test_start"), test_end.alias("test_end"),
    )


def fold_bounds(n: Column, fold: Column, preferred: int = 4) -> tuple[Column, Column, Column]:
    """Where training (and so the test's start) and test of a fold of ``n`` rows end, and whether there is such a fold."""
    folds = max(2, min(preferred, 5))
    window = F.greatest(F.lit(24), F.least(F.greatest(F.lit(40), F.floor(n / 12)), F.floor(n / (folds + 3)))).cast("long")
    start = F.greatest(F.floor(n * 0.55), window * 2).cast("long")
    small = n < 80
    train_end = F.when(small, split_index(n)).otherwise(start + (fold - 1) * window)
    test_end = F.when(small, n).otherwise(F.least(train_end + window, n))
    return train_end, test_end, (test_end > train_end) & (~small | (fold == 1))


#: Bits of a row in a fold: in the training part, in the test, last training row, first test row.
TRAIN, TEST, LAST, FIRST = 1, 2, 4, 8


def fold_marks(preferred: int = 4) -> Column:
    """The place of a row with ``idx`` and ``n`` in every fold, four bits each: what ``assign_fold`` finds, without a copy of the row or a join."""
    marks = F.lit(0)
    for fold in range(1, max(2, min(preferred, 5)) + 1):
        train_end, test_end, holds = fold_bounds(F.col("n"), F.lit(fold), preferred)
        place = (
            F.when(F.col("idx") < train_end - 1, TRAIN).when(F.col("idx") == train_end - 1, TRAIN + LAST)
            .when(F.col("idx") >= test_end, 0).when(F.col("idx") == train_end, TEST + FIRST).otherwise(TEST)
        )
        marks = marks + F.when(holds, place * (1 << 4 * (fold - 1))).otherwise(0)
    return marks


def marked(marks: Column, fold: int, bit: int) -> Column:
    return marks.bitwiseAND(bit << 4 * (fold - 1)) != 0


def latest_rows(indexed: DataFrame, rows: int = 6000) -> DataFrame:
    """The newest rows of each key."""
    return indexed.where(F.col("idx") >= F.col("n") - rows)


def persistence_baseline(indexed: DataFrame, keys: Sequence[str] = (), value: str = "value", train_end: Column | None = None) -> DataFrame:
    """Test rows with ``baseline``: the last training value of the key."""
    end = split_index(F.col("n")) if train_end is None else train_end
    last = indexed.where(F.col("idx") == end - 1).select(*keys, F.col(value).alias("baseline"))
    return attach(indexed.where(F.col("idx") >= end), last, keys)


def regression_metrics(predictions: DataFrame, keys: Sequence[str] = (), actual: str = "actual", predicted: str = "predicted", order: str = "idx") -> DataFrame:
    """MAE, RMSE, MAPE (denominator at least 1), R2 and MASE (scale: mean absolute step of the actuals) per key.

    ``order`` must number the rows of a key consecutively.
    """
    facts = predictions.groupBy(*keys).agg(F.count("*").alias("n"), F.min(order).alias("_start"))
    indexed = attach(predictions, facts, keys).withColumn("idx", F.col(order) - F.col("_start"))
    stepped = block_columns(indexed, keys, 1, {"_step": F.abs(F.col(actual) - F.lag(actual).over(block_window(keys)))})
    return metrics_of(stepped, keys, F.col(actual), F.col(predicted), F.col("_step"))


def metrics_of(df: DataFrame, keys: Sequence[str], y: Column, p: Column, step: Column) -> DataFrame:
    e = y - p
    mae = F.avg(F.abs(e))
    total = F.var_pop(y) * F.count(y)
    r2 = F.when(total > 0, 1 - F.sum(e * e) / total).otherwise(F.when(F.sum(e * e) == 0, 1.0).otherwise(0.0))
    scale = F.coalesce(F.avg(step), mae)
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"), mae.alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(1.0))) * 100).alias("mape"), r2.alias("r2"),
        (mae / F.greatest(scale, F.lit(1e-8))).alias("mase"),
    )


def fold_metrics_mean(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    return metrics.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in ("mae", "rmse", "mape", "r2", "mase")])


def best_candidate(fold_means: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Candidate with the lowest mean MAE, ties by name."""
    return fold_means.groupBy(*keys).agg(
        F.min_by("candidate", F.struct("mae", "candidate")).alias("candidate"), F.min("mae").alias("mae")
    )


def residual_summary(predictions: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Mean error, largest absolute error and its 95th percentile."""
    errors = predictions.select((F.col(actual) - F.col(predicted)).alias("e")).withColumn("a", F.abs("e"))
    p95 = exact_quantiles(errors, ["a"], [0.95])["a"][0]
    return errors.agg(F.avg("e").alias("mean_error"), F.max("a").alias("max_abs_error"), F.lit(p95).cast("double").alias("p95_abs_error"))


def mae_improvement(metrics: DataFrame, baseline: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, before, after, reduction_percent``."""
    joined = attach(metrics.select(*keys, F.col("mae").alias("after")), baseline.select(*keys, F.col("mae").alias("before")), keys)
    return joined.withColumn("reduction_percent", F.when(
        F.col("before") != 0, (F.col("before") - F.col("after")) / F.col("before") * 100).otherwise(0.0))


def evaluation_report(metrics: DataFrame, keys: Sequence[str] = (), baseline: str = "last_value") -> DataFrame:
    """``keys, candidate, rows, mae, baseline_mae, reduction_percent, acceptance`` of the best candidate per key."""
    row = F.struct("candidate", "rows", "mae")
    best = metrics.groupBy(*keys).agg(
        F.min_by(row, F.struct("mae", "candidate")).alias("_b"),
        F.max(F.when(F.col("candidate") == baseline, F.col("mae"))).alias("baseline_mae"),
    )
    mae, before = F.col("_b.mae"), F.col("baseline_mae")
    return best.select(
        *keys, "_b.candidate", "_b.rows", mae.alias("mae"), "baseline_mae",
        F.when(before != 0, (before - mae) / before * 100).otherwise(0.0).alias("reduction_percent"),
        F.when(mae.isNotNull() & ~F.isnan(mae) & (F.abs(mae) < float("inf")), "passed").otherwise("failed").alias("acceptance"),
    )


def prediction_samples(predictions: DataFrame, limit: int = 160, keys: Sequence[str] = (), order: Sequence[str] = ("idx",)) -> DataFrame:
    """Evenly spaced rows from first to last: ``keys, position, actual, predicted, error``.

    A row is kept when one of the ``limit`` grid points floor(i (n-1) / (k-1)) falls on its position.
    """
    placed = with_row_index(predictions.select(*keys, *order, "actual", "predicted").withColumnsRenamed({o: f"_o{i}" for i, o in enumerate(order)}),
                            [f"_o{i}" for i in range(len(order))], keys)
    k = F.least(F.lit(limit), F.col("n"))
    span, slots = F.col("n") - 1, k - 1
    slot = F.floor((F.col("idx") * slots + span - 1) / span)
    hit = F.when(F.col("n") == 1, F.lit(True)).otherwise(F.floor(slot * span / slots) == F.col("idx"))
    return placed.where(hit).select(
        *keys, F.col("idx").alias("position"), "actual", "predicted", (F.col("actual") - F.col("predicted")).alias("error")
    )
