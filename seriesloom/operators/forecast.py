"""Forecasts with intervals for one or many series; input is a series with ``ts``, ``value``, ``idx`` and ``n``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seriesloom.functions import stats
from seriesloom.operators.autoregression import ahead, fit_ar
from seriesloom.operators.frames import attach

# Points needed to project, recent points for the slope, points of the cycle and its weight,
# points behind the interval, its factor and its growth per step, points of the recent mean.
SHORTEST, RECENT, CYCLE, CYCLE_WEIGHT = 12, 24, 7, 0.35
SPREAD_POINTS, SPREAD_FACTOR, SPREAD_GROWTH, MEAN_POINTS = 60, 0.9, 0.04, 14


def tails(indexed: DataFrame, size: int, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, n, tail``: the last ``size`` values of each key in order, a short array."""
    recent = indexed.where(F.col("idx") >= F.col("n") - size)
    return recent.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(
        F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"]).alias("tail"))


def _steps(facts: DataFrame, horizon: int) -> DataFrame:
    return facts.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))


def forecast_ar(indexed: DataFrame, horizon: int, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, step, predicted`` by two lags of the differences; keys with fewer than 12 points or no fit are left out."""
    fitted = fit_ar(indexed, keys).where((F.col("n") >= SHORTEST) & F.col("ar2_phi1").isNotNull())
    level = ahead(F.col("step"), F.col("last"), F.col("ar2_phi1"), F.col("ar2_phi2"), F.col("d0"), F.col("d1"))
    return _steps(fitted, horizon).select(*keys, "step", level.alias("predicted"))


def forecast_drift_cycle(indexed: DataFrame, horizon: int, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, step, predicted``: last value, slope of the last 24 points and a damped cycle of the last seven."""
    tail = F.col("tail")
    size = F.size(tail)
    cycle = F.slice(tail, F.greatest(size - CYCLE + 1, F.lit(1)), F.lit(CYCLE))
    mean = F.aggregate(F.col("_cycle"), F.lit(0.0), lambda a, x: a + x) / F.size("_cycle")
    facts = tails(indexed, RECENT, keys).select(
        *keys, F.element_at(tail, -1).alias("_last"),
        ((F.element_at(tail, -1) - F.element_at(tail, 1)) / F.greatest(size - 1, F.lit(1))).alias("_slope"), cycle.alias("_cycle"),
    ).withColumn("_mean", mean)
    place = ((F.col("step") - 1) % F.size("_cycle") + 1).cast("int")
    level = F.col("_last") + F.col("_slope") * F.col("step") + (F.element_at("_cycle", place) - F.col("_mean")) * CYCLE_WEIGHT
    return _steps(facts, horizon).select(*keys, "step", level.alias("predicted"))


def forecast_flat(indexed: DataFrame, horizon: int, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, step, predicted``: the last value."""
    last = indexed.where(F.col("idx") == F.col("n") - 1).select(*keys, F.col("value").alias("predicted"))
    return _steps(last, horizon).select(*keys, "step", "predicted")


def interval_width(std: Column, step: Column) -> Column:
    return F.greatest(std * SPREAD_FACTOR, F.lit(1.0)) * (1 + (step - 1) * SPREAD_GROWTH)


def recent_spread(indexed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, spread, recent_mean``: deviation of the last 60 values and mean of the last 14 (all when fewer)."""
    recent = indexed.where(F.col("idx") >= F.col("n") - SPREAD_POINTS)
    return recent.groupBy(*keys).agg(
        F.stddev_pop("value").alias("spread"),
        F.avg(F.when((F.col("idx") >= F.col("n") - MEAN_POINTS), F.col("value"))).alias("recent_mean"),
    )


def actual_tail(indexed: DataFrame, horizon: int, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, step, actual``: the last ``horizon`` values; a shorter series is padded with its first value."""
    facts = _steps(tails(indexed, horizon, keys), horizon)
    place = F.greatest(F.col("step") - (F.lit(horizon) - F.size("tail")), F.lit(1))
    return facts.select(*keys, "step", F.element_at("tail", place).alias("actual"))


def forecast(indexed: DataFrame, horizon: int = 30, keys: Sequence[str] = (), method: str = "auto") -> DataFrame:
    """``keys, step, actual, predicted, lower, upper, method``.

    Method ``auto`` takes autoregression where it fits, else slope and cycle, and the last value below 12 points.
    """
    lengths = indexed.where(F.col("idx") == 0).select(*keys, "n")
    base = forecast_flat(indexed, horizon, keys).withColumnRenamed("predicted", "_flat")
    cyc = forecast_drift_cycle(indexed, horizon, keys).withColumnRenamed("predicted", "_cycle")
    reg = forecast_ar(indexed, horizon, keys).withColumnRenamed("predicted", "_ar")
    joined = attach(attach(attach(attach(base, cyc, [*keys, "step"]), reg, [*keys, "step"]), lengths, keys), recent_spread(indexed, keys), keys)
    joined = attach(joined, actual_tail(indexed, horizon, keys), [*keys, "step"])
    short = F.col("n") < SHORTEST
    if method == "drift_cycle":
        predicted, used = F.when(short, F.col("_flat")).otherwise(F.col("_cycle")), F.when(short, "flat").otherwise("drift_cycle")
    else:
        predicted = F.when(short, F.col("_flat")).otherwise(F.coalesce("_ar", "_cycle"))
        used = F.when(short, "flat").when(F.col("_ar").isNotNull(), "ar").otherwise("drift_cycle")
    width = interval_width(F.coalesce("spread", F.lit(0.0)), F.col("step"))
    return joined.select(
        *keys, "step", "actual", predicted.alias("predicted"), (predicted - width).alias("lower"),
        (predicted + width).alias("upper"), used.alias("method"), "recent_mean",
    )


def forecast_summary(points: DataFrame, keys: Sequence[str] = (), spans: Sequence[int] = (1, 7, 30)) -> DataFrame:
    """``keys, points, prediction, lower, upper, trend`` for the first 1, 7 and all points.

    The trend of a single point compares it with the recent mean, else the last point with the first.
    """
    stacked = points.withColumn("points", F.explode(F.array(*[F.lit(s) for s in spans]))).where(F.col("step") <= F.col("points"))
    facts = stacked.groupBy(*keys, "points").agg(
        F.avg("predicted").alias("prediction"), F.min("lower").alias("lower"), F.max("upper").alias("upper"),
        F.min_by("predicted", "step").alias("_first"), F.max_by("predicted", "step").alias("_last"), F.max("recent_mean").alias("_recent"),
    )
    single = F.when(F.col("_first") >= F.col("_recent"), "up").otherwise("down")
    trend = F.when(F.col("points") == 1, single).otherwise(stats.trend_label(F.col("_first"), F.col("_last")))
    return facts.select(*keys, "points", "prediction", "lower", "upper", trend.alias("trend"))
