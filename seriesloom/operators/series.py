"""Behaviour of ordered series, for one series or many keyed ones.

All functions from ``trend_strength`` on take a series with ``idx`` and ``n`` from ``with_row_index`` and return one row per key
unless they say otherwise. Windows run over blocks of positions (see ``rowindex``); everything per key is a partial
aggregate, so one dominant key spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from seriesloom.functions import stats
from seriesloom.operators.frames import attach
from seriesloom.operators.rowindex import block_columns, block_window, in_blocks, last_rows, with_row_index

# Lags looked at for seasonality, and the labels of the dominant period.
SEASON_LAGS = (7, 12, 24, 30, 48, 168)
PERIOD_LABELS = {7: "weekly-like", 12: "half-day-like", 24: "daily-like", 48: "two-day-like", 168: "weekly-hourly-like"}


def series_by_time(df: DataFrame, ts: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, ts, value``: the target summed per timestamp; rows without time or value are left out."""
    v = F.col(value).cast("double")
    return (
        df.where(F.col(ts).isNotNull() & v.isNotNull() & ~F.isnan(v))
        .groupBy(*keys, F.col(ts).alias("ts")).agg(F.sum(v).alias("value"))
    )


def indexed_series(df: DataFrame, ts: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """``series_by_time`` with ``idx`` and ``n``."""
    return with_row_index(series_by_time(df, ts, value, keys), ["ts"], keys)


def sample_evenly(indexed: DataFrame, points: int = 500) -> DataFrame:
    """Every (n / points)-th row from the start, at most ``points`` per key."""
    step = F.greatest(F.floor(F.col("n") / points), F.lit(1))
    step = F.when(F.col("n") > points, step).otherwise(F.lit(1))
    return indexed.where((F.col("idx") % step == 0) & (F.col("idx") / step < points))


def lagged(indexed: DataFrame, lags: Sequence[int], keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Add ``lag_k`` for each k."""
    w = block_window(keys)
    return block_columns(indexed, keys, max(lags), {f"lag_{k}": F.lag(value, k).over(w) for k in lags})


def _autocorr(lag: int) -> Column:
    corr = F.abs(stats.safe_corr(F.col(f"lag_{lag}"), F.col("value")))
    return F.when(F.max("n") > 2 * lag, corr)


def trend_expr() -> Column:
    return F.when(F.max("n") >= 3, F.abs(stats.safe_corr(F.col("idx").cast("double"), F.col("value")))).otherwise(0.0)


def season_expr() -> Column:
    best = F.greatest(*[F.coalesce(_autocorr(k), F.lit(0.0)) for k in SEASON_LAGS])
    return F.when(F.max("n") >= 48, best).otherwise(0.0)


def period_expr() -> Column:
    """Label of the best of the five named lags; ties go to the shorter lag."""
    scored = [F.coalesce(_autocorr(k), F.lit(-1.0)) for k in PERIOD_LABELS]
    best = F.greatest(*scored)
    label = F.lit(None).cast("string")
    for (k, name), score in reversed(list(zip(PERIOD_LABELS.items(), scored))):
        label = F.when(score == best, F.lit(name)).otherwise(label)
    return F.when(F.max("n") < 48, "insufficient history").when(best > 0.25, label).otherwise("weak periodicity")


def stationarity_expr() -> Column:
    v, half = F.col("value"), F.floor(F.col("n") / 2)
    first, second = F.when(F.col("idx") < half, v), F.when(F.col("idx") >= half, v)
    mean_shift = stats.ratio(F.abs(F.avg(second) - F.avg(first)), F.stddev_pop(v))
    var_shift = stats.ratio(F.abs(F.var_pop(second) - F.var_pop(first)), F.var_pop(v))
    score = F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), mean_shift / 3 + var_shift / 4))
    return F.when(F.max("n") >= 24, score).otherwise(0.0)


def drift_expr() -> Column:
    """Distance of the means of the first and last third in standard deviations (not yet scaled)."""
    v, third = F.col("value"), F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    early = F.avg(F.when(F.col("idx") < third, v))
    late = F.avg(F.when(F.col("idx") >= F.col("n") - third, v))
    return stats.ratio(F.abs(late - early), F.stddev_pop(v))


def noise_expr() -> Column:
    rest = F.stddev_pop(F.col("value") - F.col("smoothed"))
    return F.when(F.max("n") >= 10, F.least(F.lit(1.0), stats.ratio(rest, F.stddev_pop("value")))).otherwise(1.0)


def noise_width() -> Column:
    return F.greatest(F.lit(3), F.least(F.lit(24), F.floor(F.col("n") / 10)))


def regime_width() -> Column:
    return F.greatest(F.lit(12), F.least(F.lit(48), F.floor(F.col("n") / 8)))


def trend_strength(indexed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return indexed.groupBy(*keys).agg(trend_expr().alias("trend"))


def seasonality_strength(indexed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return lagged(indexed, SEASON_LAGS, keys).groupBy(*keys).agg(season_expr().alias("seasonality"))


def dominant_period(indexed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return lagged(indexed, tuple(PERIOD_LABELS), keys).groupBy(*keys).agg(period_expr().alias("period_label"))


def stationarity_score(indexed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return indexed.groupBy(*keys).agg(stationarity_expr().alias("stationarity"))


def drift_score(indexed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    drift = drift_expr()
    return indexed.groupBy(*keys).agg(
        drift.alias("drift"), F.least(drift / 3, F.lit(1.0)).alias("drift_score"),
        F.when(drift < 1.2, "stable").otherwise("shifted").alias("behavior"),
    )


def smoothed(indexed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``smoothed``: mean of the last max(3, min(24, n/10)) values, fewer at the start."""
    return block_columns(indexed, keys, 24, {"smoothed": F.avg("value").over(last_rows(noise_width(), keys))})


def noise_ratio(indexed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return smoothed(indexed, keys).groupBy(*keys).agg(noise_expr().alias("noise_ratio"))


def rolling_mean(indexed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``rolling``: full-window mean of width max(12, min(48, n/8)); null before the window is full."""
    width = regime_width()
    mean = F.when(F.col("idx") >= width - 1, F.avg("value").over(last_rows(width, keys)))
    return block_columns(indexed, keys, 48, {"rolling": mean})


def _rolling_steps(indexed: DataFrame, keys: Sequence[str]) -> DataFrame:
    width = regime_width()
    rolled = in_blocks(indexed, 49).withColumn(
        "rolling", F.when(F.col("idx") >= width - 1, F.avg("value").over(last_rows(width, keys)))
    )
    step = F.abs(F.col("rolling") - F.lag("rolling").over(block_window(keys)))
    return rolled.withColumn("step", step).where("_own").drop("_block", "_own")


def regime_changes(indexed: DataFrame, keys: Sequence[str] = (), first: int = 5) -> DataFrame:
    """Rows ``keys, rank, idx, ts, step``: first five steps of the rolling mean beyond mean + 2.5 deviations."""
    steps = _rolling_steps(indexed, keys)
    limits = steps.groupBy(*keys).agg(
        F.count("rolling").alias("_rolled"), (F.avg("step") + 2.5 * F.stddev_pop("step")).alias("_limit")
    )
    hits = attach(steps, limits, keys).where((F.col("_rolled") > 10) & (F.col("step") > F.col("_limit")))
    return _first_per_key(hits, keys, [F.asc("idx")], first).select(*keys, "rank", "idx", "ts", "step")


def _first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def z_scores(indexed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``z``: distance from the key's mean in (at least unit) deviations, with the timestamp on the row."""
    facts = indexed.groupBy(*keys).agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_std"))
    return attach(indexed, facts, keys).withColumn(
        "z", stats.ratio(F.col("value") - F.col("_mean"), F.col("_std"))
    ).drop("_mean", "_std")


def anomaly_points(indexed: DataFrame, keys: Sequence[str] = (), first: int = 8) -> DataFrame:
    """Rows ``keys, rank, idx, ts, value, severity``: first eight values more than three deviations away."""
    far = z_scores(indexed, keys).where(F.abs("z") > 3)
    return _first_per_key(far, keys, [F.asc("idx")], first).select(
        *keys, "rank", "idx", "ts", "value", F.abs("z").alias("severity")
    )


def mase_scale(indexed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean absolute step, the scale of MASE."""
    return lagged(indexed, [1], keys).groupBy(*keys).agg(F.avg(F.abs(F.col("value") - F.col("lag_1"))).alias("scale"))


def series_metrics(indexed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """All behaviour metrics per key, from two passes over the indexed series."""
    width = regime_width()
    w = block_window(keys)
    wide = in_blocks(indexed, max(SEASON_LAGS) + 1).withColumns({
        **{f"lag_{k}": F.lag("value", k).over(w) for k in SEASON_LAGS},
        "smoothed": F.avg("value").over(last_rows(noise_width(), keys)),
        "rolling": F.when(F.col("idx") >= width - 1, F.avg("value").over(last_rows(width, keys))),
    })
    wide = wide.withColumn("step", F.abs(F.col("rolling") - F.lag("rolling").over(w))).where("_own")
    drift = drift_expr()
    facts = wide.groupBy(*keys).agg(
        F.max("n").alias("n"), trend_expr().alias("trend"), season_expr().alias("seasonality"),
        period_expr().alias("period_label"), stationarity_expr().alias("stationarity"), noise_expr().alias("noise_ratio"),
        drift.alias("drift"), F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_std"),
        F.count("rolling").alias("_rolled"), (F.avg("step") + 2.5 * F.stddev_pop("step")).alias("_limit"),
    )
    # Second pass over the same windows: counts that need the key's own mean, deviation and step limit.
    judged = attach(wide.select(*keys, "value", "step"), facts.select(*keys, "_mean", "_std", "_rolled", "_limit"), keys)
    far = F.abs(stats.ratio(F.col("value") - F.col("_mean"), F.col("_std"))) > 3
    counts = judged.groupBy(*keys).agg(
        (F.count_if(far) / F.count("value")).alias("anomaly_rate"), F.count_if(far).alias("anomalies"),
        F.count_if((F.col("_rolled") > 10) & (F.col("step") > F.col("_limit"))).alias("regime_count"),
    )
    return attach(facts.drop("_mean", "_std", "_rolled", "_limit"), counts, keys).withColumn(
        "drift_score", F.least(F.col("drift") / 3, F.lit(1.0))
    )


def last_value(indexed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return indexed.where(F.col("idx") == F.col("n") - 1).select(*keys, F.col("ts").alias("last_ts"), F.col("value").alias("last"))


def forward_backward_fill(indexed: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), backward: bool = True) -> DataFrame:
    """Fill gaps with the last value before, else (with ``backward``) the first value after, inside each key.

    Inside a block this is a plain window. The value entering a block from outside comes from a table with one row per block,
    so a gap may be longer than a block.
    """
    own = in_blocks(indexed, 0)
    inside = Window.partitionBy(*keys, "_block").orderBy("idx")
    before = inside.rowsBetween(Window.unboundedPreceding, 0)
    # Looking ahead is looking back in reverse order: a frame that only grows, instead of one evaluated anew per row.
    after = Window.partitionBy(*keys, "_block").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    edges = own.groupBy(*keys, "_block").agg(*[
        x for i, c in enumerate(columns) for x in (
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col("idx"))).alias(f"_last{i}"),
            F.min_by(c, F.when(F.col(c).isNotNull(), F.col("idx"))).alias(f"_first{i}"),
        )
    ])
    blocks = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_block")
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(*keys, "_block", *[
        x for i, _ in enumerate(columns) for x in (
            F.last(f"_last{i}", ignorenulls=True).over(earlier).alias(f"_from_before{i}"),
            F.last(f"_first{i}", ignorenulls=True).over(later).alias(f"_from_after{i}"),
        )
    ])
    filled = own.withColumns({
        f"_fill{i}": F.last(c, ignorenulls=True).over(before) for i, c in enumerate(columns)
    } | {f"_next{i}": F.last(c, ignorenulls=True).over(after) for i, c in enumerate(columns)})
    joined = attach(filled, carried, [*keys, "_block"])
    sources = ["_fill", "_from_before", *(["_next", "_from_after"] if backward else [])]
    return joined.select(*[
        F.coalesce(*[f"{source}{columns.index(c)}" for source in sources]).alias(c) if c in columns else F.col(c) for c in indexed.columns
    ])
