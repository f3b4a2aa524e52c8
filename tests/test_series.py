"""Series operators: blocks, hot keys, leakage, folds, forecasts."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import autoregression, cleaning, features, forecast, pairing, rowindex, series, timeaxis, trees, validation


@pytest.fixture(scope="module")
def panel(spark):
    """Two keys of very different length (most rows in one) and a null key."""
    rng = np.random.default_rng(1)
    rows = []
    for key, n in (("hot", 700), ("cold", 5), (None, 60)):
        y = 50 + 0.05 * np.arange(n) + 10 * np.sin(np.arange(n) / 24 * 2 * np.pi) + rng.normal(0, 1, n)
        y[n // 2:] += 5
        rows += [(key, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(v)) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, value double").repartition(6)


def collected(df, order=("k", "idx")):
    return df.orderBy(*order).toPandas()


def test_row_index_over_partitions(panel):
    small = collected(rowindex.with_row_index(panel, ["ts"], ["k"]))
    for _, g in small.groupby("k", dropna=False):
        assert list(g.sort_values("ts")["idx"]) == list(range(len(g))) and set(g["n"]) == {len(g)}


def test_row_index_when_one_key_spans_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(5000).select((F.col("id") % 3 == 0).cast("int").alias("k"), F.col("id").alias("o"))
        out = rowindex.with_row_index(df, ["o"], ["k"]).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for _, g in out.groupby("k"):
        assert list(g.sort_values("o")["idx"]) == list(range(len(g)))


@pytest.mark.parametrize("rows", [60, 100])
def test_small_blocks_change_nothing(panel, monkeypatch, rows):
    indexed = rowindex.with_row_index(panel, ["ts"], ["k"])

    def run():
        wide = features.rolling_features(indexed, (3, 12), ["k"])
        lags = features.lag_features(indexed, (1, 24), ["k"])
        noise = series.noise_ratio(indexed, ["k"])
        rolled = series.rolling_mean(indexed, ["k"])
        gaps = indexed.withColumn("gap", F.when(F.col("idx").between(20, 450) | (F.col("idx") < 3), None).otherwise(F.col("value")))
        filled = series.forward_backward_fill(gaps, ["gap"], ["k"])
        return [collected(wide), collected(lags), collected(noise, ["k"]), collected(rolled), collected(filled)]

    want = run()
    monkeypatch.setattr(rowindex, "BLOCK_ROWS", rows)
    for a, b in zip(want, run()):
        pd.testing.assert_frame_equal(a, b, rtol=1e-9)


def test_fill_against_pandas(panel):
    indexed = rowindex.with_row_index(panel, ["ts"], ["k"]).withColumn("gap", F.when(F.col("idx") % 7 == 3, F.col("value")))
    got = collected(series.forward_backward_fill(indexed, ["gap"], ["k"]))
    before = collected(indexed)
    want = before.groupby("k", dropna=False)["gap"].transform(lambda s: s.ffill().bfill())
    np.testing.assert_allclose(got["gap"].to_numpy(), want.to_numpy())


def test_metrics_against_pandas(panel):
    metrics = {r["k"]: r for r in series.series_metrics(rowindex.with_row_index(panel, ["ts"], ["k"]), ["k"]).collect()}
    v = panel.where("k = 'hot'").orderBy("ts").toPandas()["value"]
    n = len(v)
    lags = [abs(v.shift(k).corr(v)) for k in (7, 12, 24, 30, 48, 168)]
    smooth = v.rolling(max(3, min(24, n // 10)), min_periods=1).mean()
    assert metrics["hot"]["seasonality"] == pytest.approx(max(lags))
    assert metrics["hot"]["noise_ratio"] == pytest.approx((v - smooth).std(ddof=0) / max(v.std(ddof=0), 1))
    assert metrics["hot"]["trend"] == pytest.approx(abs(np.corrcoef(np.arange(n), v)[0, 1]))
    assert metrics["hot"]["period_label"] in ("daily-like", "two-day-like", "weekly-hourly-like")
    assert metrics["cold"]["noise_ratio"] == 1.0 and metrics["cold"]["stationarity"] == 0.0 and metrics["cold"]["seasonality"] == 0.0
    assert metrics[None]["n"] == 60


def test_key_result_equals_single_series(panel):
    one = series.series_metrics(rowindex.with_row_index(panel.where("k = 'hot'").drop("k"), ["ts"])).first().asDict()
    keyed = series.series_metrics(rowindex.with_row_index(panel, ["ts"], ["k"]), ["k"]).where("k = 'hot'").drop("k").first().asDict()
    assert one == pytest.approx(keyed) if all(not isinstance(v, str) for v in one.values()) else all(
        one[c] == (pytest.approx(keyed[c]) if isinstance(keyed[c], float) else keyed[c]) for c in one)


def test_level_shift_and_spikes_are_found(spark):
    y = np.sin(np.arange(400) / 10) + np.where(np.arange(400) < 200, 0, 30)
    y[[50, 150, 350]] += 200
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(y)], "ts timestamp_ntz, value double")
    indexed = rowindex.with_row_index(df, ["ts"])
    assert [r["idx"] for r in series.anomaly_points(indexed).orderBy("rank").collect()] == [50, 150, 350]
    assert series.regime_changes(indexed).count() > 0
    assert series.drift_score(indexed).first()["drift"] > 1


def test_features_do_not_see_their_own_row(panel):
    indexed = rowindex.with_row_index(panel, ["ts"], ["k"])
    changed = indexed.withColumn("value", F.when((F.col("k") == "hot") & (F.col("idx") == 300), 1e6).otherwise(F.col("value")))

    def at(df):
        out = features.diff_features(features.rolling_features(features.lag_features(df, (1, 6), ["k"]), (3, 6), ["k"]), (1, 24), ["k"])
        row = out.where("k = 'hot' and idx = 300").first().asDict()
        return {k: v for k, v in row.items() if k not in ("value",)}

    assert at(indexed) == at(changed)


def test_folds_never_look_ahead(spark):
    lengths = spark.createDataFrame([("a", 79), ("b", 80), ("c", 1000), ("d", 6), ("e", 1_000_000)], "k string, n long")
    folds = validation.walk_forward_folds(lengths, ["k"]).toPandas()
    sizes = dict(lengths.collect())
    assert set(folds["k"]) == set(sizes)
    for k, g in folds.groupby("k"):
        g = g.sort_values("fold")
        assert (g["train_end"] <= g["test_start"]).all() and (g["test_end"] <= sizes[k]).all()
        assert (g["test_start"].iloc[1:].to_numpy() >= g["test_end"].iloc[:-1].to_numpy()).all()
    assert len(folds[folds.k == "a"]) == 1 and len(folds[folds.k == "c"]) == 4


@pytest.mark.parametrize("phi", [(0.5, 0.3), (0.5, -0.8), (1.0, -0.25), (0.0, 0.0), (-0.4, 0.0), (0.6, 0.4)])
def test_closed_form_equals_recursion(spark, phi):
    p1, p2 = phi
    y, d0, d1, want = 10.0, 1.5, -0.7, []
    for _ in range(40):
        d0, d1 = p1 * d0 + p2 * d1, d0
        y += d0
        want.append(y)
    f = F.lit
    got = spark.range(1, 41).select(autoregression.ahead(F.col("id"), f(10.0), f(p1), f(p2), f(1.5), f(-0.7)).alias("y")).toPandas()["y"]
    if p1 + p2 == 1:  # a unit root has no finite sum formula; the level then follows the last difference
        assert len(got) == 40 and got.notna().all()
    else:
        np.testing.assert_allclose(got, want, rtol=1e-8)


def test_forecast_short_and_long_series(panel):
    points = forecast.forecast(rowindex.with_row_index(panel, ["ts"], ["k"]), 10, ["k"]).toPandas()
    assert len(points) == 30 and (points["lower"] < points["predicted"]).all() and (points["upper"] > points["predicted"]).all()
    assert set(points[points.k == "cold"]["method"]) == {"flat"} and set(points[points.k == "hot"]["method"]) == {"ar"}
    width = (points["upper"] - points["lower"])[points.k == "hot"].to_numpy()
    assert (np.diff(points[points.k == "hot"].sort_values("step")["upper"] - points[points.k == "hot"].sort_values("step")["lower"]) > 0).all() and len(width) == 10


def test_persistence_and_metrics_against_numpy(panel):
    indexed = rowindex.with_row_index(panel.where("k = 'hot'").drop("k"), ["ts"])
    based = validation.persistence_baseline(indexed).withColumnsRenamed({"value": "actual", "baseline": "predicted"})
    row = validation.regression_metrics(based).first()
    v = panel.where("k = 'hot'").orderBy("ts").toPandas()["value"].to_numpy()
    split = max(int(len(v) * 0.8), len(v) - 200)
    y, p = v[split:], np.full(len(v) - split, v[split - 1])
    assert row["mae"] == pytest.approx(np.abs(y - p).mean())
    assert row["mase"] == pytest.approx(np.abs(y - p).mean() / np.abs(np.diff(y)).mean())
    assert row["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_sampling_grid(spark):
    df = spark.range(1000).select(F.col("id").alias("idx"), F.col("id").cast("double").alias("actual"), F.lit(0.0).alias("predicted"))
    got = [r["position"] for r in validation.prediction_samples(df, 160).orderBy("position").collect()]
    assert got == list(np.linspace(0, 999, 160).astype(int))


def test_numbers_are_no_time_axis(spark):
    df = spark.createDataFrame([(i, float(i), f"2024-01-{i % 28 + 1:02d}") for i in range(100)], "screen_time long, x double, day_text string")
    assert timeaxis.detect_time_axis(df).first()["column"] == "day_text"
    assert timeaxis.detect_time_axis(df.drop("day_text")).count() == 0


def test_trees_beat_persistence(spark):
    n = 400
    y = 50 + 10 * np.sin(np.arange(n) / 12 * 2 * np.pi)
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(v)) for i, v in enumerate(y)], "ts timestamp_ntz, value double")
    matrix, plan = features.supervised_matrix(df, "value", "ts")
    result = trees.train_trees(matrix, "value", plan.features, ["ts"], grid=[{"numTrees": 10, "maxDepth": 6}], folds=2)
    assert result.metrics.first()["mae"] < 0.5 * result.baseline.first()["mae"]
    assert result.train_rows + result.test_rows == matrix.count() and result.samples.count() > 0


def test_cleaning_same_for_any_partitioning(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"i": range(300), "t": rng.normal(0, 1, 300), "f": rng.exponential(2, 300), "g": [None if i % 3 == 0 else float(i) for i in range(300)], "c": [None if i % 50 == 0 else "ab"[i % 2] for i in range(300)]})
    df = spark.createDataFrame(pdf)
    frames = []
    for parts in (1, 40):
        clean, report = cleaning.prepare_frame(df.repartition(parts), "t", order_by=["i"])
        frames.append(clean.orderBy("i").toPandas())
    pd.testing.assert_frame_equal(*frames)
    assert report.indicators == ["g_was_missing"] and frames[0].notna().all().all()


def test_lag_join_equals_lag_window(panel):
    indexed = rowindex.with_row_index(panel, ["ts"], ["k"])
    by_join = pairing.lag_self_pair(indexed, 3, ["k"]).orderBy("k", "idx").toPandas()["earlier"]
    by_window = features.lag_features(indexed, (3,), ["k"]).where("lag_3 is not null").orderBy("k", "idx").toPandas()["lag_3"]
    assert list(by_join) == list(by_window)
