from __future__ import annotations

from pyspark.sql import functions as F

from registered import query, rounded
from registered.series import GAPS, P, SPLIT
from registered.tables import DAILY, KEY, daily_orders
from seriesloom.functions import stats
from seriesloom.operators import autoregression, forecast, pairing, runs, tables, timeaxis, validation

H = 30
FLAT = f"flat AS (SELECT o_orderpriority, CAST(step AS INT) AS step, value AS predicted FROM ix, range(1, {H + 1}) r(step) WHERE idx = n - 1)"
CYCLE = f"""t24 AS (SELECT o_orderpriority, list(value ORDER BY idx) AS tail FROM ix WHERE idx >= n - 24 GROUP BY 1),
cy AS (SELECT o_orderpriority, tail, (tail[-1] - tail[1]) / greatest(len(tail) - 1, 1) AS slope, list_slice(tail, greatest(len(tail) - 6, 1), len(tail)) AS cyc FROM t24),
cycle AS (SELECT o_orderpriority, CAST(step AS INT) AS step, tail[-1] + slope * step + 0.35 * (cyc[(step - 1) % len(cyc) + 1] - list_avg(cyc)) AS predicted FROM cy, range(1, {H + 1}) r(step))"""


def fit_sql(where: str, name: str = "fit") -> str:
    """Sums of lag products per key and the state at the end of the training rows, straight from the definition."""
    return f"""{name}_d AS (SELECT *, value - lag(value) OVER w AS d, lag(value) OVER w - lag(value, 2) OVER w AS a, lag(value, 2) OVER w - lag(value, 3) OVER w AS b FROM ix WINDOW w AS ({P} ORDER BY idx)),
{name}_s AS (SELECT o_orderpriority, max(n) AS n, arg_max(value, idx) AS last, arg_max(d, idx) AS d0, arg_max(a, idx) AS d1, sum(d * a) / sum(a * a) FILTER (WHERE a IS NOT NULL) AS p1,
 sum(a * a) FILTER (WHERE b IS NOT NULL) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(d * a) FILTER (WHERE b IS NOT NULL) AS da, sum(d * b) AS db FROM {name}_d WHERE {where} GROUP BY 1),
{name} AS (SELECT o_orderpriority, n, last, d0, d1, p1, (da * bb - db * ab) / (aa * bb - ab * ab) AS q1, (db * aa - da * ab) / (aa * bb - ab * ab) AS q2 FROM {name}_s)"""


AR = fit_sql("true") + f""", ar AS (SELECT o_orderpriority, 0 AS step, last AS y, d0 AS d, d1 AS e, q1, q2 FROM fit UNION ALL
 SELECT o_orderpriority, step + 1, y + q1 * d + q2 * e, q1 * d + q2 * e, d, q1, q2 FROM ar WHERE step < {H})"""
SPREAD = """sp AS (SELECT o_orderpriority, stddev_pop(value) AS spread, avg(value) FILTER (WHERE idx >= n - 14) AS recent_mean FROM ix WHERE idx >= n - 60 GROUP BY 1)"""
TAIL = f"""tl AS (SELECT o_orderpriority, CAST(step AS INT) AS step, value AS actual FROM ix, range(1, {H + 1}) r(step) WHERE idx = greatest(n - {H} + step - 1, 0))"""
WIDTH = "greatest(0.9 * spread, 1) * (1 + 0.04 * (step - 1))"


@query("forecast_flat", f"WITH {DAILY}, {FLAT} SELECT o_orderpriority, step, round(predicted, 2) AS predicted FROM flat")
def forecast_flat(t):
    return rounded(forecast.forecast_flat(daily_orders(t), H, KEY), 2, "predicted")


@query("forecast_drift_cycle", f"WITH {DAILY}, {CYCLE} SELECT o_orderpriority, step, round(predicted, 4) AS predicted FROM cycle")
def forecast_drift_cycle(t):
    return rounded(forecast.forecast_drift_cycle(daily_orders(t), H, KEY), 4, "predicted")


@query("forecast_ar", f"WITH RECURSIVE {DAILY}, {AR} SELECT o_orderpriority, CAST(step AS INT) AS step, round(y, 4) AS predicted FROM ar WHERE step > 0")
def forecast_ar(t):
    return rounded(forecast.forecast_ar(daily_orders(t), H, KEY), 4, "predicted")


@query("actual_tail", f"WITH {DAILY}, {TAIL} SELECT o_orderpriority, step, round(actual, 2) AS actual FROM tl")
def actual_tail(t):
    return rounded(forecast.actual_tail(daily_orders(t), H, KEY), 2, "actual")


@query("prediction_interval", f"WITH {DAILY}, {SPREAD} SELECT o_orderpriority, CAST(step AS INT) AS step, round({WIDTH}, 4) AS width FROM sp, range(1, {H + 1}) r(step)")
def prediction_interval(t):
    spread = forecast.recent_spread(daily_orders(t), KEY).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(H))))
    return rounded(spread.select(*KEY, "step", forecast.interval_width(F.col("spread"), F.col("step")).alias("width")), 4, "width")


POINTS = f"""pts AS (SELECT ar.o_orderpriority, CAST(ar.step AS INT) AS step, actual, y AS predicted, y - {WIDTH.replace('step', 'ar.step')} AS lower, y + {WIDTH.replace('step', 'ar.step')} AS upper, recent_mean
 FROM ar JOIN sp USING (o_orderpriority) JOIN tl ON tl.o_orderpriority = ar.o_orderpriority AND tl.step = ar.step WHERE ar.step > 0)"""


@query("forecast", f"WITH RECURSIVE {DAILY}, {AR}, {SPREAD}, {TAIL}, {POINTS} SELECT o_orderpriority, step, round(actual, 2) AS actual, round(predicted, 4) AS predicted, round(lower, 4) AS lower, round(upper, 4) AS upper, 'ar' AS method FROM pts")
def run_forecast(t):
    out = forecast.forecast(daily_orders(t), H, KEY).drop("recent_mean")
    return rounded(rounded(out, 2, "actual"), 4, "predicted", "lower", "upper")


@query("zip_forecast", f"WITH {DAILY}, {GAPS}, {CYCLE}, {TAIL} SELECT c.o_orderpriority, c.step, gs.\"end\" + to_seconds(modal_gap_seconds * c.step) AS ts, round(actual, 2) AS actual, round(predicted, 4) AS predicted FROM cycle c JOIN gs USING (o_orderpriority) JOIN tl ON tl.o_orderpriority = c.o_orderpriority AND tl.step = c.step")
def zip_forecast(t):
    indexed = daily_orders(t)
    times = timeaxis.future_timestamps(t("orders"), "o_orderdate", H, KEY)
    parts = pairing.zip_steps(times, forecast.forecast_drift_cycle(indexed, H, KEY), KEY)
    return rounded(rounded(pairing.zip_steps(parts, forecast.actual_tail(indexed, H, KEY), KEY), 2, "actual"), 4, "predicted")


@query("forecast_summary", f"""WITH RECURSIVE {DAILY}, {AR}, {SPREAD}, {TAIL}, {POINTS},
s AS (SELECT o_orderpriority, CAST(p AS INT) AS points, avg(predicted) AS prediction, min(lower) AS lower, max(upper) AS upper, arg_min(predicted, step) AS f, arg_max(predicted, step) AS l, any_value(recent_mean) AS m
 FROM pts, (SELECT unnest([1, 7, 30]) AS p) WHERE step <= p GROUP BY 1, 2)
SELECT o_orderpriority, points, round(prediction, 4) AS prediction, round(lower, 4) AS lower, round(upper, 4) AS upper,
 CASE WHEN points = 1 THEN CASE WHEN f >= m THEN 'up' ELSE 'down' END WHEN l > f THEN 'up' WHEN l < f THEN 'down' ELSE 'stable' END AS trend FROM s""")
def forecast_summary(t):
    points = forecast.forecast(daily_orders(t), H, KEY)
    return rounded(forecast.forecast_summary(points, KEY), 4, "prediction", "lower", "upper")


@query("trend_label", f"WITH {DAILY}, {CYCLE} SELECT o_orderpriority, CASE WHEN arg_max(predicted, step) > arg_min(predicted, step) THEN 'up' WHEN arg_max(predicted, step) < arg_min(predicted, step) THEN 'down' ELSE 'stable' END AS trend FROM cycle GROUP BY 1")
def trend_label(t):
    points = forecast.forecast_drift_cycle(daily_orders(t), H, KEY)
    return points.groupBy(*KEY).agg(stats.trend_label(F.min_by("predicted", "step"), F.max_by("predicted", "step")).alias("trend"))


# Holdout of the autoregression: recursive continuation from the training end, metrics from their definitions.
HOLD = f"""{fit_sql(f"idx < {SPLIT}", "hf")}, hl AS (SELECT o_orderpriority, max(n) AS hn, any_value({SPLIT}) AS split FROM ix GROUP BY 1),
hr AS (SELECT o_orderpriority, 0::BIGINT AS step, last AS y1, d0 AS d1v, last AS y2, d0 AS da_, d1 AS db_, p1, q1, q2, last FROM hf UNION ALL
 SELECT hr.o_orderpriority, step + 1, y1 + p1 * d1v, p1 * d1v, y2 + q1 * da_ + q2 * db_, q1 * da_ + q2 * db_, da_, p1, q1, q2, last FROM hr JOIN hl USING (o_orderpriority) WHERE step < hn - split),
ht AS (SELECT ix.o_orderpriority, idx, idx - split + 1 AS step, value AS actual, CASE WHEN idx > split THEN abs(value - prev) END AS move
 FROM (SELECT *, lag(value) OVER ({P} ORDER BY idx) AS prev FROM ix) ix JOIN hl USING (o_orderpriority) WHERE idx >= split),
hp AS (SELECT ht.*, unnest(['ar1', 'ar2', 'last_value']) AS candidate, unnest([y1, y2, last]) AS predicted, last AS baseline FROM ht JOIN hr ON hr.o_orderpriority = ht.o_orderpriority AND hr.step = ht.step),
hm AS (SELECT o_orderpriority, candidate, count(*) AS rows, avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) ** 2)) AS rmse, avg(abs(actual - predicted) / greatest(abs(actual), 1)) * 100 AS mape,
 1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)) AS r2, avg(abs(actual - predicted)) / greatest(avg(move), 1e-8) AS mase FROM hp GROUP BY 1, 2)"""
METRICS = "round(mae, 6) AS mae, round(rmse, 4) AS rmse, round(mape, 6) AS mape, round(r2, 6) AS r2, round(mase, 6) AS mase"


def round_metrics(df):
    return rounded(rounded(df, 4, "rmse"), 6, "mae", "mape", "r2", "mase")


def holdout(t):
    return autoregression.predict_holdout(daily_orders(t), KEY)


@query("fit_ar", f"WITH {DAILY}, {fit_sql('true')} SELECT o_orderpriority, round(p1, 6) AS ar1_phi1, round(q1, 6) AS ar2_phi1, round(q2, 6) AS ar2_phi2 FROM fit")
def fit_ar(t):
    out = autoregression.fit_ar(daily_orders(t), KEY).select(*KEY, "ar1_phi1", "ar2_phi1", "ar2_phi2")
    return rounded(out, 6, "ar1_phi1", "ar2_phi1", "ar2_phi2")


@query("train_ar", f"WITH RECURSIVE {DAILY}, {HOLD} SELECT o_orderpriority, candidate, rows, {METRICS}, candidate = arg_min(candidate, mae) OVER (PARTITION BY o_orderpriority) AS best FROM hm")
def train_ar(t):
    return round_metrics(autoregression.train_ar(daily_orders(t), KEY))


@query("regression_metrics", f"WITH RECURSIVE {DAILY}, {HOLD} SELECT o_orderpriority, candidate, rows, {METRICS} FROM hm")
def regression_metrics(t):
    return round_metrics(validation.regression_metrics(holdout(t), [*KEY, "candidate"]))


@query("fold_metrics_mean", f"WITH RECURSIVE {DAILY}, {HOLD} SELECT candidate, round(avg(mae), 6) AS mae, round(avg(rmse), 4) AS rmse, round(avg(mape), 6) AS mape, round(avg(r2), 6) AS r2, round(avg(mase), 6) AS mase FROM hm GROUP BY 1")
def fold_metrics_mean(t):
    return round_metrics(validation.fold_metrics_mean(autoregression.train_ar(daily_orders(t), KEY), ["candidate"]))


@query("best_candidate", f"WITH RECURSIVE {DAILY}, {HOLD} SELECT o_orderpriority, arg_min(candidate, mae) AS candidate, round(min(mae), 6) AS mae FROM hm GROUP BY 1")
def best_candidate(t):
    return rounded(validation.best_candidate(autoregression.train_ar(daily_orders(t), KEY), KEY), 6, "mae")


@query("naive_model", f"WITH RECURSIVE {DAILY}, {HOLD} SELECT o_orderpriority, rows, {METRICS} FROM hm WHERE candidate = 'last_value'")
def naive_model(t):
    based = validation.persistence_baseline(daily_orders(t), KEY).withColumnsRenamed({"value": "actual", "baseline": "predicted"})
    return round_metrics(validation.regression_metrics(based, KEY))


@query("mae_improvement", f"WITH RECURSIVE {DAILY}, {HOLD} SELECT a.o_orderpriority, round(a.mae, 6) AS after, round(b.mae, 6) AS before, round((b.mae - a.mae) / b.mae * 100, 6) AS reduction_percent FROM hm a JOIN hm b USING (o_orderpriority) WHERE a.candidate = 'ar2' AND b.candidate = 'last_value'")
def mae_improvement(t):
    metrics = autoregression.train_ar(daily_orders(t), KEY)
    out = validation.mae_improvement(metrics.where("candidate = 'ar2'"), metrics.where("candidate = 'last_value'"), KEY)
    return rounded(out, 6, "after", "before", "reduction_percent")


@query("residual_summary", f"WITH RECURSIVE {DAILY}, {HOLD} SELECT round(avg(actual - predicted), 4) AS mean_error, round(max(abs(actual - predicted)), 4) AS max_abs_error, round(quantile_cont(abs(actual - predicted), 0.95), 4) AS p95_abs_error FROM hp WHERE candidate = 'ar2'")
def residual_summary(t):
    return rounded(validation.residual_summary(holdout(t).where("candidate = 'ar2'")), 4, "mean_error", "max_abs_error", "p95_abs_error")


@query("prediction_samples", f"""WITH RECURSIVE {DAILY}, {HOLD}, s AS (SELECT o_orderpriority, step - 1 AS position, actual, predicted, count(*) OVER (PARTITION BY o_orderpriority) AS k FROM hp WHERE candidate = 'ar2')
SELECT o_orderpriority, position, round(actual, 2) AS actual, round(predicted, 4) AS predicted, round(actual - predicted, 4) AS error FROM s
WHERE position IN (SELECT floor(i * (s.k - 1) / (least(160, s.k) - 1)) FROM range(0, 160) g(i) WHERE i < least(160, s.k))""")
def prediction_samples(t):
    out = validation.prediction_samples(holdout(t).where("candidate = 'ar2'"), 160, KEY)
    return rounded(rounded(out, 2, "actual"), 4, "predicted", "error")


@query("evaluation_report", f"""WITH RECURSIVE {DAILY}, {HOLD} SELECT a.o_orderpriority, a.candidate, a.rows, round(a.mae, 6) AS mae, round(b.mae, 6) AS baseline_mae, round((b.mae - a.mae) / b.mae * 100, 6) AS reduction_percent,
 CASE WHEN isfinite(a.mae) THEN 'passed' ELSE 'failed' END AS acceptance FROM hm a JOIN hm b ON b.o_orderpriority = a.o_orderpriority AND b.candidate = 'last_value' QUALIFY row_number() OVER (PARTITION BY a.o_orderpriority ORDER BY a.mae, a.candidate) = 1""")
def evaluation_report(t):
    return rounded(validation.evaluation_report(autoregression.train_ar(daily_orders(t), KEY), KEY), 6, "mae", "baseline_mae", "reduction_percent")


# Runs of a monitor: one run per event, its type the model and its value the percentage error.
RUNS = "(SELECT event_id AS run_id, user_id AS dataset, event_type AS model, 1 - value / 500 AS r2, value AS mape, ts FROM events)"


def run_rows(t):
    return t("events").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("dataset"), F.col("event_type").alias("model"),
                              (1 - F.col("value") / 500).alias("r2"), F.col("value").alias("mape"), "ts")


@query("append_run", f"SELECT run_id, dataset, model, ts FROM {RUNS} ORDER BY ts DESC, run_id DESC LIMIT 25")
def append_run(t):
    return runs.newest(run_rows(t), runs.KEPT_RUNS).select("run_id", "dataset", "model", "ts")


@query("recent_runs", f"SELECT run_id, dataset, model, ts FROM {RUNS} ORDER BY ts DESC, run_id DESC LIMIT 10")
def recent_runs(t):
    return runs.recent_runs(run_rows(t)).select("run_id", "dataset", "model", "ts")


@query("kpi_rollup", f"SELECT round(arg_max(r2, ts) * 100, 6) AS model_accuracy, arg_max(model, ts) AS model_used, count(*) AS runs, round(least(0.95, 0.12 + arg_max(mape, ts) / 10), 6) AS drift_score FROM {RUNS}")
def kpi_rollup(t):
    return rounded(runs.kpi_rollup(run_rows(t)), 6, "model_accuracy", "drift_score")


ALERTS = f"SELECT dataset, run_id, ts, drift FROM (SELECT *, least(0.95, 0.12 + mape / 10) AS drift FROM {RUNS} QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY ts DESC, run_id DESC) = 1)"


@query("drift_alerts", f"SELECT dataset, run_id, ts, round(drift, 6) AS drift_score FROM ({ALERTS}) WHERE drift > 0.5")
def drift_alerts(t):
    return rounded(runs.drift_alerts(run_rows(t)), 6, "drift_score")


@query("open_alerts", f"SELECT dataset, run_id, round(drift, 6) AS drift_score FROM ({ALERTS}) WHERE drift > 0.5 AND drift >= 0.9")
def open_alerts(t):
    alerts = runs.drift_alerts(run_rows(t)).withColumn("acknowledged", F.col("drift_score") < 0.9)
    return rounded(runs.open_alerts(alerts).select("dataset", "run_id", "drift_score"), 6, "drift_score")


@query("latest_details", "SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_details(t):
    return pairing.latest_details(t("events").drop("props"), ["user_id", "event_type"], "ts", "event_id")


@query("sort_table", "SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders")
def sort_table(t):
    return tables.sort_table(t("orders").select("o_orderpriority", "o_orderkey", "o_totalprice"), "o_totalprice", True, ["o_orderkey"])


@query("preview_page", "SELECT *, (SELECT count(*) FROM orders) AS total_rows, CAST(ceil((SELECT count(*) FROM orders) / 25.0) AS BIGINT) AS total_pages FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25 OFFSET 50")
def preview_page(t):
    return tables.preview_page(t("orders"), ["o_orderdate", "o_orderkey"], 3)
