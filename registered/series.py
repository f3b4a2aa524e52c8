from __future__ import annotations

from pyspark.sql import functions as F

from registered import joined, logged, query, rounded
from registered.tables import DAILY, EVENTS_WITH_GAPS, KEY, LINEITEM_ORDER, daily_orders, events_with_gaps
from seriesloom.functions import names
from seriesloom.operators import features, pairing, profile, rowindex, series, timeaxis, validation

P = "PARTITION BY o_orderpriority"
LAGS = (7, 12, 24, 30, 48, 168)
LAGGED = f"lg AS (SELECT *, {', '.join(f'lag(value, {k}) OVER ({P} ORDER BY idx) AS lag_{k}' for k in LAGS)} FROM ix)"


def _auto(k: int) -> str:
    return f"coalesce(CASE WHEN any_value(n) > {2 * k} AND count(lag_{k}) >= 3 THEN abs(corr(lag_{k}, value)) END, {{none}})"


SEASON = f"CASE WHEN any_value(n) >= 48 THEN greatest({', '.join(_auto(k).format(none=0) for k in LAGS)}) ELSE 0 END"
LABELS = {7: "weekly-like", 12: "half-day-like", 24: "daily-like", 48: "two-day-like", 168: "weekly-hourly-like"}
BEST = f"greatest({', '.join(_auto(k).format(none=-1) for k in LABELS)})"
PERIOD = "CASE WHEN any_value(n) < 48 THEN 'insufficient history' WHEN " + BEST + " > 0.25 THEN CASE " + " ".join(
    f"WHEN {_auto(k).format(none=-1)} = {BEST} THEN '{v}'" for k, v in LABELS.items()) + " END ELSE 'weak periodicity' END"
TREND = "CASE WHEN count(*) >= 3 THEN abs(corr(idx, value)) ELSE 0 END"
STATION = """CASE WHEN any_value(n) >= 24 THEN greatest(0, 1 - least(1,
 abs(avg(value) FILTER (WHERE idx >= n // 2) - avg(value) FILTER (WHERE idx < n // 2)) / greatest(stddev_pop(value), 1) / 3
 + abs(var_pop(value) FILTER (WHERE idx >= n // 2) - var_pop(value) FILTER (WHERE idx < n // 2)) / greatest(var_pop(value), 1) / 4)) ELSE 0 END"""
DRIFT = """abs(avg(value) FILTER (WHERE idx >= n - greatest(1, n // 3)) - avg(value) FILTER (WHERE idx < greatest(1, n // 3))) / greatest(stddev_pop(value), 1)"""
# Windows whose width depends on the length, by a join on positions.
NOISE = """sm AS (SELECT a.o_orderpriority, a.idx, any_value(a.value) AS value, any_value(a.n) AS n, avg(b.value) AS smoothed
 FROM ix a JOIN ix b ON a.o_orderpriority = b.o_orderpriority AND b.idx BETWEEN a.idx - greatest(3, least(24, a.n // 10)) + 1 AND a.idx GROUP BY 1, 2)"""
ROLL = f"""rm AS (SELECT a.o_orderpriority, a.idx, any_value(a.ts) AS ts, any_value(a.n) AS n, CASE WHEN a.idx >= greatest(12, least(48, any_value(a.n) // 8)) - 1 THEN avg(b.value) END AS rolling
 FROM ix a JOIN ix b ON a.o_orderpriority = b.o_orderpriority AND b.idx BETWEEN a.idx - greatest(12, least(48, a.n // 8)) + 1 AND a.idx GROUP BY 1, 2),
st AS (SELECT *, abs(rolling - lag(rolling) OVER ({P} ORDER BY idx)) AS step FROM rm),
lim AS (SELECT o_orderpriority, count(rolling) AS rolled, avg(step) + 2.5 * stddev_pop(step) AS lim FROM st GROUP BY 1)"""
NOISE_RATIO = "CASE WHEN any_value(n) >= 10 THEN least(1, stddev_pop(value - smoothed) / greatest(stddev_pop(value), 1)) ELSE 1 END"


@query("series_by_time", "SELECT o_orderpriority, o_orderdate AS ts, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL")
def series_by_time(t):
    return rounded(series.series_by_time(t("orders"), "o_orderdate", "o_totalprice", KEY), 2, "value")


@query("with_row_index", """SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS idx FROM lineitem""")
def with_row_index(t):
    return rowindex.with_row_index(t("lineitem"), LINEITEM_ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "idx")


@query("sample_evenly", f"WITH {DAILY} SELECT o_orderpriority, ts, round(value, 2) AS value FROM ix WHERE idx % greatest(1, n // 500) = 0 AND idx // greatest(1, n // 500) < 500")
def sample_evenly(t):
    return rounded(series.sample_evenly(daily_orders(t)).select(*KEY, "ts", "value"), 2, "value")


@query("lag_self_pair", f"WITH {DAILY} SELECT a.o_orderpriority, a.idx, round(a.value, 2) AS value, round(b.value, 2) AS earlier FROM ix a JOIN ix b ON a.o_orderpriority = b.o_orderpriority AND b.idx = a.idx - 7")
def lag_self_pair(t):
    return rounded(pairing.lag_self_pair(daily_orders(t), 7, KEY), 2, "value", "earlier")


@query("trend_strength", f"WITH {DAILY} SELECT o_orderpriority, round({TREND}, 6) AS trend FROM ix GROUP BY 1")
def trend_strength(t):
    return rounded(series.trend_strength(daily_orders(t), KEY), 6, "trend")


@query("seasonality_strength", f"WITH {DAILY}, {LAGGED} SELECT o_orderpriority, round({SEASON}, 6) AS seasonality FROM lg GROUP BY 1")
def seasonality_strength(t):
    return rounded(series.seasonality_strength(daily_orders(t), KEY), 6, "seasonality")


@query("dominant_period", f"WITH {DAILY}, {LAGGED} SELECT o_orderpriority, {PERIOD} AS period_label FROM lg GROUP BY 1")
def dominant_period(t):
    return series.dominant_period(daily_orders(t), KEY)


@query("stationarity_score", f"WITH {DAILY} SELECT o_orderpriority, round({STATION}, 6) AS stationarity FROM ix GROUP BY 1")
def stationarity_score(t):
    return rounded(series.stationarity_score(daily_orders(t), KEY), 6, "stationarity")


@query("noise_ratio", f"WITH {DAILY}, {NOISE} SELECT o_orderpriority, round({NOISE_RATIO}, 6) AS noise_ratio FROM sm GROUP BY 1")
def noise_ratio(t):
    return rounded(series.noise_ratio(daily_orders(t), KEY), 6, "noise_ratio")


@query("rolling_mean", f"WITH {DAILY}, {ROLL} SELECT o_orderpriority, idx, round(ln(1 + rolling), 7) AS rolling FROM rm")
def rolling_mean(t):
    return logged(series.rolling_mean(daily_orders(t), KEY).select(*KEY, "idx", "rolling"), "rolling")


@query("regime_changes", f"""WITH {DAILY}, {ROLL}, hits AS (SELECT st.o_orderpriority, CAST(row_number() OVER (PARTITION BY st.o_orderpriority ORDER BY idx) AS INT) AS rank, idx, ts, round(ln(1 + step), 7) AS step
 FROM st JOIN lim USING (o_orderpriority) WHERE rolled > 10 AND step > lim) SELECT * FROM hits WHERE rank <= 5""")
def regime_changes(t):
    return logged(series.regime_changes(daily_orders(t), KEY), "step")


@query("drift_score", f"WITH {DAILY}, d AS (SELECT o_orderpriority, {DRIFT} AS drift FROM ix GROUP BY 1) SELECT o_orderpriority, round(drift, 6) AS drift, round(least(drift / 3, 1), 6) AS drift_score, CASE WHEN drift < 1.2 THEN 'stable' ELSE 'shifted' END AS behavior FROM d")
def drift_score(t):
    return rounded(series.drift_score(daily_orders(t), KEY), 6, "drift", "drift_score")


Z = "z AS (SELECT *, abs(value - avg(value) OVER (PARTITION BY o_orderpriority)) / greatest(stddev_pop(value) OVER (PARTITION BY o_orderpriority), 1) AS z FROM ix)"


@query("anomaly_points", f"WITH {DAILY}, {Z}, r AS (SELECT o_orderpriority, CAST(row_number() OVER ({P} ORDER BY idx) AS INT) AS rank, idx, ts, round(value, 2) AS value, round(z, 6) AS severity FROM z WHERE z > 3) SELECT * FROM r WHERE rank <= 8")
def anomaly_points(t):
    return rounded(rounded(series.anomaly_points(daily_orders(t), KEY), 2, "value"), 6, "severity")


@query("lookup_timestamp", f"WITH {DAILY}, {Z} SELECT o_orderpriority, idx, ts, round(z, 6) AS severity FROM z WHERE z > 3")
def lookup_timestamp(t):
    indexed = daily_orders(t)
    far = series.z_scores(indexed, KEY).where(F.abs("z") > 3).select(*KEY, "idx", F.abs("z").alias("severity"))
    return rounded(pairing.lookup_timestamp(far, indexed, KEY), 6, "severity")


@query("series_metrics", f"""WITH {DAILY}, {LAGGED}, {NOISE}, {ROLL}, {Z},
a AS (SELECT o_orderpriority, max(n) AS n, {TREND} AS trend, {SEASON} AS seasonality, {PERIOD} AS period_label, {STATION} AS stationarity, {DRIFT} AS drift FROM lg GROUP BY 1),
b AS (SELECT o_orderpriority, {NOISE_RATIO} AS noise_ratio FROM sm GROUP BY 1),
c AS (SELECT o_orderpriority, count(*) FILTER (WHERE z > 3) AS anomalies, count(*) FILTER (WHERE z > 3) / count(*) AS anomaly_rate FROM z GROUP BY 1),
d AS (SELECT st.o_orderpriority, count(*) FILTER (WHERE rolled > 10 AND step > lim) AS regime_count FROM st JOIN lim USING (o_orderpriority) GROUP BY 1)
SELECT o_orderpriority, n, round(trend, 6) AS trend, round(seasonality, 6) AS seasonality, period_label, round(stationarity, 6) AS stationarity, round(noise_ratio, 6) AS noise_ratio,
 round(drift, 6) AS drift, round(least(drift / 3, 1), 6) AS drift_score, anomalies, round(anomaly_rate, 6) AS anomaly_rate, regime_count
FROM a JOIN b USING (o_orderpriority) JOIN c USING (o_orderpriority) JOIN d USING (o_orderpriority)""")
def series_metrics(t):
    out = series.series_metrics(daily_orders(t), KEY)
    return rounded(out, 6, "trend", "seasonality", "stationarity", "noise_ratio", "drift", "drift_score", "anomaly_rate")


@query("mase_scale", f"WITH {DAILY}, s AS (SELECT *, abs(value - lag(value) OVER ({P} ORDER BY idx)) AS step FROM ix) SELECT o_orderpriority, round(avg(step), 3) AS scale FROM s GROUP BY 1")
def mase_scale(t):
    return rounded(series.mase_scale(daily_orders(t), KEY), 3, "scale")


@query("ffill_bfill", f"""WITH e AS (SELECT event_id, ts, user_id, value FROM {EVENTS_WITH_GAPS}),
k AS (SELECT e.event_id, v.event_type, e.value, e.ts FROM e JOIN events v USING (event_id))
SELECT event_id, event_type, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value
FROM (SELECT event_id, ts, CASE WHEN user_id < 75 THEN 'low' ELSE 'high' END AS event_type, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)""")
def ffill_bfill(t):
    frame = t("events").select(
        "event_id", "ts", F.when(F.col("user_id") < 75, "low").otherwise("high").alias("event_type"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    indexed = rowindex.with_row_index(frame, ["ts", "event_id"], ["event_type"])
    return series.forward_backward_fill(indexed, ["value"], ["event_type"]).select("event_id", "event_type", "value")


GAPS = """g AS (SELECT o_orderpriority, ts, c, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY o_orderpriority ORDER BY ts) AS gap FROM (SELECT o_orderpriority, o_orderdate AS ts, count(*) AS c FROM orders GROUP BY ALL)),
m AS (SELECT o_orderpriority, gap, count(*) AS k, sum(count(*)) OVER (PARTITION BY o_orderpriority) AS gaps FROM g WHERE gap IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY k DESC, gap) = 1),
gs AS (SELECT g.o_orderpriority, CAST(sum(c) AS BIGINT) AS rows, count(*) AS distinct_times, any_value(gap_m) AS modal_gap_seconds, 1 - any_value(cons) AS gap_ratio, any_value(cons) AS consistency, min(ts) AS start, max(ts) AS end, 1 - count(*) / sum(c) AS duplicate_ratio
 FROM g JOIN (SELECT o_orderpriority, gap AS gap_m, k / gaps AS cons FROM m) USING (o_orderpriority) GROUP BY 1)"""


@query("gap_stats", f"""WITH {GAPS} SELECT o_orderpriority, rows, distinct_times, modal_gap_seconds, round(gap_ratio, 6) AS gap_ratio, round(consistency, 6) AS consistency, start, "end",
 round(duplicate_ratio, 6) AS duplicate_ratio, CASE WHEN modal_gap_seconds >= 86400 THEN 'daily-like' ELSE 'sub-daily' END AS seasonality_hint FROM gs""")
def gap_stats(t):
    return rounded(timeaxis.gap_stats(t("orders"), "o_orderdate", KEY), 6, "gap_ratio", "consistency", "duplicate_ratio")


@query("ordering_score", """WITH o AS (SELECT l_shipdate, lag(l_shipdate) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS before FROM lineitem)
SELECT round(avg((l_shipdate >= before)::INT) FILTER (WHERE before IS NOT NULL), 6) AS ordering FROM o""")
def ordering_score(t):
    return rounded(timeaxis.ordering_score(t("lineitem"), "l_shipdate", LINEITEM_ORDER), 6, "ordering")


@query("detect_time_axis", """WITH d AS (SELECT DISTINCT o_orderdate AS ts FROM orders), g AS (SELECT ts, epoch(ts) - lag(epoch(ts)) OVER (ORDER BY ts) AS gap FROM d),
m AS (SELECT gap, count(*) AS k FROM g WHERE gap IS NOT NULL GROUP BY 1 ORDER BY k DESC, gap LIMIT 1)
SELECT 'o_orderdate' AS "column", 4.0 AS name_score, (SELECT count(*) FROM orders) AS rows, count(*) AS distinct_times, any_value(m.gap) AS modal_gap_seconds, round(any_value(m.k) / count(g.gap), 6) AS consistency, min(ts) AS start, max(ts) AS "end"
FROM g, m""")
def detect_time_axis(t):
    out = timeaxis.detect_time_axis(t("orders"))
    return rounded(out.select("column", "name_score", "rows", "distinct_times", "modal_gap_seconds", "consistency", "start", "end"), 6, "consistency")


@query("implicit_index", """WITH o AS (SELECT *, o_orderkey - lag(o_orderkey) OVER (ORDER BY o_orderkey) AS s1, o_custkey - lag(o_custkey) OVER (ORDER BY o_orderkey) AS s2 FROM orders)
SELECT 'o_orderkey' AS "column", count(*) AS rows, count(DISTINCT o_orderkey) AS unique_values, CAST(min(o_orderkey) AS DOUBLE) AS lowest,
 (SELECT CAST(s1 AS DOUBLE) FROM o WHERE s1 IS NOT NULL GROUP BY s1 ORDER BY count(*) DESC, s1 LIMIT 1) AS modal_step,
 count(DISTINCT o_orderkey) / count(*) > 0.95 AND min(s1) >= 0 AND min(o_orderkey) <= 10 AND (SELECT s1 FROM o WHERE s1 IS NOT NULL GROUP BY s1 ORDER BY count(*) DESC, s1 LIMIT 1) = 1 AS is_index FROM o
UNION ALL SELECT 'o_custkey', count(*), count(DISTINCT o_custkey), CAST(min(o_custkey) AS DOUBLE),
 (SELECT CAST(s2 AS DOUBLE) FROM o WHERE s2 IS NOT NULL GROUP BY s2 ORDER BY count(*) DESC, s2 LIMIT 1),
 count(DISTINCT o_custkey) / count(*) > 0.95 AND min(s2) >= 0 AND min(o_custkey) <= 10 FROM o""")
def implicit_index(t):
    return timeaxis.implicit_index(t("orders"), ["o_orderkey", "o_custkey"], ["o_orderkey"])


YEARS = "(SELECT year(o_orderdate) AS order_year, o_totalprice, o_orderkey, o_custkey AS customer_year FROM orders)"


def years(t):
    return t("orders").select(F.year("o_orderdate").alias("order_year"), "o_totalprice", "o_orderkey", F.col("o_custkey").alias("customer_year"))


def _year_row(c: str, ok: str) -> str:
    return f"""SELECT '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS lowest, CAST(max({c}) AS DOUBLE) AS highest, count(DISTINCT {c}) AS unique_values,
 contains('{c}', 'year') AND min({c}) >= 1800 AND max({c}) <= 2200 AND count(DISTINCT {c}) >= 2 AND bool_and({c} = round({c})) AS is_year FROM {YEARS}"""


@query("is_year_column", "\nUNION ALL\n".join(_year_row(c, "") for c in ("order_year", "o_totalprice", "o_orderkey", "customer_year")))
def is_year_column(t):
    return timeaxis.year_columns(years(t))


@query("fallback_time_axis", f"""SELECT 'order_year' AS "column", 'year' AS source FROM {YEARS} HAVING min(order_year) >= 1800 AND max(order_year) <= 2200 AND count(DISTINCT order_year) >= 2""")
def fallback_time_axis(t):
    return timeaxis.fallback_time_axis(years(t))


@query("future_timestamps", f"WITH {GAPS} SELECT o_orderpriority, CAST(step AS INT) AS step, \"end\" + to_seconds(modal_gap_seconds * step) AS ts FROM gs, range(1, 31) r(step)")
def future_timestamps(t):
    return timeaxis.future_timestamps(t("orders"), "o_orderdate", 30, KEY)


@query("time_rollup", f"""WITH {DAILY}, l AS (SELECT 'day' AS level, date_trunc('day', ts)::TIMESTAMP AS period, o_orderpriority, value FROM ix UNION ALL SELECT 'week', date_trunc('week', ts)::TIMESTAMP, o_orderpriority, value FROM ix
 UNION ALL SELECT 'month', date_trunc('month', ts)::TIMESTAMP, o_orderpriority, value FROM ix)
SELECT o_orderpriority, level, period, count(*) AS points, round(sum(value), 2) AS total, round(avg(value), 6) AS mean FROM l GROUP BY ALL""")
def time_rollup(t):
    daily = series.series_by_time(t("orders"), "o_orderdate", "o_totalprice", KEY)
    return rounded(rounded(timeaxis.time_rollup(daily, ["day", "week", "month"], KEY), 2, "total"), 6, "mean")


@query("entity_columns", """SELECT 'c_mktsegment' AS "column", count(DISTINCT c_mktsegment) AS unique_values FROM customer WHERE 1 = 1 HAVING count(DISTINCT c_mktsegment) BETWEEN 2 AND 0.8 * count(*)""")
def entity_columns(t):
    return timeaxis.entity_columns(t("customer"), words=[*names.ENTITY_WORDS, "segment"])


@query("sort_series", "SELECT o_orderpriority, o_orderdate, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS idx FROM orders")
def sort_series(t):
    ordered = timeaxis.sort_series(t("orders").select("o_orderpriority", "o_orderdate", "o_orderkey"), KEY, "o_orderdate")
    return rowindex.with_row_index(ordered, ["o_orderdate", "o_orderkey"], KEY).drop("n")


LAG_STEPS = (1, 2, 3, 6, 12, 24, 48, 168)


@query("lag_features", f"WITH {DAILY} SELECT o_orderpriority, idx, {', '.join(f'round(lag(value, {k}) OVER ({P} ORDER BY idx), 2) AS lag_{k}' for k in LAG_STEPS)} FROM ix")
def lag_features(t):
    out = features.lag_features(daily_orders(t), LAG_STEPS, KEY).select(*KEY, "idx", *[f"lag_{k}" for k in LAG_STEPS])
    return rounded(out, 2, *[f"lag_{k}" for k in LAG_STEPS])


def _rolling(width: int, end: str) -> str:
    frame = f"{P} ORDER BY idx ROWS BETWEEN {width if end == '1' else width - 1} PRECEDING AND {'1 PRECEDING' if end == '1' else 'CURRENT ROW'}"
    enough = f"count(value) OVER ({frame}) >= {max(2, width // 2)}"
    return f"CASE WHEN {enough} THEN round(ln(1 + avg(value) OVER ({frame})), 7) END AS rolling_mean_{width}, CASE WHEN {enough} THEN round(ln(1 + stddev_pop(value) OVER ({frame})), 7) END AS rolling_std_{width}"


WINDOWS = (3, 6, 12, 24, 72, 168)
ROLLED = [f"rolling_{m}_{w}" for w in WINDOWS for m in ("mean", "std")]


def _rounded_rolling(df):
    return logged(df, *ROLLED)


@query("rolling_features", f"WITH {DAILY} SELECT o_orderpriority, idx, {', '.join(_rolling(w, '1') for w in WINDOWS)} FROM ix")
def rolling_features(t):
    return _rounded_rolling(features.rolling_features(daily_orders(t), WINDOWS, KEY).select(*KEY, "idx", *ROLLED))


@query("rolling_features_current", f"WITH {DAILY} SELECT o_orderpriority, idx, {', '.join(_rolling(w, '0') for w in WINDOWS)} FROM ix")
def rolling_features_current(t):
    return _rounded_rolling(features.rolling_features(daily_orders(t), WINDOWS, KEY, include_current=True).select(*KEY, "idx", *ROLLED))


@query("diff_features", f"""WITH {DAILY} SELECT o_orderpriority, idx, round(lag(value, 1) OVER w - lag(value, 2) OVER w, 2) AS diff_1, round(lag(value, 1) OVER w - lag(value, 25) OVER w, 2) AS diff_24
FROM ix WINDOW w AS ({P} ORDER BY idx)""")
def diff_features(t):
    return rounded(features.diff_features(daily_orders(t), (1, 24), KEY).select(*KEY, "idx", "diff_1", "diff_24"), 2, "diff_1", "diff_24")


@query("fallback_features", f"""WITH {DAILY} SELECT o_orderpriority, idx, CAST(idx AS DOUBLE) AS row_position, {', '.join(f'CASE WHEN n >= 8 THEN round(lag(value, {k}) OVER w, 2) END AS fallback_lag_{k}' for k in (1, 2, 3))}
FROM ix WINDOW w AS ({P} ORDER BY idx)""")
def fallback_features(t):
    out = features.fallback_features(daily_orders(t), KEY).drop("ts", "value", "n")
    return rounded(out, 2, "fallback_lag_1", "fallback_lag_2", "fallback_lag_3")


@query("lag_sequence", f"""WITH {DAILY}, s AS (SELECT o_orderpriority, idx, list(value) OVER ({P} ORDER BY idx ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS seq FROM ix)
SELECT o_orderpriority, idx, array_to_string(list_transform(seq, lambda x: printf('%.2f', x)), '|') AS sequence FROM s WHERE len(seq) = 24""")
def lag_sequence(t):
    out = features.lag_sequence(daily_orders(t), 24, KEY)
    return out.select(*KEY, "idx", joined(F.transform("sequence", lambda x: F.format_string("%.2f", x))).alias("sequence"))


CAL = "hour(o_orderdate) AS hour, isodow(o_orderdate) - 1 AS dayofweek, month(o_orderdate) AS month, dayofyear(o_orderdate) AS dayofyear, CASE WHEN isodow(o_orderdate) >= 6 THEN 1.0 ELSE 0.0 END AS is_weekend"


@query("calendar_features", f"SELECT o_orderkey, {CAL} FROM orders")
def calendar_features(t):
    return features.calendar_features(t("orders"), "o_orderdate").select("o_orderkey", "hour", "dayofweek", "month", "dayofyear", "is_weekend")


@query("cyclical_features", """SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos,
 round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) AS dow_sin, round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) AS dow_cos,
 round(sin(2 * pi() * month(ts) / 12), 6) AS month_sin, round(cos(2 * pi() * month(ts) / 12), 6) AS month_cos FROM events""")
def cyclical_features(t):
    names_ = ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos"]
    return rounded(features.cyclical_features(t("events"), "ts").select("event_id", *names_), 6, *names_)


@query("year_features", """WITH y AS (SELECT o_orderkey, year(o_orderdate) AS y, min(year(o_orderdate)) OVER () AS y0 FROM orders)
SELECT o_orderkey, y AS year, CAST(y AS DOUBLE) AS year_value, CAST(y // 10 * 10 AS DOUBLE) AS decade, CAST(y - y0 AS DOUBLE) AS year_trend, round(sin(2 * pi() * (y - y0) / 10), 6) AS year_sin, round(cos(2 * pi() * (y - y0) / 10), 6) AS year_cos FROM y""")
def year_features(t):
    frame = t("orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    return rounded(features.year_features(frame, "year"), 6, "year_sin", "year_cos")


@query("broadcast_scalars", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(avg(l_extendedprice) OVER (), 4) AS mean, round(stddev_pop(l_extendedprice) OVER (), 4) AS std FROM lineitem")
def broadcast_scalars(t):
    frame = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return rounded(pairing.broadcast_scalars(frame, "l_extendedprice"), 4, "mean", "std")


@query("align_pairs", "SELECT o.o_orderkey AS orderkey, o.o_totalprice AS \"left\", round(l.v, 2) AS \"right\" FROM orders o JOIN (SELECT l_orderkey, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1) l ON o.o_orderkey = l.l_orderkey")
def align_pairs(t):
    left = t("orders").select(F.col("o_orderkey").alias("orderkey"), "o_totalprice")
    right = t("lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.sum("l_extendedprice").alias("v"))
    return rounded(pairing.align_pairs(left, right, ["orderkey"], "o_totalprice", "v"), 2, "right")


FOLDS = """lens AS (SELECT o_orderpriority, max(n) AS n FROM ix GROUP BY 1),
fw AS (SELECT *, greatest(24, least(greatest(40, n // 12), n // 7)) AS w FROM lens),
fs AS (SELECT *, greatest(CAST(floor(n * 0.55) AS BIGINT), 2 * w) AS s FROM fw),
fo AS (SELECT o_orderpriority, CAST(f AS INT) AS fold, s + (f - 1) * w AS train_end, s + (f - 1) * w AS test_start, least(s + f * w, n) AS test_end FROM fs, range(1, 5) r(f) WHERE least(s + f * w, n) > s + (f - 1) * w)"""


@query("walk_forward_folds", f"WITH {DAILY}, {FOLDS} SELECT * FROM fo")
def walk_forward_folds(t):
    lengths = daily_orders(t).groupBy(*KEY).agg(F.max("n").alias("n"))
    return validation.walk_forward_folds(lengths, KEY)


@query("assign_fold", f"""WITH {DAILY}, {FOLDS} SELECT o_orderpriority, idx, fold, CASE WHEN idx < train_end THEN 'train' ELSE 'test' END AS part FROM ix JOIN fo USING (o_orderpriority) WHERE idx < test_end""")
def assign_fold(t):
    indexed = daily_orders(t)
    folds = validation.walk_forward_folds(indexed.groupBy(*KEY).agg(F.max("n").alias("n")), KEY)
    return pairing.assign_fold(indexed, folds, KEY).select(*KEY, "idx", "fold", "part")


SPLIT = "CAST(greatest(floor(n * 0.8), n - greatest(200, floor(n * 0.02))) AS BIGINT)"


@query("temporal_split", f"WITH {DAILY} SELECT o_orderpriority, idx, CASE WHEN idx < {SPLIT} THEN 'train' ELSE 'test' END AS part FROM ix")
def temporal_split(t):
    return validation.temporal_split(daily_orders(t)).select(*KEY, "idx", "part")


@query("latest_rows", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC LIMIT 6000")
def latest_rows(t):
    indexed = rowindex.with_row_index(t("lineitem"), LINEITEM_ORDER)
    return validation.latest_rows(indexed).select("l_orderkey", "l_linenumber", "l_partkey")


@query("persistence_baseline", f"WITH {DAILY}, b AS (SELECT o_orderpriority, value AS baseline FROM ix WHERE idx = {SPLIT} - 1) SELECT o_orderpriority, idx, round(value, 2) AS value, round(baseline, 2) AS baseline FROM ix JOIN b USING (o_orderpriority) WHERE idx >= {SPLIT}")
def persistence_baseline(t):
    out = validation.persistence_baseline(daily_orders(t), KEY).select(*KEY, "idx", "value", "baseline")
    return rounded(out, 2, "value", "baseline")
