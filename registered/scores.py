from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from registered import joined, query, rounded
from registered.profiles import FENCE
from registered.series import DRIFT, GAPS, LAGGED, NOISE, NOISE_RATIO, PERIOD, ROLL, SEASON, STATION, TREND, Z
from registered.tables import (
    DAILY, EVENTS_WITH_GAPS, KEY, LABELLED, LINEITEM, LINEITEM_NUMERIC, LINEITEM_ORDER, LINEITEM_TEXT, daily_orders, events_with_gaps,
    labelled_documents,
)
from seriesloom.functions import names, stats
from seriesloom.operators import cleaning, profile, rowindex, scoring, series, timeaxis
from seriesloom.operators.frames import attach
from seriesloom.plans.profiling import leakage_warnings as plan_warnings, profile_dataset, series_facts
from seriesloom.sources.evidence import evidence_chunks as chunks_of, evidence_id as id_of

# A table whose column names trigger the name rules; its values come from lineitem.
NAMED = {
    "sales": "l_extendedprice", "sales_value": "l_extendedprice * 2", "next_sales_forecast": "l_extendedprice + 1", "order_id": "l_orderkey", "humidity": "l_discount",
    "store_name": "l_returnflag", "upper_bound_sales": "l_extendedprice * 1.1", "price_rank": "l_linenumber", "energy_demand_kwh": "l_quantity", "order date": "l_shipdate",
    "year": "year(l_shipdate)", "residual": "l_tax", "postal_code": "l_suppkey", "quantity_label": "l_linestatus",
}
NAMED_SQL = "(SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in NAMED.items()) + " FROM lineitem)"
TARGET = "sales"


def named(t):
    return t("lineitem").select(*[F.expr(e).alias(n) for n, e in NAMED.items()])


STATS_SQL = "st AS (" + " UNION ALL ".join(
    f"""SELECT '{n}' AS "column", count(*) AS rows, count(DISTINCT "{n}") AS unique_values, 100.0 * (count(*) - count("{n}")) / count(*) AS missing_percent FROM {NAMED_SQL}""" for n in NAMED) + ")"


def lst(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def any_in(expr: str, values) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{v}')" for v in values) + ")"


# What the name rules must say about the columns of NAMED, written out.
DERIVED, INTERVAL = "derived from the target or known only afterwards", "interval or uncertainty of the target"
LEAKS = {
    "sales": "target column", "sales_value": "name contains the target name", "next_sales_forecast": DERIVED, "upper_bound_sales": INTERVAL,
    "price_rank": DERIVED, "residual": DERIVED, "quantity_label": DERIVED,
}
EXCLUDED_NAMES = ("order_id", "price_rank", "year", "residual", "postal_code")
NON_TIME_NAMES, TEMPORAL_NAMES = ("order_id", "year", "postal_code"), ("order date", "year")
TIME_SCORES = {"order date": 9.0, "year": 3.0, "order_id": -5.0, "humidity": -5.0, "residual": -5.0, "postal_code": -5.0}


def _case(values: dict, otherwise: str) -> str:
    return 'CASE "column" ' + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + f" ELSE {otherwise} END"


def _listed(values) -> str:
    return '"column" IN (' + ", ".join(f"'{v}'" for v in values) + ")"


LEAK, EXCLUDED, NON_TIME, TIME_SCORE = _case(LEAKS, "NULL"), _listed(EXCLUDED_NAMES), _listed(NON_TIME_NAMES), _case(TIME_SCORES, "0.0")


def name_stats(t):
    return profile.column_stats(named(t)).select("column", "rows", "unique_values")


@query("leakage_reason", f"""WITH {STATS_SQL} SELECT "column", rows, unique_values, {LEAK} AS reason FROM st""")
def leakage_reason(t):
    return name_stats(t).withColumn("reason", names.leakage_reason(F.col("column"), F.lit(TARGET)))


@query("safe_features", f"""WITH {STATS_SQL} SELECT "column", rows, unique_values, ({LEAK}) IS NULL AS safe FROM st""")
def safe_features(t):
    return name_stats(t).withColumn("safe", names.safe_feature(F.col("column"), F.lit(TARGET)))


@query("leakage_warnings", f"""WITH {STATS_SQL} SELECT "column" FROM st WHERE "column" = 'next_sales_forecast'""")
def leakage_warnings(t):
    return plan_warnings(named(t), TARGET)


@query("excluded_feature", f"""WITH {STATS_SQL} SELECT "column", rows, unique_values, {EXCLUDED} AS excluded FROM st""")
def excluded_feature(t):
    return name_stats(t).withColumn("excluded", names.excluded_feature(F.col("column")))


@query("non_time_column", f"""WITH {STATS_SQL} SELECT "column", rows, unique_values, {NON_TIME} AS non_time, {_listed(TEMPORAL_NAMES)} AS temporal FROM st""")
def non_time_column(t):
    return name_stats(t).withColumns({"non_time": names.non_time_column(F.col("column")), "temporal": names.temporal_name(F.col("column"))})


@query("time_name_score", f"""WITH {STATS_SQL} SELECT "column", rows, unique_values, CAST({TIME_SCORE} AS DOUBLE) AS score FROM st""")
def time_name_score(t):
    return name_stats(t).withColumn("score", names.time_name_score(F.col("column")))


@query("unusable_columns", f"""WITH c AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, 'bank' AS branch, CASE WHEN c_acctbal > 9000 THEN c_name END AS note, CASE WHEN c_acctbal > 8000 THEN c_acctbal END AS rich, c_acctbal AS balance FROM customer),
s AS ({' UNION ALL '.join(f'''SELECT '{c}' AS "column", {str(c in ("name", "note", "branch", "segment")).lower()} AS is_text, count(*) AS rows, count(DISTINCT {c}) AS u, 100.0 * (count(*) - count({c})) / count(*) AS m FROM c''' for c in ("id", "name", "segment", "branch", "note", "rich", "balance"))})
SELECT "column", CASE WHEN m > 70 THEN 'mostly missing' WHEN u <= 1 THEN 'constant' WHEN u = rows AND is_text THEN 'one text value per row' ELSE 'free text or identifier' END AS reason
FROM s WHERE "column" <> 'balance' AND (m > 70 OR u <= 1 OR (u = rows AND is_text) OR (is_text AND u > greatest(200, floor(rows * 0.8))))""")
def unusable_columns(t):
    frame = t("customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.lit("bank").alias("branch"),
        F.when(F.col("c_acctbal") > 9000, F.col("c_name")).alias("note"), F.when(F.col("c_acctbal") > 8000, F.col("c_acctbal")).alias("rich"),
        F.col("c_acctbal").alias("balance"))
    return cleaning.unusable_columns(profile.column_stats(frame), "balance")


TN = """trim(replace(replace(replace(lower("column"), '_', ' '), '(', ' '), ')', ' '))"""
TWORDS = f"regexp_split_to_array({TN}, ' +')"


def _plus(test: str, points: float) -> str:
    return f"CASE WHEN {test} THEN {points} ELSE 0 END"


LOW = any_in(TN, names.TARGET_LOW_PRIORITY)
SCORE_SQL = " + ".join([
    _plus(any_in(TN, names.TARGET_PHRASES), 8), _plus(any_in(TN, names.TARGET_UNITS), 3), _plus(f"{TN} IN ({', '.join(repr(v) for v in names.TARGET_EXACT)})", 6),
    f"CASE WHEN lower(\"column\") IN ({', '.join(repr(h.replace(' ', '_')) for h in names.TARGET_HINTS)}) THEN 3 WHEN {any_in(TN, [h.replace('_', ' ') for h in names.TARGET_HINTS])} THEN 2 ELSE 0 END",
    f"CASE WHEN unique_values <= 2 THEN -7 WHEN unique_values <= 10 AND {LOW} THEN -5 WHEN unique_values / rows < 0.01 AND {LOW} THEN -3 ELSE 0 END",
    _plus(LOW, -2), _plus(any_in(TN, names.TARGET_COMPONENTS), -4), _plus(f"{TN} IN ({', '.join(repr(v) for v in names.TARGET_BEST)})", 6),
    "CASE WHEN abs(mean) > 0 THEN least(std / abs(mean), 1) ELSE 0 END", "least(unique_values / rows, 1)",
])
USABLE = f"""NOT (({TN} NOT IN ({', '.join(repr(v) for v in names.TARGET_ALWAYS_ALLOWED)}) AND list_has_any({TWORDS}, {lst(names.TARGET_EXCLUDE_MARKS)})) OR list_has_any({TWORDS}, {lst(names.NON_TARGET_NAMES)})
 OR lower("column") IN ({', '.join(repr(v) for v in names.NON_TARGET_NAMES)})) AND NOT list_has_any({TWORDS}, {lst(names.TARGET_ID_WORDS)})"""
FACT_NAMES = [n for n in NAMED if n not in ("store_name", "order date", "quantity_label")]
FACTS_SQL = "f AS (" + " UNION ALL ".join(
    f"""SELECT '{n}' AS "column", count("{n}") AS rows, count(DISTINCT "{n}") AS unique_values, avg("{n}") AS mean, stddev_pop("{n}") AS std FROM {NAMED_SQL}""" for n in FACT_NAMES) + ")"


@query("score_targets", f"""WITH {FACTS_SQL} SELECT "column", round({SCORE_SQL}, 6) AS score FROM f WHERE {USABLE}""")
def score_targets(t):
    return rounded(scoring.score_targets(scoring.target_facts(named(t))), 6, "score")


LI_FACTS = "f AS (" + " UNION ALL ".join(f"""SELECT '{n}' AS "column", count({n}) AS rows, count(DISTINCT {n}) AS unique_values, avg({n}) AS mean, stddev_pop({n}) AS std FROM lineitem""" for n in LINEITEM_NUMERIC) + ")"


@query("recommend_target", f"""WITH {LI_FACTS} SELECT "column", round({SCORE_SQL}, 6) AS score FROM f WHERE {USABLE} ORDER BY score DESC, "column" LIMIT 1""")
def recommend_target(t):
    return rounded(scoring.recommend_target(t("lineitem")), 6, "score")


def _role(c: str) -> str:
    if c == "l_shipdate":
        role = "temporal_index"
    elif c == "l_extendedprice":
        role = "forecast_target"
    elif c in LINEITEM_TEXT:
        return f"CASE WHEN count(DISTINCT {c}) > least(500, greatest(50, count({c}) * 0.5)) THEN 'context_feature' ELSE 'entity_or_grouping' END"
    else:
        role = "external_regressor"
    return f"any_value('{role}')"


@query("recommend_target_fallback", """SELECT 'rank' AS "column", count(*) AS rows FROM customer""")
def recommend_target_fallback(t):
    """Only an id, a serial number and excluded names: the first numeric name that is not excluded, else the first numeric one."""
    frame = t("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("rank"))
    found = scoring.recommend_target(frame.select("rank", "user_id")).select("column")
    return attach(found, frame.agg(F.count("*").alias("rows")))


@query("serial_ids", """SELECT 'c_custkey' AS "column", count(*) AS rows FROM customer""")
def serial_ids(t):
    frame = t("customer").select("c_custkey", "c_nationkey", "c_acctbal")
    found = scoring.serial_ids(frame)
    return frame.agg(F.lit("|".join(found)).alias("column"), F.count("*").alias("rows"))


@query("column_roles", "WITH r AS (" + " UNION ALL ".join(f"""SELECT '{c}' AS "column", {_role(c)} AS role FROM lineitem""" for c in LINEITEM) + f""")
SELECT "column", role, CASE role WHEN 'temporal_index' THEN 'parses_as_dates' WHEN 'forecast_target' THEN 'chosen_number_over_time' WHEN 'prediction_target' THEN 'chosen_number' WHEN 'external_regressor' THEN 'number_beside_a_series' WHEN 'numeric_feature' THEN 'number' WHEN 'entity_or_grouping' THEN 'few_values' ELSE 'text_or_many_values' END AS reason FROM r""")
def column_roles(t):
    return scoring.column_roles(profile.infer_kind(t("lineitem")), "l_extendedprice", "l_shipdate").drop("kind")


FACTS = f"""{DAILY}, {LAGGED}, {NOISE}, {GAPS}, a AS (SELECT o_orderpriority, max(n) AS n, {TREND} AS trend, {SEASON} AS seasonality, {STATION} AS stationarity, {PERIOD} AS period_label, {DRIFT} AS drift FROM lg GROUP BY 1),
b AS (SELECT o_orderpriority, {NOISE_RATIO} AS noise_ratio FROM sm GROUP BY 1),
mt AS (SELECT a.*, b.noise_ratio, gs.consistency, gs.gap_ratio, CASE WHEN n < 24 THEN 25 ELSE least(100, greatest(0, trend * 20 + seasonality * 25 + stationarity * 15 + greatest(0, 1 - noise_ratio) * 20 + consistency * 20)) END AS score
 FROM a JOIN b USING (o_orderpriority) JOIN gs USING (o_orderpriority))"""
GRADE = "CASE WHEN score >= 80 THEN 'strong' WHEN score >= 60 THEN 'moderate' WHEN score >= 40 THEN 'weak' ELSE 'poor' END"


def order_facts(t):
    return series_facts(t("orders"), "o_orderdate", "o_totalprice", KEY)


@query("forecastability_series", f"""WITH {FACTS} SELECT o_orderpriority, round(score, 6) AS score, {GRADE} AS grade,
 printf('seasonality=%.2f', seasonality) || CASE WHEN seasonality > 0.45 THEN ' ok' ELSE ' low' END || '|' || printf('trend=%.2f', trend) || CASE WHEN trend > 0.35 THEN ' ok' ELSE ' low' END || '|' ||
 printf('noise=%.2f', noise_ratio) || CASE WHEN noise_ratio < 0.55 THEN ' ok' ELSE ' high' END AS reasons,
 concat_ws('|', CASE WHEN consistency < 0.7 THEN 'uneven_intervals' END, CASE WHEN noise_ratio > 0.65 THEN 'noisy' END, CASE WHEN stationarity < 0.35 THEN 'not_stationary' END) AS risks FROM mt""")
def forecastability_series(t):
    out = scoring.forecastability_series(order_facts(t), KEY)
    return rounded(out.withColumns({"reasons": joined("reasons"), "risks": joined("risks")}), 6, "score")


@query("score_grade", f"WITH {FACTS} SELECT o_orderpriority, {GRADE} AS grade FROM mt")
def score_grade(t):
    return order_facts(t).select(*KEY, stats.score_grade(F.col("score")).alias("grade"))


PLAIN = f"""px AS (SELECT l_extendedprice AS value, row_number() OVER (ORDER BY {', '.join(LINEITEM_ORDER)}) - 1 AS idx, count(*) OVER () AS n FROM lineitem),
ps AS (SELECT value, n, avg(value) OVER (ORDER BY idx ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS smoothed FROM px),
pn AS (SELECT any_value(n) AS n, least(1, stddev_pop(value - smoothed) / greatest(stddev_pop(value), 1)) AS noise FROM ps)"""


@query("forecastability_table", f"WITH {PLAIN} SELECT n, round(noise, 6) AS noise_ratio, round(least(n / 10000, 1) * 30 + least(7 / 5, 1) * 30 + greatest(0, 1 - noise) * 40, 6) AS score FROM pn")
def forecastability_table(t):
    plain = rowindex.with_row_index(t("lineitem").withColumn("value", F.col("l_extendedprice")), LINEITEM_ORDER)
    noise = series.noise_ratio(plain).select("noise_ratio", F.lit(t("lineitem").count()).alias("n"))
    score = scoring.forecastability_table(F.col("n"), F.lit(len(LINEITEM_NUMERIC) - 1), F.col("noise_ratio"))
    return rounded(noise.withColumn("score", score).withColumn("n", F.col("n").cast("long")), 6, "noise_ratio", "score")


@query("cross_sectional_shape", f"""SELECT count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers,
 round(count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) / count(value), 6) AS anomaly_rate, round(skewness(value), 6) AS skewness,
 CASE WHEN skewness(value) > 0.5 THEN 'right-skewed' WHEN skewness(value) < -0.5 THEN 'left-skewed' ELSE 'approximately normal' END AS shape FROM events, {FENCE.format(c='value', t='events')}""")
def cross_sectional_shape(t):
    return rounded(scoring.cross_sectional_shape(t("events"), "value"), 6, "anomaly_rate", "skewness")


BEHAVIOR = f"""{FACTS}, {ROLL}, {Z}, zc AS (SELECT o_orderpriority, count(*) FILTER (WHERE z > 3) AS anomalies, count(*) FILTER (WHERE z > 3) / count(*) AS anomaly_rate FROM z GROUP BY 1),
rc AS (SELECT st.o_orderpriority, count(*) FILTER (WHERE rolled > 10 AND step > lim) AS regime_count FROM st JOIN lim USING (o_orderpriority) GROUP BY 1)"""


@query("temporal_behavior", f"""WITH {BEHAVIOR} SELECT o_orderpriority, period_label AS periodicity, anomalies, round(anomaly_rate, 6) AS anomaly_rate, regime_count, round(least(drift / 3, 1), 6) AS drift_score,
 CASE WHEN drift < 1.2 THEN 'stable' ELSE 'shifted' END AS interpretation FROM mt JOIN zc USING (o_orderpriority) JOIN rc USING (o_orderpriority)""")
def temporal_behavior(t):
    return rounded(scoring.temporal_behavior(order_facts(t), KEY), 6, "anomaly_rate", "drift_score")


EV_MISSING = "avg(((event_id IS NULL)::INT + (ts IS NULL)::INT + (user_id IS NULL)::INT + (event_type IS NULL)::INT + (value IS NULL)::INT) / 5.0)"


@query("trust_score", f"""WITH m AS (SELECT {EV_MISSING} AS missing FROM {EVENTS_WITH_GAPS}),
g AS (SELECT epoch(ts) - lag(epoch(ts)) OVER (ORDER BY ts) AS gap FROM (SELECT DISTINCT ts FROM events)),
k AS (SELECT count(*) AS c FROM g WHERE gap IS NOT NULL GROUP BY gap ORDER BY c DESC LIMIT 1),
q AS (SELECT quantile_cont(value, 0.75) AS q3 FROM {EVENTS_WITH_GAPS}),
s AS (SELECT {EV_MISSING.replace('avg(', 'avg(')} FILTER (WHERE value > q3) AS high, {EV_MISSING} FILTER (WHERE NOT coalesce(value > q3, false)) AS rest FROM {EVENTS_WITH_GAPS}, q)
SELECT round(100 - least(missing * 120, 65) - (1 - c / (SELECT count(gap) FROM g)) * 35, 6) AS trust_score, round(missing, 6) AS missing_share,
 CASE WHEN high > 1.5 * rest AND high > 0.01 THEN 'concentrated in high values' ELSE 'broadly distributed' END AS missing_pattern,
 CASE WHEN 1 - c / (SELECT count(gap) FROM g) < 0.05 THEN 'low' ELSE 'medium' END AS duplicate_risk, 'low' AS leakage_risk FROM m, k, s""")
def trust_score(t):
    frame = events_with_gaps(t)
    gaps = timeaxis.gap_stats(frame, "ts").first()
    out = scoring.quality_report(frame, "value", gaps["consistency"], gaps["gap_ratio"]).drop("recommendations", "leaking")
    return rounded(out, 6, "trust_score", "missing_share")


FAMILY = """CASE WHEN n < 800 OR (consistency > 0.85 AND seasonality > 0.45 AND n < 4000 AND noise_ratio <= 0.65) THEN 'ARIMA' WHEN n <= 2500 AND score >= 45 THEN 'RandomForest'
 WHEN n <= 4000 AND score >= 55 AND noise_ratio <= 0.55 THEN 'SVM' WHEN n >= 4000 AND score > 65 THEN 'XGBoost' WHEN score < 45 OR noise_ratio > 0.75 THEN 'RandomForest' ELSE 'XGBoost' END"""


@query("recommend_strategy", f"WITH {FACTS} SELECT o_orderpriority, {FAMILY} AS family, {GRADE} AS confidence, 'sort|fill_forward|lags|walk_forward' AS plan FROM mt")
def recommend_strategy(t):
    return scoring.recommend_strategy(order_facts(t), KEY).select(*KEY, "family", "confidence", joined("plan").alias("plan"))


MODEL = """CASE WHEN family = 'ARIMA' AND n >= 96 AND consistency >= 0.8 AND seasonality >= 0.35 AND noise_ratio <= 0.55 THEN 'ARIMA' WHEN n <= 2500 AND score >= 45 THEN 'RandomForest'
 WHEN n <= 5000 AND score >= 55 AND noise_ratio <= 0.55 AND strong >= 1 THEN 'SVM' WHEN n >= 300 AND (strong >= 1 OR numeric_columns >= 3 OR score >= 55 OR trust >= 70) THEN 'XGBoost'
 WHEN family = 'ARIMA' OR n < 300 THEN 'ARIMA' ELSE 'RandomForest' END"""


@query("select_model", f"WITH {FACTS}, e AS (SELECT *, {FAMILY} AS family, 0 AS strong, 3 AS numeric_columns, 100 - (1 - consistency) * 35 AS trust FROM mt) SELECT o_orderpriority, {MODEL} AS model FROM e")
def select_model(t):
    facts = order_facts(t)
    family = scoring.recommend_strategy(facts, [*KEY, "n", "score", "seasonality", "noise_ratio", "consistency"])
    ready = family.withColumns({"strong_signals": F.lit(0), "numeric_columns": F.lit(3), "trust": scoring.trust_score(F.lit(0.0), F.col("consistency"))})
    return scoring.select_model(ready, KEY)


FULL_FACTS = f"""ser AS (SELECT o_orderdate AS ts, sum(o_totalprice) AS value FROM orders GROUP BY 1), six AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS idx, count(*) OVER () AS n FROM ser)"""


def _four(expr: str) -> str:
    return f"printf('%.4f', CAST({expr} AS DOUBLE))"


ORDER_NUMBERS, ORDER_TEXTS = ("o_orderkey", "o_custkey", "o_totalprice"), ("o_orderstatus", "o_orderpriority")
ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
LAGGED_ORDERS = "lo AS (SELECT *, " + ", ".join(f"lag({c}) OVER w AS p_{c}" for c in ORDER_NUMBERS[:2]) + " FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey))"
SECTIONS = f"""WITH {FULL_FACTS}, {LAGGED_ORDERS},
a AS (SELECT max(n) AS n, {TREND} AS trend, {STATION} AS stationarity, {DRIFT} AS drift FROM six),
eta AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, (SELECT sum(c * (m - g) ** 2) / any_value(t) FROM (SELECT count(*) AS c, avg(o_totalprice) AS m FROM orders GROUP BY {c}), (SELECT avg(o_totalprice) AS g, var_pop(o_totalprice) * count(*) AS t FROM orders)) AS e" for c in ORDER_TEXTS)}),
gd AS (SELECT DISTINCT o_orderdate AS ts FROM orders), gg AS (SELECT epoch(ts) - lag(epoch(ts)) OVER (ORDER BY ts) AS gap FROM gd), gm AS (SELECT count(*) AS c FROM gg WHERE gap IS NOT NULL GROUP BY gap ORDER BY c DESC LIMIT 1)
SELECT 'meaning' AS section, unnest(['dataset', 'title', 'target', 'time_column', 'dataset_type']) AS name, unnest(['shop/orders-dataset', 'Orders', 'o_totalprice', 'o_orderdate', 'time-series']) AS value
UNION ALL SELECT 'dataset_summary', unnest(['rows', 'columns', 'missing_percent']), unnest([count(*)::VARCHAR, '6', '0.0000']) FROM orders
UNION ALL SELECT 'column_roles', unnest({list(ORDER_COLUMNS)}), unnest(['external_regressor', 'external_regressor', 'entity_or_grouping', 'forecast_target', 'temporal_index', 'entity_or_grouping'])
{" ".join(f"UNION ALL SELECT 'column_profile', '{c}', count(DISTINCT {c})::VARCHAR FROM orders" for c in ORDER_COLUMNS)}
{" ".join(f"UNION ALL SELECT 'feature_signals', '{c}', {_four(f'abs(corr({c}, o_totalprice))')} || '|' || {_four(f'abs(corr(p_{c}, o_totalprice))')} FROM lo" for c in ORDER_NUMBERS[:2])}
UNION ALL SELECT 'feature_signals', feature, {_four('least(e, 1)')} || '|0.0000' FROM eta
{" ".join(f"UNION ALL SELECT 'redundant_pairs', '{x}', '{y}' FROM orders HAVING abs(corr({x}, {y})) > 0.92" for k, x in enumerate(ORDER_NUMBERS) for y in ORDER_NUMBERS[k + 1:])}
UNION ALL SELECT 'series_metrics', unnest(['n', 'trend', 'stationarity', 'drift']), unnest([n::VARCHAR, {_four('trend')}, {_four('stationarity')}, {_four('drift')}]) FROM a
UNION ALL SELECT 'quality', unnest(['trust_score', 'missing_pattern', 'duplicate_risk', 'leakage_risk']), unnest([{_four('100 - (1 - c / (SELECT count(gap) FROM gg)) * 35')}, 'none', CASE WHEN 1 - c / (SELECT count(gap) FROM gg) < 0.05 THEN 'low' ELSE 'medium' END, 'low']) FROM gm"""


def sections_of(found):
    """Every section of a profile as (section, name, value)."""
    four = lambda c: F.format_string("%.4f", F.col(c).cast("double"))

    def facts(section, df, columns):
        return df.select(F.lit(section).alias("section"), F.inline(F.array(*[F.struct(F.lit(k).alias("name"), v.cast("string").alias("value")) for k, v in columns.items()])))

    def listed(section, df, name, value):
        return df.select(F.lit(section).alias("section"), F.col(name).alias("name"), value.cast("string").alias("value"))

    parts = [
        facts("meaning", found.facts, {c: F.col(c) for c in ("dataset", "title", "target", "time_column", "dataset_type")}),
        facts("dataset_summary", found.summary, {"rows": F.col("rows"), "columns": F.col("columns"), "missing_percent": four("missing_percent")}),
        listed("column_roles", found.roles, "column", F.col("role")),
        listed("column_profile", found.columns, "column", F.col("unique_values")),
        listed("feature_signals", found.signals, "feature", F.concat(four("same_time"), F.lit("|"), four("lag"))),
        listed("redundant_pairs", found.redundant, "feature1", F.col("feature2")),
        facts("series_metrics", found.metrics, {"n": F.col("n"), "trend": four("trend"), "stationarity": four("stationarity"), "drift": four("drift")}),
        facts("quality", found.quality, {"trust_score": four("trust_score"), "missing_pattern": F.col("missing_pattern"), "duplicate_risk": F.col("duplicate_risk"), "leakage_risk": F.col("leakage_risk")}),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("full_profile", SECTIONS)
def full_profile(t):
    return sections_of(profile_dataset(t("orders"), "shop/orders-dataset", ["o_orderkey"], target="o_totalprice"))


@query("full_profile_scores", f"""WITH {FULL_FACTS}, pn AS (SELECT max(n) AS n FROM six)
SELECT n, CASE WHEN n < 24 THEN 25 END IS NULL AS scored, true AS graded, true AS planned FROM pn""")
def full_profile_scores(t):
    """The rule tables of the profile agree with each other and lie within their ranges."""
    found = profile_dataset(t("orders"), "shop/orders-dataset", ["o_orderkey"], target="o_totalprice")
    scored = attach(found.forecastability, found.strategy.select("family", "confidence"))
    return attach(scored, found.metrics.select("n")).select(
        "n", F.col("score").between(0, 100).alias("scored"), F.col("grade").isin("strong", "moderate", "weak", "poor").alias("graded"),
        F.col("family").isin("ARIMA", "RandomForest", "SVM", "XGBoost").alias("planned"))


@query("full_profile_text_dates", f"""WITH {FULL_FACTS}, a AS (SELECT max(n) AS n, {TREND} AS trend, {STATION} AS stationarity, {DRIFT} AS drift FROM six)
SELECT 'day' AS time_column, n, round(trend, 6) AS trend, round(stationarity, 6) AS stationarity, round(drift, 6) AS drift, (SELECT min(o_orderdate) FROM orders) AS time_start, (SELECT max(o_orderdate) FROM orders) AS time_end FROM a""")
def full_profile_text_dates(t):
    """The same orders with their dates as M/d/yyyy text."""
    frame = t("orders").select("o_orderkey", "o_totalprice", F.date_format("o_orderdate", "M/d/yyyy").alias("day"), "o_orderpriority")
    found = profile_dataset(frame, "shop/orders-text", ["o_orderkey"], target="o_totalprice")
    ends = found.summary.select("time_start", "time_end")
    return rounded(attach(found.metrics.select(F.lit(found.time_column).alias("time_column"), "n", "trend", "stationarity", "drift"), ends), 6, "trend", "stationarity", "drift")


@query("evidence_chunks", """WITH s AS (SELECT 'dataset_summary' AS kind, count(*) AS rows, count(DISTINCT o_orderstatus) AS u FROM orders)
SELECT kind, '{"rows":' || rows || ',"columns":6}' AS text FROM s
UNION ALL SELECT 'missing', '{"column":"' || c || '","missing":' || m || '}' FROM (SELECT 'user_id' AS c, count(*) - count(user_id) AS m FROM """ + EVENTS_WITH_GAPS + """ UNION ALL
 SELECT 'event_type', count(*) - count(event_type) FROM """ + EVENTS_WITH_GAPS + """ UNION ALL SELECT 'value', count(*) - count(value) FROM """ + EVENTS_WITH_GAPS + """)""")
def evidence_chunks(t):
    return chunks_of({
        "dataset_summary": profile.dataset_summary(t("orders")).select("rows", "columns"),
        "missing": profile.missing_report(events_with_gaps(t)).select("column", "missing"),
    })


@query("evidence_id", """SELECT doc_id, 'docs__' || source || '-' || substr(sha256('{"doc_id":' || doc_id || ',"n_chars":' || n_chars || '}'), 1, 16) AS evidence_id FROM documents""")
def evidence_id(t):
    content = F.to_json(F.struct("doc_id", "n_chars"))
    return t("documents").select("doc_id", id_of(F.concat(F.lit("docs/"), "source"), content).alias("evidence_id"))
