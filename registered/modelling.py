from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from registered import logged, query, rounded
from registered.tables import DAILY, EVENTS_WITH_GAPS, KEY, LABELLED, LINEITEM_NUMERIC, LINEITEM_ORDER, daily_orders, events_with_gaps, labelled_documents
from registered.reading import place
from seriesloom.operators import cleaning, features, rowindex, series, tables, trees, validation
from seriesloom.operators.frames import attach
from seriesloom.operators.frames import first_numeric as first_of, select_numeric as numeric_of
from seriesloom.plans.rawscoring import score_rows
from seriesloom.plans.steps import run_steps as run_list
from seriesloom.plans.training import train_and_report as train_all
from seriesloom.sources.models import read_model, write_model as store_model
from seriesloom.sources.runlog import read_runs

MEDIAN = f"(SELECT median(value) FROM {EVENTS_WITH_GAPS})"
MODE_TYPE = f"(SELECT event_type FROM {EVENTS_WITH_GAPS} WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
MODE_USER = f"(SELECT user_id FROM {EVENTS_WITH_GAPS} WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query("to_numeric", """SELECT event_id, TRY_CAST(regexp_extract(props, '"k": *([^}]*)', 1) AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS not_a_number FROM events""")
def to_numeric(t):
    k = F.get_json_object("props", "$.k")
    return t("events").select("event_id", cleaning.to_numeric(k).alias("k"), cleaning.to_numeric(F.col("event_type")).alias("not_a_number"))


@query("drop_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def drop_columns(t):
    return tables.drop_columns(t("orders"), ["o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "no_such_column"])[0]


@query("select_numeric", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def select_numeric(t):
    return numeric_of(t("orders"))


@query("first_numeric", "SELECT lang AS first_of, count(n_chars) AS values FROM (SELECT 'n_chars' AS lang, n_chars FROM documents) GROUP BY 1")
def first_numeric(t):
    frame = t("documents").select("lang", "source", "n_chars")
    name = first_of(frame)
    return frame.agg(F.lit(name).alias("first_of"), F.count(name).alias("values"))


@query("require_target", f"SELECT event_id, CAST(value AS DOUBLE) AS value FROM {EVENTS_WITH_GAPS} WHERE value IS NOT NULL")
def require_target(t):
    return cleaning.require_target(events_with_gaps(t), "value").select("event_id", "value")


@query("finite_rows", f"SELECT event_id, user_id, value FROM {EVENTS_WITH_GAPS} WHERE user_id IS NOT NULL AND value IS NOT NULL AND value <> 0.5 AND user_id <> 10")
def finite_rows(t):
    broken = events_with_gaps(t).withColumn("rate", F.when(F.col("user_id") == 10, F.lit(float("inf"))).otherwise(F.when(F.col("value") == 0.5, F.lit(float("nan"))).otherwise(F.col("value"))))
    return cleaning.finite_rows(broken, ["user_id", "value", "rate"]).select("event_id", "user_id", "value")


def _clip(c: str, tab: str) -> str:
    return f"least(greatest(CAST({c} AS DOUBLE), (SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM {tab})), (SELECT quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM {tab}))"


@query("clip_iqr", f"SELECT event_id, round({_clip('value', 'events')}, 6) AS value FROM events")
def clip_iqr(t):
    return rounded(cleaning.clip_iqr(t("events"), ["value"]).select("event_id", "value"), 6, "value")


@query("clip_report", "SELECT 'value' AS \"column\", round(any_value(lo), 6) AS low, round(any_value(hi), 6) AS high, count(*) FILTER (WHERE value < lo) AS capped_low, count(*) FILTER (WHERE value > hi) AS capped_high FROM events, (SELECT quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lo, quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS hi FROM events)")
def clip_report(t):
    return rounded(cleaning.clip_report(t("events"), ["value"]), 6, "low", "high")


@query("clip_iqr_features", f"SELECT l_extendedprice, {', '.join(f'round({_clip(c, chr(108) + chr(105))}, 6) AS {c}' for c in ('l_quantity', 'l_discount', 'skewed'))} FROM li".replace("FROM li", "FROM (SELECT l_extendedprice, l_quantity, l_discount, l_quantity * l_quantity * l_quantity AS skewed FROM lineitem)"))
def clip_iqr_features(t):
    frame = t("lineitem").select("l_extendedprice", "l_quantity", "l_discount", (F.col("l_quantity") * F.col("l_quantity") * F.col("l_quantity")).alias("skewed"))
    return rounded(cleaning.clip_iqr_features(frame, "l_extendedprice"), 6, "l_quantity", "l_discount", "skewed")


@query("impute_median", f"SELECT event_id, coalesce(value, {MEDIAN}) AS value FROM {EVENTS_WITH_GAPS}")
def impute_median(t):
    return cleaning.impute_median(events_with_gaps(t), ["value"]).select("event_id", "value")


@query("impute_mode", f"SELECT event_id, coalesce(event_type, {MODE_TYPE}) AS event_type, coalesce(user_id, {MODE_USER}) AS user_id FROM {EVENTS_WITH_GAPS}")
def impute_mode(t):
    return cleaning.impute_mode(events_with_gaps(t), ["event_type", "user_id"]).select("event_id", "event_type", "user_id")


@query("impute_constant", f"SELECT event_id, coalesce(event_type, 'missing') AS event_type FROM {EVENTS_WITH_GAPS}")
def impute_constant(t):
    return cleaning.impute_constant(events_with_gaps(t), ["event_type"], "missing").select("event_id", "event_type")


@query("impute_categorical_auto", f"SELECT event_id, coalesce(event_type, {MODE_TYPE}) AS event_type, CASE WHEN value IS NULL THEN 'Unknown' ELSE 'known' END AS grade FROM {EVENTS_WITH_GAPS}")
def impute_categorical_auto(t):
    frame = events_with_gaps(t).withColumn("grade", F.when(F.col("value").isNotNull(), "known"))
    return cleaning.impute_categorical_auto(frame, ["event_type", "grade"]).select("event_id", "event_type", "grade")


@query("missing_indicator", f"SELECT doc_id, n_chars, quality, toxic, CASE WHEN quality IS NULL THEN 1.0 ELSE 0.0 END AS quality_was_missing, CASE WHEN toxic IS NULL THEN 1.0 ELSE 0.0 END AS toxic_was_missing FROM {LABELLED}")
def missing_indicator(t):
    return cleaning.missing_indicator(labelled_documents(t).select("doc_id", "n_chars", "quality", "toxic"))


@query("label_encode", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS o_orderstatus FROM orders")
def label_encode(t):
    frame = t("orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return cleaning.label_encode(cleaning.label_encode(frame, "o_orderpriority"), "o_orderstatus")


@query("onehot_encode", "SELECT o_orderkey, " + ", ".join(f"CASE WHEN o_orderstatus = '{v}' THEN 1.0 ELSE 0.0 END AS o_orderstatus_{v}" for v in "FOP") + " FROM orders")
def onehot_encode(t):
    return cleaning.onehot_encode(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")


@query("encode_auto", "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS DOUBLE) AS enc_p_name, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS DOUBLE) AS enc_p_brand, "
       + ", ".join(f"CASE WHEN p_type = '{v}' THEN 1.0 ELSE 0.0 END AS onehot_p_type_{v}" for v in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")) + " FROM part")
def encode_auto(t):
    frame = t("part").select("p_partkey", "p_name", "p_brand", "p_type")
    plan = cleaning.plan_encoding(frame)
    return cleaning.encode_auto(frame, plan).drop("p_name", "p_brand", "p_type")


CLASSES = [f"k{i:02d}" for i in range(24)]


@query("encode_auto_with_gaps", "SELECT event_id, " + ", ".join(f"CASE WHEN event_id % 7 <> 0 AND event_id % 24 = {i} THEN 1.0 ELSE 0.0 END AS onehot_kind_{c}" for i, c in enumerate(CLASSES))
       + ", CASE WHEN event_id % 7 = 0 THEN 1.0 ELSE 0.0 END AS \"onehot_kind_Unknown\" FROM events")
def encode_auto_with_gaps(t):
    """24 classes and missing values: 25 columns, none cut."""
    kind = F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("k"), F.lpad((F.col("event_id") % 24).cast("string"), 2, "0")))
    frame = t("events").select("event_id", kind.alias("kind"))
    return cleaning.encode_auto(frame, cleaning.plan_encoding(frame)).drop("kind")


@query("standard_scale", "SELECT l_orderkey, l_linenumber, l_partkey, round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 6) AS l_extendedprice, round((l_discount - avg(l_discount) OVER ()) / stddev_pop(l_discount) OVER (), 6) AS l_discount FROM lineitem")
def standard_scale(t):
    frame = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount")
    return rounded(cleaning.standard_scale(frame, ["l_extendedprice", "l_discount"]), 6, "l_extendedprice", "l_discount")


GAP_ORDER = "PARTITION BY kind ORDER BY ts, event_id"


@query("prepare_frame", f"""WITH e AS (SELECT event_id, ts, kind, amount, score, spare, CASE WHEN spare IS NULL THEN 1.0 ELSE 0.0 END AS spare_was_missing FROM (
  SELECT event_id, ts, event_type AS kind, value AS amount, CASE WHEN event_type <> 'click' OR value > 60 THEN user_id END AS score, CASE WHEN value < 30 THEN value * 2 END AS spare FROM events)),
ff AS (SELECT event_id, ts, kind, amount, spare_was_missing,
 last_value(score IGNORE NULLS) OVER ({GAP_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS score, last_value(spare IGNORE NULLS) OVER ({GAP_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spare
 FROM e),
f AS (SELECT event_id, ts, kind, amount, spare_was_missing, coalesce(score, (SELECT median(score) FROM ff)) AS score, coalesce(spare, (SELECT median(spare) FROM ff)) AS spare FROM ff)
SELECT event_id, ts, kind, amount, spare_was_missing, round({_clip('score', 'f')}, 6) AS score, round({_clip('spare', 'f')}, 6) AS spare FROM f""")
def prepare_frame(t):
    frame = t("events").select(
        "event_id", "ts", F.col("event_type").alias("kind"), F.col("value").alias("amount"), F.when((F.col("event_type") != "click") | (F.col("value") > 60), F.col("user_id")).alias("score"),
        F.when(F.col("value") < 30, F.col("value") * 2).alias("spare"), F.lit("x").alias("constant"), F.col("value").alias("amount_forecast"))
    clean, _ = cleaning.prepare_frame(frame, "amount", "ts", ["kind"], ["event_id"])
    return rounded(clean, 6, "score", "spare")


MATRIX_LAGS, MATRIX_WINDOWS = (1, 2, 3, 6, 12, 24, 48, 168), (3, 6, 12, 24, 72, 168)
MATRIX = [f"lag_{k}" for k in MATRIX_LAGS] + [f"rolling_{m}_{w}" for w in MATRIX_WINDOWS for m in ("mean", "std")] + ["diff_1", "diff_24"]


SHIPPED = """series AS (SELECT l_linestatus, l_shipdate AS ts, sum(l_extendedprice) AS value FROM lineitem GROUP BY ALL),
ix AS (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY ts) - 1 AS idx FROM series)"""


def _matrix_sql() -> str:
    by = "PARTITION BY l_linestatus ORDER BY idx"
    lags = ", ".join(f"lag(value, {k}) OVER w AS lag_{k}" for k in MATRIX_LAGS)
    rolls = ", ".join(f"CASE WHEN count(value) OVER r{w} >= {max(2, w // 2)} THEN avg(value) OVER r{w} END AS rolling_mean_{w}, CASE WHEN count(value) OVER r{w} >= {max(2, w // 2)} THEN stddev_pop(value) OVER r{w} END AS rolling_std_{w}" for w in MATRIX_WINDOWS)
    frames = ", ".join(f"r{w} AS ({by} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)" for w in MATRIX_WINDOWS)
    return f"m AS (SELECT l_linestatus, ts, value, {lags}, {rolls}, lag(value, 1) OVER w - lag(value, 2) OVER w AS diff_1, lag(value, 1) OVER w - lag(value, 25) OVER w AS diff_24 FROM ix WINDOW w AS ({by}), {frames})"


@query("supervised_matrix", f"""WITH {SHIPPED}, {_matrix_sql()} SELECT l_linestatus, ts, round(value, 2) AS value, {', '.join(f'round({c}, 2) AS {c}' if c.startswith('diff') else f'round(ln(1 + {c}), 7) AS {c}' for c in MATRIX)},
 CAST(isodow(ts) - 1 AS DOUBLE) AS dayofweek, CAST(month(ts) AS DOUBLE) AS month, CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END AS "onehot_l_linestatus_O" FROM m WHERE {' AND '.join(f'{c} IS NOT NULL' for c in MATRIX)}""")
def supervised_matrix(t):
    daily = series.series_by_time(t("lineitem"), "l_shipdate", "l_extendedprice", ["l_linestatus"])
    matrix, _ = features.supervised_matrix(daily, "value", "ts", ["l_linestatus"])
    out = matrix.select("l_linestatus", "ts", "value", *MATRIX, "dayofweek", "month", "onehot_l_linestatus_O")
    return logged(rounded(out, 2, "value", "diff_1", "diff_24"), *[c for c in MATRIX if not c.startswith("diff")])


@query("feature_plan", f"""WITH {DAILY}, l AS (SELECT max(n) AS n FROM ix), p AS (SELECT count(DISTINCT o_orderpriority) AS k FROM ix)
SELECT 'temporal' AS role, 11 + (SELECT count(*) FROM l, (VALUES (1), (2), (3), (6), (12), (24), (48), (168)) v(x) WHERE x <= greatest(1, n // 3)) + 2 * (SELECT count(*) FROM l, (VALUES (3), (6), (12), (24), (72), (168)) v(x) WHERE x <= greatest(3, n // 2))
 + (SELECT count(*) FROM l, (VALUES (1), (24)) v(x) WHERE n > x) AS features UNION ALL SELECT 'encoded', k FROM p""")
def feature_plan(t):
    daily = daily_orders(t).drop("idx", "n")
    _, plan = features.supervised_matrix(daily, "value", "ts", KEY)
    return plan.as_rows(daily).groupBy("role").agg(F.count("*").alias("features"))


@query("run_steps", """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem), c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linestatus,
 least(greatest(l_extendedprice, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) AS l_extendedprice FROM lineitem, q)
SELECT l_orderkey, l_linenumber, l_partkey, round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 6) AS l_extendedprice, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END AS "l_linestatus_F", CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END AS "l_linestatus_O" FROM c""")
def run_steps(t):
    frame = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus", "l_extendedprice", "l_returnflag")
    out = run_list(frame, [
        ("drop_columns", {"columns": ["l_returnflag"]}), ("clip_iqr", {"columns": ["l_extendedprice"]}),
        ("standard_scale", {"columns": ["l_extendedprice"]}), ("onehot_encode", {"column": "l_linestatus"}),
    ])
    return rounded(out, 6, "l_extendedprice")


# Complete rows of the daily matrix, their split and the last-value baseline; ``sane``: the model's error is finite and below twice the baseline's.
SPLIT = "CASE WHEN n <= 4 THEN greatest(1, n - 1) ELSE greatest(floor(n * 0.8), n - greatest(200, floor(n * 0.02))) END"
BASELINE = f"""{DAILY}, l AS (SELECT max(n) AS n FROM ix),
r AS (SELECT greatest((SELECT coalesce(max(x), 1) FROM l, (VALUES (1), (2), (3), (6), (12), (24), (48), (168)) v(x) WHERE x <= greatest(1, n // 3)),
 (SELECT coalesce(max(greatest(2, x // 2)), 2) FROM l, (VALUES (3), (6), (12), (24), (72), (168)) v(x) WHERE x <= greatest(3, n // 2)), CASE WHEN (SELECT n FROM l) > 24 THEN 25 ELSE 2 END) AS r),
m AS (SELECT o_orderpriority, value, row_number() OVER (PARTITION BY o_orderpriority ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM ix, r WHERE idx >= r),
s AS (SELECT *, {SPLIT} AS split FROM m), z AS (SELECT o_orderpriority, max_by(value, k) AS last FROM s WHERE k < split GROUP BY 1),
b AS (SELECT count(*) AS rows, avg(abs(value - last)) AS mae, sqrt(avg((value - last) ** 2)) AS rmse FROM s JOIN z USING (o_orderpriority) WHERE k >= split)
SELECT rows, (SELECT count(*) FROM s WHERE k < split) AS train_rows, round(mae, 2) AS baseline_mae, round(rmse, 2) AS baseline_rmse, true AS sane FROM b"""


def _judged(model, baseline, train_rows: int):
    both = attach(baseline.select("rows", F.col("mae").alias("baseline_mae"), F.col("rmse").alias("baseline_rmse")), model.select("mae"))
    sane = F.coalesce((F.col("mae") >= 0) & (F.col("mae") < 2 * F.col("baseline_mae")), F.lit(False))
    return rounded(both.select("rows", F.lit(train_rows).cast("long").alias("train_rows"), "baseline_mae", "baseline_rmse", sane.alias("sane")), 2, "baseline_mae", "baseline_rmse")


def _trees(t, family: str, grid):
    daily = daily_orders(t).drop("idx", "n")
    matrix, plan = features.supervised_matrix(daily, "value", "ts", KEY)
    result = trees.train_trees(matrix, "value", plan.features, ["ts"], KEY, family, grid)
    return _judged(result.metrics, result.baseline, result.train_rows)


@query("train_random_forest", f"WITH {BASELINE}")
def train_random_forest(t):
    return _trees(t, "forest", [{"numTrees": 20, "maxDepth": 6, "minInstancesPerNode": 3}, {"numTrees": 20, "maxDepth": 8, "minInstancesPerNode": 1}])


@query("train_gbt", f"WITH {BASELINE}")
def train_gbt(t):
    return _trees(t, "boosting", [{"maxIter": 10, "maxDepth": 3, "stepSize": 0.1, "minInstancesPerNode": 1}])


YEARS_SOLD = "(SELECT year(o_orderdate) AS year, o_custkey % 20 AS region, sum(o_totalprice) AS sales FROM orders GROUP BY ALL)"


@query("train_year_axis", f"""WITH ix AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY year) - 1 AS idx, count(*) OVER (PARTITION BY region) AS n FROM {YEARS_SOLD}),
l AS (SELECT max(n) AS n FROM ix),
r AS (SELECT greatest((SELECT coalesce(max(x), 1) FROM l, (VALUES (1), (2), (3), (6)) v(x) WHERE x <= greatest(1, n // 3)), 2) AS r),
m AS (SELECT region, sales AS value, row_number() OVER (PARTITION BY region ORDER BY year) - 1 AS k, count(*) OVER (PARTITION BY region) AS n FROM ix, r WHERE idx >= r),
s AS (SELECT *, {SPLIT} AS split FROM m), z AS (SELECT region, max_by(value, k) AS last FROM s WHERE k < split GROUP BY 1)
SELECT 'year' AS time_column, count(*) AS rows, round(avg(abs(value - last)), 2) AS baseline_mae FROM s JOIN z USING (region) WHERE k >= split""")
def train_year_axis(t):
    """A panel of yearly sums: found by its year column, trained on year features."""
    sold = t("orders").groupBy(F.year("o_orderdate").alias("year"), F.concat(F.lit("r"), F.lpad((F.col("o_custkey") % 20).cast("string"), 2, "0")).alias("region")).agg(F.sum("o_totalprice").alias("sales"))
    run = train_all(sold, "sales", ["region"], entities=["region"], model="RandomForest", grid=[{"numTrees": 5, "maxDepth": 3}], folds=2)
    return run.baseline.select(F.lit(run.time_column).alias("time_column"), "rows", F.round("mae", 2).alias("baseline_mae"))


@query("train_without_leaks", """SELECT 'fitted on training rows' AS state, count(*) AS rows, true AS same FROM orders""")
def train_without_leaks(t):
    """Changed holdout values leave the fill values, fences and categories of the training rows as they were."""
    base = t("orders").select("o_orderkey", "o_orderdate", "o_totalprice", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey").cast("double")).alias("amount"), "o_orderpriority")
    placed = rowindex.with_row_index(base, ["o_orderdate", "o_orderkey"])
    placed = placed.withColumn(cleaning.TRAINING, F.col("idx") < validation.split_index(F.col("n")))
    fit = F.col(cleaning.TRAINING)
    other = placed.withColumns({"amount": F.when(fit, F.col("amount")).otherwise(F.lit(1e9)), "o_orderpriority": F.when(fit, F.col("o_orderpriority")).otherwise(F.lit("9-NEW"))})
    cleaned = [cleaning.prepare_frame(frame, "o_totalprice", "o_orderdate", (), ["o_orderkey"], fit)[0] for frame in (placed, other)]
    plans = [features.supervised_matrix(c, "o_totalprice", "o_orderdate", (), ["o_orderkey"], fit_where=fit)[1] for c in cleaned]
    kept = [c.where(fit).select("o_orderkey", "amount", "o_orderpriority") for c in cleaned]
    same = kept[0].exceptAll(kept[1]).isEmpty() and plans[0].features == plans[1].features
    return base.agg(F.lit("fitted on training rows").alias("state"), F.count("*").alias("rows"), F.lit(same).alias("same"))


@query("train_and_report", """WITH s AS (SELECT o_orderpriority, o_totalprice AS value, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS idx, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT unnest(['last_value', 'model']) AS candidate, 'RandomForest' AS model, 'o_totalprice' AS target, true AS measured FROM (SELECT count(*) AS rows FROM s HAVING count(*) > 0)""")
def train_and_report(t):
    """The whole way, stored: the run log holds the report's model row and the model can be read again."""
    frame = t("orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus")
    path = place(frame.sparkSession, "training")
    run = train_all(frame, "o_totalprice", ["o_orderkey"], "o_orderdate", ["o_orderpriority"], "RandomForest", [{"numTrees": 10, "maxDepth": 5}], folds=2, dataset="orders", path=path)
    logged_run, (_, meta) = read_runs(frame.sparkSession, f"{path}/runs").first(), read_model(frame.sparkSession, f"{path}/model")
    stored = logged_run["model"] == run.model and meta.first()["model"] == run.model
    measured = F.col("mae").isNotNull() & (F.col("rows") > 0) & (F.col("mae") >= 0) & F.lit(stored)
    return run.report().select("candidate", "model", "target", measured.alias("measured"))


@query("score_raw_rows", f"""WITH s AS (SELECT o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS idx, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderpriority, count(*) AS rows, count(*) AS scored, count(*) AS same FROM s WHERE idx >= {SPLIT} GROUP BY 1""")
def score_raw_rows(t):
    """Raw orders of the holdout, scored by the stored model in a plan of its own, get the training plan's own predictions."""
    frame = t("orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey").cast("double")).alias("amount"))
    path = place(frame.sparkSession, "scoring")
    run = train_all(frame, "o_totalprice", ["o_orderkey"], "o_orderdate", ["o_orderpriority"], "RandomForest", [{"numTrees": 10, "maxDepth": 5}], folds=2, path=path)
    placed = rowindex.with_row_index(frame, ["o_orderdate", "o_orderkey"], ["o_orderpriority"])
    training = F.col("idx") < validation.split_index(F.col("n"))
    raw = [placed.where(part).drop("idx", "n") for part in (~training, training)]
    scored = score_rows(frame.sparkSession, f"{path}/model", raw[0], raw[1])
    own = run.trees.model.transform(run.matrix).select("o_orderkey", F.col("predicted").alias("own"))
    agree = F.abs(F.col("predicted") - F.col("own")) <= 1e-9 * F.abs(F.col("own"))
    return scored.join(own, "o_orderkey", "left").groupBy("o_orderpriority").agg(F.count("*").alias("rows"), F.count("predicted").alias("scored"), F.count_if(agree).alias("same"))


@query("write_model", """SELECT count(*) AS rows, true AS same FROM part""")
def write_model(t):
    """A fitted model written and read again predicts the same."""
    frame = t("part").select(F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    fitted = Pipeline(stages=[VectorAssembler(inputCols=["size"], outputCol="features"), LinearRegression(featuresCol="features", labelCol="price", predictionCol="predicted")]).fit(frame)
    path = place(frame.sparkSession, "model")
    store_model(fitted, frame.agg(F.lit("linear").alias("family"), F.count("*").alias("rows")), path)
    again, meta = read_model(frame.sparkSession, path)
    gap = again.transform(frame).agg(F.sum("predicted")).first()[0] - fitted.transform(frame).agg(F.sum("predicted")).first()[0]
    return meta.select("rows", F.lit(abs(gap) < 1e-6).alias("same"))
