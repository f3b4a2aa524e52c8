from __future__ import annotations

from pyspark.sql import functions as F

from registered import joined, query, rounded, shortened, sig
from registered.tables import (
    EVENTS_WITH_GAPS, GAP_COLUMNS, LABELLED, LINEITEM, LINEITEM_NUMERIC, LINEITEM_TEXT, ORDERS, events_with_gaps, labelled_documents,
)
from seriesloom.operators import profile, rowindex, timeaxis

TOPS = "(SELECT string_agg(v, '|' ORDER BY c DESC, raw) FROM (SELECT {col} AS raw, CAST({col} AS VARCHAR) AS v, count(*) AS c FROM {tab} WHERE {col} IS NOT NULL GROUP BY ALL ORDER BY c DESC, raw LIMIT {k}))"
FENCE = "(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t})"


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def _profile_part(c: str) -> str:
    kind = "numeric" if c in LINEITEM_NUMERIC else "categorical" if c in LINEITEM_TEXT else "datetime"
    tops = TOPS.format(col=c, tab="lineitem", k=3)
    if kind != "numeric":
        rule = f"CASE WHEN count(DISTINCT {c}) > least(500, greatest(50, count({c}) * 0.5)) THEN 'text' ELSE 'categorical' END" if kind == "categorical" else "'datetime'"
        nulls = ", ".join(f"CAST(NULL AS DOUBLE) AS {x}" for x in ("min", "max", "mean", "median", "std", "variance", "outlier_percent", "word_count_mean"))
        return f"SELECT 'lineitem' AS dataset, '{c}' AS \"column\", {rule} AS kind, round(100.0 * (count(*) - count({c})) / count(*), 6) AS missing_percent, count(DISTINCT {c}) AS unique_values, {nulls}, {tops} AS top_values FROM lineitem"
    return f"""SELECT 'lineitem' AS dataset, '{c}' AS "column", 'numeric' AS kind,
 round(100.0 * (count(*) - count({c})) / count(*), 6) AS missing_percent, count(DISTINCT {c}) AS unique_values,
 {sig(f'min({c})')} AS min, {sig(f'max({c})')} AS max, {sig(f'avg({c})')} AS mean, round(median({c}), 7) AS median,
 {sig(f'stddev_pop({c})')} AS std, {sig(f'var_pop({c})')} AS variance,
 {sig(f'100.0 * count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / count({c})')} AS outlier_percent,
 CAST(NULL AS DOUBLE) AS word_count_mean, {tops} AS top_values
FROM lineitem, {FENCE.format(c=c, t='lineitem')}"""


@query("column_profile", union(_profile_part(c) for c in LINEITEM))
def column_profile(t):
    out = profile.column_profile(t("lineitem"), "lineitem").withColumn("top_values", joined("top_values"))
    return shortened(rounded(rounded(out, 6, "missing_percent"), 7, "median"), "min", "max", "mean", "std", "variance", "outlier_percent")


@query("dataset_summary", """SELECT count(*) AS rows, 11 AS columns, 0.0 AS missing_percent, min(l_shipdate) AS time_start, max(l_shipdate) AS time_end,
 'l_extendedprice' AS target FROM lineitem""")
def dataset_summary(t):
    return profile.dataset_summary(t("lineitem"), "l_shipdate", "l_extendedprice")


@query("load_dataset_summary", union(
    f"""SELECT '{c}' AS "column", '{k}' AS kind, count(*) AS rows, 0.0 AS missing_percent, count(DISTINCT {c}) AS unique_values,
 (SELECT string_agg(CAST({c} AS VARCHAR), '|' ORDER BY o_orderkey) FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 3)) AS sample_values FROM orders"""
    for c, k in zip(ORDERS, ["numeric", "numeric", "categorical", "numeric", "datetime", "categorical"])))
def load_dataset_summary(t):
    return profile.dataset_overview(t("orders"), ["o_orderkey"]).withColumn("sample_values", joined("sample_values"))


@query("infer_kind", union(
    f"""SELECT '{c}' AS "column", {"'numeric'" if c in LINEITEM_NUMERIC else "'datetime'" if c == 'l_shipdate' else
    f"CASE WHEN count(DISTINCT {c}) > least(500, greatest(50, count({c}) * 0.5)) THEN 'text' ELSE 'categorical' END"} AS kind,
 count(DISTINCT {c}) AS unique_values FROM lineitem""" for c in LINEITEM))
def infer_kind(t):
    return profile.infer_kind(t("lineitem"))


@query("type_counts", """SELECT kind, count(*) AS columns FROM (
 SELECT unnest(['numeric', 'numeric', 'categorical', 'numeric', 'datetime', 'categorical']) AS kind FROM (SELECT count(*) FROM orders)) GROUP BY kind""")
def type_counts(t):
    return profile.type_counts(profile.infer_kind(t("orders")))


def _missing(c: str, table: str) -> str:
    share = f"(count(*) - count({c})) / count(*)"
    return f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing, round(100.0 * {share}, 6) AS percent,
 CASE WHEN {share} > 0.3 THEN 'high' WHEN {share} > 0.05 THEN 'medium' ELSE 'low' END AS severity FROM {table} HAVING count(*) > count({c})"""


@query("missing_report", union([_missing(c, EVENTS_WITH_GAPS) for c in GAP_COLUMNS] + [_missing(c, LABELLED) for c in ("doc_id", "lang", "source", "n_chars", "quality", "toxic")]))
def missing_report(t):
    both = profile.missing_report(events_with_gaps(t)).unionByName(profile.missing_report(labelled_documents(t)))
    return rounded(both, 6, "percent")


@query("missing_by_stratum", f"""WITH q AS (SELECT quantile_cont(n_chars, 0.75) AS q3 FROM documents)
SELECT CASE WHEN n_chars > q3 THEN 'high' ELSE 'rest' END AS stratum, count(*) AS rows,
 round(avg(((doc_id IS NULL)::INT + (lang IS NULL)::INT + (source IS NULL)::INT + (n_chars IS NULL)::INT + (quality IS NULL)::INT + (toxic IS NULL)::INT) / 6.0), 6) AS missing_share
FROM {LABELLED}, q GROUP BY 1""")
def missing_by_stratum(t):
    return rounded(profile.missing_by_stratum(labelled_documents(t), "n_chars"), 6, "missing_share")


@query("describe_numeric", union(
    f"""SELECT '{c}' AS "column", {sig(f'avg({c})')} AS mean, {sig(f'stddev_samp({c})')} AS std, {sig(f'min({c})')} AS min,
 round(quantile_cont({c}, 0.25), 7) AS q1, round(quantile_cont({c}, 0.5), 7) AS q2, round(quantile_cont({c}, 0.75), 7) AS q3,
 {sig(f'max({c})')} AS max, round(skewness({c}), 6) AS skewness FROM lineitem""" for c in LINEITEM_NUMERIC))
def describe_numeric(t):
    out = profile.describe_numeric(t("lineitem"))
    return rounded(rounded(shortened(out, "mean", "std", "min", "max"), 7, "q1", "q2", "q3"), 6, "skewness")


@query("numerical_analysis", union(
    f"""SELECT '{c}' AS "column", {sig(f'avg({c})')} AS mean, round(median({c}), 7) AS median, {sig(f'stddev_pop({c})')} AS std,
 {sig(f'var_pop({c})')} AS variance, {sig(f'min({c})')} AS min, {sig(f'max({c})')} AS max, round(skewness({c}), 6) AS skewness,
 round(kurtosis({c}), 6) AS kurtosis,
 round(100.0 * count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / count({c}), 6) AS outlier_percent
FROM lineitem, {FENCE.format(c=c, t='lineitem')}""" for c in LINEITEM_NUMERIC))
def numerical_analysis(t):
    out = profile.numeric_moments(t("lineitem"))
    return rounded(rounded(shortened(out, "mean", "std", "variance", "min", "max"), 7, "median"), 6, "skewness", "kurtosis", "outlier_percent")


@query("value_counts", union(
    f"""SELECT '{c}' AS "column", CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS rank, CAST({c} AS VARCHAR) AS value, count(*) AS rows
FROM orders WHERE {c} IS NOT NULL GROUP BY {c} QUALIFY row_number() OVER (ORDER BY count(*) DESC, {c}) <= 10""" for c in ORDERS if c != "o_totalprice"))
def value_counts(t):
    return profile.value_counts(t("orders").drop("o_totalprice"))


@query("top_values", union(f"""SELECT '{c}' AS "column", {TOPS.format(col=c, tab='part', k=3)} AS top_values""" for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")))
def top_values(t):
    return profile.top_values(t("part")).withColumn("top_values", joined("top_values"))


def _words(c: str) -> str:
    return f"len(list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> ''))"


@query("categorical_analysis", union(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_values, {TOPS.format(col=c, tab='orders', k=5)} AS top_values,
 round((SELECT max(c) FROM (SELECT count(*) AS c FROM orders GROUP BY {c})) / count({c}), 6) AS dominant_share,
 round(avg({_words(c)}), 6) AS word_count_mean FROM orders""" for c in ("o_orderstatus", "o_orderpriority")))
def categorical_analysis(t):
    out = profile.categorical_analysis(t("orders")).withColumn("top_values", joined("top_values"))
    return rounded(out, 6, "dominant_share", "word_count_mean")


@query("word_count_mean", f"SELECT lang, round(avg({_words('text')}), 6) AS word_count_mean FROM documents GROUP BY lang")
def word_count_mean(t):
    return rounded(profile.word_count_mean(t("documents"), "text", ["lang"]), 6, "word_count_mean")


@query("constant_columns", union(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_values FROM (SELECT c_custkey, c_mktsegment, 'bank' AS branch,
 CASE WHEN c_acctbal > 1e9 THEN c_acctbal END AS huge_balance FROM customer) HAVING count(DISTINCT {c}) <= 1""" for c in ("c_custkey", "c_mktsegment", "branch", "huge_balance")))
def constant_columns(t):
    return profile.constant_columns(t("customer").select(
        "c_custkey", "c_mktsegment", F.lit("bank").alias("branch"), F.when(F.col("c_acctbal") > 1e9, F.col("c_acctbal")).alias("huge_balance")))


@query("high_cardinality", union(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_values FROM lineitem HAVING count(DISTINCT {c}) > 20""" for c in [*LINEITEM_TEXT, "l_shipdate"]))
def high_cardinality(t):
    return profile.high_cardinality(t("lineitem"))


def _outliers(c: str, tab: str = "lineitem") -> str:
    low, high = "q1 - 1.5 * (q3 - q1)", "q3 + 1.5 * (q3 - q1)"
    hit = f"count(*) FILTER (WHERE {c} < {low} OR {c} > {high})"
    return f"""SELECT '{c}' AS "column", round(any_value({low}), 7) AS low, round(any_value({high}), 7) AS high, {hit} AS outliers,
 round(100.0 * {hit} / count({c}), 6) AS percent FROM {tab}, {FENCE.format(c=c, t=tab)}"""


@query("outlier_counts", union([_outliers(c) for c in LINEITEM_NUMERIC] + [_outliers("value", "events")]))
def outlier_counts(t):
    both = profile.outlier_counts(t("lineitem")).unionByName(profile.outlier_counts(t("events"), ["value"]))
    return rounded(rounded(both, 7, "low", "high"), 6, "percent")


@query("outlier_percent", union(
    f"""SELECT '{c}' AS "column", round(100.0 * count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / count({c}), 6) AS percent
FROM {t}, {FENCE.format(c=c, t=t)}""" for c, t in (("value", "events"), ("o_totalprice", "orders"), ("p_retailprice", "part"))))
def outlier_percent(t):
    parts = [profile.outlier_counts(t(n), [c]) for c, n in (("value", "events"), ("o_totalprice", "orders"), ("p_retailprice", "part"))]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]).select("column", "percent"), 6, "percent")


DOCS = "(SELECT text, lang, n_chars FROM documents)"


@query("dedupe_rows", f"""SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM {DOCS})) AS distinct_rows,
 count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {DOCS})) AS duplicate_rows FROM {DOCS}""")
def dedupe_rows(t):
    return profile.duplicate_count(t("documents").select("text", "lang", "n_chars"))


@query("anomaly_report", f"""SELECT 'duplicate_rows' AS issue, '*' AS "column", count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {DOCS})) AS n FROM {DOCS}
UNION ALL SELECT 'high_cardinality', 'text', count(DISTINCT text) FROM {DOCS} HAVING count(DISTINCT text) > 20
UNION ALL SELECT 'high_cardinality', 'lang', count(DISTINCT lang) FROM {DOCS} HAVING count(DISTINCT lang) > 20
UNION ALL SELECT 'constant', 'lang', count(DISTINCT lang) FROM {DOCS} HAVING count(DISTINCT lang) <= 1
UNION ALL SELECT 'outliers', 'n_chars', count(*) FILTER (WHERE n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1)) AS n
 FROM documents, {FENCE.format(c='n_chars', t='documents')}""")
def anomaly_report(t):
    return profile.anomaly_report(t("documents").select("text", "lang", "n_chars"))


@query("analyze_target", """WITH c AS (SELECT CAST(quality AS VARCHAR) AS class, count(*) AS rows FROM labels GROUP BY 1)
SELECT class, rows, round(100.0 * rows / sum(rows) OVER (), 6) AS percent, round(max(rows) OVER () / min(rows) OVER (), 6) AS imbalance_ratio,
 max(rows) OVER () / min(rows) OVER () > 3 AS is_imbalanced FROM c""")
def analyze_target(t):
    return rounded(profile.analyze_target(t("labels"), "quality"), 6, "percent", "imbalance_ratio")


@query("analyze_target_numeric", """SELECT count(*) - count(o_totalprice) AS missing, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std,
 min(o_totalprice) AS min, max(o_totalprice) AS max, round(skewness(o_totalprice), 6) AS skewness, abs(skewness(o_totalprice)) > 1 AS is_skewed FROM orders""")
def analyze_target_numeric(t):
    return rounded(rounded(profile.analyze_target(t("orders"), "o_totalprice"), 4, "mean", "std"), 6, "skewness")


@query("duplicate_timestamps", """SELECT o_orderpriority, count(o_orderdate) AS rows, count(DISTINCT o_orderdate) AS distinct_times,
 round(1 - count(DISTINCT o_orderdate) / count(o_orderdate), 6) AS duplicate_ratio FROM orders GROUP BY 1""")
def duplicate_timestamps(t):
    return rounded(profile.duplicate_timestamps(t("orders"), "o_orderdate", ["o_orderpriority"]), 6, "duplicate_ratio")


@query("record_batches", f"""WITH ix AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, count(*) OVER () AS n FROM {EVENTS_WITH_GAPS})
SELECT CAST(floor(idx / ceil(n / 9.0)) + 1 AS BIGINT) AS batch, count(*) AS rows, min(idx) + 1 AS first_row, max(idx) + 1 AS last_row,
 round(100.0 * sum((event_id IS NULL)::INT + (ts IS NULL)::INT + (user_id IS NULL)::INT + (event_type IS NULL)::INT + (value IS NULL)::INT) / (count(*) * 5), 6) AS missing_percent,
 3 AS numeric_columns, 2 AS categorical_columns, round(avg(event_id), 4) AS mean_event_id, round(avg(user_id), 6) AS mean_user_id, round(avg(value), 6) AS mean_value,
 1.0 AS parse_rate_ts FROM ix GROUP BY 1""")
def record_batches(t):
    indexed = rowindex.with_row_index(events_with_gaps(t), ["ts", "event_id"])
    out = profile.record_batches(indexed, GAP_COLUMNS)
    return rounded(rounded(out, 6, "missing_percent", "mean_user_id", "mean_value"), 4, "mean_event_id")


@query("histogram", """WITH f AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, CAST(least(12, greatest(6, floor(sqrt(count(l_extendedprice)) / 2))) AS INT) AS b FROM lineitem),
slots AS (SELECT unnest(range(1, b + 1)) AS bin, lo, hi, b, (hi - lo) / b AS w FROM f),
c AS (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / b)) + 1, b) AS INT) AS bin, count(*) AS rows FROM lineitem, f GROUP BY 1),
e AS (SELECT s.bin, lo + (s.bin - 1) * w AS low, CASE WHEN s.bin = b THEN hi ELSE lo + s.bin * w END AS high, coalesce(c.rows, 0) AS rows FROM slots s LEFT JOIN c USING (bin))
SELECT CAST(bin AS INT) AS bin, round(low, 4) AS low, round(high, 4) AS high, rows, printf('%.1fK-%.1fK', low / 1000, high / 1000) AS label FROM e""")
def histogram(t):
    return rounded(profile.histogram(t("lineitem"), "l_extendedprice"), 4, "low", "high")


@query("is_date_like_text", """WITH a AS (SELECT CAST(o_orderdate AS VARCHAR) AS d, o_orderpriority AS p, o_orderkey FROM orders),
s AS (SELECT 'date_text' AS "column", d AS v FROM a UNION ALL SELECT 'o_orderpriority', p FROM a),
m AS (SELECT "column", avg((length(trim(v)) >= 6 AND (regexp_matches(trim(v), '\\d{4}[-/]\\d{1,2}[-/]\\d{1,2}') OR regexp_matches(trim(v), '\\d{1,2}[-/]\\d{1,2}[-/]\\d{2,4}')
 OR regexp_matches(trim(v), ':.*\\d|\\d.*:')))::INT) AS share FROM s GROUP BY 1)
SELECT "column", round(share, 6) AS share, share >= 0.6 AS date_like FROM m""")
def is_date_like_text(t):
    frame = t("orders").select(F.col("o_orderdate").cast("string").alias("date_text"), "o_orderpriority")
    return rounded(timeaxis.is_date_like_text(frame, ["date_text", "o_orderpriority"]), 6, "share")


@query("parse_datetime", """SELECT strftime(o_orderdate, '%y-%b') AS month_text, date_trunc('month', o_orderdate)::TIMESTAMP AS parsed, count(*) AS rows FROM orders GROUP BY ALL""")
def parse_datetime(t):
    frame = t("orders").select(F.date_format("o_orderdate", "yy-MMM").alias("month_text"))
    return timeaxis.parse_datetime(frame, "month_text", "parsed").groupBy("month_text", "parsed").agg(F.count("*").alias("rows"))


@query("dedupe_microseconds", """WITH m AS (SELECT date_trunc('hour', ts)::TIMESTAMP + to_microseconds(event_id % 3) AS moment, event_type,
 CASE WHEN event_id % 2 = 0 THEN 0.0::DOUBLE ELSE -0.0::DOUBLE END AS zero FROM events)
SELECT moment, event_type, zero + 0.0 AS zero FROM (SELECT DISTINCT * FROM m)""")
def dedupe_microseconds(t):
    """Rows one microsecond apart stay two; both zeros are one."""
    at = F.expr("timestampadd(MICROSECOND, CAST(event_id % 3 AS INT), date_trunc('HOUR', ts))")
    frame = t("events").select(at.cast("timestamp_ntz").alias("moment"), "event_type", F.when(F.col("event_id") % 2 == 0, F.lit(0.0)).otherwise(F.lit(-0.0)).alias("zero"))
    return profile.dedupe_rows(frame).withColumn("zero", F.col("zero") + F.lit(0.0))


def events_with_nan(t):
    """As ``events_with_gaps``, with NaN where a value is missing."""
    return events_with_gaps(t).withColumn("value", F.coalesce("value", F.lit(float("nan")))).select("user_id", "value")


@query("describe_with_nan", union(
    f"""SELECT '{c}' AS "column", {sig(f'avg({c})')} AS mean, {sig(f'stddev_samp({c})')} AS std, {sig(f'min({c})')} AS min,
 round(quantile_cont({c}, 0.25), 7) AS q1, round(quantile_cont({c}, 0.5), 7) AS q2, round(quantile_cont({c}, 0.75), 7) AS q3,
 {sig(f'max({c})')} AS max, round(skewness({c}), 6) AS skewness FROM {EVENTS_WITH_GAPS}""" for c in ("user_id", "value")))
def describe_with_nan(t):
    out = profile.describe_numeric(events_with_nan(t))
    return rounded(rounded(shortened(out, "mean", "std", "min", "max"), 7, "q1", "q2", "q3"), 6, "skewness")


@query("outliers_with_nan", union(_outliers(c, EVENTS_WITH_GAPS) for c in ("user_id", "value")))
def outliers_with_nan(t):
    return rounded(rounded(profile.outlier_counts(events_with_nan(t)), 7, "low", "high"), 6, "percent")


NESTED = {"kinds": "[event_type, props]", "place": "{'user': user_id, 'kind': event_type}", "fixed": "[1]"}


@query("profile_nested", union(
    f"""SELECT '{c}' AS "column", count(*) AS rows, 0.0 AS missing_percent, count(DISTINCT {expr}) AS unique_values FROM events""" for c, expr in NESTED.items()))
def profile_nested(t):
    frame = t("events").select(
        F.array("event_type", "props").alias("kinds"), F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind")).alias("place"), F.array(F.lit(1)).alias("fixed"))
    return profile.column_stats(frame).drop("data_type")


DOTTED = {c: c.replace("_", ".", 1) for c in LINEITEM}


@query("profile_dotted", "SELECT * REPLACE (replace(\"column\", '_', '.') AS \"column\") FROM (" + union(_profile_part(c) for c in LINEITEM) + ")")
def profile_dotted(t):
    """Headers with dots are names, not paths into a struct."""
    out = profile.column_profile(t("lineitem").withColumnsRenamed(DOTTED), "lineitem").withColumn("top_values", joined("top_values"))
    return shortened(rounded(rounded(out, 6, "missing_percent"), 7, "median"), "min", "max", "mean", "std", "variance", "outlier_percent")
