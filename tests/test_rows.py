"""Rows that differ in the last microsecond stay apart, and NaN is missing."""

import math

from pyspark.sql import functions as F

from seriesloom.operators import cleaning, profile


def test_equal_rows_are_those_of_distinct(spark):
    df = spark.sql("""
        SELECT * FROM VALUES (TIMESTAMP '2024-01-01 00:00:00.000001', TIMESTAMP_NTZ '2024-01-01 00:00:00.000001', 0.0D, array(1.5D)),
          (TIMESTAMP '2024-01-01 00:00:00.000002', TIMESTAMP_NTZ '2024-01-01 00:00:00.000001', 0.0D, array(1.5D)),
          (TIMESTAMP '2024-01-01 00:00:00.000001', TIMESTAMP_NTZ '2024-01-01 00:00:00.000002', 0.0D, array(1.5D)),
          (TIMESTAMP '2024-01-01 00:00:00.000001', TIMESTAMP_NTZ '2024-01-01 00:00:00.000001', -0.0D, array(1.5D)),
          (TIMESTAMP '2024-01-01 00:00:00.000001', TIMESTAMP_NTZ '2024-01-01 00:00:00.000001', double('NaN'), array(double('NaN'))),
          (TIMESTAMP '2024-01-01 00:00:00.000001', TIMESTAMP_NTZ '2024-01-01 00:00:00.000001', double('NaN'), array(double('NaN'))),
          (NULL, NULL, NULL, NULL) AS t(`a.b`, b, c, d)
    """)
    assert df.distinct().count() == 5
    assert profile.dedupe_rows(df).count() == 5 and profile.dedupe_rows(df).columns == df.columns
    assert tuple(profile.duplicate_count(df).first()) == (7, 5, 2)


def test_nan_is_missing_in_fences(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (3.0,), (2.0,), (1000.0,), (None,)], "x double")
    row = profile.outlier_counts(df).first()
    assert (row.low, row.high, row.outliers, row.percent) == (1.75 - 1.5 * 250.5, 252.25 + 1.5 * 250.5, 1, 25.0)


def test_nested_columns_are_counted(spark):
    """Arrays, structs, maps and bytes are told apart and never taken for constants; a type without an order is left open."""
    frame = spark.range(6).select(
        "id", F.array(F.col("id") % 3, F.lit(1)).alias("a"), F.struct((F.col("id") % 2).alias("x")).alias("s"), F.array(F.lit(1)).alias("flat"),
        F.create_map(F.lit("k"), F.col("id") % 4).alias("m"), F.encode(F.col("id").cast("string"), "utf-8").alias("b"),
        F.array(F.create_map(F.lit("k"), F.col("id"))).alias("open"), (F.col("id") + F.lit(0.5)).alias("price"),
    )
    found = {r["column"]: r["unique_values"] for r in profile.column_stats(frame).collect()}
    assert found == {"id": 6, "a": 3, "s": 2, "flat": 1, "m": 4, "b": 6, "open": None, "price": 6}
    assert [r["column"] for r in profile.constant_columns(frame).collect()] == ["flat"]
    clean, report = cleaning.prepare_frame(frame, "price", order_by=["id"])
    assert set(report.dropped) == {"flat"} and "a" in clean.columns
    assert cleaning.plan_encoding(frame.drop("open")).names == []
    tops = {r["column"]: r["top_values"] for r in profile.top_values(frame, ["a", "s"], 2).collect()}
    assert tops == {"a": ["[0, 1]", "[1, 1]"], "s": ["{0}", "{1}"]}

def test_dotted_names(spark):
    """A header with dots is a name in every profile and cleaning step, NaN is missing in their moments."""
    df = spark.createDataFrame([(1.0, "a", 5), (math.nan, "b", 6), (3.0, None, 7), (2.0, "a", 8)] * 5, "`x.y` double, `t.u` string, `n.` long")
    row = profile.describe_numeric(df, ["x.y"]).first()
    assert (row["mean"], row["q2"], row["min"], row["max"]) == (2.0, 2.0, 1.0, 3.0)
    found = {r["column"]: r for r in profile.column_profile(df).collect()}
    assert found["x.y"].missing_percent == 25.0 and found["x.y"].unique_values == 3 and found["t.u"].top_values == ["a", "b"]
    assert {r["column"]: r["missing"] for r in profile.missing_report(df).collect()} == {"x.y": 5, "t.u": 5}
    assert profile.numeric_moments(df, ["x.y"]).first()["mean"] == 2.0 and profile.outlier_counts(df, ["x.y"]).first()["outliers"] == 0
    filled = cleaning.impute_categorical_auto(cleaning.impute_median(df.replace(math.nan, None), ["x.y"]), ["t.u"])
    assert filled.where("`x.y` IS NULL OR `t.u` IS NULL").count() == 0
    clean, report = cleaning.prepare_frame(df, "n.")
    assert clean.columns[:3] == ["x.y", "t.u", "n."] and clean.where("`x.y` IS NULL").count() == 0 and report.fills == {"t.u": "Unknown"}
    assert {"onehot_t.u_a", "onehot_t.u_b"} <= set(cleaning.encode_auto(df, cleaning.plan_encoding(df, ["t.u"])).columns)
