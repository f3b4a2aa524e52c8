"""Statistical conventions against pandas and numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.functions import domains, names, stats, text
from seriesloom.operators import associations, profile, quantiles


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(5, 2, 90), "b": rng.exponential(3, 90), "k": rng.integers(0, 4, 90)})
    pdf.loc[5:9, "b"] = np.nan
    return pdf, spark.createDataFrame(pdf).withColumn("b", F.when(~F.isnan("b"), F.col("b")))


def test_moments(frame):
    pdf, df = frame
    row = df.agg(stats.skewness_g1(F.col("b")).alias("g1"), stats.kurtosis_g2(F.col("b")).alias("g2")).first()
    assert row["g1"] == pytest.approx(pdf["b"].skew())
    assert row["g2"] == pytest.approx(pdf["b"].kurtosis())


def test_corr_of_complete_pairs(frame):
    pdf, df = frame
    assert df.agg(stats.safe_corr(F.col("a"), F.col("b"))).first()[0] == pytest.approx(pdf["a"].corr(pdf["b"]))
    assert df.agg(stats.safe_corr(F.col("a"), F.lit(1.0))).first()[0] == 0.0


@pytest.mark.parametrize("inside", [1, 10, 200_000])
def test_bracketed_quantiles(spark, monkeypatch, inside):
    monkeypatch.setattr(quantiles, "INSIDE_VALUES", inside)
    monkeypatch.setattr(quantiles, "ACCURACY", 50)
    rng = np.random.default_rng(0)
    # A third of all rows share one value, another column is constant, a third is empty.
    hot = np.where(rng.random(3000) < 0.35, 7.0, rng.normal(7, 3, 3000))
    pdf = pd.DataFrame({"hot": hot, "flat": 2.0, "wide": rng.lognormal(0, 3, 3000)})
    df = spark.createDataFrame(pdf).withColumn("none", F.lit(None).cast("double")).repartition(5)
    probs = [0.0, 0.05, 0.25, 0.31, 0.5, 0.66, 0.75, 0.95, 1.0]
    got = quantiles.exact_quantiles(df, ["hot", "flat", "wide", "none"], probs)
    for c in pdf:
        assert got[c] == pytest.approx(list(pdf[c].quantile(probs)), rel=1e-12)
    assert got["none"] == [None] * len(probs)


def test_profile_of_degenerate_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (1, None, None)], "c int, n double, s string")
    rows = {r["column"]: r for r in profile.column_profile(df).collect()}
    assert rows["n"]["missing_percent"] == 100 and rows["n"]["unique_values"] == 0 and rows["n"]["top_values"] == []
    assert rows["c"]["outlier_percent"] == 0 and rows["c"]["std"] == 0
    assert rows["s"]["top_values"] == ["x"]
    empty = profile.column_profile(df.where("c > 5")).collect()
    assert len(empty) == 3 and all(r["missing_percent"] == 0 for r in empty)


def test_eta_squared_matches_groups(frame):
    pdf, df = frame
    got = associations.eta_squared(df.withColumn("k", F.col("k").cast("string")), "a", ["k"]).first()["same_time"]
    groups = pdf.groupby("k")["a"]
    between = sum(len(g) * (g.mean() - pdf["a"].mean()) ** 2 for _, g in groups)
    assert got == pytest.approx(between / ((pdf["a"] - pdf["a"].mean()) ** 2).sum())


@pytest.mark.parametrize("value, month", [
    ("03-Jan", "2003-01"), ("2003-Jan", "2003-01"), ("Jan-99", "1999-01"), ("Jan-2003", "2003-01"), ("01-2003", "2003-01"), ("2003-01", "2003-01"),
])
def test_month_formats(spark, value, month):
    from seriesloom.operators.timeaxis import parse_datetime

    df = spark.createDataFrame([(value,)] * 5, "m string")
    assert str(parse_datetime(df, "m", "t").first()["t"])[:7] == month


def test_name_rules(spark):
    def values(rule, *names_):
        df = spark.createDataFrame([(n,) for n in names_], "column string")
        return [r[0] for r in df.select(rule(F.col("column"))).collect()]

    assert values(names.excluded_target, "humidity", "user_id", "year", "sales", "demand_rank") == [False, True, True, False, True]
    assert values(lambda c: names.excluded_target(c, substrings=True), "humidity") == [True]
    leak = lambda c: names.leakage_reason(c, F.lit("happiness_score")).isNotNull()
    assert values(leak, "happiness_score", "happiness_rank", "upper_whisker", "explained_gdp", "happiness_score_2", "life_score") == [True, True, True, False, True, True]
    safe = lambda c: names.safe_feature(c, F.lit("energy consumption (kwh)"))
    assert values(safe, "hvac load", "next energy use", "temperature") == [False, False, True]
    assert values(names.time_name_score, "order_date", "timestamp", "row_time") == [9.0, 7.0, -2.0]


def test_words_split_on_every_white_space(spark):
    # Narrow no-break space, ideographic space, unit separator, line separator.
    df = spark.createDataFrame([("one\u202ftwo\u3000three\x1ffour\u2028 five, (six)",)], "t string")
    row = df.select(text.words(F.col("t")), text.tokens(F.col("t")), text.token_uses(F.col("t"), ["six", "two"])).first()
    assert row[0] == ["one", "two", "three", "four", "five,", "(six)"]
    assert row[1] == ["one", "two", "three", "four", "five", "six"]
    assert row[2] == ["two", "six"]


def test_token_uses_equal_tokens(spark):
    df = spark.createDataFrame([("The the THE. (the) a., the,the at. x the",)], "t string")
    wanted = ["the", "a", "at"]
    row = df.select(F.filter(text.tokens(F.col("t")), lambda w: w.isin(wanted)), text.token_uses(F.col("t"), wanted)).first()
    assert row[0] == row[1]


def test_titles(spark):
    df = spark.createDataFrame([("o/gold-price_history-v2",), ("a--sales-data",), ("plain",), ("a__x-12345",)], "d string")
    assert [r[0] for r in df.select(text.title_from_id(F.col("d"))).collect()] == ["Gold Price History", "Sales", "Plain", "X"]


def test_corr_matrix_with_gaps_and_constants(frame):
    pdf, df = frame
    wide = df.withColumns({"flat": F.lit(0.1), "twice": F.col("a") * 2 + 1e6, "none": F.lit(None).cast("double")})
    got = {(r[0], r[1]): r[2] for r in associations.corr_matrix(wide).collect()}
    assert len(got) == 15
    assert got["a", "b"] == pytest.approx(pdf["a"].corr(pdf["b"])) and got["b", "k"] == pytest.approx(pdf["b"].corr(pdf["k"]))
    assert got["a", "twice"] == pytest.approx(1) and got["a", "flat"] is None and got["a", "none"] is None and got["b", "flat"] is None


def test_use_case_of_each_domain(spark):
    texts = ["Power, load and grid price", "market stock cost", "nothing known", "supply chain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(domains.domain_by_tokens(F.col("t")).alias("d"))
    rows = df.select(domains.use_case(F.col("d"), True), domains.use_case(F.col("d"), False)).collect()
    assert [tuple(r) for r in rows] == [
        ("energy demand forecasting and grid optimization", "energy consumption analysis and segmentation"),
        ("price forecasting and risk modeling", "financial pattern analysis"),
        ("forecasting and operational planning", "exploratory analysis and predictive modeling"),
        ("supply chain disruption prediction and resilience scoring",) * 2,
    ]
    other = spark.createDataFrame([("commerce",), (None,)], "d string").select(domains.use_case(F.col("d"), True))
    assert [r[0] for r in other.collect()] == ["forecasting and operational planning"] * 2
