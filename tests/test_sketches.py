"""Profiles merged from batches, against the same facts of the whole table."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.streaming import sketches

COLUMNS = ["x", "k", "t", "at", "d", "none"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = [
        (i % 4, float("nan") if i % 50 == 0 else float(v), i % 700, f"w{i % 9}" if i % 10 else None, dt.datetime(2020, 1, 1, 0, 0, 0, i % 3), Decimal(10**20 + i % 2), None)
        for i, v in enumerate(rng.lognormal(0, 2, 6000))
    ]
    return spark.createDataFrame(rows, "part int, x double, k long, t string, at timestamp_ntz, d decimal(38,0), none double")


@pytest.fixture(scope="module")
def profiled(spark, table, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sketches"))
    for i in range(4):
        sketches.keep_batch(table.where(f"part = {i}"), COLUMNS, path, i)
    sketches.keep_batch(table.where("part = 2"), COLUMNS, path, 2)  # a batch run again
    sketches.keep_batch(table.where("part > 9"), COLUMNS, path, 4)  # an empty one
    return {r["column"]: r for r in sketches.reconcile(spark, path).collect()}


def test_exact_parts(table, profiled):
    pdf = table.toPandas()
    for c in COLUMNS:
        assert profiled[c].rows == 6000 and profiled[c].missing == pdf[c].isna().sum()
        assert profiled[c].unique_values == pdf[c].dropna().nunique()
    assert profiled["x"].mean == pytest.approx(pdf.x.mean()) and profiled["x"]["std"] == pytest.approx(pdf.x.std(ddof=0))
    assert (profiled["x"].lowest, profiled["x"].highest) == (pdf.x.min(), pdf.x.max())
    words = sorted(pdf.t.value_counts().items(), key=lambda p: (-p[1], p[0]))
    assert profiled["t"].top_values == [w for w, _ in words[:3]]
    assert profiled["d"].top_values == [str(10**20), str(10**20 + 1)]
    assert profiled["none"].top_values == [] and profiled["none"].median is None and profiled["t"].median is None


def test_sketches_within_their_errors(table, profiled):
    x = pd.Series(table.select("x").toPandas().x).dropna()
    for p, v in ((0.25, profiled["x"].q1), (0.5, profiled["x"].median), (0.75, profiled["x"].q3)):
        assert (x < v).mean() - sketches.RANK_ERROR <= p <= (x <= v).mean() + sketches.RANK_ERROR
    for c in ("x", "k", "t", "at", "d"):
        assert profiled[c].distinct_estimate == pytest.approx(profiled[c].unique_values, rel=sketches.DISTINCT_ERROR)


def test_a_stream_restarted_counts_once(spark, table, tmp_path):
    table.select("k", "t").repartition(6).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second start finds nothing new
        stream = spark.readStream.schema("k long, t string").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
        sketches.stream_profile(stream, ["k", "t"], f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    found = {r["column"]: r for r in sketches.reconcile(spark, f"{tmp_path}/out").collect()}
    assert spark.read.parquet(f"{tmp_path}/out/facts").select("batch").distinct().count() == 3
    assert found["k"].rows == 6000 and found["k"].unique_values == 700 and found["t"].missing == 600


def test_nested_columns_are_refused(spark, tmp_path):
    frame = spark.range(3).select(F.array("id").alias("a"))
    with pytest.raises(TypeError, match="a"):
        sketches.keep_batch(frame, ["a"], str(tmp_path), 0)
