"""Readers, writers, catalog, evidence, run log, models, steps."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from seriesloom.plans import steps
from seriesloom.sources import catalog, evidence, files, models, runlog


def test_latin1_and_quoted_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name,v\ncafé,1\n".encode("latin-1"))
    assert files.scan_csv(spark, str(tmp_path / "a.csv")).first()["name"] == "café"
    folder = tmp_path / "q"
    folder.mkdir()
    (folder / "b.csv").write_text('id,text\n1,"two\nlines"\n2,plain\n')
    assert files.file_shapes(spark, str(folder), multi_line=True).first()["rows"] == 2
    assert files.scan_csv(spark, str(folder / "b.csv"), multi_line=True).count() == 2


def test_catalog_takes_largest_file(spark, tmp_path):
    for name, rows in (("own__daily-demand", 5), ("plain", 2)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "small.csv").write_text("a,b\n1,2\n")
        (tmp_path / name / "big.csv").write_text("time,demand,load\n" + "1,2,3\n" * rows)
    rows = {r["id"]: r for r in catalog.build_catalog(spark, str(tmp_path)).collect()}
    assert set(rows) == {"own--daily-demand", "plain"}
    assert rows["own--daily-demand"]["row_count"] == 5 and rows["own--daily-demand"]["column_count"] == 3
    assert rows["own--daily-demand"]["domain"] == "energy" and rows["own--daily-demand"]["is_time_series"]
    assert rows["plain"]["ref"] is None


def test_missing_frame_is_an_error(spark, tmp_path):
    cache = files.FrameCache(spark)
    with pytest.raises(FileNotFoundError):
        cache.load(str(tmp_path))
    assert cache.load(str(tmp_path), required=False) is None


def test_run_log(spark, tmp_path):
    assert runlog.read_runs(spark, str(tmp_path / "none")).count() == 0
    rows = spark.range(40).select(F.col("id").cast("string").alias("run_id"), F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("ts"))
    runlog.append_run(rows, str(tmp_path / "log"))
    kept = runlog.read_runs(spark, str(tmp_path / "log"))
    assert kept.count() == 25 and kept.first()["run_id"] == "39"
    (tmp_path / "bad.json").write_text('[{"run_id": "a"}, {"run_id": ')
    assert runlog.read_runs_json(spark, str(tmp_path / "bad.json"), "run_id string").count() == 0


def test_evidence_round_trip(spark, tmp_path):
    path = str(tmp_path / "ev")
    one = spark.createDataFrame([("x-1", "quality", "alpha beta"), ("x-1", "summary", "gamma")], "evidence_id string, kind string, text string")
    evidence.write_evidence(one, path)
    evidence.write_evidence(one.withColumn("evidence_id", F.lit("y-2")), path)
    assert evidence.read_evidence(spark, path).count() == 4
    row = evidence.read_evidence(spark, path, "x-1").where("kind = 'quality'").first()
    assert len(row["embedding"]) == 384 and sum(v * v for v in row["embedding"]) == pytest.approx(1, rel=1e-5)
    evidence.clear_evidence(spark, path)
    assert not list((tmp_path / "ev").glob("evidence_id=*"))


def test_model_round_trip(spark, tmp_path):
    df = spark.range(20).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression(labelCol="y")]).fit(df)
    models.write_model(model, spark.createDataFrame([("linear", 0.0)], "family string, mae double"), str(tmp_path / "m"))
    again, meta = models.read_model(spark, str(tmp_path / "m"))
    assert meta.first()["family"] == "linear"
    assert again.transform(df).select("prediction").first()[0] == pytest.approx(0, abs=1e-6)


def test_unknown_step_is_named(spark):
    with pytest.raises(KeyError, match="nothing"):
        steps.run_step(spark.range(1), "nothing")
    steps.register_step("double", lambda df, column: df.withColumn(column, F.col(column) * 2))
    assert steps.run_steps(spark.range(3), [("double", {"column": "id"})]).agg(F.sum("id")).first()[0] == 6
