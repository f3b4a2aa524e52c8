"""Time axes of every kind, short tables, pages and searches by block."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import retrieval, scoring, tables, timeaxis
from seriesloom.plans.profiling import profile_dataset
from seriesloom.plans.training import train_and_report
from seriesloom.sources import files


@pytest.fixture(scope="module")
def daily(spark):
    rows = [(i, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), 10.0 + i % 7 + i / 50, f"g{i % 2}") for i in range(120)]
    return spark.createDataFrame(rows, "id long, when timestamp_ntz, sales double, region string")


@pytest.mark.parametrize("form", ["M/d/yyyy", "yyyy-MM-dd", "d-MMM-yyyy", None])
def test_axis_kinds(daily, form):
    frame = daily if form is None else daily.withColumn("when", F.date_format("when", form))
    axis = timeaxis.find_time_axis(frame)
    if form == "d-MMM-yyyy":  # no reading of this form
        assert axis is None or axis.column != "when"
        return
    assert (axis.column, axis.kind) == ("when", "timestamp" if form is None else "text")
    read = timeaxis.with_time(frame, axis)
    assert read.agg(F.min("when"), F.max("when")).first()[:] == (dt.datetime(2020, 1, 1), dt.datetime(2020, 4, 29))


def test_year_axis(spark):
    frame = spark.createDataFrame([(2000 + i, 1.5 * i, "a") for i in range(30)], "year int, sales double, region string")
    assert timeaxis.find_time_axis(frame) == timeaxis.TimeAxis("year", "year")
    assert timeaxis.find_time_axis(frame, years=False) is None
    assert timeaxis.find_time_axis(frame.select("sales", "region")) is None
    years = timeaxis.instants(frame, timeaxis.TimeAxis("year", "year"))
    assert years.agg(F.max("year")).first()[0] == dt.datetime(2029, 1, 1)


def test_text_dates_are_profiled(daily):
    frame = daily.withColumn("when", F.date_format("when", "M/d/yyyy"))
    found = profile_dataset(frame, "shop/days", ["id"], target="sales")
    assert found.time_column == "when" and found.summary.first()["time_end"] == dt.datetime(2020, 4, 29)
    assert found.quality.first()["leakage_risk"] == "low"


def test_short_table_keeps_the_last_value(daily):
    run = train_and_report(daily.where("id < 12"), "sales", ["id"], "when", model="RandomForest")
    assert run.model == "LastValue" and run.metrics.first()["rows"] > 0


def test_target_falls_back(spark):
    ids = spark.createDataFrame([(i, i % 3) for i in range(10)], "user_id long, rank long")
    assert scoring.recommend_target(ids).first()["column"] in ("user_id", "rank")
    serial = spark.createDataFrame([(i, float(i % 4)) for i in range(50)], "count long, size double")
    assert scoring.serial_ids(serial) == ["count"]
    assert scoring.recommend_target(serial).first()["column"] == "size"
    assert scoring.recommend_target(spark.createDataFrame([("a",)], "t string")).count() == 0


def test_pages(daily):
    first = tables.preview_page(daily, ["when", "id"], 1, 50).collect()
    after = tables.preview_page(daily, ["when", "id"], page_size=50, after=[first[-1]["when"], first[-1]["id"]]).collect()
    assert [r["id"] for r in first + after] == list(range(100)) and first[0]["total_pages"] == 3
    for bad in ({"page": 0}, {"page_size": 0}):
        with pytest.raises(ValueError):
            tables.preview_page(daily, ["id"], **bad)
    assert tables.preview_page(daily, ["id"], 1, 500).count() == 120


def test_quoted_headers_and_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"x, y",z\n"one\ntwo","say ""hi"""\n3,4\n')
    (tmp_path / "b.csv").write_text('"p, q",r,s\n1,2,3\n')
    got = {r["path"].rsplit("/", 1)[1]: (r["header"], r["columns"], r["rows"]) for r in files.file_shapes(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": (["x, y", "z"], 2, 2), "b.csv": (["p, q", "r", "s"], 3, 1)}


def test_encodings_per_file(spark, tmp_path):
    (tmp_path / "good.csv").write_text("id,name\n1,café\n", encoding="utf-8")
    (tmp_path / "old.csv").write_text("id,name\n2,thé\n", encoding="latin-1")
    got = files.scan_csv(spark, str(tmp_path))
    assert {(r["id"], r["name"]) for r in got.collect()} == {(1, "café"), (2, "thé")}


def test_vector_search_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "VECTORS_IN_BLOCK", 40)
    monkeypatch.setattr(retrieval, "QUERIES_IN_BLOCK", 3)
    rows = [(i, [float((i * 7) % 11), float((i * 3) % 5), 1.0 + i % 3]) for i in range(200)] + [(999, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = vectors.where("vec_id < 10").withColumnRenamed("vec_id", "query")
    got = {(r["query"], r["rank"]): r["vec_id"] for r in retrieval.vector_topk(vectors, queries, 3, "vec_id", "query").collect()}
    norm = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    unit = {i: norm(v) for i, v in rows if v}
    for q in range(10):
        best = sorted(unit, key=lambda i: (-round(sum(a * b for a, b in zip(unit[i], unit[q])), 12), i))[:3]
        scores = lambda ids: [round(sum(a * b for a, b in zip(unit[i], unit[q])), 9) for i in ids]
        assert scores([got[q, k] for k in (1, 2, 3)]) == scores(best)
