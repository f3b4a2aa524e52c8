"""Work done once and in parts that grow in number, not in size, with the table."""

import datetime as dt

import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from seriesloom.operators import pairing, profile, scoring, trees, validation
from seriesloom.plans import rawscoring, training


def test_target_counts_values_once(spark, tmp_path, monkeypatch):
    """One count of values serves the serial numbers, the scores and the result; the result does not read the table again."""
    rows = [(i, i % 5, float(i % 9), None if i % 4 else 0.5) for i in range(60)]
    spark.createDataFrame(rows, "serial long, level int, size double, total double").write.parquet(f"{tmp_path}/t")
    calls = []
    monkeypatch.setattr(scoring, "distinct_counts", lambda *a: calls.append(a) or profile.distinct_counts(*a))
    found = scoring.recommend_target(spark.read.parquet(f"{tmp_path}/t"))
    assert len(calls) == 1 and found.inputFiles() == []
    assert found.first()["column"] == "size"
    ids = spark.createDataFrame([(i, i % 3) for i in range(10)], "user_id long, rank long")
    assert scoring.recommend_target(ids).first()[:] == ("user_id", None)


def test_frequencies_keep_columns_apart(spark):
    """Columns of one family are counted together, each under its own name and without nulls."""
    frame = spark.createDataFrame([(1, 1, "x", True), (1, None, "x", None), (2, None, None, True)], "a int, b long, c string, d boolean")
    got = {(r["column"], str(r["value"])): r["rows"] for f in profile.value_frequencies(frame) for r in f.collect()}
    assert got == {("a", "1"): 2, ("a", "2"): 1, ("b", "1"): 1, ("c", "x"): 2, ("d", "true"): 2}


@pytest.mark.parametrize("preferred", [1, 2, 4, 5])
def test_fold_marks_are_the_folds(spark, preferred):
    """Every row has the same part in every fold as by ``assign_fold``, in short and long series and one without a name."""
    sizes = {"a": 1, "b": 7, "c": 79, "d": 80, "e": 333, None: 130}
    rows = [(k, i, n) for k, n in sizes.items() for i in range(n)]
    indexed = spark.createDataFrame(rows, "k string, idx long, n long")
    plan = validation.walk_forward_folds(indexed.groupBy("k").agg(F.max("n").alias("n")), ["k"], preferred)
    want = {(r["fold"], r["part"], r["k"], r["idx"]) for r in pairing.assign_fold(indexed, plan, ["k"]).collect()}
    kept = indexed.withColumn("marks", validation.fold_marks(preferred)).collect()
    place = {r["fold"]: {} for r in plan.collect()}
    for r in plan.collect():
        place[r["fold"]][r["k"]] = r
    bits = {"train": validation.TRAIN, "test": validation.TEST}
    got = {(f, part, r["k"], r["idx"]) for f in range(1, 6) for part, bit in bits.items() for r in kept if r["marks"] >> 4 * (f - 1) & bit}
    assert got == want and len(want) > 600
    last = {(f, r["k"], r["idx"]) for f in range(1, 6) for r in kept if r["marks"] >> 4 * (f - 1) & validation.LAST}
    first = {(f, r["k"], r["idx"]) for f in range(1, 6) for r in kept if r["marks"] >> 4 * (f - 1) & validation.FIRST}
    assert last == {(f, k, r["train_end"] - 1) for f in place for k, r in place[f].items()}
    assert first == {(f, k, r["test_start"]) for f in place for k, r in place[f].items()}


def test_trees_learn_from_small_parts(spark, monkeypatch):
    """What trees learn from comes in parts of bounded size, their number grows with the rows."""
    seen = []
    fit = RandomForestRegressor.fit
    monkeypatch.setattr(trees, "PART_CELLS", 120, raising=False)
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, df, *a: seen.append(df.rdd.glom().map(len).collect()) or fit(self, df, *a))
    frame = spark.createDataFrame([(i, float(i % 7), float(i % 7) * 2 + i % 3) for i in range(1200)], "id long, a double, y double")
    result = trees.train_trees(frame, "y", ["a"], ["id"], (), "forest", [{"numTrees": 2, "maxDepth": 2}], 2)
    assert len(seen) == 3 and all(len(s) >= 20 and max(s) <= 150 for s in seen)
    assert (result.train_rows, result.test_rows) == (1000, 200)


def test_only_rows_to_score_and_their_reach_are_predicted(spark, tmp_path, monkeypatch):
    """Rows further back than any feature looks are read, ordered and used to fill gaps, but get no features and no prediction of their own."""
    rows = [(i, dt.datetime(2020, 1, 1) + dt.timedelta(days=i // 2), 10.0 + i % 7, f"g{i % 2}", float(i % 5) if i < 6 else None if i % 3 else 4.0) for i in range(1000)]
    frame = spark.createDataFrame(rows, "id long, when timestamp_ntz, sales double, region string, size double")
    grid = [{"numTrees": 3, "maxDepth": 3}]
    run = training.train_and_report(frame, "sales", ["id"], "when", ["region"], "RandomForest", grid, folds=2, path=str(tmp_path))
    sizes, predicted = [], rawscoring._predicted
    monkeypatch.setattr(rawscoring, "_predicted", lambda s, m, f: sizes.append(f.count()) or predicted(s, m, f))
    last = frame.where("id >= 960")
    scored = rawscoring.score_rows(spark, f"{tmp_path}/model", last, frame.where("id < 960")).collect()
    own = {r["id"]: r["predicted"] for r in run.trees.model.transform(run.matrix).collect()}
    assert len(scored) == 40 and all(r["predicted"] == pytest.approx(own[r["id"]]) for r in scored)
    assert sizes == [40 + 2 * run.scorer.plan.reach]
