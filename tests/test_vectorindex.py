"""The inverted-file index: every row is in it, a search opens only its lists, and reading all lists is the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import retrieval, vectorindex


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16)) * 4
    rows = [(f"v{i}", [float(x) for x in centres[0 if i % 3 == 0 else i % 30] + rng.normal(size=16)]) for i in range(3000)]
    rows += [("none", None), ("zero", [0.0] * 16), ("v1", rows[1][1])]
    return spark.createDataFrame(rows, "name string, embedding array<float>").repartition(5)


@pytest.fixture(scope="module")
def index(clustered, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    vectorindex.build_index(clustered, path, "name")
    return path


def asked(clustered):
    return clustered.where("name rlike '^v[0-9]*00$' OR name = 'none'").select(F.col("name").alias("q"), "embedding")


def test_every_row_with_a_vector_is_in_one_list(spark, clustered, index):
    rows = vectorindex.read_lists(spark, index)
    assert sorted(r[0] for r in rows.select("name").collect()) == sorted(r[0] for r in clustered.where("embedding IS NOT NULL").select("name").collect())
    sizes = {r["list"]: r["rows"] for r in spark.read.parquet(f"{index}/sizes").collect()}
    assert sizes == {r["list"]: r["n"] for r in rows.groupBy("list").agg(F.count("*").alias("n")).collect()}


def test_few_lists_recall_and_all_lists_are_exact(spark, clustered, index):
    exact = retrieval.vector_topk(clustered, asked(clustered), 10, "name", "q").cache()
    found = vectorindex.search_index(spark, index, asked(clustered), 10, "name", "q")
    lists = spark.read.parquet(f"{index}/sizes")
    assert lists.first()["probes"] <= lists.count() / 2  # clustered vectors need few lists
    assert vectorindex.recall(found, exact, "name", "q").first()["recall"] >= 0.9
    full = vectorindex.search_index(spark, index, asked(clustered), 10, "name", "q", probes=10_000)
    shown = lambda df: sorted((r["q"], r["rank"], r["name"], round(r["score"], 9)) for r in df.collect())
    assert shown(full) == shown(exact)


def test_only_probed_lists_are_opened(spark, clustered, index):
    one = asked(clustered).where("q = 'v100'")
    found = vectorindex.search_index(spark, index, one, 3, "name", "q", probes=1)
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "list" in plan.split("PartitionFilters:")[1].split("]")[0]
    opened = [r for r in vectorindex.read_lists(spark, index, [0]).inputFiles()]
    assert 0 < found.count() <= 3 and opened


def test_empty_and_single(spark, tmp_path):
    schema = "name string, embedding array<float>"
    queries = spark.createDataFrame([("a", [1.0, 0.0])], "q string, embedding array<float>")
    vectorindex.build_index(spark.createDataFrame([], schema), str(tmp_path / "none"), "name")
    assert vectorindex.search_index(spark, str(tmp_path / "none"), queries, 3, "name", "q").count() == 0
    vectorindex.build_index(spark.createDataFrame([("x", [2.0, 0.0])], schema), str(tmp_path / "one"), "name")
    row = vectorindex.search_index(spark, str(tmp_path / "one"), queries, 3, "name", "q").first()
    assert (row["q"], row["name"], row["rank"], row["score"]) == ("a", "x", 1, 1.0)
    assert vectorindex.search_index(spark, str(tmp_path / "one"), queries.where("q = 'b'"), 3, "name", "q").count() == 0
