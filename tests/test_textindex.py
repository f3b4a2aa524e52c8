"""The stored word index ranks as the scan of the texts does and opens only the buckets of the query's tokens."""

import pytest

from seriesloom.operators import retrieval, textindex


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(["common"] * (i % 4) + [f"word{i % 37}", f"(rare{i})", "of", "..."])) for i in range(400)]
    return spark.createDataFrame(rows + [(1000, None), (1001, ""), (1002, "common word5 " * 5000)], "doc_id long, text string").repartition(4)


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("words"))
    textindex.build_text_index(docs, path, "text", buckets=16)
    return path


@pytest.mark.parametrize("query", ["common word5 common", "rare7", "Common, rare17 absent", "nothing here", "of to"])
@pytest.mark.parametrize("limit", [3, 60, 1000])
def test_same_rows_and_scores(spark, docs, index, query, limit):
    got = textindex.search_text_index(spark, index, docs, query, limit).collect()
    assert [(r.doc_id, r.text, r.score) for r in got] == [(r.doc_id, r.text, r.score) for r in retrieval.rank_tfidf(docs, query, "text", limit).collect()]


def test_only_the_buckets_of_the_query_are_opened(spark, docs, index):
    plan = textindex.search_text_index(spark, index, docs, "rare7", 1)._jdf.queryExecution().toString()
    filters = plan.split("/postings]")[-1].split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in filters and "PushedFilters: [" in plan


def test_empty_table(spark, docs, tmp_path):
    nothing = docs.where("doc_id < 0")
    textindex.build_text_index(nothing, str(tmp_path), "text")
    assert textindex.search_text_index(spark, str(tmp_path), nothing, "common", 5).count() == 0
