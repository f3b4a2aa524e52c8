"""Inverted-file index for nearest vectors: a coarse clustering fitted on a bounded sample, and a table of every row partitioned by cluster.

Below the path of an index lie ``centres`` (one row per list), ``sizes`` (rows per list) and ``rows`` partitioned by ``list``. A search
reads only the lists next to its queries; ``probes`` equal to the number of lists gives the exact answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from seriesloom.operators.retrieval import QUERIES_IN_BLOCK, VECTORS_IN_BLOCK, best_of_block, vector_topk

#: Bounds of what the fit looks at and of what a task is handed: sampled vectors, and lists of an index.
MOST_SAMPLED, MOST_LISTS = 65_536, 4_096
#: Rows that a build searches exactly to learn how many lists a search must read, and the share of their neighbours to be found.
MOST_TRIED, TARGET_RECALL = 256, 0.95


def build_index(
    vectors: DataFrame, path: str, id_column: str, embedding: str = "embedding", lists: int | None = None,
    most_sampled: int = MOST_SAMPLED, rounds: int = 10, neighbours: int = 10, target: float = TARGET_RECALL,
) -> None:
    """Write the index of all rows with a vector.

    The centres come from at most ``most_sampled`` rows, those of the smallest id hashes; every row is then put in the list of its nearest
    centre. ``lists`` is the square root of the number of rows when not given, ``MOST_LISTS`` at most. A zero vector is as near to any list
    and goes to the first; a null vector is in no list. Repeated rows stay repeated. A large list is written as several files.

    How many lists a search reads is learnt from the rows themselves: ``MOST_TRIED`` of them are searched exactly, and as many lists are
    probed as hold the share ``target`` of their ``neighbours`` nearest others. Vectors without any clusters so cost nearly all lists.
    """
    spark = vectors.sparkSession
    rows = vectors.select(id_column, embedding).where(F.col(embedding).isNotNull())
    n = rows.count()
    wanted = min(MOST_LISTS, lists or max(1, round(n ** 0.5)))
    sample = rows.where(_norm(F.col(embedding)) > 0).orderBy(F.xxhash64(F.col(id_column).cast("string")), id_column).limit(most_sampled)
    sample = sample.select(array_to_vector(F.col(embedding).cast("array<double>")).alias("features")).persist()
    if sample.isEmpty():
        centres = np.zeros((1, 1))
    elif wanted == 1:
        centres = np.zeros((1, len(sample.first()["features"])))
    else:
        model = KMeans(k=wanted, maxIter=rounds, seed=7, distanceMeasure="cosine").fit(sample)
        centres = np.array(model.clusterCenters())
    sample.unpersist()
    found = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
    spark.createDataFrame(found, "list int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["list"] = _nearest(batch[embedding], centres, 1)[:, 0]
            yield batch

    types = dict(rows.dtypes)
    schema = f"`{id_column}` {types[id_column]}, `{embedding}` {types[embedding]}, list int"
    dealt = rows.mapInPandas(place, schema).repartitionByRange("list", F.xxhash64(F.col(id_column).cast("string")))  # a hot list spreads over tasks
    dealt.write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
    stored = spark.read.schema(schema).parquet(f"{path}/rows")
    probes = _probes_needed(stored, centres, id_column, embedding, neighbours, target) if n and len(centres) > 1 else 1
    sizes = stored.groupBy("list").agg(F.count("*").alias("rows"), F.lit(schema).alias("schema"), F.lit(probes).alias("probes"))
    sizes.coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes")


def _probes_needed(stored: DataFrame, centres: np.ndarray, id_column: str, embedding: str, neighbours: int, target: float) -> int:
    """Number of lists that hold the wanted share of the nearest others of a few rows; found by one exact search over all rows."""
    tried = stored.where(_norm(F.col(embedding)) > 0).orderBy(F.xxhash64(F.lit("tried"), F.col(id_column).cast("string")), id_column).limit(MOST_TRIED)
    tried = tried.select(F.col(id_column).alias("_tried"), embedding)

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_tried": batch["_tried"], "_order": list(_nearest(batch[embedding], centres, len(centres)))})

    ordered = tried.mapInPandas(order, f"_tried {dict(tried.dtypes)['_tried']}, _order array<int>")
    found = vector_topk(stored, tried, neighbours + 1, id_column, "_tried", embedding).where(F.col(id_column) != F.col("_tried"))
    placed = found.join(stored.select(id_column, "list"), id_column).join(ordered, "_tried")
    depths = sorted(r[0] for r in placed.select(F.array_position("_order", F.col("list"))).collect())  # a few numbers per tried row
    return int(depths[max(0, math.ceil(target * len(depths)) - 1)]) if depths else 1


def _norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _nearest(vectors: pd.Series, centres: np.ndarray, count: int) -> np.ndarray:
    """Numbers of the ``count`` nearest centres per vector, nearest first, ties to the smaller number."""
    if len(centres) == 1 or not len(vectors):
        return np.zeros((len(vectors), count), dtype="int32")
    matrix = np.stack(vectors.to_numpy()).astype("float64")
    return np.argsort(-(matrix @ centres.T), axis=1, kind="stable")[:, :count].astype("int32")


def read_lists(spark: SparkSession, path: str, lists: list[int] | None = None) -> DataFrame:
    """``id, embedding, list`` of the given lists (all when missing); the files of other lists are not opened."""
    known = spark.read.parquet(f"{path}/sizes").first()
    if known is None:
        raise ValueError("the index holds no vector")
    rows = spark.read.schema(known["schema"]).parquet(f"{path}/rows")
    return rows if lists is None else rows.where(F.col("list").isin(lists))


def search_index(
    spark: SparkSession, path: str, queries: DataFrame, k: int, id_column: str, query_column: str, embedding: str = "embedding", probes: int | None = None,
) -> DataFrame:
    """``query, rank, id, score`` as ``vector_topk`` gives them, from the ``probes`` lists nearest to each query.

    As many lists as the build found necessary are read when ``probes`` is not given. Queries without a vector and an index without rows give nothing.
    The driver holds the centres and one number per list; vectors and queries of a list meet in blocks, so a hot list is many tasks.
    """
    centres_ = [r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("list").collect()]  # at most MOST_LISTS rows
    centres = np.array(centres_)
    known = spark.read.parquet(f"{path}/sizes")
    if known.isEmpty():
        return spark.createDataFrame([], f"`{query_column}` {dict(queries.dtypes)[query_column]}, `{id_column}` long, score double, rank int")
    count = min(len(centres), known.first()["probes"] if probes is None else probes)
    query_type = dict(queries.dtypes)[query_column]
    asked = queries.select(query_column, embedding).where(F.col(embedding).isNotNull())

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lists = _nearest(batch[embedding], centres, count)
            out = batch.loc[batch.index.repeat(count)].reset_index(drop=True)
            out["list"] = lists.reshape(-1)
            yield out

    probed = asked.mapInPandas(probe, f"`{query_column}` {query_type}, `{embedding}` {dict(asked.dtypes)[embedding]}, list int")
    load = probed.groupBy("list").agg(F.count("*").alias("asked"))
    # One row per list that a query probes: its vectors are dealt into n blocks, its queries into m.
    blocks = {r["list"]: (-(-r["rows"] // VECTORS_IN_BLOCK), -(-r["asked"] // QUERIES_IN_BLOCK)) for r in known.join(load, "list").collect()}
    rows = read_lists(spark, path, sorted(blocks))
    id_type = dict(rows.dtypes)[id_column]
    per_list = lambda i: F.create_map(*[F.lit(x) for number, nm in blocks.items() for x in (number, nm[i])])[F.col("list")]
    if not blocks:
        return spark.createDataFrame([], f"`{query_column}` {query_type}, `{id_column}` {id_type}, score double, rank int")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    left = rows.select("*", F.pmod(F.xxhash64(id_column), per_list(0)).alias("_v"), every(per_list(1)).alias("_q"))
    right = probed.where(F.col("list").isin(list(blocks))).select("*", F.pmod(F.xxhash64(query_column), per_list(1)).alias("_q"), every(per_list(0)).alias("_v"))
    best = best_of_block(k, id_column, query_column, embedding)
    schema = f"`{query_column}` {query_type}, `{id_column}` {id_type}, score double"
    found = left.groupBy("list", "_v", "_q").cogroup(right.groupBy("list", "_v", "_q")).applyInPandas(best, schema)
    w = Window.partitionBy(query_column).orderBy(F.desc("score"), F.asc(id_column))  # probes times blocks times k rows per query
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame, id_column: str, query_column: str) -> DataFrame:
    """``wanted, reached, recall``: how much of the exact answer a search has found."""
    hits = exact.select(query_column, id_column).join(found.select(query_column, id_column, F.lit(1).alias("_hit")).distinct(), [query_column, id_column], "left")
    return hits.agg(F.count("*").alias("wanted"), F.count("_hit").alias("reached")).withColumn("recall", F.try_divide(F.col("reached").cast("double"), F.col("wanted")))
