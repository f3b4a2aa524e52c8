"""Ranking of documents and catalog entries by words or vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from seriesloom.functions import text as tx
from seriesloom.operators.frames import attach

# Fixed value: width of the hashed vectors.
DIMENSIONS = 384
# Rows of a block of vectors and of a block of queries: what one task multiplies at a time.
VECTORS_IN_BLOCK, QUERIES_IN_BLOCK = 16_384, 2_048


def query_tokens(query: str) -> list[str]:
    """Tokens of a query text, by the same rule as for documents."""
    return [w.strip(tx.TOKEN_EDGE).lower() for w in query.split() if len(w) > 2]


def tags_from_text(text: Column | str, domain: Column) -> Column:
    """Domain and the first five distinct tokens, underscores as hyphens."""
    shown = F.transform(tx.tokens(F.col(text) if isinstance(text, str) else text), lambda t: F.translate(t, "_", "-"))
    return F.concat(F.array(domain), F.slice(F.array_distinct(shown), 1, 5))


def rank_tfidf(docs: DataFrame, query: str, text: str, limit: int | None = None, id_column: str = "doc_id") -> DataFrame:
    """``docs`` with ``score``, best first.

    Uses of the query's tokens are counted on each row, so documents are not shuffled; only the vocabulary size needs the distinct
    tokens of all documents.
    """
    wanted = query_tokens(query)
    if not wanted:
        out = docs.withColumn("score", F.lit(None).cast("double")).orderBy(id_column)
        return out.limit(limit) if limit else out
    distinct = list(dict.fromkeys(wanted))
    counted = docs.withColumn("_hits", tx.token_uses(F.col(text), distinct)).withColumn(
        "_tf", F.array(*[_uses("_hits", q) for q in distinct])
    )
    size = counted.agg(F.count("*").alias("_docs"), *[F.count_if(F.col("_tf")[i] > 0).alias(f"_df{i}") for i in range(len(distinct))])
    vocabulary = tx.token_rows(docs.select(text), text).select("token").distinct().agg(F.count("*").alias("_vocabulary"))
    facts = attach(size, vocabulary)
    score = tfidf_score(
        [(F.col("_tf")[i], F.col(f"_df{i}"), wanted.count(q)) for i, q in enumerate(distinct)], F.col("_docs"), F.col("_vocabulary"))
    scored = attach(counted, facts).withColumn("score", score)
    out = scored.drop("_hits", "_tf", "_docs", "_vocabulary", *[f"_df{i}" for i in range(len(distinct))])
    out = out.orderBy(F.desc("score"), id_column)
    return out.limit(limit) if limit else out


def tfidf_score(uses: list[tuple[Column, Column, int]], docs: Column, vocabulary: Column) -> Column:
    """Score from, per word of the query, its uses in the document, the documents that have it, and how often the query names it."""
    score = F.lit(0.0)
    for tf, df, times in uses:
        weight = (1 + F.log(tf.cast("double"))) * F.log((1 + docs) / (1 + df) + 1)
        score = score + F.when(tf > 0, weight * times).otherwise(0.0)
    return F.least(F.lit(0.99), F.lit(0.55) + score / F.greatest(vocabulary, F.lit(1)))


def _uses(tokens: str, token: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == token))


def hash_embedding(docs: DataFrame, text: str, id_column: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """Sparse signed-hash vectors of unit length: ``id, bucket, weight``; zero weights are left out."""
    pieces = F.split(F.translate(F.lower(tx.plain_space(F.col("_text"))), "_", " "), r"\s+")
    # Dealt out by document once: every later grouping is by document as well and needs no shuffle of its own.
    dealt = docs.select(id_column, F.col(text).alias("_text")).repartition(id_column)
    exploded = dealt.select(id_column, F.explode(pieces).alias("_w")).where("_w != ''")
    # Words are counted per document first, so that each is hashed once there.
    counted = exploded.groupBy(id_column, "_w").agg(F.count("*").alias("_n")).withColumn("_h", F.sha2("_w", 256))
    little_endian = F.concat(*[F.substring("_h", p, 2) for p in (7, 5, 3, 1)])
    bucket = F.conv(little_endian, 16, 10).cast("long") % dimensions
    # The last bit of the fifth byte gives the sign.
    sign = F.when(F.substring("_h", 10, 1).isin(*"02468ace"), 1.0).otherwise(-1.0)
    sums = counted.select(id_column, bucket.alias("bucket"), (sign * F.col("_n")).alias("_s")).groupBy(id_column, "bucket").agg(F.sum("_s").alias("_v"))
    # At most one row per bucket and document in each window.
    norm = F.sqrt(F.sum(F.col("_v") * F.col("_v")).over(Window.partitionBy(id_column)))
    return sums.select(id_column, "bucket", (F.col("_v") / F.greatest(norm, F.lit(1e-8))).alias("weight")).where("weight != 0")


def dense_vectors(sparse: DataFrame, id_column: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """``id, embedding array<float>`` from ``bucket, weight`` rows."""
    packed = sparse.groupBy(id_column).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("_m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.element_at("_m", i.cast("long")), F.lit(0.0)))
    return packed.select(id_column, every.cast("array<float>").alias("embedding"))


def best_of_block(k: int, id_column: str, query_column: str, embedding: str):
    """Function of a block of vectors and a block of queries: the block's k largest inner products of unit vectors per query."""
    def best(block: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(wanted):
            return pd.DataFrame({query_column: [], id_column: [], "score": []})
        matrices = []
        for side in (block, wanted):
            matrix = np.stack(side[embedding].to_numpy()).astype("float64")
            matrices.append(matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-8))
        scores, ids = matrices[0] @ matrices[1].T, block[id_column].to_numpy()
        parts = []
        for q, name in enumerate(wanted[query_column]):
            order = np.lexsort((ids, -scores[:, q]))[:k]
            parts.append(pd.DataFrame({query_column: name, id_column: ids[order], "score": scores[order, q]}))
        return pd.concat(parts)

    return best


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, id_column: str, query_column: str, embedding: str = "embedding") -> DataFrame:
    """``query, rank, id, score``: the k largest inner products of unit vectors per query.

    Vectors and queries are dealt into blocks by their ids; each pair of blocks is one multiplication in a task, which keeps the block's
    best k per query. Nothing passes the driver, and a task holds two blocks. Rows without a vector are left out.
    """
    id_type, query_type = dict(vectors.dtypes)[id_column], dict(queries.dtypes)[query_column]
    schema = f"{query_column} {query_type}, {id_column} {id_type}, score double"
    rows = vectors.select(id_column, embedding).where(F.col(embedding).isNotNull())
    asked = queries.select(query_column, embedding).where(F.col(embedding).isNotNull())
    n, m = max(1, -(-rows.count() // VECTORS_IN_BLOCK)), max(1, -(-asked.count() // QUERIES_IN_BLOCK))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = rows.select("*", F.pmod(F.xxhash64(id_column), F.lit(n)).cast("int").alias("_v"), every(m).alias("_q"))
    right = asked.select("*", F.pmod(F.xxhash64(query_column), F.lit(m)).cast("int").alias("_q"), every(n).alias("_v"))

    best = best_of_block(k, id_column, query_column, embedding)
    out = left.groupBy("_v", "_q").cogroup(right.groupBy("_v", "_q")).applyInPandas(best, schema)
    w = Window.partitionBy(query_column).orderBy(F.desc("score"), F.asc(id_column))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def centroids(vectors: DataFrame, by: str, embedding: str = "embedding") -> DataFrame:
    """Mean vector per group, as ``by, embedding array<double>``; summed per position, so groups of any size combine early."""
    exploded = vectors.select(by, F.posexplode(embedding).alias("_p", "_x"))
    means = exploded.groupBy(by, "_p").agg(F.avg("_x").alias("_m"))
    return means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_m"))), lambda s: s["_m"]).alias(embedding))
