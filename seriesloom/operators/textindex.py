"""Stored inverted index for ranking by words: a search reads the buckets of its own tokens, not the texts.

Below the path of an index lie ``postings`` (token, id, uses) and ``tokens`` (token, docs), both partitioned by a bucket of the token's hash,
and ``facts`` (one row: documents, size of the vocabulary, number of buckets).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seriesloom.functions import text as tx
from seriesloom.operators.retrieval import query_tokens, tfidf_score

#: Buckets of an index; a hot token spreads over several files of its bucket.
BUCKETS = 256


def bucket_of(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def build_text_index(docs: DataFrame, path: str, text: str, id_column: str = "doc_id", buckets: int = BUCKETS) -> None:
    """Write the index of all documents. Ids are unique and not null; a null or empty text has no tokens but counts as a document."""
    spark = docs.sparkSession
    token = tx.token_rows(docs.select(id_column, text), text).select("token", F.col(id_column).alias("id"))
    uses = token.groupBy("token", "id").agg(F.count("*").alias("uses")).withColumn("bucket", bucket_of(F.col("token"), buckets))
    # Sorted by token inside a file, so that the file's statistics leave out most of a bucket.
    dealt = uses.repartitionByRange("bucket", "token", F.xxhash64("id")).sortWithinPartitions("bucket", "token")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    kind = dict(uses.dtypes)["id"]
    stored = spark.read.schema(f"token string, id {kind}, uses long, bucket int").parquet(f"{path}/postings")
    per_token = stored.groupBy("bucket", "token").agg(F.count("*").alias("docs"))
    per_token.repartitionByRange("bucket", "token").sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/tokens")
    size = spark.read.schema("token string, docs long, bucket int").parquet(f"{path}/tokens").count()
    docs.agg(F.count("*").alias("docs")).withColumns({
        "vocabulary": F.lit(size), "buckets": F.lit(buckets), "id_kind": F.lit(kind),
    }).write.mode("overwrite").parquet(f"{path}/facts")


def search_text_index(spark: SparkSession, path: str, docs: DataFrame, query: str, limit: int, id_column: str = "doc_id") -> DataFrame:
    """The rows and scores of ``rank_tfidf`` with the same ``limit``; only the found rows of ``docs`` are joined, texts are not read for the ranking."""
    wanted = query_tokens(query)
    if not wanted:
        return docs.withColumn("score", F.lit(None).cast("double")).orderBy(id_column).limit(limit)
    facts = spark.read.parquet(f"{path}/facts").first()
    distinct = list(dict.fromkeys(wanted))
    buckets = spark.range(1).select(*[bucket_of(F.lit(w), facts["buckets"]).alias(f"b{i}") for i, w in enumerate(distinct)]).first()
    own = F.col("bucket").isin(sorted(set(buckets))) & F.col("token").isin(distinct)
    tokens = spark.read.schema("token string, docs long, bucket int").parquet(f"{path}/tokens").where(own)
    frequency = {r["token"]: r["docs"] for r in tokens.collect()}  # one row per word of the query
    postings = spark.read.schema(f"token string, id {facts['id_kind']}, uses long, bucket int").parquet(f"{path}/postings").where(own)
    uses = postings.groupBy("id").agg(*[F.max(F.when(F.col("token") == w, F.col("uses"))).alias(f"_{i}") for i, w in enumerate(distinct)])
    count, vocabulary = F.lit(facts["docs"]), F.lit(facts["vocabulary"])
    score = tfidf_score([
        (F.coalesce(F.col(f"_{i}"), F.lit(0)), F.lit(frequency.get(w, 0)), wanted.count(w)) for i, w in enumerate(distinct)
    ], count, vocabulary)
    hits = uses.select(F.col("id").alias(id_column), score.alias("score"))
    best = hits.orderBy(F.desc("score"), id_column).limit(limit)
    missing = limit - best.count()
    if missing > 0:  # documents without any of the words follow, by id
        rest = docs.select(id_column).join(hits, id_column, "left_anti").orderBy(id_column).limit(missing)
        best = best.unionByName(rest.withColumn("score", tfidf_score([], count, vocabulary)))
    return docs.join(best, id_column).select(*docs.columns, "score").orderBy(F.desc("score"), id_column)
