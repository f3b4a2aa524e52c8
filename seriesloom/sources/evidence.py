"""Profiles flattened into text records with a content id and vectors, stored by id."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seriesloom.operators.retrieval import dense_vectors, hash_embedding


def evidence_chunks(sections: Mapping[str, DataFrame]) -> DataFrame:
    """``kind, text``: each row of each section as JSON, the kind being the section's name."""
    out = None
    for kind, rows in sections.items():
        part = rows.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*rows.columns)).alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


def evidence_id(dataset: Column, content: Column) -> Column:
    """Dataset id safe for paths, a hyphen, and the first 16 hex digits of the content's hash."""
    safe = F.replace(F.replace(F.replace(dataset, F.lit("/"), F.lit("__")), F.lit("\\"), F.lit("__")), F.lit(":"), F.lit("_"))
    return F.concat(safe, F.lit("-"), F.substring(F.sha2(content, 256), 1, 16))


def write_evidence(chunks: DataFrame, path: str) -> None:
    """Chunks (``evidence_id, kind, text``) with hashed vectors; other ids below the path are kept."""
    keyed = chunks.withColumn("chunk_id", F.sha2(F.concat_ws("\n", "evidence_id", "kind", "text"), 256))
    vectors = dense_vectors(hash_embedding(keyed, "text", "chunk_id"), "chunk_id")
    (
        keyed.join(vectors, "chunk_id", "left").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("evidence_id").parquet(path)
    )


def read_evidence(spark: SparkSession, path: str, evidence: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.where(F.col("evidence_id") == evidence) if evidence else rows


def clear_evidence(spark: SparkSession, path: str) -> None:
    """Leave an empty table of the same shape."""
    spark.read.parquet(path).limit(0).drop("evidence_id").write.mode("overwrite").option(
        "partitionOverwriteMode", "static").parquet(path)
