"""A profile of an unbounded table from parts that merge: moments and sketches per batch, and exact counts per value.

Below the path of a profile lie ``facts`` (one row per column and batch, with its sketches) and ``counts/<kind>`` (one row per column, batch
and distinct value, values in their own type). Each batch overwrites its own partition, so a batch run twice counts once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from seriesloom.operators.frames import named_rows, nan_to_null, numeric_columns
from seriesloom.operators.profile import distinct_of, tops_of, value_frequencies
from seriesloom.streaming.jobs import merged_profile

#: Size of the quantile sketches, and how far the rank of a quantile may be off (as a share of the rows, with 99 % confidence).
SKETCH_K, RANK_ERROR = 800, 0.005
#: Size of the distinct sketches (2 to this power registers), and three standard errors of the estimate.
SKETCH_LG, DISTINCT_ERROR = 14, 0.025
#: Kinds of value that ``counts`` has a folder for, as the folder is named; decimals have one per scale.
_COUNTED = (T.NumericType, T.StringType, T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType)


def batch_facts(batch: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, rows, missing, mean, m2, lowest, highest, quantiles, distincts`` in one pass; numbers only for numeric columns."""
    numeric = set(numeric_columns(batch))
    kinds = dict(batch.dtypes)
    none = F.lit(None).cast("double")

    def aggregates(c: str) -> dict:
        value, number = F.col(f"`{c}`"), F.col(f"`{c}`").cast("double") + F.lit(0.0) if c in numeric else none
        # the sketch knows integers, texts and bytes; other kinds go in as text, which tells their values apart
        key = value if kinds[c] in ("string", "int", "bigint") else number.cast("string") if kinds[c] in ("double", "float") else value.cast("string")
        return {
            "rows": F.count("*"), "missing": F.count_if(value.isNull()), "mean": F.avg(number), "m2": F.var_pop(number) * F.count(value),
            "lowest": F.min(number), "highest": F.max(number),
            "quantiles": F.kll_sketch_agg_double(number, SKETCH_K) if c in numeric else F.lit(None).cast("binary"),
            "distincts": F.hll_sketch_agg(key, SKETCH_LG),
        }

    return named_rows(nan_to_null(batch), "column", {c: aggregates(c) for c in columns})


def keep_batch(batch: DataFrame, columns: Sequence[str], path: str, number: int) -> None:
    """Write the parts of one batch below ``path``, in place of what an earlier run of this batch has left."""
    odd = [f.name for f in batch.schema if f.name in columns and not isinstance(f.dataType, _COUNTED)]
    if odd:
        raise TypeError(f"nested and binary columns are not profiled: {', '.join(odd)}")
    parts = [("facts", batch_facts(batch, columns))]
    for counts in value_frequencies(nan_to_null(batch.select(*[F.col(f"`{c}`") for c in columns])), columns):
        kind = dict(counts.dtypes)["value"]
        if kind == "double":  # one zero
            counts = counts.groupBy("column", (F.col("value") + F.lit(0.0)).alias("value")).agg(F.sum("rows").alias("rows"))
        parts.append((f"counts/{kind.replace('(', '_').replace(',', '_').rstrip(')')}", counts))
    for name, part in parts:
        part.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/{name}")


def stream_profile(stream: DataFrame, columns: Sequence[str], path: str, checkpoint: str) -> StreamingQuery:
    """Profile every micro-batch of ``stream`` into ``path``; ``reconcile`` reads it at any time."""
    def keep(batch: DataFrame, number: int) -> None:
        kept = batch.persist()  # the facts and each kind of value read the batch
        try:
            keep_batch(kept, columns, path, number)
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _of(parts: DataFrame, batches: Sequence[int] | None) -> DataFrame:
    return parts if batches is None else parts.where(F.col("batch").isin(list(batches)))


def merged_counts(spark: SparkSession, path: str, batches: Sequence[int] | None = None) -> list[DataFrame]:
    """``column, value, rows`` over all (or the given) batches, one frame per kind of value."""
    frames = []
    for kind in ("bigint", "double", "string", "timestamp_ntz", *[f"decimal_38_{s}" for s in range(39)]):
        try:
            counts = spark.read.parquet(f"{path}/counts/{kind}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        frames.append(_of(counts, batches).groupBy("column", "value").agg(F.sum("rows").alias("rows")))
    return frames


def reconcile(spark: SparkSession, path: str, top: int = 3, batches: Sequence[int] | None = None) -> DataFrame:
    """``column, rows, missing, mean, std, lowest, highest, q1, median, q3, distinct_estimate, unique_values, top_values`` of all batches so far, or of the given ones.

    Rows, missing, extremes, ``unique_values`` and ``top_values`` (text, most frequent first, ties to the smaller value) are exact. The quartiles' ranks
    are off by RANK_ERROR of the rows at most, ``distinct_estimate`` by DISTINCT_ERROR: they cost one row per column and
    batch, where the exact counts cost one row per distinct value and batch. NaN is missing. A column without any value has 0 distinct values and no top ones.
    """
    facts = _of(spark.read.parquet(f"{path}/facts"), batches)
    sketched = facts.groupBy("column").agg(
        F.kll_merge_agg_double("quantiles", SKETCH_K).alias("_q"), F.hll_union_agg("distincts").alias("_d"), F.count("mean").alias("_filled"),
    )
    at = lambda p: F.when(F.col("_filled") > 0, F.kll_sketch_get_quantile_double("_q", F.lit(p)))
    estimates = sketched.select("column", at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"), F.hll_sketch_estimate("_d").alias("distinct_estimate"))
    out = merged_profile(facts).join(estimates, "column")
    tallies = merged_counts(spark, path, batches)
    if not tallies:
        return out.withColumns({"unique_values": F.lit(0).cast("long"), "top_values": F.array().cast("array<string>")})
    exact = distinct_of(tallies).select("column", "unique_values").join(tops_of(tallies, top), "column")
    return out.join(exact, "column", "left").withColumns({
        "unique_values": F.coalesce("unique_values", F.lit(0)), "top_values": F.coalesce("top_values", F.array().cast("array<string>")),
    })
