"""Profiles and run monitoring over unbounded input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from seriesloom.operators.frames import named_rows


def partial_profile(batch: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, rows, missing, mean, m2, lowest, highest``: m2 is the sum of squared distances from the batch's own mean."""
    return named_rows(batch, "column", {c: {
        "rows": F.count("*"), "missing": F.count_if(F.col(c).isNull()),
        "mean": F.avg(F.col(c).cast("double")), "m2": F.var_pop(F.col(c).cast("double")) * F.count(c),
        "lowest": F.min(F.col(c).cast("double")), "highest": F.max(F.col(c).cast("double")),
    } for c in columns})


def stream_batch_profile(stream: DataFrame, columns: Sequence[str], path: str, checkpoint: str) -> StreamingQuery:
    """Write one partial profile per micro-batch below ``path``.

    The batch number is the partition, overwritten on a retry, so a batch run twice counts once.
    """
    def keep(batch: DataFrame, number: int) -> None:
        partial_profile(batch, columns).withColumn("batch", F.lit(number)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reconcile_profile(spark: SparkSession, path: str) -> DataFrame:
    """``column, rows, missing, mean, std, lowest, highest`` over all batches written so far."""
    return merged_profile(spark.read.parquet(path))


def merged_profile(parts: DataFrame) -> DataFrame:
    """Partial profiles, one row per column and batch, merged to one row per column."""
    n = F.col("rows") - F.col("missing")
    # distances from a value near the means keep the merge exact for large values; one row per column
    near = parts.groupBy("column").agg(F.min("mean").alias("_near"))
    shifted = parts.join(near, "column").withColumn("_gap", F.col("mean") - F.col("_near"))
    sums = shifted.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.sum("m2").alias("_within"), F.any_value("_near").alias("_near"),
        F.try_divide(F.sum(n * F.col("_gap")), F.sum(n)).alias("_gap"), F.try_divide(F.sum(n * F.col("_gap") ** 2), F.sum(n)).alias("_gap2"),
        F.min("lowest").alias("lowest"), F.max("highest").alias("highest"),
    )
    between = F.greatest(F.col("_gap2") - F.col("_gap") ** 2, F.lit(0.0))
    return sums.select(
        "column", "rows", "missing", (F.col("_near") + F.col("_gap")).alias("mean"), F.sqrt(F.try_divide("_within", n) + between).alias("std"), "lowest", "highest",
    )


def hourly_monitor(events: DataFrame, ts: str, kind: str, value: str, late: str = "1 hour") -> DataFrame:
    """``window_start, kind, events, mean_value, drift_score`` per hour and kind; works on streams and tables.

    Event time needs a zoned timestamp, so it is cast (the session runs in UTC). Rows later than ``late`` are dropped by a stream.
    """
    from seriesloom.operators.runs import drift_from_mape

    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("_ts", late)
    counts = timed.groupBy(F.window("_ts", "1 hour"), F.col(kind).alias("kind")).agg(
        F.count("*").alias("events"), F.avg(value).alias("mean_value")
    )
    return counts.select(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"), "kind", "events", "mean_value",
        drift_from_mape(F.col("mean_value")).alias("drift_score"),
    )


def stream_run_monitor(stream: DataFrame, ts: str, kind: str, value: str, path: str, checkpoint: str) -> StreamingQuery:
    """Closed hours appended to a Parquet table."""
    return hourly_monitor(stream, ts, kind, value).writeStream.outputMode("append").format("parquet").option(
        "path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
