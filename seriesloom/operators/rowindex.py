"""Row positions and windows that never put a whole series into one task.

``Window.partitionBy(key).orderBy(ts)`` sends a key to one task, and a window without keys sends everything there.
Here the rows are range partitioned by (keys, order), numbered inside their partition, and shifted by the row counts of
the partitions before. Windows then run over blocks of consecutive positions; each block also gets copies of the last
rows of the block before, as many as the widest window reaches back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from seriesloom.operators.frames import attach
from seriesloom.session import cut_lineage

BLOCK_ROWS = 1 << 17


def with_row_index(df: DataFrame, order_by: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Add ``idx`` (position within the key, from 0) and ``n`` (rows of the key).

    ``order_by`` must end in something unique per key, or equal rows get positions by a hash of the row, which also spreads them over
    partitions. The sorted rows are checkpointed, so a lost executor cannot renumber them.
    """
    sort = [*keys, *order_by, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]
    placed = cut_lineage(
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    counts = placed.groupBy(*keys, "_part").agg(F.min("_seq").alias("_first"), F.count("*").alias("_rows"))
    # One row per key and partition holding it: the windows below see at most as many rows per key as there are partitions.
    same_key = Window.partitionBy(*(keys or [F.lit(0)]))
    earlier = same_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_part", "_first",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(same_key).alias("n"),
    )
    # Kept as well, so that nothing is counted twice; the planner joins them by their size.
    offsets = cut_lineage(offsets)
    joined = attach(placed, offsets, [*keys, "_part"], "inner")
    return joined.withColumn("idx", F.col("_seq") - F.col("_first") + F.col("_before")).drop(
        "_part", "_seq", "_first", "_before"
    )


def in_blocks(indexed: DataFrame, reach: int, block_rows: int | None = None) -> DataFrame:
    """Add ``_block`` and ``_own``; the last ``reach`` rows of a block appear again in the next one with ``_own`` false."""
    size = block_rows or BLOCK_ROWS
    if reach > size:
        raise ValueError("a window must not reach back further than one block")
    block = F.floor(F.col("idx") / size).cast("long")
    homes = F.when(F.col("idx") % size >= size - reach, F.array(block, block + 1)).otherwise(F.array(block))
    return indexed.withColumn("_block", F.explode(homes)).withColumn("_own", F.col("_block") == block)


def block_window(keys: Sequence[str] = ()) -> WindowSpec:
    return Window.partitionBy(*keys, "_block").orderBy("idx")


def block_columns(
    indexed: DataFrame, keys: Sequence[str], reach: int, columns: dict[str, Column], block_rows: int | None = None
) -> DataFrame:
    """Evaluate window expressions written over ``block_window(keys)`` and return the original rows with them."""
    out = in_blocks(indexed, reach, block_rows).withColumns(columns)
    return out.where("_own").drop("_block", "_own")


def last_rows(width: Column, keys: Sequence[str] = ()) -> WindowSpec:
    """The last ``width`` rows up to the current one, where ``width`` (at most 1,000) may differ by key.

    A frame needs literal bounds, so positions are stretched by 1/width and the frame spans just under one unit.
    """
    unit = 1_000_000
    return (
        Window.partitionBy(*keys, "_block")
        .orderBy(F.floor(F.col("idx") * unit / width).cast("long"))
        .rangeBetween(-(unit - 500), 0)
    )
