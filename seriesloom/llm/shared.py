"""What the text operators share: intermediate tables, free column names and byte-wise views of Arrow text."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

import seriesloom
from seriesloom.session import shared_dir

_shipped: set[str] = set()

#: Bytes that separate words: space and tab to carriage return.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])

#: Narrow rows that are worth a task and a file of their own.
ROWS_A_TASK = 16_384


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package, as --py-files does, once per application."""
    context, root = spark.sparkContext, Path(seriesloom.__file__).parent
    if context.applicationId in _shipped or not root.is_dir():
        return
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="seriesloom-")), "seriesloom-code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def in_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow whose workers can import this package."""
    ship_code(df.sparkSession)
    return df.mapInArrow(function, schema)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the folder that all executors share and read it again.

    Cuts lineage so that lost executors never cost a second run of what lies before, and gives the planner a file size to decide
    joins by.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def few(df: DataFrame, rows: int) -> DataFrame:
    """The table, which has ``rows`` narrow rows at most, in no more partitions than these need; never in fewer than there are cores.

    What a shuffle deals out is gathered again as Spark does where it may coalesce partitions by itself; large tables stay as they are.
    """
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))
    return df.coalesce(parts) if parts < int(spark.conf.get("spark.sql.shuffle.partitions")) else df


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the table does not use, whatever the case of its letters."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keyed(df: DataFrame, name: str) -> DataFrame:
    """The table with a key of its own for every row: a hash of all columns. Decisions are made on narrow tables of keys and joined back.

    Only if the table holds equal hashes, the rows are numbered by partition and position as well, and written with their numbers, so that
    these stay the same; no window ever gathers equal rows.
    """
    hashed = df.withColumn(name, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    if hashed.groupBy(name).count().where("count > 1").isEmpty():
        return hashed
    return stored(hashed.withColumn(name, F.xxhash64(name, F.monotonically_increasing_id())), "keyed")


def with_fields(df: DataFrame, *fields: T.StructField) -> T.StructType:
    """Schema of the table with further fields."""
    return T.StructType([*df.schema.fields, *fields])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column in a row, and the offsets of each text; null counts as empty."""
    column = pc.fill_null(column.cast(pa.string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.empty(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def row_slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes of text each; a longer text has a range of its own."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def word_counts(column: pa.Array) -> np.ndarray:
    """Words (runs of bytes other than BLANKS) of each text; null has none."""
    counts = np.zeros(len(column), np.int64)
    blank = np.zeros(256, bool)
    blank[list(BLANKS)] = True
    for a, b in row_slices(column, 8 << 20):
        raw, at = text_bytes(column.slice(a, b - a))
        gap = blank[raw]
        first = np.empty(len(raw), bool)
        first[:1], first[1:] = True, gap[:-1]
        first[at[:-1][at[:-1] < len(raw)]] = True
        total = np.concatenate(([0], np.cumsum(first & ~gap)))
        counts[a:b] = total[at[1:]] - total[at[:-1]]
    return counts


def with_word_count(df: DataFrame, text: str, name: str) -> DataFrame:
    """The table without its text, with the text's number of words instead."""
    rest = [c for c in df.columns if c not in (text, name)]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(name, T.LongType(), False)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(word_counts(batch.column(text)), pa.int64())], [*rest, name])

    return in_arrow(df, count, schema)
