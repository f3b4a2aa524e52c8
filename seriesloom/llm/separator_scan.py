"""Token counts from flat token files: a vectorised scan for the end-of-document number, stitched across blocks by a prefix scan.

A token file is nothing but numbers of two or four bytes, each document ended by one number; it has no index. The scan reads blocks
of a file independently, finds the end numbers of a block at once, and joins documents that cross blocks by prefix sums over
the blocks: the number of documents before a block, and where the last document before it ended.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from seriesloom.llm.shared import in_arrow, row_slices, stored
from seriesloom.session import shared_dir

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: The first number that the vocabulary leaves free ends a document.
END_OF_DOCUMENT = 50_256
_WRITTEN = "file string, ordinal long, doc_id long, bytes long"


def encoding(ranks: bytes) -> tiktoken.Encoding:
    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})


def write_token_files(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end: int = END_OF_DOCUMENT, dtype: str = "<u2") -> DataFrame:
    """Write the tokens of whole texts to flat files in the shared folder, one file per task, and give (file, ordinal, doc_id, bytes).

    ``ordinal`` numbers the documents of a file; ``bytes`` is the file's length so far at the
    end of each batch, else null. A task writes under a name of its own
    attempt and the result names the file of the attempt that Spark took, so a lost or doubled task leaves at most an unused file. Special names inside a
    text are ordinary text. Null and empty texts are documents of no tokens.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encode = TaskContext.get(), encoding(ranks.value).encode_ordinary
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path)
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        ordinal, size = 0, 0
        with store.open_output_stream(f"{path}/{name}") as out:
            for batch in batches:
                ids, texts = batch.columns
                for a, b in row_slices(texts, 1 << 20):
                    parts = []
                    for x in texts.slice(a, b - a).to_pylist():
                        parts += [np.array(encode(x), dtype) if x else np.empty(0, dtype), np.array([end], dtype)]
                    block = np.concatenate(parts).tobytes()
                    out.write(block)
                    size += len(block)
                n = len(batch)
                lengths = pa.array([None] * (n - 1) + [size], pa.int64()) if n else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"] * n, pa.string()), pa.array(np.arange(ordinal, ordinal + n)), ids, lengths], ["file", "ordinal", "doc_id", "bytes"])
                ordinal += n

    return stored(in_arrow(rows, run, _WRITTEN), "ordinals")


def file_blocks(spark: SparkSession, files: DataFrame, block_bytes: int) -> DataFrame:
    """(file, block, offset, length): files of a table (file, bytes) cut into blocks, spread over the tasks."""
    rows = files.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / block_bytes))).alias("block"))
    return rows.select("file", "block", (F.col("block") * block_bytes).alias("offset"), F.least(F.col("bytes") - F.col("block") * block_bytes, F.lit(block_bytes)).alias("length"))


def scan(files: DataFrame, end: int = END_OF_DOCUMENT, dtype: str = "<u2", block_bytes: int = 1 << 20) -> DataFrame:
    """(file, ordinal, start, n_tokens) for every document of the flat files in a table (file, bytes).

    ``start`` is the place of the document's first token. Tokens behind the last end number of a file are a last, unended document. An
    end number at once behind another is a document of no tokens. Empty files have no documents. ``block_bytes`` must be a multiple
    of the numbers' width.
    """
    width = np.dtype(dtype).itemsize
    blocks = file_blocks(files.sparkSession, files.where("bytes > 0"), block_bytes).repartition("file", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(x["file"])
                with store.open_input_file(path) as source:
                    numbers = np.frombuffer(source.read_at(x["length"], x["offset"]), dtype)
                found.append(np.flatnonzero(numbers == end) + x["offset"] // width)
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
            ends = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*found, np.empty(0, np.int64)]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), ends], ["file", "block", "ends"])

    scanned = stored(in_arrow(blocks, run, "file string, block long, ends array<long>"), "ends")
    # prefix scan over the blocks of a file: one narrow row per block
    marks = scanned.select("file", "block", F.size("ends").cast("long").alias("n"), F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1).alias("last"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    marks = marks.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ordinal"), F.coalesce(F.last("last", ignorenulls=True).over(before), F.lit(-1)).alias("behind"))
    ends = scanned.join(marks, ["file", "block"]).select("file", "ordinal", "behind", "ends", F.posexplode("ends").alias("i", "at"))
    start = F.when(F.col("i") == 0, F.col("behind")).otherwise(F.try_element_at("ends", F.col("i"))) + 1
    ended = ends.select("file", (F.col("ordinal") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("at") - start).alias("n_tokens"))
    sums = scanned.groupBy("file").agg(F.sum(F.size("ends")).alias("ordinal"), F.coalesce(F.max(F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1)), F.lit(-1)).alias("last"))
    tail = files.join(sums, "file").select("file", "ordinal", (F.col("last") + 1).alias("start"), (F.floor(F.col("bytes") / width) - F.col("last") - 1).alias("n_tokens")).where("n_tokens > 0")
    return ended.unionByName(tail)


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, file, ordinal, start, n_tokens) for every row of ``docs``, by writing flat token files and scanning them.

    Null and empty texts have no tokens. Repeated rows and null ids are documents like any other. An empty table gives no rows.
    """
    written = write_token_files(docs, doc_id, text)
    files = stored(written.groupBy("file").agg(F.max("bytes").alias("bytes")), "files")
    return written.select("file", "ordinal", "doc_id").join(scan(files, block_bytes=block_bytes), ["file", "ordinal"]).select("doc_id", F.element_at(F.split("file", "/"), -1).alias("file"), "ordinal", "start", "n_tokens")
