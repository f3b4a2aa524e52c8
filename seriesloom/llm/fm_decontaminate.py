"""Benchmark decontamination: an FM-index per training shard, searched for the benchmark's word windows.

A shard is an Arrow batch of documents (64 MB or 10,000 rows by Spark's defaults). Words outside the benchmark's vocabulary end a
run; runs shorter than the shortest phrase cannot hold one and stay out of the index. Every phrase is found by backward search,
its places by walking to sampled suffix positions, and the places are merged into spans of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from seriesloom.llm.fm_index import FMIndex
from seriesloom.llm.shared import free_name, in_arrow

#: ASCII capitals become small; other ASCII signs than digits and letters become spaces; all bytes of other characters stay.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)]), False)
FOUND = T.StructType([
    T.StructField("n_words", T.LongType(), False),
    T.StructField("n_hit", T.LongType(), False),
    T.StructField("spans", SPANS, False),
    T.StructField("items", T.ArrayType(T.StringType(), False), False),
])


def folded_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Phrases:
    """Distinct windows of the items' words, numbered by a vocabulary of their own, with the items that hold each window."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in folded_words(text)]
            for i in range(max(1, len(numbers) - window + 1) if numbers else 0):
                windows.setdefault(tuple(numbers[i : i + window]), set()).update([] if item_id is None else [item_id])
        self.items = [sorted(x) for x in windows.values()]
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.shortest = int(self.lengths.min(initial=window))
        self.matrix = np.zeros((len(windows), window), np.int32)
        for row, w in zip(self.matrix, windows):
            row[window - len(w) :] = w


def search_shard(texts: Iterator[str | None], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word offsets of the documents, and (start word, phrase) of every occurrence in the shard."""
    get, parts, sizes = phrases.vocabulary.get, [], []
    for text in texts:
        words = folded_words(text)
        parts.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
        parts.append(np.zeros(1, np.int32))  # keeps runs within a document
        sizes.append(len(words))
    offsets = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64) + 1)))
    nothing = np.empty(0, np.int64)
    if not parts or not len(phrases.lengths):
        return offsets, nothing, nothing
    numbers = np.concatenate(parts)
    known = np.flatnonzero(np.diff(np.concatenate(([False], numbers > 0, [False])).astype(np.int8))).reshape(-1, 2)
    known = known[known[:, 1] - known[:, 0] >= phrases.shortest]
    if not len(known):
        return offsets, nothing, nothing
    lengths = known[:, 1] - known[:, 0] + 1  # each run and the 0 that ends it
    into = np.concatenate(([0], np.cumsum(lengths)))
    places = np.arange(into[-1]) + np.repeat(known[:, 0] - into[:-1], lengths)
    index = FMIndex(numbers[places] + 1)
    low, high = index.search(phrases.matrix + 1, phrases.lengths)
    counts = high - low
    which = np.repeat(np.arange(len(counts)), counts)
    rows = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
    return offsets, places[index.locate(rows)], which


def _merged(offsets: np.ndarray, starts: np.ndarray, which: np.ndarray, phrases: Phrases, before: list[dict | None]) -> list[dict]:
    """What was found in each document, together with what an earlier part of the benchmark found."""
    marks = np.zeros(int(offsets[-1]) + 1, np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + phrases.lengths[which], -1)
    for i, old in enumerate(before):
        for span in (old or {}).get("spans", ()):
            marks[offsets[i] + span["start"]] += 1
            marks[offsets[i] + span["end"]] -= 1
    edges = np.flatnonzero(np.diff(np.concatenate(([False], np.cumsum(marks) > 0)).astype(np.int8)))
    spans = edges.reshape(-1, 2)
    owner = np.searchsorted(offsets, spans[:, 0], "right") - 1
    found = [{"n_words": int(b - a - 1), "n_hit": 0, "spans": [], "items": list((old or {}).get("items", ()))} for a, b, old in zip(offsets[:-1], offsets[1:], before)]
    for doc, (a, b) in zip(owner.tolist(), spans.tolist()):
        found[doc]["spans"].append({"start": a - int(offsets[doc]), "end": b - int(offsets[doc])})
        found[doc]["n_hit"] += b - a
    if len(starts):
        pairs = np.unique(np.stack((np.searchsorted(offsets, starts, "right") - 1, which)), axis=1)
        for doc, phrase in pairs.T.tolist():
            found[doc]["items"].extend(phrases.items[phrase])
    for one in found:
        one["items"] = sorted(set(one["items"]))
    return found


def with_benchmark_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", name: str = "found", window: int = 13, part_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` with a struct ``name`` (a column of that name is replaced): n_words, n_hit, merged word spans [start, end) and the sorted ids of the items found.

    Item texts travel to the executors in parts of about ``part_bytes``; a larger benchmark is searched part by part over the same
    rows, so no broadcast outgrows that bound and nothing is left out. Items without words are no phrase. An item of fewer than
    ``window`` words is one phrase. A null item_id marks words and names no item; repeated items count once. A null text has no
    words. An empty benchmark finds nothing, an empty table stays empty.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).head().n or 0
    parts = -(-size // part_bytes) or 1
    for part in range(parts):
        mine = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part) if parts > 1 else items
        shared = docs.sparkSession.sparkContext.broadcast(Phrases([tuple(r) for r in mine.collect()], window))
        docs = _searched(docs, shared, text, name, part > 0)
    return docs


def _searched(docs: DataFrame, shared, text: str, name: str, again: bool) -> DataFrame:
    columns = [c for c in docs.columns if c.lower() != name.lower()]
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField(name, FOUND, False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, kind = shared.value, None
        for batch in batches:
            column = batch.column(text)
            before = batch.column(name).to_pylist() if again else [None] * len(column)
            found = _merged(*search_shard((column[i].as_py() for i in range(len(column))), phrases), phrases, before)
            kind = kind or pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(found, kind)], [*columns, name])

    return in_arrow(docs, run, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 13, share: int = 20) -> DataFrame:
    """``docs`` without the rows whose words are hit to one in ``share`` or more; all other rows stay as they were."""
    name = free_name(docs, "found")
    found = with_benchmark_spans(docs, benchmark, text, name=name, window=window)
    bad = (F.col(f"{name}.n_hit") > 0) & (share * F.col(f"{name}.n_hit") >= F.col(f"{name}.n_words"))
    return found.where(~bad).drop(name)
