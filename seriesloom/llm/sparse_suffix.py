"""Repeated passages by a sparse suffix array over words.

Suffixes are kept only where the hash of ``seed_words`` words is the least among all that a window of ``min_words`` words holds. The
choice depends on content alone, so every window of ``min_words`` words has exactly one such anchor and equal windows have it at
the same place. A kept suffix carries a digest of everything its windows see (at most min_words - seed_words words to the left and
min_words to the right) and a digest per window. The suffixes are range-partitioned and sorted by (seed, surroundings, document,
position): neighbours with one seed agree on seed_words words, neighbours with one digest agree as far as any of their windows
reaches. Neighbours that share a seed and differ in their surroundings are not extended word by word: a second shuffle groups
them by the digests of the windows to their left and right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from seriesloom.llm.shared import free_name, in_arrow, stored, with_word_count

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that powers never vanish
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_SUFFIX = "seed long, around long, doc_id long, row long, anchor int, first int, windows array<long>"
_EVENT = "doc_id long, row long, start int, end int, own boolean, repeated boolean, seed long, window long"


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits spread over the whole number (finaliser of a well-known 64-bit hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word (run of characters other than blanks), as it stands."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _powers(n: int) -> np.ndarray:
    powers = np.full(n, _BASE, np.uint64)
    powers[:1] = 1
    return np.cumprod(powers, dtype=np.uint64)


def run_hashes(hashes: np.ndarray, width: int, powers: np.ndarray) -> np.ndarray:
    """Hash of every run of ``width`` words: a polynomial that starts anew in each run, then mixed."""
    out = np.zeros(len(hashes) - width + 1, np.uint64)
    done, block, size = 0, hashes, 1  # block: polynomial of runs of ``size`` words, by doubling
    while True:
        if width & size:
            out += block[done : done + len(out)] * powers[done]
            done += size
        if done == width:
            return _mixed(out)
        block = block[: len(block) - size] + block[size:] * powers[size]
        size *= 2


def anchors(seeds: np.ndarray, span: int) -> np.ndarray:
    """For every window of ``span`` seeds the place of its least seed, the leftmost of equals."""
    n = len(seeds) - span + 1
    best, at, size = seeds, np.arange(len(seeds)), 1
    while size < span:  # minimum of doubled and then overlapping halves
        step = min(size, span - size)
        left, right = best[: len(best) - step], best[step:]
        take = right < left
        best, at = np.where(take, right, left), np.where(take, at[step:], at[: len(at) - step])
        size += step
    return at[:n]


def _suffixes(texts: Iterator[tuple[int | None, int, str | None]], min_words: int, seed_words: int) -> Iterator[list[np.ndarray]]:
    powers = _powers(2 * min_words)
    for doc_id, row, text in texts:
        hashes = word_hashes(text)
        if len(hashes) < min_words:
            continue
        seeds = run_hashes(hashes, seed_words, powers)
        at = anchors(seeds, min_words - seed_words + 1)
        windows = run_hashes(hashes, min_words, powers)
        cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))  # windows of one anchor stand together
        mine, counts = at[cut], np.diff(np.append(cut, len(at)))
        # the surroundings: all windows' digests together with the place of the anchor in the first of them
        place = (np.arange(len(windows)) - np.repeat(cut, counts)).astype(np.uint64)
        around = np.add.reduceat(_mixed(windows + place * _BASE), cut) + _mixed((mine - cut).astype(np.uint64))
        yield [doc_id, row, seeds[mine].view(np.int64), _mixed(around).view(np.int64), mine, cut, counts, windows.view(np.int64)]


def _sorted_suffixes(rows: DataFrame, min_words: int, seed_words: int) -> DataFrame:
    """Rows of _SUFFIX for a table (doc_id, row, text), in suffix order over range partitions."""

    def batch_of(held: list[list]) -> pa.RecordBatch:
        sizes = [len(x[4]) for x in held]
        ids = pa.array([x[0] for x in held], pa.int64()).take(pa.array(np.repeat(np.arange(len(held)), sizes)))
        starts = np.concatenate(([0], np.cumsum(np.concatenate([x[6] for x in held])))).astype(np.int32)
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([x[2] for x in held])), pa.array(np.concatenate([x[3] for x in held])), ids,
            pa.array(np.repeat(np.array([x[1] for x in held], np.int64), sizes)),
            pa.array(np.concatenate([x[4] for x in held]).astype(np.int32)), pa.array(np.concatenate([x[5] for x in held]).astype(np.int32)),
            pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate([x[7] for x in held]))),
        ], [f.split()[0] for f in _SUFFIX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids, numbers, texts = batch.columns
            for x in _suffixes(((ids[i].as_py(), numbers[i].as_py(), texts[i].as_py()) for i in range(len(batch))), min_words, seed_words):
                held.append(x)
                size += len(x[7])
                if size >= 500_000:
                    yield batch_of(held)
                    held, size = [], 0
        if held:
            yield batch_of(held)

    order = ["seed", "around", "doc_id", "row", "anchor"]
    return in_arrow(rows, run, _SUFFIX).repartitionByRange(*order).sortWithinPartitions(*order)


def _compared(suffixes: DataFrame, min_words: int) -> DataFrame:
    """Neighbours of the sorted suffixes, compared: rows of _EVENT.

    Spans (``own`` true) are settled: all windows of the suffix stand in an earlier row of the same surroundings, or, for the first
    such row, in a later one. Windows (``own`` false) are open: their seed occurs in other surroundings, or begins or ends the
    partition and may go on in the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the last seed, which may go on in the next batch
        first = True
        for batch in batches:
            seeds = batch.column(0).to_numpy()
            if not len(seeds):
                continue
            cut = int(np.searchsorted(seeds, seeds[-1]))
            if cut:
                yield from settle(pa.Table.from_batches([*held, batch.slice(0, cut)]), first, False)
                held, first = [batch.slice(cut)], False
            elif held and held[-1].column(0)[0].as_py() != seeds[0]:
                yield from settle(pa.Table.from_batches(held), first, False)
                held, first = [batch], False
            else:
                held.append(batch)
                if sum(len(x) for x in held) > 200_000:  # a very common seed: its rows are open anyway
                    yield from settle(pa.Table.from_batches(held), True, True)
                    held, first = [], True
        if held:
            yield from settle(pa.Table.from_batches(held), first, True)

    def settle(table: pa.Table, starts: bool, ends: bool) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        seed, around, row, anchor, first = (table.column(k).to_numpy() for k in ("seed", "around", "row", "anchor", "first"))
        new_seed = np.concatenate(([True], seed[1:] != seed[:-1]))
        new = new_seed | np.concatenate(([True], around[1:] != around[:-1]))
        # an identical row of a repeated input row is the same place again, not a copy
        same = np.concatenate(([False], (row[1:] == row[:-1]) & (anchor[1:] == anchor[:-1]) & ~new[1:]))
        run_of = np.cumsum(new) - 1
        places = np.bincount(run_of, ~same)
        run_sizes, head = places[run_of], np.flatnonzero(new)
        seed_of = np.cumsum(new_seed) - 1
        kinds = np.bincount(seed_of, new)[seed_of]
        opened = kinds > 1
        if starts:
            opened |= seed == seed[0]
        if ends:
            opened |= seed == seed[-1]
        lists = table.column("windows").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        at = lists.offsets.to_numpy().astype(np.int64)
        counts = np.diff(at)
        ends_at = first + counts + min_words - 1
        leads = (row == row[head][run_of]) & (anchor == anchor[head][run_of])
        settled = np.flatnonzero((run_sizes > 1) & ~(leads & opened))
        ids = table.column("doc_id")
        if len(settled):
            none = pa.nulls(len(settled), pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(settled)).combine_chunks(), pa.array(row[settled]), pa.array(first[settled]), pa.array(ends_at[settled].astype(np.int32)), pa.array(np.full(len(settled), True)), pa.array(~leads[settled]), none, none], _names(_EVENT))
        values = lists.values.to_numpy()
        todo = np.flatnonzero(opened & leads & ~same)  # later rows of a run are settled whole
        for k in range(0, len(todo), 4096):
            these = todo[k : k + 4096]
            n = counts[these]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = np.repeat(first[these], n) + inner
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(np.repeat(these, n))).combine_chunks(), pa.array(np.repeat(row[these], n)), pa.array(start.astype(np.int32)), pa.array((start + min_words).astype(np.int32)),
                pa.array(np.full(len(start), False)), pa.array(np.repeat(run_sizes[these] > 1, n)), pa.array(np.repeat(seed[these], n)), pa.array(values[np.repeat(at[these], n) + inner]),
            ], _names(_EVENT))

    return in_arrow(suffixes, run, _EVENT)


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _union(spans) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def repeated_spans(rows: DataFrame, min_words: int = 50, seed_words: int = 8) -> DataFrame:
    """(doc_id, row, repeated, removable) for the rows of a table (doc_id long, row long, text) that hold a repeated passage.

    ``repeated``: word spans [start, end) covered by a window of ``min_words`` words that occurs at two places or more.
    ``removable``: those covered by a window that occurs at an earlier place too, in the order of (doc_id, row, position), so the
    first occurrence of every passage stays. ``row`` tells rows apart; equal rows of the table count as one place. A null doc_id
    comes first, as Spark sorts. Texts of fewer than ``min_words`` words, null and empty ones have no windows.
    """
    events = stored(_compared(_sorted_suffixes(rows, min_words, seed_words), min_words), "suffixes")
    place = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "row", "start")
    windows = events.where(~F.col("own"))
    # one row per place; ``repeated`` there says that the suffix has identical copies, which are settled
    first = windows.groupBy("seed", "window").agg(F.min(place).alias("head"), F.count("*").alias("n"), F.max("repeated").alias("copies"))
    first = first.where("n > 1 OR copies").select("seed", "window", "head")
    shared = windows.join(first, ["seed", "window"]).select("doc_id", "row", "start", "end", (F.col("head") < place).alias("later"))
    spans = events.where("own").select("doc_id", "row", "start", "end", F.col("repeated").alias("later")).unionByName(shared)
    return stored(_merged_spans(spans), "spans")


def _merged_spans(spans: DataFrame) -> DataFrame:
    """Union of the spans of each row, pre-merged where they are made."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("row", T.LongType()), T.StructField("repeated", SPANS), T.StructField("removable", SPANS)])
    pair = F.struct("start", "end")
    grouped = spans.groupBy("doc_id", "row").agg(F.collect_set(pair).alias("all"), F.collect_set(F.when(F.col("later"), pair)).alias("later"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, every, later = batch.columns
            both = [[_union((s["start"], s["end"]) for s in x) for x in c.to_pylist()] for c in (every, later)]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([ids, rows, pa.array(both[0], kind), pa.array(both[1], kind)], schema.names)

    return in_arrow(grouped, run, schema)


def _numbered(docs: DataFrame, doc_id: str, text: str):
    """Number of a row: equal for equal (doc_id, text)."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def _joined(rows: DataFrame, spans: DataFrame, doc_id: str, row: str) -> DataFrame:
    spans = spans.withColumnsRenamed({"doc_id": "_span_id", "row": "_span_row"}).hint("merge")  # the same plan at every size
    on = (rows[row] == spans["_span_row"]) & rows[doc_id].eqNullSafe(spans["_span_id"])
    return rows.join(spans, on, "left").drop(spans["_span_id"], spans["_span_row"])


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50, seed_words: int = 8) -> DataFrame:
    """(doc_id, n_words, n_repeated, n_removable, repeated, removable) for every row of ``docs``; see repeated_spans."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _numbered(docs, doc_id, text).alias("row"), F.col(text).alias("text"))
    spans = repeated_spans(rows, min_words, seed_words)
    none = F.array().cast(SPANS)
    counted = _joined(with_word_count(rows, "text", "n_words"), spans, "doc_id", "row")
    counted = counted.withColumns({c: F.coalesce(c, none) for c in ("repeated", "removable")})
    size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return counted.select("doc_id", "n_words", size("repeated").alias("n_repeated"), size("removable").alias("n_removable"), "repeated", "removable")


def cut_words(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans; what remains keeps its own blanks."""
    if not text or not spans:
        return text
    raw, out, last = text.encode("utf-8", "surrogatepass"), [], 0
    data = np.frombuffer(raw, np.uint8)
    gap = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    starts = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    for a, b in spans:
        out.append(raw[last : starts[a]])
        last = int(starts[b]) if b < len(starts) else len(raw)
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50, seed_words: int = 8) -> DataFrame:
    """``docs`` with the removable words cut out of their texts; documents of which nothing stays are left out.

    All columns come back; only ``text`` changes, and only in documents that repeat a passage. Null and empty texts stay.
    """
    row, spans = free_name(docs, "row"), free_name(docs, "removable")
    numbered = docs.withColumn(row, _numbered(docs, doc_id, text))
    found = repeated_spans(numbered.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(row).alias("row"), F.col(text).alias("text")), min_words, seed_words)
    found = found.where(F.size("removable") > 0).select("doc_id", "row", F.col("removable").alias(spans))
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cuts = batch.column(text), batch.column(spans)
            new, keep = texts.to_pylist(), np.ones(len(batch), bool)
            for i in np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False)).tolist():
                new[i] = cut_words(new[i], [(s["start"], s["end"]) for s in cuts[i].as_py()])
                keep[i] = bool(new[i].split())
            columns = [pa.array(new, texts.type) if c == text else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    return in_arrow(_joined(numbered, found, doc_id, row).drop(row), run, schema)
