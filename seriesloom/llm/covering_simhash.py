"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

A covering family for radius r gives every bit position a non-zero vector of r + 1 bits. Table v (v = 1 ... 2^(r+1) - 1) keeps the
positions whose vector has an odd inner product with v. Up to r differing positions span at most r dimensions, so some v is
orthogonal to all of them and its table keeps none of the differing bits: every pair within the radius meets in some table, with
certainty rather than with high probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from seriesloom.llm.components import components
from seriesloom.llm.shared import free_name, in_arrow, keyed, stored

BITS = 64


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """Masks of the 2^(radius+1) - 1 tables; vectors are dealt to the positions in turn, so that tables keep about as many bits."""
    size = (1 << (radius + 1)) - 1
    vectors = [i % size + 1 for i in range(bits)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, size + 1)]


def simhash(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Majority of the XXH64 bits of all word shingles, repeats included; a bit at exactly half is 0; no words give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(b" ".join(words), seed)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    votes, total = np.zeros(BITS, np.int64), len(starts)
    for k in range(0, total, 65_536):  # a very long text takes several rounds
        hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts[k : k + 65_536], ends[k : k + 65_536])], np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > total, bitorder="little").view(np.uint64)[0])


def with_fingerprint(df: DataFrame, text: str, name: str, width: int = 3, seed: int = 42) -> DataFrame:
    """The table without its text, with the 64-bit fingerprint (as a signed long) instead."""
    rest = [c for c in df.columns if c not in (text, name)]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(name, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text)
            prints = np.fromiter((simhash(column[i].as_py(), width, seed) for i in range(len(column))), np.uint64, len(column))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(prints.view(np.int64))], [*rest, name])

    return in_arrow(df, run, schema)


def near_links(prints: DataFrame, radius: int = 2, pairs_below: int = 48) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` of at most ``radius`` differing bits (radius 1 or 2).

    ``prints`` holds each fingerprint once. Buckets of up to ``pairs_below`` members compare their pairs, which bounds the pairs of a
    bucket. Larger buckets are resolved exactly without pairs: each member stands at itself and at all its neighbours at one free
    bit; members within two bits of each other share such a point, and all that share a point are within two bits, so linking each
    to the smallest at its point loses no connection. Points are spread by their value, never by the bucket.
    """
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    masks = covering_masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(signed)])
    members = prints.select("fp", F.inline(tables))
    sizes = members.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(members.join(sizes, ["t", "key"]), "buckets")
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    few = members.where(F.col("n") <= pairs_below).select("t", "key", "fp")
    pairs = few.select("t", "key", F.col("fp").alias("a")).join(few.select("t", "key", F.col("fp").alias("b")), ["t", "key"])
    pairs = pairs.where(F.col("a") < F.col("b")).where(distance <= radius).select("a", "b")
    free = [[1 << i for i in range(BITS) if not m >> i & 1] for m in masks]
    flips = F.array(*[F.array(F.lit(0), *[F.lit(x - (1 << 64) if x >> 63 else x).cast("long") for x in bits]) for bits in free])
    points = members.where(F.col("n") > pairs_below).select("fp", F.explode(F.element_at(flips, F.col("t") + 1)).alias("flip"))
    points = points.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point")).distinct()
    around = points.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = points.join(around, "point").select("a", F.col("fp").alias("b")).where("a != b")
    if radius == 1:
        stars = stars.where(distance <= 1)
    return pairs.unionByName(stars).distinct()


def named(prints: DataFrame, first: str, radius: int) -> DataFrame:
    """(fp, name) for every distinct fingerprint; the name is the smallest value of ``first`` in the fingerprint's component."""
    distinct = stored(prints.groupBy("fp").agg(F.min(first).alias("first")), "distinct")
    linked = components(near_links(distinct.select("fp"), radius))
    roots = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("first").alias("name"))
    return roots.join(least, "root").select("fp", "name")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) per row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links of at most ``radius`` bits, the row's own included. Exact copies are
    reduced to one fingerprint by a pre-aggregated count before any search, so a group of copies costs what one document does.
    Null and empty texts have fingerprint 0 and link like any other. Repeated rows are kept. A null doc_id takes part in links and
    never names a component unless all ids of its component are null. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = stored(with_fingerprint(rows, "text", "fp", width, seed), "fingerprints")
    names = named(prints, "doc_id", radius).withColumnRenamed("name", "component_id")
    return prints.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """One row of ``docs`` for each group of near copies: that with the smallest doc_id (null last), of repeated ids any one.

    Texts move in one join, against the keys of the rows to drop; its plan is the same at every size. All columns come back as they
    were. Rows without words form one group. An empty table stays empty.
    """
    key = free_name(docs, "row_key")
    rows = keyed(docs, key)
    short = rows.select(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(key).alias("key")).alias("first"), F.col(text).alias("text"))
    prints = stored(with_fingerprint(short, "text", "fp", width, seed), "fingerprints")
    names = named(prints, "first", radius)
    dropped = prints.join(names, "fp").where(F.col("first.key") != F.col("name.key")).select(F.col("first.key").alias(key))
    return rows.join(stored(dropped, "dropped").hint("merge"), key, "left_anti").drop(key)
