"""Near copies by the Jaccard similarity of their word shingles: bands of minimum hashes find pairs, the shingles of both texts decide.

A pair of similarity s agrees in all rows of a band with s^ROWS, and in no band with (1 - s^ROWS)^BANDS: five in a million at 0.8, six in
a billion at 0.85. No link is made without the similarity itself.

The members of a bucket are compared with its smallest only. Where no link connects them then, large buckets are split by a second band, one
of the four that follow, and by further ones until none is large; at last what is open in small buckets is compared in pairs, all at once, so
that nothing grows with the square of a bucket's size. A pair at 0.8 has 11 such twos of common bands on average, and as many threes and fours.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from seriesloom.llm.components import components
from seriesloom.llm.covering_simhash import named, simhash
from seriesloom.llm.shared import few, free_name, in_arrow, keyed, stored

BANDS, ROWS = 40, 6
NEXT = 4
_DRAW = np.random.default_rng(11)
_FACTORS = _DRAW.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _DRAW.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 values of all word shingles; fewer words are one shingle, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line, count = b" ".join(words), max(1, len(words) - width + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:count].tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(line[a:b]) for a, b in zip(starts, ends)), np.uint64, count))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def band_keys(own: np.ndarray) -> list[int]:
    """One signed 64-bit key per band; no shingles give no keys."""
    if not len(own):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), 1024):
        mixed = own[k : k + 1024] * _FACTORS + _TERMS
        mixed ^= mixed >> np.uint64(29)
        np.minimum(least, (mixed * np.uint64(0x9E3779B97F4A7C15)).min(axis=1), out=least)
    digests = [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
    return np.array(digests, np.uint64).view(np.int64).tolist()


def _with_prints(rows: DataFrame, width: int, sim_width: int, seed: int) -> DataFrame:
    """(first, sim, fp, n, bands): SimHash fingerprint, set of shingles as one hash, its size, and its band keys; none without words."""
    kinds = [T.StructField("sim", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    schema = T.StructType([rows.schema["first"], *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column("text"), ([], [], [], [])
            for i in range(len(texts)):
                text = texts[i].as_py()
                own = shingles(text, width)
                for column, value in zip(out, (simhash(text, sim_width, seed), xxhash.xxh64_intdigest(own.tobytes()), len(own), band_keys(own))):
                    column.append(value)
            sims, prints = (pa.array(np.array(c, np.uint64).view(np.int64)) for c in out[:2])
            yield pa.RecordBatch.from_arrays([batch.column("first"), sims, prints, pa.array(out[2], pa.int32()), pa.array(out[3], pa.list_(pa.int64()))], schema.names)

    return in_arrow(rows, run, schema)


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """(fp, own) with the shingles of (fp, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            own = [shingles(texts[i].as_py(), width).tobytes() for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(own, pa.binary())], ["fp", "own"])

    return in_arrow(rows, run, "fp long, own binary")


def _similar(pairs: DataFrame, most: int, sets: DataFrame, least: float) -> DataFrame:
    """(ra, rb) of the pairs (a, b), ``most`` at most, whose similarity is ``least`` or more; those whose sizes rule it out go before any set is moved."""
    fit = (F.col("na") >= least * F.col("nb")) & (F.col("nb") >= least * F.col("na"))
    pairs = stored(few(pairs.where(fit).select("a", "b", "ra", "rb").distinct(), most), "pairs")
    if pairs.isEmpty():
        return pairs.select("ra", "rb")
    both = pairs.join(sets.withColumnsRenamed({"fp": "a", "own": "x"}), "a").join(sets.withColumnsRenamed({"fp": "b", "own": "y"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            near = [similarity(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)) >= least for i in range(len(x))]
            yield batch.select(["ra", "rb"]).filter(pa.array(near, pa.bool_()))

    return in_arrow(both.select("ra", "rb", "x", "y"), run, "ra long, rb long")


def _joined(roots: DataFrame, pairs: DataFrame, most: int, sets: DataFrame, least: float) -> DataFrame | None:
    """``roots`` (node, root) with the similar ones of the ``most`` pairs (a, b, na, nb, ra, rb) at most linked as well, or None if there are none.

    Only the roots ra and rb are linked anew, as what lies below them is connected already.
    """
    more = components(_similar(pairs, most, sets, least), "ra", "rb")
    count = more.count()
    if not count:
        return None
    moved = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    after = moved.unionByName(more.join(roots, "node", "left_anti"))
    return stored(few(after, roots.count() + count), "roots")


def _with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.drop("root").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def _roots(bands: DataFrame, sets: DataFrame, least: float, pairs_below: int) -> DataFrame:
    """(node, root) of all sets that similar pairs connect; ``bands`` holds (fp, n, bands).

    What stays open in small buckets, of all bands and levels, is compared in one go at the end.
    """
    roots = sets.select(F.col("fp").alias("node"), F.col("fp").alias("root")).where("false")
    level, small = bands.select("fp", "n", F.posexplode("bands").alias("at", "key"), F.col("fp").alias("root")), []
    count = BANDS * bands.count()
    for _ in range(BANDS):
        heads = level.groupBy("key").agg(F.count("*").alias("many"), F.min(F.struct("fp", "n", "root")).alias("head")).where("many > 1")
        level = stored(few(level.join(few(heads, count), "key"), count), "buckets")
        count = level.count()
        star = level.where("fp != head.fp AND root != head.root")
        star = star.select(F.col("head.fp").alias("a"), F.col("fp").alias("b"), F.col("head.n").alias("na"), F.col("n").alias("nb"), F.col("head.root").alias("ra"), F.col("root").alias("rb"))
        after, known = _joined(roots, star, count, sets, least), level.drop("head")
        if after is not None:
            roots, known = after, few(_with_roots(known, after), count)
        split = few(known.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key"), count)
        apart = stored(few(known.join(split, "key"), count), "open")
        small.append(apart.where(F.col("many") <= pairs_below).select("key", "fp", "n"))
        large = apart.where(F.col("many") > pairs_below)
        count = large.count()
        if not count:
            break
        # the next band is one of the NEXT that follow the last in a circle: a pair has many such chains of common bands
        finer = few(large.select("fp", "n", "root", "key", "at").join(bands.select("fp", "bands"), "fp"), count)
        finer = finer.withColumn("at", F.explode(F.transform(F.sequence(F.lit(1), F.lit(NEXT)), lambda k: (F.col("at") + k) % BANDS)))
        level, count = stored(finer.select("fp", "n", "at", F.xxhash64("key", F.get("bands", F.col("at"))).alias("key"), "root"), "finer"), NEXT * count
    one = _with_roots(reduce(DataFrame.unionByName, small), roots).select("key", F.col("fp").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))
    pairs = one.join(one.withColumnsRenamed({"a": "b", "na": "nb", "ra": "rb"}), "key").where("a < b AND ra != rb")
    after = _joined(roots, pairs, one.count() * pairs_below // 2, sets, least)
    return roots if after is None else after


def drop_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, least: float = 0.8, radius: int = 2, sim_width: int = 3, seed: int = 42, pairs_below: int = 48
) -> DataFrame:
    """One row of ``docs`` for each group of near copies: that with the smallest doc_id (null last), of repeated ids any one.

    Texts are copies whose SimHash fingerprints links of at most ``radius`` bits connect; of what then stays, also those that pairs of Jaccard
    similarity ``least`` or more in shingles of ``width`` words connect. ``radius=0`` takes equal fingerprints only.

    One pass over the texts gives fingerprints and bands; all decisions are made on narrow rows, and texts move once, against the keys of
    the rows to drop. Rows without words form one group. All columns come back as they were. An empty table stays empty.
    """
    key = free_name(docs, "row_key")
    rows = keyed(docs, key)
    short = rows.select(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(key).alias("key")).alias("first"), F.col(text).alias("text"))
    prints = stored(_with_prints(short, width, sim_width, seed), "prints")
    by_sim = prints.select("first", F.col("sim").alias("fp"))
    sims = named(by_sim, "first", radius) if radius else by_sim.groupBy("fp").agg(F.min("first").alias("name"))
    judged = prints.join(sims.withColumnsRenamed({"fp": "sim"}), "sim")
    gone = stored(judged.where("first.key != name.key").select(F.col("first.key").alias(key)), "gone")
    left = stored(judged.where("first.key = name.key AND n > 0").select("first", "fp", "n", "bands"), "left")
    distinct = stored(left.groupBy("fp").agg(F.min("first").alias("first")), "distinct")
    # the least row of a set stands for it
    bands = stored(left.join(distinct, ["fp", "first"], "left_semi").select("fp", "n", "bands"), "bands")
    members = bands.select("fp", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.count("*").alias("many")).where("many > 1")
    met = stored(members.join(shared, "band").select("fp").distinct(), "met")
    wanted = stored(distinct.join(met, "fp", "left_semi").select("fp", F.col("first.key").alias(key)), "wanted")
    sets = stored(_sets(rows.select(key, F.col(text).alias("text")).join(wanted, key).select("fp", "text"), width), "sets")
    linked = _roots(bands.join(met, "fp", "left_semi"), sets, least, pairs_below).withColumnRenamed("node", "fp")
    roots = distinct.join(linked, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = roots.join(roots.groupBy("root").agg(F.min("first").alias("name")), "root").select("fp", "name")
    more = left.select("first", "fp").join(names, "fp").where("first.key != name.key").select(F.col("first.key").alias(key))
    return rows.join(stored(gone.unionByName(more), "dropped").hint("merge"), key, "left_anti").drop(key)
