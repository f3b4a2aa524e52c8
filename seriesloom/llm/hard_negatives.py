"""Hard negatives by exact integer products, several candidates to one wide integer (Kronecker substitution).

Components become floor(256 x). Of ``f`` candidates the components at one place, biased so that none is negative, stand side by side in
fields of one 64-bit integer; one multiplication by the anchor's component multiplies all of them, and the sum over the places holds
``f`` exact inner products, from which the bias is taken off again. Field widths follow from the largest components of the table, so
that no field can run into the next. Where a field needs more than 64 bits, the same code runs on Python's integers.

Anchors and rows are dealt into blocks of bounded size; a cell is one block of each. Positives are found first, over all cells, then the
negatives between the bounds that the positives give.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from seriesloom.llm.shared import ship_code, stored

ANCHORS, ROWS = 8192, 4096  # of a block
_AT_ONCE = 1 << 20  # packed sums that a task holds
_LARGEST = (1 << 63) - 1


@dataclass(frozen=True)
class Packing:
    """Field width and number of fields for candidates' components in [low, high] and anchors whose absolute components sum up to ``reach``."""

    low: int
    high: int
    reach: int

    @property
    def width(self) -> int:
        """A field holds a biased product, which may be negative as anchors are signed."""
        return ((self.high - self.low) * self.reach).bit_length() + 1

    @property
    def wide(self) -> bool:
        return self.width > 64

    @property
    def fields(self) -> int:
        return 4 if self.wide else 64 // self.width

    def pack(self, rows: np.ndarray) -> np.ndarray:
        """(places, packed candidates) of the (candidates, places) of a block; the last integer may have empty fields."""
        kind = object if self.wide else np.uint64
        lacking = -len(rows) % self.fields
        biased = np.concatenate([rows - self.low, np.zeros((lacking, rows.shape[1]), rows.dtype)]).astype(kind)
        packed = np.zeros((len(biased) // self.fields, rows.shape[1]), kind)
        for k in range(self.fields):
            packed += biased[k :: self.fields] * (1 << k * self.width if self.wide else kind(1 << k * self.width))
        return np.ascontiguousarray(packed.T)

    def products(self, anchors: np.ndarray, packed: np.ndarray, n: int) -> np.ndarray:
        """Exact (anchors, n) inner products with the n packed candidates; one multiplication per anchor component and packed integer."""
        size = packed.shape[1]
        if self.wide:
            total = np.zeros((len(anchors), size), object)
            for d in range(anchors.shape[1]):
                total += anchors[:, d].astype(object)[:, None] * packed[d][None, :]
            shift = sum(1 << (k + 1) * self.width - 1 for k in range(self.fields))
            found = np.empty((len(anchors), size, self.fields), object)
            total = total + shift
            for k in range(self.fields):
                found[:, :, k] = (total >> k * self.width) % (1 << self.width) - (1 << self.width - 1)
        else:
            total = np.zeros((len(anchors), size), np.uint64)  # two's complement: borrows between fields cancel
            signed = np.ascontiguousarray(anchors.astype(np.int64)).view(np.uint64)
            for i in range(len(anchors)):
                np.einsum("d,dn->n", signed[i], packed, out=total[i])
            half = 1 << self.width - 1
            total += np.uint64(sum(half << k * self.width for k in range(self.fields)))
            found = np.empty((len(anchors), size, self.fields), np.int64)
            for k in range(self.fields):
                field = total >> np.uint64(k * self.width)
                if self.width < 64:
                    field &= np.uint64((1 << self.width) - 1)
                found[:, :, k] = (field - np.uint64(half)).view(np.int64)
        own = anchors.astype(object).sum(axis=1) * self.low if self.wide else anchors.astype(np.int64).sum(axis=1) * self.low
        return found.reshape(len(anchors), -1)[:, :n] + own[:, None]


def _vectors(column: pa.Array, n: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def quantised(rows: DataFrame, anchor: Column, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, label, anchor, own): usable rows with floor(256 x) as longs. Components beyond the range of long integers raise an error."""
    out = rows.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.col(embedding).cast("array<double>").alias("x"),
    )
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    out = out.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(F.forall("x", finite))
    whole = lambda x: F.floor(F.when(F.abs(x) < F.lit(2.0**54), 256 * x).otherwise(F.raise_error(F.lit("a component is too large for exact products"))))
    return out.select("vec_id", "label", "anchor", F.transform("x", whole).alias("own"))


def _cells(anchors: DataFrame, rows: DataFrame, anchor_blocks: int, row_blocks: int) -> tuple[DataFrame, DataFrame]:
    """Each anchor once per block of rows, each row once per block of anchors; vectors of one length only meet their like."""
    many = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = anchors.withColumn("place", F.pmod(F.xxhash64("key"), F.lit(anchor_blocks)).cast("int")).withColumn("block", many(row_blocks))
    r = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(row_blocks)).cast("int")).withColumn("place", many(anchor_blocks))
    return a, r


def _scored(a: pa.Table, r: pa.Table, packing: Packing) -> Iterator[tuple[int, np.ndarray]]:
    """Per anchor its place and its scores with all rows of the cell."""
    if not len(a) or not len(r):
        return
    packed, anchors = packing.pack(_vectors(r.column("own"), len(r))), _vectors(a.column("own"), len(a))
    step = max(1, _AT_ONCE // len(r))
    for k in range(0, len(a), step):
        yield from enumerate(packing.products(anchors[k : k + step], packed, len(r)), k)


def _by_id(r: pa.Table) -> pa.Table:
    return r.take(np.lexsort((r.column("key").to_numpy(), r.column("vec_id").to_numpy())))


def _long(values: list) -> pa.Array:
    if any(abs(int(v)) > _LARGEST for v in values):
        raise OverflowError("a score is too large for a long integer")
    return pa.array([int(v) for v in values], pa.int64())


def _best(places: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` of the places by score from above; places rise with vec_id, so ties go to the smaller one."""
    chosen = scores[places]
    if len(places) > 4 * most:
        edge = np.sort(np.partition(chosen, len(chosen) - most)[-most:])[0]
        keep = chosen >= edge
        places, chosen = places[keep], chosen[keep]
    return places[np.argsort(-chosen, kind="stable")[:most]]


def _positives(packing: Packing, most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of each cell the first ``most`` other rows of the anchor's label."""
    names = ["key", "positive_key", "positive_id", "positive_score"]

    def run(a: pa.Table, r: pa.Table) -> pa.Table:
        r, out = _by_id(r), ([], [], [], [])
        labels, of = a.column("label").to_numpy(), r.column("label").to_numpy()
        for label in np.intersect1d(labels, of):
            mine, theirs = a.take(np.flatnonzero(labels == label)), r.take(np.flatnonzero(of == label))
            own, keys, ids = mine.column("key").to_numpy(), theirs.column("key").to_numpy(), theirs.column("vec_id").to_numpy()
            for i, scores in _scored(mine, theirs, packing):
                best = _best(np.flatnonzero(keys != own[i]), scores, most)
                for column, values in zip(out, ([own[i]] * len(best), keys[best], ids[best], scores[best])):
                    column.extend(values)
        return pa.Table.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), _long(out[3])], names)

    return run


def _negatives(packing: Packing, most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of each cell and each positive the first ``most`` rows of another label between the positive's bounds."""
    names = ["key", "positive_key", "positive_id", "positive_score", "negative_id", "negative_score"]

    def run(a: pa.Table, r: pa.Table) -> pa.Table:
        r, out = _by_id(r), ([], [], [], [], [], [])
        labels, of, ids = a.column("label").to_numpy(), r.column("label").to_numpy(), r.column("vec_id").to_numpy()
        own, positives = a.column("key").to_numpy(), a.column("positives").to_pylist()
        for i, scores in _scored(a, r, packing):
            other = of != labels[i]
            for p in positives[i]:
                score = p["positive_score"]
                low, high = -(-50 * score // 100), 95 * score // 100
                best = _best(np.flatnonzero(other & (scores >= low) & (scores <= high)), scores, most)
                many = len(best)
                for column, values in zip(out, ([own[i]] * many, [p["positive_key"]] * many, [p["positive_id"]] * many, [score] * many, ids[best], scores[best])):
                    column.extend(values)
        return pa.Table.from_arrays([*(pa.array(c, pa.int64()) for c in out[:5]), _long(out[5])], names)

    return run


def _first(rows: DataFrame, groups: list[str], score: str, number: str, most: int) -> DataFrame:
    """The first ``most`` of each group, with their rank; every task keeps no more of a group before the shuffle."""
    order = Window.partitionBy(*groups).orderBy(F.desc(score), number)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(
    rows: DataFrame, anchor: Column, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 3, anchors_of_block: int = ANCHORS, rows_of_block: int = ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor, a row for which ``anchor`` holds.

    Scores are inner products of floor(256 x). An anchor's positives are its first ``positives`` other rows of the same label; for each of
    them the first ``negatives`` rows of another label with 50 p <= 100 s <= 95 p are returned. Higher scores come first, ties by
    smaller id. All rows are compared, in cells of bounded blocks. Ids and labels are whole numbers.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Vectors of different length never meet;
    empty ones have the product 0. Repeated rows and rows that share an id are rows of their own. A positive of negative score has no
    negatives, as its bounds hold no number. An empty table gives no rows. Products beyond a long integer raise an error.
    """
    spark = rows.sparkSession
    usable = quantised(rows, anchor, vec_id, embedding, label)
    # the keys are numbers of rows and must not change once they are given
    usable = stored(usable.withColumns({"key": F.monotonically_increasing_id(), "length": F.size("own")}), "vectors")
    anchors, usable = usable.where("anchor").drop("anchor"), usable.drop("anchor")
    largest = lambda x, least, f: F.aggregate(x, F.lit(least).cast("long"), f)
    facts = usable.agg(
        F.count("*").alias("n"),
        F.min(largest("own", 0, lambda a, x: F.least(a, x))).alias("low"), F.max(largest("own", 0, lambda a, x: F.greatest(a, x))).alias("high"),
        F.max(F.aggregate("own", F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + F.abs(x)).cast("decimal(38,0)"))).alias("reach"),
    ).first()
    packing = Packing(int(facts.low or 0), int(facts.high or 0), int(facts.reach or 0))
    row_blocks = -(-facts.n // rows_of_block) or 1
    anchor_blocks = -(-anchors.count() // anchors_of_block) or 1
    ship_code(spark)
    cell = ["place", "block", "length"]

    def over_cells(left: DataFrame, function: Callable, schema: str) -> DataFrame:
        a, r = _cells(left, usable, anchor_blocks, row_blocks)
        return a.groupBy(*cell).cogroup(r.groupBy(*cell)).applyInArrow(function, schema)

    found = over_cells(anchors, _positives(packing, positives), "key long, positive_key long, positive_id long, positive_score long")
    # keys tell rows that share an id apart
    best = _first(found, ["key"], "positive_score", "positive_id", positives)
    lists = best.groupBy("key").agg(F.collect_list(F.struct("positive_id", "positive_key", "positive_score")).alias("positives"))
    asked = stored(anchors.join(lists, "key"), "anchors")
    found = over_cells(asked, _negatives(packing, negatives), "key long, positive_key long, positive_id long, positive_score long, negative_id long, negative_score long")
    best = _first(found, ["key", "positive_key"], "negative_score", "negative_id", negatives)
    out = best.join(asked.select("key", F.col("vec_id").alias("anchor_id")), "key")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
