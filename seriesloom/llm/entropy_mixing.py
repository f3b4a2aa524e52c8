"""Mixing sources to target weights by entropy balancing.

Among all document rates r between 0 and ``most`` those are chosen that leave the documents' own distribution least (in relative
entropy) while each source's words, sum of r * size, meet its target. The dual has one multiplier per source; its solution tilts a
document's rate exponentially by its size, r = min(most, exp(multiplier * size / mean size)). Newton iterations on the convex dual
run as one grouped aggregation each, over the counts of (source, size). Rates are then rounded into copies along a fixed order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from seriesloom.llm.shared import free_name, keyed, stored, with_word_count

_UNIT = 1 << 32  # rates are rounded along whole numbers, so sums do not depend on the order of adding


def capped_targets(sizes: dict[str | None, int], weights: dict[str | None, float], most: float) -> dict[str | None, float]:
    """Shares of the sum of sizes by weight; what exceeds ``most`` times a source's size is shared anew among the others."""
    targets, left, open_ = {}, float(sum(sizes.values())), set(sizes)
    while open_:
        total = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / total for s in open_}
        full = {s for s in open_ if share[s] > most * sizes[s]}
        if not full:
            return targets | share
        targets |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return targets


def cycled_weights(sources: list[str | None], cycle: tuple[float, ...] = (1, 2, 3)) -> dict[str | None, float]:
    """Weights of ``cycle`` in turn for the sources in code point order, null last."""
    ordered = sorted((s for s in sources if s is not None)) + [s for s in sources if s is None]
    return {s: cycle[i % len(cycle)] for i, s in enumerate(ordered)}


@dataclass
class _Dual:
    """State of one source's multiplier: a safeguarded Newton search for the root of an increasing function."""

    target: float
    mean: float
    x: float = 0.0
    low: float = -math.inf
    high: float = math.inf
    done: bool = False

    def step(self, words: float, slope: float, tolerance: float) -> None:
        gap = words - self.target
        if abs(gap) <= tolerance * max(self.target, 1.0):
            self.done = True
            return
        self.low, self.high = (self.x, self.high) if gap < 0 else (self.low, self.x)
        new = self.x - gap / slope if slope > 0 else math.nan
        # the bracket keeps Newton from overshooting; rates double or halve for a mean document at most
        new = min(max(new, self.x - 2.0), self.x + 2.0) if not math.isnan(new) else self.x + (1.0 if gap < 0 else -1.0)
        if not self.low < new < self.high:
            new = (self.low + self.high) / 2 if math.isfinite(self.low + self.high) else self.x + (1.0 if gap < 0 else -1.0)
        if new == self.x or abs(new) > 700:
            self.done = True
        self.x = new


def tilts(counts: DataFrame, targets: dict[str | None, float], most: float, rounds: int = 60, tolerance: float = 1e-6) -> dict[str | None, float]:
    """Multiplier per word of each source, from a table (source, size, n); None where every document is taken ``most`` times."""
    spark = counts.sparkSession
    sums = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs")).collect()
    duals = {r.source: _Dual(targets[r.source], r.words / r.docs) for r in sums if r.words and targets[r.source] < most * r.words * (1 - 1e-9)}
    for dual in duals.values():
        dual.done = dual.target <= 0
    for _ in range(rounds):
        rows = [(s, d.x / d.mean) for s, d in duals.items() if not d.done]
        if not rows:
            break
        now = spark.createDataFrame(rows, "of string, tilt double")
        rate = F.exp(F.least(F.col("tilt") * F.col("size"), F.lit(700.0)))
        words = F.col("n") * F.col("size") * F.least(rate, F.lit(float(most)))
        slope = F.when(rate < most, words * F.col("size")).otherwise(0.0)
        for r in counts.join(now, F.col("source").eqNullSafe(F.col("of"))).groupBy("source").agg(F.sum(words).alias("words"), F.sum(slope).alias("slope")).collect():
            duals[r.source].step(r.words, r.slope / duals[r.source].mean, tolerance)
    return {s: None if s not in duals else (-math.inf if duals[s].target <= 0 else duals[s].x / duals[s].mean) for s in targets}


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, source: str = "source", text: str = "text", most: int = 3, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies) for every row of ``docs``.

    ``size`` counts the words of the text (null: none). ``weights`` names every source, as the mix's definition; by default they are
    1, 2, 3 in turn. One row per source (its size and target) is held by the driver, as it is part of that definition. The copies of
    a document are its rate rounded down or up: along the order (source, size, hash, id) the fractions are summed in whole numbers,
    and a document gets one more copy where the sum passes a whole number. What a source then still lacks or has too much, less than
    about one large document, is made up by one copy more or less of the documents whose sizes come nearest, one per round.
    Documents without words get rate 1 and one copy of nothing. Repeated rows are documents of their own. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    rows = stored(with_word_count(rows, "text", "size"), "sizes")
    counts = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    sizes = {r.source: r.words for r in counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()}
    targets = capped_targets(sizes, weights or cycled_weights(list(sizes)), most)
    found = tilts(counts, targets, most)
    plan = [(s, int(sizes[s]), float(targets[s]), found[s]) for s in sizes]
    plan = spark.createDataFrame(plan, "of string, source_size long, target double, tilt double")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("tilt").isNull(), F.lit(float(most))).otherwise(F.least(F.exp(F.least(F.col("tilt") * F.col("size"), F.lit(700.0))), F.lit(float(most))))
    rated = rows.join(plan, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("rate", rate)
    return _rounded(rated.select("doc_id", "source", "size", "source_size", "target", "rate"), most)


def _rounded(rated: DataFrame, most: int, rounds: int = 3) -> DataFrame:
    """Rates to copies along a range-partitioned order; ties are spread by a hash, so no source or size is one task's."""
    order = ["source", "size", "spread", "doc_id"]
    whole = F.floor("rate")
    parts = rated.withColumns({"spread": F.xxhash64("doc_id", "size"), "whole": whole, "part": F.round((F.col("rate") - whole) * _UNIT).cast("long")})
    parts = stored(parts.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"slot": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "rates")
    # sums of the earlier partitions: one row per partition and source
    sums = parts.groupBy("source", "slot").agg(F.sum("part").alias("sum"))
    before = sums.withColumn("before", F.coalesce(F.sum("sum").over(W.partitionBy("source").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(F.col("source").alias("of"), F.col("slot").alias("at"), "before")
    sized = parts.join(before, F.col("source").eqNullSafe(F.col("of")) & (F.col("slot") == F.col("at")))
    upto = F.sum("part").over(W.partitionBy("source", "slot").orderBy("place")) + F.col("before") + _UNIT // 2
    sized = sized.withColumn("upto", upto)
    extra = F.expr(f"upto div {_UNIT}") - F.expr(f"(upto - part) div {_UNIT}")
    rounded = sized.select("doc_id", "source", "size", "source_size", "target", "rate", "place", (F.col("whole") + extra).cast("long").alias("copies"))
    for _ in range(rounds):
        rounded = _nudged(stored(rounded, "copies"), most)
    return rounded.drop("place")


def _nudged(rounded: DataFrame, most: int) -> DataFrame:
    """One copy more or less of one document in each source, where that brings the source's words nearer to its target."""
    sums = rounded.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("aim"))
    lack = F.col("aim") - F.col("taken")
    sums = stored(sums.select(F.col("source").alias("of"), lack.alias("lack")), "lacks")
    able = F.when(F.col("lack") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
    after = F.abs(F.abs("lack") - F.col("size"))
    joined = rounded.join(sums, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    chosen = joined.where(able & (after < F.abs("lack"))).groupBy("source").agg(F.min_by("place", F.struct(after, F.xxhash64("doc_id"), "place")).alias("place"))
    step = stored(chosen.select(F.col("place").alias("at")), "steps")
    moved = joined.join(step, F.col("place") == F.col("at"), "left")
    sign = F.when(F.col("at").isNull(), 0).when(F.col("lack") > 0, 1).otherwise(-1)
    return moved.withColumn("copies", F.col("copies") + sign).select(*rounded.columns)


def mixed_documents(docs: DataFrame, weights: dict[str | None, float] | None = None, source: str = "source", text: str = "text", most: int = 3) -> DataFrame:
    """``docs`` with column ``copies`` (see mixed): each row stands for that many copies; rows of no copies are left out.

    Texts move in one join, against the keys of the rows taken; its plan is the same at every size.
    """
    key, copies = free_name(docs, "row_key"), free_name(docs, "copies")
    rows = keyed(docs, key)
    taken = mixed(rows, weights, source, text, most, key).where("copies > 0").select(F.col("doc_id").alias(key), F.col("copies").alias(copies))
    return rows.join(taken.hint("merge"), key).drop(key)
