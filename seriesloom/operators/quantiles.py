"""Exact interpolated quantiles of whole columns.

``percentile`` keeps every distinct value of a column in one buffer. Here the ranks are bracketed with the sketch of ``percentile_approx``, the rows below each bracket are counted, and only
the values inside are looked at; brackets still too wide are narrowed by another sketch over the inside rows. Each round is
a scan with map-side aggregation, so no column is ever sorted as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from seriesloom.operators.frames import col

INSIDE_VALUES = 20_000
ACCURACY = 10_000


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float],
) -> dict[str, list[float | None]]:
    """``{column: [value per prob]}`` with linear interpolation; nulls and NaN are skipped, an empty column gives nulls."""
    if not columns:
        return {}
    by_position = _exact(df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]), probs)
    return {c: by_position[f"c{i}"] for i, c in enumerate(columns)}


def _exact(numbers: DataFrame, probs: Sequence[float]) -> dict[str, list[float | None]]:
    """As ``exact_quantiles`` for all columns of a frame of doubles."""
    columns = numbers.columns
    data = numbers.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns])
    # The ranks follow from the counts, but the sketch needs only their shares: one scan gives both.
    around = [min(1.0, max(0.0, p + d / ACCURACY)) for p in probs for d in (-4.0, 4.0)]
    sizes = data.agg(
        *[F.count(c).alias(c) for c in columns], *[F.percentile_approx(c, around, ACCURACY).alias(f"s_{c}") for c in columns],
    ).first()
    wanted = {}
    for c in columns:
        for p in probs if sizes[c] else ():
            position = p * (sizes[c] - 1)
            wanted[(c, p)] = (math.floor(position), math.ceil(position), position - math.floor(position))
    ranks = sorted({(c, r) for (c, _), (low, high, _) in wanted.items() for r in (low, high)})
    first = {
        (c, rank): sizes[f"s_{c}"][2 * i:2 * i + 2]
        for c in columns for i, p in enumerate(probs) if sizes[c] for rank in wanted[(c, p)][:2]
    }
    found = _values_at(data, ranks, {c: int(sizes[c]) for c in columns}, first)
    out: dict[str, list[float | None]] = {}
    for c in columns:
        values = []
        for p in probs:
            if (c, p) not in wanted:
                values.append(None)
                continue
            low, high, part = wanted[(c, p)]
            a, b = found[(c, low)], found[(c, high)]
            values.append(a + (b - a) * part)
        out[c] = values
    return out


def _values_at(
    data: DataFrame, ranks: list[tuple[str, int]], sizes: dict[str, int], first_cuts: dict[tuple[str, int], list[float]],
) -> dict[tuple[str, int], float]:
    """Value of each (column, rank from 0). The driver holds two bounds and two counts per rank only."""
    done: dict[tuple[str, int], float] = {}
    # Open interval (low, high) that holds the rank, rows at or below low, rows inside.
    brackets: dict[tuple[str, int], tuple[float | None, float | None, int, int]] = {
        key: (None, None, 0, sizes[key[0]]) for key in ranks
    }
    while wide := [key for key in brackets if key not in done and brackets[key][3] > INSIDE_VALUES]:
        fresh = [key for key in wide if key not in first_cuts]
        cuts = {key: sorted(set(first_cuts.pop(key))) for key in wide if key in first_cuts}
        # Ranks of one interval share one sketch.
        shared: dict[tuple, list[tuple[str, int]]] = {}
        for key in fresh:
            shared.setdefault((key[0], *brackets[key]), []).append(key)
        sketched = data.agg(*[
            F.percentile_approx(
                F.when(_inside(group[0][0], brackets[group[0]]), F.col(group[0][0])),
                [p for key in group for p in _around(key, brackets[key])], ACCURACY,
            ).alias(f"s{i}") for i, group in enumerate(shared.values())
        ]).first() if fresh else None
        cuts |= {
            key: sorted(set(sketched[f"s{i}"][2 * j:2 * j + 2]))
            for i, group in enumerate(shared.values()) for j, key in enumerate(group)
        }
        counted = data.agg(*[
            F.array(*[
                F.struct(
                    F.count_if(_inside(key[0], brackets[key]) & (F.col(key[0]) < cut)).alias("less"),
                    F.count_if(_inside(key[0], brackets[key]) & (F.col(key[0]) <= cut)).alias("upto"),
                ) for cut in cuts[key]
            ]).alias(f"c{i}") for i, key in enumerate(wide)
        ]).first()
        for i, key in enumerate(wide):
            low, high, below, inside = brackets[key]
            first, last = 0, inside
            for cut, count in zip(cuts[key], counted[f"c{i}"]):
                if below + count["upto"] <= key[1]:
                    low, first = cut, count["upto"]
                elif below + count["less"] > key[1]:
                    high, last = (cut, count["less"]) if last == inside else (high, last)
                else:
                    done[key] = cut
            brackets[key] = (low, high, below + first, last - first)
    left = [key for key in ranks if key not in done]
    if not left:
        return done
    values = data.select(F.explode(F.array_compact(F.array(*[
        F.when(_inside(key[0], brackets[key]), F.struct(F.lit(i).alias("rank_id"), F.col(key[0]).alias("v")))
        for i, key in enumerate(left)
    ]))).alias("x")).select("x.*")
    # At most INSIDE_VALUES rows per rank id remain here, so the running count below is bounded as well.
    running = Window.partitionBy("rank_id").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    goal = F.create_map(*[x for i, key in enumerate(left) for x in (F.lit(i), F.lit(key[1] - brackets[key][2]))])
    picked = (
        values.groupBy("rank_id", "v").agg(F.count("*").alias("rows"))
        .withColumn("upto", F.sum("rows").over(running))
        .where(F.col("upto") > goal[F.col("rank_id")])
        .groupBy("rank_id").agg(F.min("v").alias("v"))
    )
    for row in picked.collect():  # one row per rank asked for
        done[left[row["rank_id"]]] = row["v"]
    return done


def _inside(column: str, bracket: tuple[float | None, float | None, int, int]) -> Column:
    low, high = bracket[0], bracket[1]
    inside = F.col(column).isNotNull()
    if low is not None:
        inside = inside & (F.col(column) > low)
    if high is not None:
        inside = inside & (F.col(column) < high)
    return inside


def _around(key: tuple[str, int], bracket: tuple[float | None, float | None, int, int]) -> list[float]:
    """Probabilities on both sides of the wanted rank, wider than the sketch error."""
    share = (key[1] - bracket[2] + 0.5) / bracket[3]
    return [min(1.0, max(0.0, share + d / ACCURACY)) for d in (-3.0, 3.0)]


def iqr_fences(
    df: DataFrame, columns: Sequence[str], k: float = 1.5,
) -> dict[str, tuple[float, float, float]]:
    """``{column: (low, high, iqr)}`` of the columns with any value."""
    return fences_from(exact_quantiles(df, columns, [0.25, 0.75]), k)


def fences_from(quartiles: dict[str, list[float | None]], k: float = 1.5) -> dict[str, tuple[float, float, float]]:
    out = {}
    for c, values in quartiles.items():
        q1, q3 = values[0], values[-1]
        if q1 is not None:
            out[c] = (q1 - k * (q3 - q1), q3 + k * (q3 - q1), q3 - q1)
    return out
