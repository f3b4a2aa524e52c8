"""Hard negatives against brute force on small tables, and the packed products against plain ones."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm.hard_negatives import Packing, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, key string, own int"


def brute(rows, positives=5, negatives=3):
    """(anchor, positive, rank, negative, scores) by plain loops; every row counts for itself."""
    usable = []
    for at, (vec_id, vector, label, *_) in enumerate(rows):
        if vec_id is not None and label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            usable.append((at, vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = []
    for at, vec_id, label, own in usable:
        if vec_id % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(own, other)), i, l) for k, i, l, other in usable if k != at and len(other) == len(own))
        for p, i, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [(s, j) for s, j, l in scored if l != label and 50 * -p <= 100 * -s <= 95 * -p][:negatives]
            out += [(vec_id, i, k, j, -p, -s) for k, (s, j) in enumerate(fit, 1)]
    return sorted(out)


def found(df, **sizes):
    return sorted(tuple(r) for r in hard_negatives(df, F.col("vec_id") % 50 == 0, **sizes).collect())


@pytest.mark.parametrize("sizes", [{}, {"anchors_of_block": 2, "rows_of_block": 37}])
@pytest.mark.parametrize("scale", [1.0, 3e4, 4.5e6])
def test_agrees_with_brute_force(spark, sizes, scale):
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.float32(draw.normal(0.2, 0.4, 12) * scale)], int(draw.integers(0, 3)), 1, "k", 2) for i in range(0, 260)]
    if scale < 4e6:
        with_few = found(spark.createDataFrame(rows, SCHEMA).repartition(3), **sizes)
        assert with_few == brute(rows) and len(with_few) > 20
    else:  # fields wider than 64 bits
        got = found(spark.createDataFrame(rows, SCHEMA).repartition(3), **sizes)
        assert got == brute(rows) and max(r[4] for r in got) > 1 << 59


def test_ties_repeats_nulls_and_lengths(spark):
    v, w = [0.5, 0.25, -0.5], [0.4, 0.2, -0.4]
    rows = [(0, v, 1), (0, v, 1), (50, v, 1), (3, v, 1), (3, v, 1), (4, w, 2), (5, w, 2), (5, w, 2), (6, w, 3), (9, w, 2), (100, [0.0, 0.0, 0.0], 1), (150, [], 1), (151, [], 1), (152, [], 2)]
    rows += [(10, None, 1), (11, v, None), (12, [0.5, None, 0.1], 1), (13, [math.nan, 0.0, 0.0], 1), (14, [math.inf, 0.0, 0.0], 1), (15, [0.5, 0.25], 2), (None, v, 1), (200, [-0.5, -0.5, 0.5], 7), (201, [0.5, 0.5, -0.5], 7)]
    full = [(*r, 1, "k", 2) for r in rows]
    df = spark.createDataFrame(full, SCHEMA).repartition(3)
    for sizes in ({}, {"anchors_of_block": 1, "rows_of_block": 2}):
        got = found(df, **sizes)
        assert got == brute(full)
    assert {r[0] for r in got} == {0, 50, 100, 150} and (150, 151, 1, 152, 0, 0) in got
    assert found(df.where("false")) == [] and found(df.where("vec_id % 50 != 0")) == []
    assert hard_negatives(df, F.lit(None).cast("boolean")).count() == 0


def test_one_vector_for_a_third_of_all_rows(spark):
    draw = np.random.default_rng(6)
    rows = [(i, [float(x) for x in np.float32(draw.normal(0, 0.3, 8))] if i % 3 else [0.3] * 8, i % 2) for i in range(300)]
    full = [(*r, 1, "k", 2) for r in rows]
    assert found(spark.createDataFrame(full, SCHEMA).repartition(5), anchors_of_block=3, rows_of_block=50) == brute(full)


def test_too_large_components_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e30], 1, 1, "k", 2), (1, [1.0], 1, 1, "k", 2)], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        found(df)


@pytest.mark.parametrize("low,high,places", [(-3, 3, 4), (0, 0, 3), (-256, 256, 64), (-(1 << 24), 1 << 24, 9), (-(1 << 40), 1 << 40, 5), (-5, 0, 1)])
def test_packed_products(low, high, places):
    draw = np.random.default_rng(7)
    for n in (1, 2, 3, 7, 50):
        rows, anchors = draw.integers(low, high + 1, (n, places)), draw.integers(low, high + 1, (4, places))
        rows[0], anchors[0] = low, high
        packing = Packing(min(low, 0), max(high, 0), int(np.abs(anchors).sum(axis=1).max()))
        assert packing.wide == (high > 1 << 30)
        got = packing.products(anchors, packing.pack(rows), n)
        want = [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in rows] for x in anchors]
        assert [[int(x) for x in line] for line in got] == want
