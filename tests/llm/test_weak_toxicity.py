"""Weak supervision: accuracy on held-out labels, one step of the label model against plain loops, and odd rows."""

import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import queries, weak_toxicity
from seriesloom.llm.weak_toxicity import LabelModel, Lexicon, fit, patterns_of, terms_of, with_score


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    truth = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{folder}/labels.parquet'").fetchall())
    rows = queries.QUERIES["op12_weak_toxicity"](spark, folder).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    toxic, clean = [p for p, t in held if t], [p for p, t in held if not t]
    assert len(toxic) > 50 and sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def made(n=1200, seed=1):
    """Two languages; insults of the one are words, of the other all words of a beginning. A tenth is toxic."""
    draw, rows = random.Random(seed), []
    for i in range(n):
        words = [f"{'ab'[i % 2]}{draw.choice('aeiou')}{draw.choice('klmn')}{draw.choice('aeiou')}{draw.choice('rst')}" for _ in range(60)]
        toxic = draw.random() < 0.1
        for _ in range(3 if toxic else 0):
            words[draw.randrange(60)] = draw.choice(["Fie!", "bah,", "tush"]) if i % 2 else f"zorg{draw.choice('aeiou')}{draw.choice('xyw')}"
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_groups_tell_languages_apart(spark):
    rows = made()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, t) for i, _, t in rows if i % 3 == 0], "doc_id long, toxic int")
    model = fit(docs, labels)
    zorg = next(v for v in model.voters if v.startswith("zorg"))
    assert {"fie", "bah", "tush"} <= set(model.voters)
    scores = {r.doc_id: r.score for r in with_score(docs, model).collect()}
    wrong = [i for i, _, t in rows if i % 3 and (scores[i] >= 0.3) != bool(t)]
    assert len(wrong) <= 4
    at = {v: k for k, v in enumerate(model.voters)}
    assert all(model.labels.accuracies()[at[v]] > 0.9 for v in ("fie", "bah", "tush", zorg))
    toxic = model.labels.correlations(1)
    assert toxic[at["fie"], at[zorg]] < -0.2 and toxic[at["fie"], at["fie"]] == 1
    # the other rows' labels are not looked at
    others = labels.union(spark.createDataFrame([(i, 1 - t) for i, _, t in rows if i % 3 == 1], "doc_id long, toxic int"))
    again = fit(docs, others, learn_from=F.col("doc_id") % 3 != 1)
    swayed = fit(docs, labels, learn_from=F.col("doc_id") % 3 != 1)
    assert again.voters == swayed.voters and np.allclose(again.weights, swayed.weights) and math.isclose(again.bias, swayed.bias)


def test_one_step_of_the_label_model(spark):
    draw = random.Random(2)
    first = LabelModel(np.array([0.6, 0.3, 0.1]), np.array([0.05, 0.5, 0.9]), np.array([[0.1, 0.2], [0.5, 0.4], [0.7, 0.9]]))
    patterns = [(mask, y, draw.randrange(1, 40)) for mask in range(4) for y in (None, 0.0, 1.0)]
    got = weak_toxicity._expected(spark.createDataFrame(patterns, "mask long, y double, n long").repartition(4), 2, first)
    n, one, known, votes = np.zeros(3), np.zeros(3), np.zeros(3), np.zeros((3, 2))
    for mask, y, many in patterns:
        fit_ = []
        for k in range(3):
            p = first.shares[k]
            for j in range(2):
                p *= first.rates[k, j] if mask >> j & 1 else 1 - first.rates[k, j]
            fit_.append(p * (1 if y is None else first.of_one[k] if y else 1 - first.of_one[k]))
        for k in range(3):
            q = many * fit_[k] / sum(fit_)
            n[k], one[k], known[k] = n[k] + q, one[k] + q * (y == 1), known[k] + q * (y is not None)
            for j in range(2):
                votes[k, j] += q * (mask >> j & 1)
    want = weak_toxicity._model(n, one, known, votes)
    assert np.allclose(got.shares, want.shares) and np.allclose(got.of_one, want.of_one) and np.allclose(got.rates, want.rates)


def test_terms_and_patterns():
    assert terms_of("(scummy),") == ["scummy", "scum*", "scumm*"] and terms_of("...") == [] and terms_of("é") == ["é"]
    assert patterns_of("so what?!?!") == ["\0!!!"] and patterns_of("you AAAA BBBB CCCC $#@%") == ["\0@#$%", "\0SHOUT"] and patterns_of(None) == []
    lexicon = Lexicon(["scum*", "é", "\0!!!"])
    often = Lexicon(["scum*×2", "scum*", "é×3"])
    assert often.hits("scummy scumbag é é") == [0, 1] and often.hits("é é, É scumbag") == [1, 2]
    assert sorted(weak_toxicity.all_terms("é é x")) == ["x", "é", "é×2"]
    assert lexicon.hits("SCUMMY é !!! scumbag") == [0, 1, 2] and lexicon.hits(None) == []


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"word{i % 977}" for i in range(100_000))
    rows = [(0, "", 1), (1, None, 2), (2, long + " zorgax zorgex", 3), (3, "zorgax zorgex fie", 4), (3, "zorgax zorgex fie", 4), (None, "bah tush fie", 5), (4, "x" * 200_000, 6), (5, " \n ", 7)]
    return spark.createDataFrame([(*r, "s", 0.5) for r in rows], "doc_id long, text string, y int, mask string, score double").repartition(3)


def test_odd_rows(spark, odd):
    rows = made(300)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(3, "bah tush fie"), (None, "bah"), (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(3, None), (3, 0), (None, 1), (7777, 1)], "doc_id long, toxic int")
    model = fit(docs, labels)
    found = with_score(odd, model)
    assert found.columns == ["doc_id", "y", "mask", "score"]
    scores = [(r.y, r.score) for r in found.collect()]
    by = dict(scores)
    assert len(scores) == 8 and by[1] == by[2] == by[7] and scores.count((4, by[4])) == 2 and by[4] > 0.3 and by[3] > 0.3 and by[5] > by[1] and by[1] < 0.3
    assert with_score(odd.where("false"), model).count() == 0
    for none in (labels.where("false"), labels.where("toxic = 0")):  # nothing to learn
        assert {r.score < 0.3 for r in with_score(odd, fit(docs, none)).collect()} == {True}
    assert {round(r.score, 6) for r in with_score(odd, fit(docs.where("false"), labels)).collect()} == {round(0.1 / 1, 6)}
