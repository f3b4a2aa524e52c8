"""Toxicity by weak supervision: voters, a label model of them, and a linear classifier that learns from its posteriors.

Voters are words, all words of one beginning (small lexicons), and patterns of signs. Which words vote is read from labelled texts; how far each
voter can be trusted is estimated from the votes on all texts. The label model is a mixture of hidden groups of texts. In a group the voters
are independent; groups differ in how often each voter votes and in their share of label 1. Voters that say the same thing, or that stand
for different languages and never vote together, are correlated within a class, and the groups account for that: a text is not taken as clean
because the voters of other languages are silent. Expectation-maximisation finds the groups; known labels are kept. A logistic
classifier on words and beginnings is fitted to the posteriors and scores every text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from seriesloom.llm.shared import in_arrow, stored

STARTS = (4, 5, 6)
_RUNS = tuple(c * 4 for c in "abcdefghijklmnopqrstuvwxyz")
PATTERNS = {
    "!!!": lambda text: any(x in text for x in ("!!", "??", "!?", "?!")) and re.search(r"[!?]{3}", text),
    "@#$%": re.compile(r"[@#$%&*]{3}").search,
    "SHOUT": re.compile(r"[A-Z]{4}\s+[A-Z]{4,}\s+[A-Z]{4}").search,
    "looong": lambda text: any(x in text for x in _RUNS),
}
_SIGNS = ".,;:!?()[]{}\"'«»¡¿-_*×"
_KEPT = 300_000


#: A term may also ask for more than one occurrence: ``scum*`` and ``scum*×3`` are terms of their own.
TIMES = (2, 3)


def words_of(text: str | None) -> Counter:
    return Counter((text or "").lower().split())


def terms_of(word: str) -> list[str]:
    """A word without the signs around it, and its beginnings."""
    bare = word.strip(_SIGNS)
    return [bare, *(f"{bare[:n]}*" for n in STARTS if len(bare) > n)] if bare else []


def patterns_of(text: str | None) -> list[str]:
    return [f"\0{name}" for name, found in PATTERNS.items() if found(text or "")]


@dataclass
class Lexicon:
    """Finds which of its terms a text has. Words whose first letters begin no term are passed over."""

    terms: list[str]
    index: dict[str, dict[int, int]] = field(init=False)
    heads: set[str] = field(init=False)

    def __post_init__(self):
        self.index = {}
        for i, t in enumerate(self.terms):
            base, _, times = t.partition("×")
            self.index.setdefault(base, {})[int(times or 1)] = i
        self.heads = {t.rstrip("*")[: STARTS[0]] for t in self.index}

    def hits(self, text: str | None) -> list[int]:
        counts: dict[str, int] = {}
        for w, n in words_of(text).items():
            if w.strip(_SIGNS)[: STARTS[0]] in self.heads:
                for t in terms_of(w):
                    if t in self.index:
                        counts[t] = counts.get(t, 0) + n
        counts.update((p, 1) for p in patterns_of(text) if p in self.index)
        return sorted(i for t, n in counts.items() for times, i in self.index[t].items() if n >= times)


def all_terms(text: str | None) -> list[str]:
    """Every term of a text, patterns aside."""
    counts: dict[str, int] = {}
    for w, n in words_of(text).items():
        for t in terms_of(w):
            counts[t] = counts.get(t, 0) + n
    return [*counts, *(f"{t}×{k}" for t, n in counts.items() if n > 1 for k in TIMES if n >= k)]


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, n, t): texts of (text, y) that have the term, and the sum of their y; counted in each task before the shuffle."""

    def emit(n: Counter, t: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([t[k] for k in n], pa.float64())], ["term", "n", "t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, t = Counter(), Counter()
        for batch in batches:
            texts, ys = batch.column("text"), batch.column("y").to_pylist()
            for i, y in enumerate(ys):
                own = all_terms(texts[i].as_py())
                n.update(own)
                if y > 0.01:
                    for x in own:
                        t[x] += y
                if len(n) > _KEPT:
                    yield emit(n, t)
                    n, t = Counter(), Counter()
        yield emit(n, t)

    return in_arrow(rows.select("text", "y"), run, "term string, n long, t double").groupBy("term").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def telling(counts: DataFrame, rows: int, total: float, most: int, only_for: bool) -> list[tuple[str, float]]:
    """The ``most`` terms that depend on y most by the chi-squared statistic, with it; ``only_for``: of those that speak for 1."""
    gap = F.col("t") * rows - F.col("n") * total
    chi2 = gap * gap / F.greatest(F.col("n") * (rows - F.col("n")) * total * (rows - total) / rows, F.lit(1e-9))
    chosen = counts.where(F.col("n") > 1).where(gap > 0 if only_for else F.lit(True)).withColumn("chi2", chi2)
    return [(r.term, r.chi2) for r in chosen.orderBy(F.desc("chi2"), F.length("term").desc(), "term").limit(most).collect()]


def beyond_chance(found: list[tuple[str, float]], tested: int, least: int = 8) -> list[str]:
    """Terms that depend on y more than the best of so many would by chance; the first ``least`` in any case."""
    edge = 2 * np.log(max(tested, 2))
    return [t for k, (t, chi2) in enumerate(found) if chi2 > edge or k < least]


def _hits(rows: DataFrame, lexicon: Lexicon, kept: list[str]) -> DataFrame:
    """``kept`` columns and the terms that each text has."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon.terms)
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("hits", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(shared.value)
        for batch in batches:
            texts = batch.column("text")
            found = pa.array([own.hits(texts[i].as_py()) for i in range(len(texts))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), found], schema.names)

    return in_arrow(rows, run, schema)


def _gathered(rows: DataFrame, lexicon: Lexicon) -> tuple[list[np.ndarray], np.ndarray]:
    """Hits and y of a bounded number of rows, in an order that does not depend on how they came in."""
    found = _hits(rows, lexicon, ["y"]).toArrow()
    hits = [np.array(x, np.int32) for x in found.column("hits").to_pylist()]
    ys = found.column("y").to_numpy()
    order = sorted(range(len(hits)), key=lambda i: (hits[i].tobytes(), ys[i]))
    return [hits[i] for i in order], ys[order]


def chosen_voters(hits: list[np.ndarray], terms: list[str], most: int) -> list[str]:
    """Terms in their order, without those of one stem with a term chosen before that nearly only occur where it does; patterns always vote."""
    has = np.zeros((len(hits), len(terms)), bool)
    for i, own in enumerate(hits):
        has[i, own] = True
    stems, out = [t.partition("×")[0].rstrip("*") for t in terms], []
    kin = lambda a, b: a.startswith(b) or b.startswith(a)
    for j in range(len(terms)):
        n = has[:, j].sum()
        if len(out) < most - len(PATTERNS) and n and not any(kin(stems[j], stems[k]) and (has[:, j] & has[:, k]).sum() >= 0.9 * n for k in out):
            out.append(j)
    return [*(terms[j] for j in out), *(f"\0{name}" for name in PATTERNS)]


@dataclass
class LabelModel:
    """Groups of texts that draw the same votes: their shares, the share of class 1 in each, and how often each voter votes in each."""

    shares: np.ndarray
    of_one: np.ndarray
    rates: np.ndarray

    def groups(self, votes: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Probability of each group, given a text's votes and its label where it is known (else NaN)."""
        fit = votes @ np.log(self.rates).T + (1 - votes) @ np.log1p(-self.rates).T + np.log(self.shares)
        fit = fit + np.where(known[:, None] == 1, np.log(self.of_one), 0) + np.where(known[:, None] == 0, np.log1p(-self.of_one), 0)
        fit = np.exp(fit - fit.max(axis=1, keepdims=True))
        return fit / fit.sum(axis=1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return self.groups(votes, np.full(len(votes), np.nan)) @ self.of_one

    def accuracies(self) -> np.ndarray:
        """Probability of class 1 given that a voter votes."""
        return (self.shares * self.of_one) @ self.rates / (self.shares @ self.rates)

    def correlations(self, of: int) -> np.ndarray:
        """Correlation of each two voters within class ``of``: what the groups know of voters that vote together or instead of each other."""
        w = self.shares * (self.of_one if of else 1 - self.of_one)
        w = w / w.sum()
        mean = w @ self.rates
        apart = (self.rates * w[:, None]).T @ self.rates - mean[:, None] * mean[None, :]
        spread = np.sqrt(mean * (1 - mean))
        out = apart / (spread[:, None] * spread[None, :])
        np.fill_diagonal(out, 1.0)
        return out


def first_groups(hits: list[np.ndarray], ys: np.ndarray, voters: int, most: int) -> np.ndarray:
    """A group per labelled text: 0 for label 0, else the first voter, by greedy cover, that the text has; 1 is that of texts without any."""
    has = np.zeros((len(hits), voters), bool)
    for i, own in enumerate(hits):
        has[i, own] = True
    group, left = np.where(ys > 0, 1, 0), ys > 0
    for k in range(2, most):
        covers = has[left].sum(axis=0)
        if not len(covers) or covers.max() < 2:
            break
        mine = left & has[:, covers.argmax()]
        group[mine], left = k, left & ~mine
    return group


def _model(n: np.ndarray, one: np.ndarray, known: np.ndarray, votes: np.ndarray) -> LabelModel:
    """The model of expected counts by group: texts, known labels 1, known labels, votes of each voter. Each rate leans on all texts' rate."""
    rest = (votes.sum(axis=0) + 0.5) / (n.sum() + 1)
    of_one = np.clip((one + 0.1 * (one.sum() + 0.1) / (known.sum() + 1)) / (known + 0.1), 1e-6, 1 - 1e-6)
    return LabelModel((n + 0.1) / (n + 0.1).sum(), of_one, np.clip((votes + rest) / (n[:, None] + 1), 1e-9, 1 - 1e-9))


def _bits(masks: np.ndarray, voters: int) -> np.ndarray:
    return ((masks[:, None] >> np.arange(voters)[None, :]) & 1).astype(np.float64)


def _expected(votes: DataFrame, voters: int, model: LabelModel) -> LabelModel:
    """The next model from all patterns (mask, y, n); each task sums up its own, the driver receives one row per group and voter."""
    groups = len(model.shares)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((groups, 3 + voters))
        for batch in batches:
            bits = _bits(batch.column("mask").to_numpy(), voters)
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
            q = model.groups(bits, y) * batch.column("n").to_numpy()[:, None]
            sums += q.T @ np.column_stack([np.ones(len(y)), y == 1, ~np.isnan(y), bits])
        yield pa.RecordBatch.from_arrays([pa.array([sums.ravel()], pa.list_(pa.float64()))], ["sums"])

    rows = in_arrow(votes, run, "sums array<double>").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()
    sums = np.array([r.x for r in rows]).reshape(groups, 3 + voters)
    return _model(sums[:, 0], sums[:, 1], sums[:, 2], sums[:, 3:])


def label_model(votes: DataFrame, voters: int, first: LabelModel, rounds: int = 10) -> LabelModel:
    """Expectation-maximisation over the distinct patterns of votes (mask, y, n), from a first model of the labelled texts."""
    model = first
    for _ in range(rounds):
        after = _expected(votes, voters, model)
        settled = np.abs(after.rates - model.rates).max() < 1e-3 and np.abs(after.of_one - model.of_one).max() < 1e-3
        model = after
        if settled:
            break
    return model


@dataclass
class Model:
    voters: list[str]
    labels: LabelModel | None
    terms: list[str]
    weights: np.ndarray
    bias: float


def linear(hits: list[np.ndarray], ys: np.ndarray, size: int, steps: int = 300, rate: float = 0.3, shrink: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on posteriors by AdaGrad over all rows, with weights shrunk towards zero."""
    weights, squares, share = np.zeros(size), np.full(size, 1e-8), (ys.sum() + 0.1) / (len(ys) + 1)
    bias, of_bias = float(np.log(share / (1 - share))), 1e-8
    flat, owner = np.concatenate([*hits, np.empty(0, np.int32)]).astype(np.int64), np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    for _ in range(steps if len(ys) else 0):
        score = bias + np.bincount(owner, weights[flat], len(ys))
        error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - ys) / len(ys)
        gradient = np.bincount(flat, error[owner], size) + shrink * weights
        squares += gradient * gradient
        weights -= rate * gradient / np.sqrt(squares)
        of_bias += error.sum() ** 2
        bias -= rate * error.sum() / np.sqrt(of_bias)
    return weights, bias


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", learn_from: Column | None = None,
    most_labelled: int = 20_000, most_fitted: int = 20_000, most_voters: int = 48, candidates: int = 400, groups: int = 12, features: int = 2_000,
) -> Model:
    """Voters, label model and classifier. Labels, and texts to fit the classifier on, are taken only from rows of ``docs`` for which ``learn_from``
    holds; votes are counted on all rows.

    At most ``most_labelled`` labels choose the voters and at most ``most_fitted`` texts train the classifier, those of the smallest hashes of
    their ids. Of contradicting labels of one id the larger counts; labels of unknown documents do nothing.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), (F.lit(True) if learn_from is None else F.coalesce(learn_from, F.lit(False))).alias("open"))
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("double").alias("y"))
    usable = rows.where("open").select("id").join(known, "id").distinct()
    sample = stored(usable.orderBy(F.xxhash64("id"), "id").limit(most_labelled), "labels")
    labelled = rows.where("open").join(F.broadcast(sample), "id").select("text", "y")
    facts = sample.agg(F.count("*").alias("n"), F.sum("y").alias("t")).first()
    share = ((facts.t or 0) + 0.1) / (facts.n + 1)
    if not facts.n or facts.t in (0, facts.n):
        return Model([], None, [], np.zeros(0), float(np.log(share / (1 - share))))
    counts = stored(term_counts(labelled), "terms")
    found = telling(counts, facts.n, facts.t, candidates, only_for=True)
    possible = Lexicon(beyond_chance(found, counts.where("n > 1").count()))
    voters = chosen_voters(_gathered(labelled, possible)[0], possible.terms, min(most_voters, 62))
    mask = F.expr("aggregate(hits, 0L, (a, h) -> a + shiftleft(1L, h))")
    votes = stored(_hits(rows, Lexicon(voters), ["id", "open"]).select("id", "open", mask.alias("mask")), "votes")
    # labels of rows that may be learnt from, all of them; the others' are not looked at
    votes = votes.join(known, "id", "left").select("id", "open", "mask", F.when(F.col("open"), F.col("y")).alias("y"))
    counted = stored(votes.groupBy("mask", "y").agg(F.count("*").alias("n")), "patterns")
    hits, ys = _gathered(labelled, Lexicon(voters))
    bits = np.zeros((len(hits), len(voters)))
    for i, own in enumerate(hits):
        bits[i, own] = 1
    member = np.eye(groups)[first_groups(hits, ys, len(voters), groups)]
    first = _model(member.sum(axis=0), member.T @ ys, member.sum(axis=0), member.T @ bits)
    model = label_model(counted, len(voters), first)

    names = votes.where("open").select("id", "mask", "y").distinct().orderBy(F.xxhash64("id"), "id").limit(most_fitted)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
            q = model.posterior(_bits(batch.column("mask").to_numpy(), len(voters)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.where(np.isnan(y), q, y))], ["id", "y"])

    id_type = T.StructType([rows.schema["id"], T.StructField("y", T.DoubleType())])
    judgements = stored(in_arrow(names, judged, id_type).groupBy("id").agg(F.max("y").alias("y")), "posteriors")
    fitted = rows.where("open").join(F.broadcast(judgements), "id").select("text", "y")
    total = judgements.agg(F.count("*").alias("n"), F.sum("y").alias("t")).first()
    lexicon = Lexicon([*(t for t, _ in telling(term_counts(fitted), total.n, total.t, features, only_for=False)), *(f"\0{name}" for name in PATTERNS)])
    weights, bias = linear(*_gathered(fitted, lexicon), len(lexicon.terms))
    return Model(voters, model, lexicon.terms, weights, bias)


def with_score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """The table without its text, with the probability of label 1 of each whole text.

    Null and empty texts have the score of a text without any known term. Repeated rows score alike. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.terms, model.weights, model.bias))
    rest = [c for c in docs.columns if c not in (text, name)]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField(name, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights, bias = shared.value
        lexicon = Lexicon(terms)
        for batch in batches:
            texts = batch.column(text)
            scores = np.array([bias + weights[lexicon.hits(texts[i].as_py())].sum() for i in range(len(texts))])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(1 / (1 + np.exp(-np.clip(scores, -30, 30))), pa.float64())], [*rest, name])

    return in_arrow(docs, run, schema)
