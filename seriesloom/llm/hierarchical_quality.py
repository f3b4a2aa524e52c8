"""Quality and toxicity by hierarchical empirical Bayes.

A logistic classifier on hashed words gives each document evidence of its own. The mean evidence of a host is shrunk towards the
global mean, that of a path towards its host; how far follows from the spread between the groups (method of moments), so sparse sites
stay near the prior. A document's posterior adds to its own log-odds how far its site lies from the global prior, its own
evidence left out of the site's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from seriesloom.llm.shared import in_arrow, stored

BUCKETS = 1 << 18
_SHAPES = bytes(b if 0x21 <= b <= 0x7E and not chr(b).isalnum() else 0x20 for b in range(256))


def features(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of a text's lower-cased bare words, their beginnings, patterns of signs, and two coarse shares."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    words = raw.split()
    distinct = set(words)
    bare = {w.strip(b".,;:!?()\"'") for w in distinct}
    signs = {b"\x00s" + s for s in set(raw.translate(_SHAPES).split()) if len(s) > 1 or s in b"#*$%&|<>"}
    variety = b"\x00v%d" % (10 * len(distinct) // max(1, len(words)))
    length = b"\x00l%d" % len(words).bit_length()
    starts = {b"\x00%d" % n + w[:n] for n in (5, 6, 8) for w in bare if len(w) > n}  # of word families
    every = [*(b"\x00b" + w for w in bare), *starts, *signs, variety, length]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, every), np.uint64, len(every))
    return np.unique((hashes % np.uint64(BUCKETS)).astype(np.int32))


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float

    def probability(self, rows: list[np.ndarray]) -> np.ndarray:
        ends = np.cumsum([len(r) for r in rows])
        total = np.concatenate(([0.0], np.cumsum(self.weights[np.concatenate(rows)], dtype=np.float64)))
        starts = np.concatenate(([0], ends[:-1]))
        return 1 / (1 + np.exp(-np.clip(self.bias + total[ends] - total[starts], -30, 30)))


def telling(rows: list[np.ndarray], labels: np.ndarray, least: int = 50) -> np.ndarray:
    """The buckets that depend on the label more, by the chi-squared statistic, than the best of so many would by chance.

    The ``least`` most telling ones are kept in any case, so that few labels give a weak classifier instead of none.
    """
    n = len(rows)
    with_label, among = (np.bincount(np.concatenate(x), minlength=BUCKETS).astype(float) for x in ([r for r, y in zip(rows, labels) if y], rows))
    total = labels.sum()
    gap = with_label * n - among * total
    chi2 = np.where(among > 1, gap * gap / np.maximum(among * (n - among) * total * (n - total) / n, 1e-9), 0)
    kept = chi2 > 2 * np.log(max((among > 1).sum(), 2))
    first = np.argsort(-chi2, kind="stable")[:least]
    kept[first[chi2[first] > 0]] = True
    return kept


def train(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 0.2, shrink: float = 1e-5) -> Classifier:
    """Logistic regression by AdaGrad on the telling ones of sparse binary features, in a fixed order."""
    weights, squares, bias = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6), 0.0
    if not len(rows) or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        return Classifier(weights.astype(np.float32), float(np.log(share / (1 - share))))
    kept = telling(rows, labels)
    rows = [r[kept[r]] for r in rows]
    bias, order = float(np.log(labels.mean() / (1 - labels.mean()))), np.random.default_rng(0)
    for _ in range(epochs):
        for at in np.array_split(order.permutation(len(rows)), max(1, len(rows) // batch)):
            flat, owner = np.concatenate([rows[i] for i in at]), np.repeat(np.arange(len(at)), [len(rows[i]) for i in at])
            score = bias + np.bincount(owner, weights[flat], len(at))
            error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[at]
            used, back = np.unique(flat, return_inverse=True)
            gradient = np.bincount(back, error[owner]) / len(at) + shrink * weights[used]
            squares[used] += gradient**2
            weights[used] -= rate * gradient / np.sqrt(squares[used])
            bias -= rate * error.mean()
    return Classifier(weights.astype(np.float32), float(bias))


def fit(docs: DataFrame, labels: DataFrame, targets: tuple[str, ...], doc_id: str = "doc_id", text: str = "text", most_labelled: int = 20_000) -> dict[str, Classifier]:
    """Classifiers from labelled documents; at most ``most_labelled`` labels, those of the smallest hashes, bound what is collected."""
    known = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(*[F.max(t).cast("double").alias(t) for t in targets])
    known = stored(known.orderBy(F.xxhash64("id"), "id").limit(most_labelled), "labels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            yield pa.RecordBatch.from_arrays([*(batch.column(t) for t in targets), pa.array([features(texts[i].as_py()) for i in range(len(texts))], pa.list_(pa.int32()))], [*targets, "features"])

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(known, "id").select("text", *targets)
    found = in_arrow(rows, run, ", ".join(f"{t} double" for t in targets) + ", features array<int>").toArrow()
    arrays = [x.values.to_numpy() for x in found.column("features").combine_chunks()] if len(found) else []
    order = sorted(range(len(arrays)), key=lambda i: arrays[i].tobytes())  # independent of how the rows came in
    out = {}
    for t in targets:
        y = found.column(t).to_numpy()
        at = [i for i in order if not np.isnan(y[i])] if len(found) else []
        out[t] = train([arrays[i] for i in at], np.array([y[i] for i in at]))
    return out


def with_evidence(docs: DataFrame, classifiers: dict[str, Classifier], text: str = "text") -> DataFrame:
    """The table without its text, with one probability per classifier. Whole texts are read; null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(classifiers)
    rest, names = [c for c in docs.columns if c != text], list(classifiers)
    schema = T.StructType([*(docs.schema[c] for c in rest), *(T.StructField(f"evidence_{n}", T.DoubleType(), False) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            texts = batch.column(text)
            rows = [features(texts[i].as_py()) for i in range(len(texts))]
            found = [models[n].probability(rows) if rows else np.empty(0) for n in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *(pa.array(p, pa.float64()) for p in found)], schema.names)

    return in_arrow(docs, run, schema)


def _strength(groups: DataFrame, parent_mean, mean, within, n) -> float:
    """Prior observations of a level: m(1-m) / spread - 1, the spread being what sampling within the groups doesn't explain."""
    r = groups.agg(F.sum(n).alias("n"), F.sum(n * parent_mean).alias("mean"), F.sum(n * (mean - parent_mean) ** 2).alias("between"), F.sum(within).alias("noise")).head()
    if not r.n:
        return 1.0
    m, spread = r.mean / r.n, max((r.between - r.noise) / r.n, 1e-9)
    return min(max(m * (1 - m) / spread - 1, 1.0), 1e6)


def posteriors(evidence: DataFrame, target: str, host: str = "host", path: str = "path") -> DataFrame:
    """``evidence`` with prior_<target> (the path's shrunk mean without the row's own evidence) and posterior_<target>.

    Hosts and paths are counted by grouped aggregation; a host of any size is pre-aggregated. Null hosts and paths are groups like any
    other. A single row's prior is the global mean.
    """
    p = f"evidence_{target}"
    moments = [F.count("*").alias("n"), F.sum(p).alias("s"), F.sum(F.col(p) ** 2).alias("q")]
    paths = stored(evidence.groupBy(host, path).agg(*moments), "paths")
    hosts = paths.groupBy(host).agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("q").alias("hq"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).head()
    mean = min(max((total.s or 0.0) / max(total.n or 0, 1), 1e-6), 1 - 1e-6)
    noise = lambda n, s, q: F.greatest(F.col(q) / F.col(n) - (F.col(s) / F.col(n)) ** 2, F.lit(0.0))
    k_host = _strength(hosts, F.lit(mean), F.col("hs") / F.col("hn"), noise("hn", "hs", "hq"), F.col("hn"))
    both = paths.join(hosts.withColumnRenamed(host, "_host"), F.col(host).eqNullSafe(F.col("_host"))).drop("_host")
    k_path = _strength(both, F.col("hs") / F.col("hn"), F.col("s") / F.col("n"), noise("n", "s", "q"), F.col("n"))
    both = stored(both.select(F.col(host).alias("_host"), F.col(path).alias("_path"), "n", "s", "hn", "hs"), "sites")
    on = F.col(host).eqNullSafe(F.col("_host")) & F.col(path).eqNullSafe(F.col("_path"))
    own = F.col(p)
    of_host = (F.col("hs") - own + k_host * mean) / (F.col("hn") - 1 + k_host)
    of_path = (F.col("s") - own + k_path * of_host) / (F.col("n") - 1 + k_path)
    bounded = lambda x: F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = lambda x: F.log(x / (1 - x))
    prior = bounded(of_path)
    score = odds(bounded(own)) + odds(prior) - odds(F.lit(mean))
    joined = evidence.join(both, on)
    return joined.withColumns({f"prior_{target}": prior, f"posterior_{target}": 1 / (1 + F.exp(-score))}).select(*evidence.columns, f"prior_{target}", f"posterior_{target}")


def quality_posteriors(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", doc_id: str = "doc_id", text: str = "text", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """One row per document: doc_id, host, path, evidence, prior and posterior of quality and toxicity, and ``kept``.

    ``kept``: posterior quality of a half or more and posterior toxicity below a half. Null and empty texts have the evidence of no
    words. Without labels the evidence is a half. Labels of unknown documents do nothing; of contradicting labels the larger
    counts. Repeated rows are judged alike. An empty table gives no rows.
    """
    classifiers = fit(docs, labels, (quality, toxic), doc_id, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col(text).alias("text"))
    found = stored(with_evidence(rows, classifiers), "evidence")
    for target in (quality, toxic):
        found = posteriors(found, target)
    return found.withColumn("kept", (F.col(f"posterior_{quality}") >= 0.5) & (F.col(f"posterior_{toxic}") < 0.5))
