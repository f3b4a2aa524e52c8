"""Language identification by mixture inference.

Character trigrams of letters (with word ends) give each span of a few words a likelihood under every language. Expectation-
maximisation estimates the languages' proportions in a document; the set of languages grows along their estimated proportions for
as long as the penalised likelihood rises.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from seriesloom.llm.shared import in_arrow, row_slices, with_fields

BUCKETS = 1 << 16
_PIECE = 2 << 20
MIXTURE = T.StructType([
    T.StructField("lang", T.StringType(), False),
    T.StructField("share", T.DoubleType(), False),
    T.StructField("languages", T.MapType(T.StringType(), T.DoubleType()), False),
])


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram bucket, text number and word number of every letter of the lower-cased texts."""
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer("".join(f"{t}\n" for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    at = np.flatnonzero(letter)
    known = np.where(letter, codes, 0).astype(np.uint32)
    before, after = known[at - 1], known[at + 1]  # the line end behind each text is no letter, also before the first
    mixed = before * np.uint32(0x9E3779B1) + known[at] * np.uint32(0x85EBCA77) + after * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    bucket = ((mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(16)).astype(np.int64)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in low), np.int64, len(low)))
    return bucket, np.searchsorted(ends, at, "right"), np.cumsum(before == 0) - 1


def gram_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, bucket, n) over all rows with a language, counted in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0), batch.column(1)
            for a, b in row_slices(texts, _PIECE):
                names = langs.slice(a, b - a).to_pylist()
                bucket, doc, _ = grams(texts.slice(a, b - a).to_pylist())
                for name in {x for x in names if x is not None}:
                    mine = np.fromiter((x == name for x in names), bool, len(names))
                    counts.setdefault(name, np.zeros(BUCKETS, np.int64))
                    counts[name] += np.bincount(bucket[mine[doc]], minlength=BUCKETS)
        for name, n in counts.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(n[used])], ["lang", "bucket", "n"])

    counted = in_arrow(docs.select(text, lang), run, "lang string, bucket int, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Log-likelihood of each bucket under each language; languages in the order of their size in training."""

    languages: list[str]
    log_likelihood: np.ndarray


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.5) -> Model:
    """Smoothed trigram likelihoods from all rows with a language. The model holds 256 KB per language, whatever the input."""
    rows = gram_counts(docs, text, lang).toPandas()
    totals = rows.groupby("lang")["n"].sum()
    languages = sorted(totals.index, key=lambda x: (-totals[x], x))
    table = np.full((BUCKETS, len(languages)), smoothing)
    np.add.at(table, (rows["bucket"].to_numpy(np.int64), rows["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64)), rows["n"].to_numpy())
    return Model(languages, np.log(table / table.sum(axis=0)).astype(np.float32))


def _expect(weights: np.ndarray, doc: np.ndarray, cuts: np.ndarray, shares: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM on the spans' scaled likelihoods; gives the documents' shares and log-likelihoods (up to the scale)."""
    sizes = np.diff(np.append(cuts, len(doc)))[:, None]
    for _ in range(rounds):
        joint = weights * shares[doc]
        joint /= joint.sum(axis=1, keepdims=True) + 1e-30
        shares = np.add.reduceat(joint, cuts, axis=0) / sizes
    total = np.log((weights * shares[doc]).sum(axis=1) + 1e-30, dtype=np.float64)
    return shares, np.add.reduceat(total, cuts)


def mixtures(texts: list[str | None], model: Model, span_words: int = 5, rounds: int = 12, penalty: float = 3.0) -> list[np.ndarray | None]:
    """Language shares of each text; None without a letter."""
    out: list[np.ndarray | None] = [None] * len(texts)
    bucket, doc, word = grams(texts)
    if not len(bucket) or not model.languages:
        return out
    new_doc = np.concatenate(([True], doc[1:] != doc[:-1]))
    first_word = word[np.flatnonzero(new_doc)][np.cumsum(new_doc) - 1]
    span = (word - first_word) // span_words
    head = np.flatnonzero(new_doc | np.concatenate(([True], span[1:] != span[:-1])))
    likely = np.add.reduceat(model.log_likelihood[bucket], head, axis=0)
    scale = likely.max(axis=1)
    weights = np.exp(likely - scale[:, None])
    doc = doc[head]
    cuts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    owners, sizes = doc[cuts], np.diff(np.append(cuts, len(doc)))
    local = np.repeat(np.arange(len(owners)), sizes)
    k = len(model.languages)
    shares, _ = _expect(weights, local, cuts, np.full((len(owners), k), 1 / k, np.float32), rounds)
    ranks = np.argsort(-shares, axis=1, kind="stable")
    # sets of one language need no EM
    single = np.add.reduceat(likely.astype(np.float64) - scale[:, None], cuts, axis=0)
    top = np.argmax(single, axis=1)
    best, score = np.zeros_like(shares), single[np.arange(len(owners)), top]
    best[np.arange(len(owners)), top] = 1
    growing = np.flatnonzero(sizes > 1)
    for n in range(2, k + 1):
        if not len(growing):
            break
        rows = np.isin(local, growing)
        mine = np.searchsorted(growing, local[rows])
        start = np.zeros((len(growing), k), np.float32)
        np.put_along_axis(start, ranks[growing, :n], 1 / n, axis=1)
        grown, fit_ = _expect(weights[rows], mine, np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1]))), start, rounds)
        cost = penalty * np.log(sizes[growing])
        better = fit_ - cost * (n - 1) > score[growing]
        growing = growing[better]
        best[growing], score[growing] = grown[better], (fit_ - cost * (n - 1))[better]
    for i, owner in enumerate(owners.tolist()):
        out[owner] = best[i]
    return out


def with_language(docs: DataFrame, model: Model, text: str = "text", name: str = "language", keep_text: bool = True, **options) -> DataFrame:
    """``docs`` with a struct ``name`` of MIXTURE (a column of that name is replaced): the leading language, its share, and the shares of all languages of the set.

    A null text, a text without a letter, and any text where no language was learned give ``und``, share 0 and no languages.
    Equally likely languages go to the one with more training text. Whole texts are read, in pieces of about 2 MB of documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if (keep_text or c != text) and c.lower() != name.lower()]
    schema = with_fields(docs.select(*[docs[c] for c in columns]), T.StructField(name, MIXTURE, False))
    kind = pa.struct([("lang", pa.string()), ("share", pa.float64()), ("languages", pa.map_(pa.string(), pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts, found = batch.column(text), []
            for a, b in row_slices(texts, _PIECE):
                for x in mixtures(texts.slice(a, b - a).to_pylist(), model, **options):
                    if x is None:
                        found.append({"lang": "und", "share": 0.0, "languages": []})
                    else:
                        i = int(np.argmax(x))
                        found.append({"lang": model.languages[i], "share": min(1.0, float(x[i])), "languages": [(model.languages[j], float(x[j])) for j in np.flatnonzero(x > 1e-4).tolist()]})
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(found, kind)], schema.names)

    return in_arrow(docs, run, schema)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4
