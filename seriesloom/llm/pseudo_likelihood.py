"""Masked pseudo-likelihood: a window network predicts every word from the words on both sides; the summed log-probabilities score a text.

Words are numbered by their count over the whole corpus; rarer ones share hashed numbers, whose count grows with the corpus. A number is a
class and a member, and its probability is that of the class times that of the member in the class, each a softmax of the hidden vector on
top of the corpus frequencies. The probability of a word that shares its number is that of the number times the word's part of the
number's count, which comes from the table of all words by a join. The hidden vector is tanh of the neighbours' vectors, weighted by place. Every task trains a copy of the network with numpy
on all its texts; the copies are averaged by their number of words.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from seriesloom.llm.shared import free_name, in_arrow, row_slices, stored

LEAST_SIDE = 32  # classes, and members of a class
SIDE = 3  # neighbours on each side
WIDTH = 16
_PIECE = 1 << 20


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of ``words_of`` of all texts in a row, and the text of each."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    words = lists.flatten()
    full = pc.greater(pc.binary_length(words), 0)  # blanks at either end of a text leave an empty word there
    return words.filter(full).cast(pa.binary()), pc.list_parent_indices(lists).filter(full).to_numpy().astype(np.int64)


def as_bytes(words: pa.Array) -> list[bytes]:
    return words.to_numpy(zero_copy_only=False).tolist()


def word_table(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) over all texts, counted in each task, piece by piece, before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            for a, b in row_slices(texts, 8 * _PIECE):
                found = split_words(texts.slice(a, b - a))[0].value_counts()
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])

    return in_arrow(docs.select(text), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def side_of(tokens: int) -> int:
    """Classes, and members of each, for a corpus of so many words: the numbers grow as the cube root of the corpus."""
    return max(LEAST_SIDE, round(2 * tokens ** (1 / 6)))


@dataclass
class Encoder:
    """Word to number; rare words have the slot of their hash."""

    numbers: dict[bytes, int]
    common: int
    slots: int

    def encode(self, words: list[bytes]) -> np.ndarray:
        own = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int32, len(words))
        hashed = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % np.uint32(self.slots)
        return np.where(own < 0, self.common + hashed.astype(np.int32), own)


@dataclass
class Vocabulary:
    """Three quarters of the numbers are words of their own, the others slots; ``table`` holds the counts of all words and stays on the driver."""

    numbers: dict[bytes, int]
    counts: np.ndarray
    table: DataFrame | None = None

    @property
    def common(self) -> int:
        return len(self.counts) * 3 // 4

    def sent(self) -> Vocabulary:
        return replace(self, table=None)

    def encode(self, words: list[bytes]) -> np.ndarray:
        return self.encoder().encode(words)

    def encoder(self) -> Encoder:
        return Encoder(self.numbers, self.common, len(self.counts) - self.common)

    def shares(self) -> np.ndarray:
        """What the log-probability of each number loses for a word that was seen once or never: its part of the slot's count, to which
        one is added for all unseen words."""
        loss = np.zeros(len(self.counts) + 1)
        loss[self.common : -1] = -np.log(self.counts[self.common :] + 0.5)
        return loss


def vocabulary(docs: DataFrame, text: str = "text") -> Vocabulary:
    """Numbers of the most common words (ties: by bytes) and the corpus counts of all numbers."""
    table = stored(word_table(docs, text), "words")
    units = side_of(table.agg(F.sum("n")).first()[0] or 0) ** 2
    own, slots = units * 3 // 4, units - units * 3 // 4
    common = table.orderBy(F.desc("n"), "word").limit(own).collect()
    numbers = {bytes(r.word): i for i, r in enumerate(common)}
    counts = np.zeros(units)
    for r in table.groupBy((F.crc32("word") % slots).alias("slot")).agg(F.sum("n").alias("n")).collect():
        counts[own + r.slot] = r.n
    for r in common:
        counts[numbers[bytes(r.word)]] = r.n
        counts[own + zlib.crc32(bytes(r.word)) % slots] -= r.n
    return Vocabulary(numbers, counts + 0.5, table)


class Network:
    """Parameters in one flat vector: neighbours' vectors (one more for the text's edge), weights of the places, output weights."""

    def __init__(self, counts: np.ndarray, flat: np.ndarray | None = None):
        self.units, self.side = len(counts), math.isqrt(len(counts))
        # places of the text run along the last axis everywhere, so that sums and maxima over classes are sums of whole rows
        shapes = ((WIDTH, self.units + 1), (2 * SIDE, WIDTH), (WIDTH, 2 * self.side))
        if flat is None:
            draw = np.random.default_rng(7)
            flat = np.concatenate([(draw.standard_normal(s) * 0.1 + (k == 1)).ravel() for k, s in enumerate(shapes)])
        self.flat = flat.astype(np.float32)
        cuts = np.cumsum([0] + [a * b for a, b in shapes])
        self.vectors, self.places, self.out = (self.flat[a:b].reshape(s) for a, b, s in zip(cuts, cuts[1:], shapes))
        by_class = counts.reshape(self.side, self.side)
        self.class_base = np.log(by_class.sum(axis=1) / by_class.sum()).astype(np.float32)[:, None]
        self.member_base = np.ascontiguousarray(np.log(by_class / by_class.sum(axis=1, keepdims=True)).astype(np.float32).T)

    def hidden(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of a stretch of numbers and the hidden vectors of all but its SIDE first and last places."""
        vectors, n = np.take(self.vectors, ids, axis=1), len(ids) - 2 * SIDE
        total = np.zeros((WIDTH, n), np.float32)
        for k, shift in enumerate(self.shifts()):
            total += vectors[:, shift : shift + n] * self.places[k][:, None]
        return vectors, np.tanh(total, out=total)

    @staticmethod
    def shifts() -> list[int]:
        return [s for s in range(2 * SIDE + 1) if s != SIDE]

    def log_probabilities(self, ids: np.ndarray, softmax: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Log-probability of every place of the stretch but its edges; also the two softmaxes (if asked for) and what they come from."""
        vectors, hidden = self.hidden(ids)
        target = ids[SIDE:-SIDE]
        # the text's edge stands for no word; its log-probability is ignored by all callers
        of_class, member = np.minimum(target // self.side, self.side - 1), target % self.side
        scores = self.out.T @ hidden
        scores[: self.side] += self.class_base
        scores[self.side :] += np.take(self.member_base, of_class, axis=1, mode="clip")
        columns, found = np.arange(len(target)), 0.0
        for part, right in ((scores[: self.side], of_class), (scores[self.side :], member)):
            part -= part.max(axis=0)
            found = found + part[right, columns]
            np.exp(part, out=part)
            total = part.sum(axis=0)
            found = found - np.log(total)
            if softmax:
                part *= 1 / total
        return found, scores, hidden, vectors

    def train(self, ids: np.ndarray, squares: np.ndarray, rate: float) -> None:
        """One AdaGrad step on a stretch."""
        _, error, hidden, vectors = self.log_probabilities(ids, softmax=True)
        target, n = ids[SIDE:-SIDE], len(ids) - 2 * SIDE
        real = target < self.units
        columns = np.arange(n)
        error[np.minimum(target // self.side, self.side - 1), columns] -= 1
        error[self.side + target % self.side, columns] -= 1
        error *= (real / max(1, real.sum())).astype(np.float32)
        back = (self.out @ error) * (1 - hidden * hidden)
        of_places, of_vectors = np.zeros_like(self.places), np.zeros_like(vectors)
        for k, shift in enumerate(self.shifts()):
            of_places[k] = np.einsum("ji,ji->j", back, vectors[:, shift : shift + n])
            of_vectors[:, shift : shift + n] += back * self.places[k][:, None]
        gathered = np.stack([np.bincount(ids, of_vectors[j], self.units + 1) for j in range(WIDTH)])
        gradient = np.concatenate([gathered.ravel(), of_places.ravel(), (hidden @ error.T).ravel()]).astype(np.float32)
        squares += gradient * gradient
        self.flat -= rate * gradient / np.sqrt(squares)


def stretches(column: pa.Array, units: int, encoder: Encoder, tails: list[tuple[pa.Array, pa.Array]] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers, row) of the words of a column; SIDE edge signs stand before and behind each text, with row -1.

    ``tails`` receives for each stretch the words without a number of their own and how often each stands, as lists by text.
    """
    for a, b in row_slices(column, _PIECE):
        words, of = split_words(column.slice(a, b - a))
        words = words.dictionary_encode()
        at, own = words.indices.to_numpy(), encoder.encode(as_bytes(words.dictionary))
        ids, rows = np.full(len(of) + SIDE * (b - a + 1), units, np.int32), np.full(len(of) + SIDE * (b - a + 1), -1, np.int64)
        places = np.arange(len(of)) + SIDE * (of + 1)
        ids[places], rows[places] = own[at], of + a
        if tails is not None:
            rare, many = own[at] >= encoder.common, max(1, len(own))
            found, times = np.unique(of[rare] * many + at[rare], return_counts=True)
            ends = pa.array(np.searchsorted(found, np.arange(b - a + 1) * many), pa.int32())
            tail = words.dictionary.take(pa.array(found % many, pa.int64()))
            tails.append((pa.ListArray.from_arrays(ends, tail), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))))
        yield ids, rows


def train(docs: DataFrame, words: Vocabulary, text: str = "text", step: int = 4096, rate: float = 0.1) -> np.ndarray:
    """Parameters trained on all texts: one pass in every task, then the mean weighted by the tasks' words.

    The tasks' parameters are written to the shared folder and summed place by place with map-side aggregation; the driver receives
    one vector.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words.sent())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        net, encoder = Network(words.counts), words.encoder()
        squares, seen = np.full_like(net.flat, 1e-7), 0
        for batch in batches:
            for ids, rows in stretches(batch.column(0), net.units, encoder):
                for k in range(0, len(ids) - 2 * SIDE, step):
                    net.train(ids[k : k + step + 2 * SIDE], squares, rate)
                seen += int((rows >= 0).sum())
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([net.flat], pa.list_(pa.float32()))], ["seen", "flat"])

    copies = stored(in_arrow(docs.select(text), run, "seen double, flat array<float>"), "networks")
    sums = copies.select("seen", F.posexplode("flat").alias("at", "x")).groupBy("at").agg((F.sum(F.col("seen") * F.col("x")) / F.sum("seen")).alias("x")).orderBy("at").collect()
    return np.array([r.x for r in sums], np.float32) if sums else Network(words.counts).flat


SCORES = [T.StructField("n_tokens", T.LongType(), False), T.StructField("log_likelihood", T.DoubleType(), False)]
#: Words without a number of their own, and how often each stands in the text.
_TAIL = [T.StructField("tail", T.ArrayType(T.BinaryType())), T.StructField("times", T.ArrayType(T.LongType()))]


def scored(docs: DataFrame, words: Vocabulary, flat: np.ndarray, text: str = "text", step: int = 16_384) -> DataFrame:
    """The table without its text, with n_tokens and log_likelihood, the sum over all words of the whole text.

    A word with a slot has the slot's probability times n / (N + 1), where n and N are the counts of the word and of the slot in the
    training corpus; words unseen there have 1 / (N + 1) together, which each of them gets.
    """
    shared = docs.sparkSession.sparkContext.broadcast((words.sent(), flat))
    key = free_name(docs, "row")
    rest = [key, *(c for c in docs.columns if c != text)]
    docs = docs.withColumn(key, F.monotonically_increasing_id())
    schema = T.StructType([*(docs.schema[c] for c in rest), *SCORES, *_TAIL])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, flat = shared.value
        net, shares, encoder = Network(words.counts, flat), words.shares(), words.encoder()
        for batch in batches:
            column = batch.column(text)
            total, count, tails = np.zeros(len(column)), np.zeros(len(column), np.int64), []
            for ids, rows in stretches(column, net.units, encoder, tails):
                for k in range(0, len(ids) - 2 * SIDE, step):
                    found = net.log_probabilities(ids[k : k + step + 2 * SIDE])[0] + shares[ids[k + SIDE : k + step + SIDE][: len(ids) - 2 * SIDE - k]]
                    owner = rows[k + SIDE : k + SIDE + len(found)]
                    real = owner >= 0
                    total += np.bincount(owner[real], found[real], len(column))
                    count += np.bincount(owner[real], minlength=len(column))
            tail, times = (pa.concat_arrays([pa.array([], kind), *lists]) for kind, lists in zip((pa.list_(pa.binary()), pa.list_(pa.int64())), zip(*tails) if tails else ((), ())))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(count), pa.array(total), tail, times], schema.names)

    # written, as the rows' numbers must not change between the sums and what they are added to
    base = stored(in_arrow(docs, run, schema), "scores")
    tail = base.select(F.col(key).alias("at"), F.explode(F.arrays_zip("tail", "times")).alias("t")).select("at", F.col("t.tail").alias("word"), "t.times")
    # hashed, not sorted: a word stands once in the table, so its partitions are even and small
    parts = tail.join(words.table.where("n > 1").hint("shuffle_hash"), "word").groupBy("at").agg(F.sum(F.col("times") * F.log("n")).alias("gain"))
    whole = base.drop("tail", "times").join(parts, F.col(key) == F.col("at"), "left")
    return whole.withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("gain", F.lit(0.0))).drop(key, "at", "gain")


def pseudo_likelihoods(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, per_token) for every row of ``docs``, by a network trained on all of them.

    Null and empty texts have no tokens, log-likelihood 0 and a null ``per_token``. Repeated rows are trained on and scored like any
    other. An empty table gives no rows. As every task trains a copy of its own, scores depend a little on how the table is partitioned.
    """
    words = vocabulary(docs, text)
    flat = train(docs, words, text)
    found = scored(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words, flat)
    return found.withColumn("per_token", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
