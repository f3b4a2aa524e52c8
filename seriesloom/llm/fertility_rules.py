"""Quality rules on tokeniser fertility: characters per token, byte-fallback share and token entropy, with bands per language or script."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql import types as T

from seriesloom.llm.shared import free_name, in_arrow, keyed, stored, with_fields

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
_SYMBOLS = b"#*$%&|<>"
#: First code points of the blocks that tell scripts apart; each runs to the next.
_BLOCKS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"),
    (0x0900, "devanagari"), (0x0980, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
]
METRICS = ("chars_per_token", "fallback_share", "entropy")
MEASURES = T.StructType([
    T.StructField("n_words", T.LongType(), False),
    T.StructField("word_chars", T.LongType(), False),
    T.StructField("n_symbols", T.LongType(), False),
    T.StructField("n_dup_lines", T.LongType(), False),
    T.StructField("n_repeat_words", T.LongType(), False),
    T.StructField("n_tokens", T.LongType(), False),
    T.StructField("script", T.StringType(), False),
    *[T.StructField(m, T.DoubleType(), True) for m in METRICS],
])


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words in windows of ``width`` words that the text holds twice or more, the first included."""
    if len(words) <= width:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    total, key = len(words) - width + 1, None
    for k in range(width):  # windows of k + 1 words get numbers below their count, so keys never overflow
        part = ids[k : k + total]
        key = part if key is None else np.unique(key * np.int64(len(numbers)) + part, return_inverse=True)[1]
    often = np.bincount(key)[key] > 1
    marks = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(often)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + width, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def script_of(text: str) -> str:
    """The script of most letters beyond ASCII signs; ``none`` without a letter."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else "none"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = codes | 32
    codes = codes[(codes >= 0x80) | ((small >= 0x61) & (small <= 0x7A))]
    if not len(codes):
        return "none"
    block = np.searchsorted([b for b, _ in _BLOCKS], codes, "right") - 1
    counts: dict[str, int] = {}
    for i, n in enumerate(np.bincount(block, minlength=len(_BLOCKS)).tolist()):
        counts[_BLOCKS[i][1]] = counts.get(_BLOCKS[i][1], 0) + n
    return max(counts, key=lambda s: (counts[s], s))


class Meter:
    """Measures texts with one public vocabulary."""

    def __init__(self, model: bytes):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.fallback = np.array([self.pieces.is_byte(i) or self.pieces.is_unknown(i) for i in range(self.pieces.get_piece_size())])

    def tokens(self, words: list[bytes], step: int = 4096) -> np.ndarray:
        """Token numbers of the words, separated by one space. Tokens never span a space, so long texts are cut between words."""
        lines = [b" ".join(words[i : i + step]).decode("utf-8", "replace") for i in range(0, len(words), step)]
        return np.concatenate([np.array(x, np.int32) for x in self.pieces.encode(lines, num_threads=1)] or [np.empty(0, np.int32)])

    def measure(self, text: str | None) -> dict:
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.split()
        tokens = self.tokens(words)
        blanks = len(raw) - sum(map(len, words))
        chars = len(text or "") - blanks
        out = {
            "n_words": len(words), "word_chars": chars, "n_symbols": len(raw) - len(raw.translate(None, _SYMBOLS)), "n_dup_lines": duplicate_lines(raw),
            "n_repeat_words": repeat_words(words), "n_tokens": len(tokens), "script": script_of(text or ""), **dict.fromkeys(METRICS),
        }
        if len(tokens):
            counts = np.unique(tokens, return_counts=True)[1] / len(tokens)
            out["chars_per_token"] = chars / len(tokens)
            out["fallback_share"] = float(self.fallback[tokens].mean())
            out["entropy"] = float(-(counts * np.log(counts)).sum() / np.log(len(tokens))) if len(tokens) > 1 else 1.0
        return out


def with_measures(docs: DataFrame, text: str, name: str, keep_text: bool = True, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with a struct ``name`` of MEASURES (a column of that name is replaced). A null text counts as empty and has no fertility.

    The vocabulary file (0.5 MB) is read where the job is built and travels to the tasks.
    """
    with open(vocabulary, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    columns = [c for c in docs.columns if (keep_text or c != text) and c.lower() != name.lower()]
    schema = with_fields(docs.select(*[docs[c] for c in columns]), T.StructField(name, MEASURES, False))
    kind = pa.struct([(f.name, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.dataType.typeName()]) for f in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(model.value)
        for batch in batches:
            texts = batch.column(text)
            measures = [meter.measure(texts[i].as_py()) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(measures, kind)], schema.names)

    return in_arrow(docs, run, schema)


def _quartiles(cells: DataFrame, least: int, steps: int) -> DataFrame:
    """(scope, value, metric, q1, q2, q3) from rows (scope, value, metric, bin), counted before the shuffle."""
    counts = cells.groupBy("scope", "value", "metric", "bin").agg(F.count("*").alias("n"))
    group = W.partitionBy("scope", "value", "metric")  # a few thousand bins at most
    ranked = counts.withColumns({"upto": F.sum("n").over(group.orderBy("bin")), "total": F.sum("n").over(group)}).where(F.col("total") >= least)
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bin"))) / steps
    return ranked.groupBy("scope", "value", "metric").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))


def bands(measured: DataFrame, lang: str, name: str, width: float = 4.0, least: int = 50, steps: int = 400) -> DataFrame:
    """(scope, value, metric, low, high, center): accepted values per language, per script and over all, from all documents that pass the base.

    Quartiles are read from counts per 1/``steps`` of a metric, so they are the same however the rows are spread; a band reaches
    ``width`` interquartile ranges beyond them (of entropy and fallback share at least 0.05 each). Characters per token are judged by their
    distance from the scope's median times the root of the number of tokens, as short texts scatter more; their ``low`` and ``high``
    bound that product. Scopes of fewer than ``least`` documents give no band.
    """
    m = F.col(name)
    base = measured.where(~failed_base(name)).where(m["n_tokens"] > 0)
    scopes = F.array(
        F.struct(F.lit("lang").alias("scope"), F.col(lang).cast("string").alias("value")),
        F.struct(F.lit("script").alias("scope"), m["script"].alias("value")), F.struct(F.lit("all").alias("scope"), F.lit("").alias("value")),
    )
    base = base.select(F.explode(scopes).alias("s"), m["n_tokens"].alias("n_tokens"), *[m[x].alias(x) for x in METRICS]).select("s.*", "n_tokens", *METRICS)
    base = base.where(F.col("value").isNotNull())
    metrics = F.array(*[F.struct(F.lit(x).alias("metric"), F.round(F.col(x) * steps).cast("int").alias("bin")) for x in METRICS])
    plain = stored(_quartiles(base.select("scope", "value", F.inline(metrics)), least, steps), "quartiles")
    center = plain.where(F.col("metric") == METRICS[0]).select("scope", "value", F.col("q2").alias("center"))
    spread = base.join(center, ["scope", "value"]).withColumn("bin", F.round((F.col(METRICS[0]) - F.col("center")) * F.sqrt("n_tokens") * steps).cast("int"))
    spread = _quartiles(spread.select("scope", "value", F.lit(METRICS[0]).alias("metric"), "bin"), least, steps).join(center, ["scope", "value"])
    reach = width * (F.col("q3") - F.col("q1"))
    scaled = spread.select("scope", "value", "metric", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"), "center")
    reach = width * F.greatest(F.col("q3") - F.col("q1"), F.lit(0.05))
    rest = plain.where(F.col("metric") != METRICS[0])
    return scaled.unionByName(rest.select("scope", "value", "metric", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"), F.lit(None).cast("double").alias("center")))


def failed_base(name: str):
    m = F.col(name)
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def judged(measured: DataFrame, lang: str, name: str, low: str, kept: str, width: float = 4.0) -> DataFrame:
    """``measured`` with ``low`` (base failed) and ``kept``: the base passed and every metric lies in the narrowest scope's band.

    The scope is the language where it has a band, else the script, else all documents; without any band only the base decides.
    """
    m = F.col(name)
    found = bands(measured, lang, name, width).groupBy("scope", "value").agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct("low", "high", "center")))).alias("band"))
    # the band of every pair of language and script that occurs: its language's, else its script's, else that of all
    pairs = measured.select(F.col(lang).cast("string").alias("of_lang"), m["script"].alias("of_script")).distinct()
    order = (("lang", F.col("of_lang")), ("script", F.col("of_script")), ("all", F.lit("")))
    scopes = F.array(*[F.struct(F.lit(rank).alias("rank"), F.lit(scope).alias("scope"), value.alias("value")) for rank, (scope, value) in enumerate(order)])
    nearest = pairs.select("*", F.inline(scopes)).join(found, ["scope", "value"]).groupBy("of_lang", "of_script").agg(F.min_by("band", "rank").alias("band"))
    nearest = stored(nearest, "bands")
    of_lang, of_script, band_of = (free_name(measured, n) for n in ("of_lang", "of_script", "band"))
    nearest = nearest.toDF(of_lang, of_script, band_of)
    out = measured.join(nearest, F.col(lang).cast("string").eqNullSafe(F.col(of_lang)) & (m["script"] == F.col(of_script)), "left")
    band = F.col(band_of)
    inside = F.lit(True)
    for x in METRICS:
        judged_by = F.coalesce((m[x] - band[x]["center"]) * F.sqrt(m["n_tokens"]), m[x])
        inside &= F.coalesce(judged_by.between(band[x]["low"], band[x]["high"]), F.lit(True))
    return out.withColumns({low: failed_base(name), kept: ~failed_base(name) & inside}).drop(of_lang, of_script, band_of)


def quality_verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", width: float = 4.0) -> DataFrame:
    """One row of measures and verdict per row of ``docs``.

    Null and empty texts have no words and fail the base. A null language is judged by its script. Equal rows get equal verdicts.
    An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    measured = stored(with_measures(rows, "text", "m", keep_text=False), "measures")
    return judged(measured, "lang", "m", "base_failed", "kept", width).select("doc_id", "m.*", "base_failed", "kept")


def drop_low_quality(docs: DataFrame, text: str = "text", lang: str = "lang", width: float = 4.0) -> DataFrame:
    """The rows of ``docs`` that quality_verdicts keeps, unchanged.

    Texts move in one join, against the keys of the rejected rows; its plan is the same at every size.
    """
    key = free_name(docs, "row_key")
    rows = keyed(docs, key)
    short = rows.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    measured = stored(with_measures(short, "text", "m", keep_text=False), "measures")
    rejected = judged(measured, "lang", "m", "base_failed", "kept", width).where(~F.col("kept")).select(F.col("key").alias(key))
    return rows.join(stored(rejected, "rejected").hint("merge"), key, "left_anti").drop(key)
