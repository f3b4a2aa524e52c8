"""Queries of the operators over the test tables, and the SQL they must agree with where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a table reader ``t(name) -> DataFrame`` under its own name."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__doc__ = fn.__doc__
        QUERIES[fn.__name__] = run
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return wrap


@query()
def op1_language_mixture(t):
    """Language of every document, learned from three quarters of them."""
    from seriesloom.llm.language_mixture import fit, fold, with_language

    docs = t("documents")
    held_out = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False))
    model = fit(docs.where(~held_out))
    found = with_language(docs.select("doc_id", "text"), model, keep_text=False)
    return found.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.share").alias("score"), F.size("language.languages").alias("n_languages"))


@query()
def op2_entropy_mixing(t):
    """All documents with the words that the mix takes of each."""
    from seriesloom.llm.entropy_mixing import mixed

    rows = mixed(t("documents"))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")


OP4 = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS hex FROM p),
bits AS (SELECT hex, string_agg(right('000' || to_base(strpos('0123456789abcdef', substr(hex, i, 1)) - 1, 2), 4), '' ORDER BY i) AS b FROM (SELECT DISTINCT hex FROM d), range(1, 41) r(i) GROUP BY hex),
coded AS (SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(b, i, 1)::INT + 8 * substr(b, i + 1, 1)::INT + 4 * substr(b, i + 2, 1)::INT + 2 * substr(b, i + 3, 1)::INT + substr(b, i + 4, 1)::INT, 1), '' ORDER BY i) AS digest FROM bits, range(1, 160, 5) r(i) GROUP BY hex),
firsts AS (SELECT hex, min(page_id) AS first FROM d GROUP BY hex)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, true AS intact
FROM d JOIN coded USING (hex) JOIN firsts USING (hex)
"""


@query(OP4)
def op4_warc_chunks(t):
    """Every page as it is read back from the archives."""
    from seriesloom.llm.warc_chunks import read_chunks, records, write_archives

    pages = t("pages")
    found = records(read_chunks(pages.sparkSession, write_archives(pages)))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


OP3 = r"""
WITH folded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), places AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM folded, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), found AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, win)),
words AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM found),
hits AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM folded LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query(OP3)
def op3_benchmark_decontamination(t):
    """Hit words and found items of every document."""
    from seriesloom.llm.fm_decontaminate import with_benchmark_spans

    found = with_benchmark_spans(t("documents").select("doc_id", "text"), t("benchmark"))
    hit, words = F.col("found.n_hit"), F.col("found.n_words")
    return found.select(
        "doc_id", words.alias("n_words"), hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), ((hit > 0) & (20 * hit >= words)).alias("contaminated"),
    )


@query()
def op5_simhash_near_dedup(t):
    """Fingerprint and component of every document."""
    from seriesloom.llm.covering_simhash import near_groups

    return near_groups(t("documents"))


@query()
def op6_hierarchical_quality(t):
    """Posteriors of quality and toxicity of every document, by source and language."""
    from seriesloom.llm.hierarchical_quality import quality_posteriors

    return quality_posteriors(t("documents"), t("labels"))


@query()
def op7_tokeniser_fertility(t):
    """Measures and verdict of every document."""
    from seriesloom.llm.fertility_rules import quality_verdicts

    return quality_verdicts(t("documents"))


@query()
def op8_separator_scan(t):
    """Tokens of every document, counted from flat token files."""
    from seriesloom.llm.separator_scan import token_counts

    return token_counts(t("documents")).select("doc_id", "ordinal", "start", "n_tokens")


@query()
def op9_suffix_array_dedup(t):
    """Repeated passages of 50 words or more in every document, and what of them stands elsewhere before."""
    from seriesloom.llm.sparse_suffix import repeated_passages

    return repeated_passages(t("documents"))


@query()
def op10_masked_pseudo_likelihood(t):
    """Pseudo-likelihood of every document under a network trained on all of them."""
    from seriesloom.llm.pseudo_likelihood import pseudo_likelihoods

    return pseudo_likelihoods(t("documents"))


OP11 = r"""
WITH t AS (
  SELECT conv_id, sha256(sha256(coalesce(role, '')) || coalesce(text, '')) AS symbol, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  SELECT conv_id, xor(list_reduce([4294967295::BIGINT] || [ascii(x)::BIGINT for x in string_split(conv_id::VARCHAR, '')],
    lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) AS crc
  FROM (SELECT DISTINCT conv_id FROM t)
), c AS (
  SELECT conv_id, crc % 4 AS h, (SELECT count(*) FROM t WHERE t.conv_id = crc.conv_id - crc.conv_id % 20 AND pos <= crc.crc % 4) AS m FROM crc
), turns AS (
  SELECT c.conv_id, pos AS depth, symbol, words FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND pos <= h
  UNION ALL SELECT c.conv_id, m + pos - h, symbol, words FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h
), p AS (
  SELECT conv_id, depth, words, sha256(string_agg(symbol, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), lengths AS (SELECT conv_id, max(depth) AS length FROM p GROUP BY conv_id),
nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE depth = length), '')) AS ends
  FROM p JOIN lengths USING (conv_id) GROUP BY node, depth
), up AS (SELECT n.node, u.node AS parent, u.conv_id AS parent_conv_id FROM nodes n JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 JOIN nodes u ON u.node = p.node),
children AS (SELECT parent AS node, count(*) AS n_children FROM up GROUP BY parent),
below AS (
  SELECT a.node, count(*) FILTER (WHERE coalesce(n_children, 0) = 0) AS n_leaves, sum((n_convs - 1) * n.words) AS saved
  FROM nodes n LEFT JOIN children USING (node) JOIN p a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.node
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved::BIGINT AS saved_tokens, ends AS ends_sha256
FROM nodes LEFT JOIN up USING (node) LEFT JOIN children USING (node) JOIN below USING (node)
"""


@query(OP11)
def op11_conversation_trie(t):
    """Every distinct beginning of the rebuilt conversations."""
    from seriesloom.llm.zfast_trie import prefix_digests, spliced, trie_nodes

    conv = F.col("conv_id")
    return trie_nodes(*spliced(prefix_digests(t("conversations")), conv - conv % 20, F.crc32(conv.cast("string")) % 4, 3))


@query()
def op12_weak_toxicity(t):
    """Toxicity of every document, learned from the labels of three quarters of them."""
    from seriesloom.llm.weak_toxicity import fit, with_score

    docs = t("documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs, t("labels"), learn_from=~held_out)
    found = with_score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS own
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, list_inner_product(a.own, r.own)::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


@query(OP13)
def op13_hard_negatives(t):
    """Hard negatives of every positive of every fiftieth vector."""
    from seriesloom.llm.hard_negatives import hard_negatives

    rows = t("embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def add_pipeline(run, sql: str | None) -> None:
    """Register the pipeline, whose module lies at the top of the repository."""
    QUERIES["pipeline"] = run
    if sql:
        ORACLES["pipeline"] = sql
