from __future__ import annotations

from pyspark.sql import functions as F

from registered import joined, query, rounded
from registered.tables import place
from seriesloom.functions import domains, text
from seriesloom.operators import pairing, retrieval, tables, textindex, vectorindex
from seriesloom.operators.frames import attach
from seriesloom.plans.search import search_catalog as run_search

QUERY = "the rest of that and her region"


# The white space of the library as one character class.
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def toks(c: str) -> str:
    return f"list_transform(list_filter(regexp_split_to_array({c}, '{SPACE}'), lambda w: length(w) > 2), lambda w: lower(trim(w, '.,:;()[]')))"


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{SPACE}'), lambda w: w <> '')"


@query("tokenize", f"SELECT token, count(*) AS uses, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({toks('text')}) AS token FROM documents) GROUP BY 1")
def tokenize(t):
    tokens = text.token_rows(t("documents").select("doc_id", "text"), "text").select("doc_id", "token")
    per_doc = tokens.groupBy("token", "doc_id").agg(F.count("*").alias("c"))
    return per_doc.groupBy("token").agg(F.sum("c").alias("uses"), F.count("*").alias("docs"))


def _tfidf(table: str, id_column: str, c: str, q: str, limit: int) -> str:
    wanted = retrieval.query_tokens(q)
    values = ", ".join(f"('{w}')" for w in wanted)
    return f"""tk AS (SELECT {id_column} AS id, unnest({toks(c)}) AS token FROM {table}),
q AS (SELECT token, count(*) AS uses FROM (VALUES {values}) v(token) GROUP BY 1),
df AS (SELECT token, count(DISTINCT id) AS df FROM tk GROUP BY 1),
tf AS (SELECT id, token, count(*) AS tf FROM tk WHERE token IN (SELECT token FROM q) GROUP BY 1, 2),
sc AS (SELECT id, sum(uses * (1 + ln(tf)) * ln((1 + (SELECT count(*) FROM {table})) / (1 + df) + 1)) AS s FROM tf JOIN q USING (token) JOIN df USING (token) GROUP BY 1),
ranked AS (SELECT d.*, least(0.99, 0.55 + coalesce(s, 0) / greatest(1, (SELECT count(*) FROM df))) AS score FROM {table} d LEFT JOIN sc ON sc.id = d.{id_column} ORDER BY score DESC, d.{id_column} LIMIT {limit})"""


@query("rank_tfidf", f"WITH {_tfidf('documents', 'doc_id', 'text', QUERY, 25)} SELECT doc_id, lang, round(score, 6) AS score FROM ranked")
def rank_tfidf(t):
    out = retrieval.rank_tfidf(t("documents").select("doc_id", "lang", "text"), QUERY, "text", 25)
    return rounded(out.select("doc_id", "lang", "score"), 6, "score")


@query("search_text_index", f"WITH {_tfidf('documents', 'doc_id', 'text', QUERY, 25)} SELECT doc_id, lang, round(score, 6) AS score FROM ranked")
def search_text_index(t):
    """The same ranking from the stored index."""
    docs = t("documents").select("doc_id", "lang", "text")
    path = place(docs.sparkSession, "text-index")
    textindex.build_text_index(docs, path, "text")
    out = textindex.search_text_index(docs.sparkSession, path, docs, QUERY, 25)
    return rounded(out.select("doc_id", "lang", "score"), 6, "score")


HEX = "sha256(w)"


@query("hash_embedding", f"""WITH w AS (SELECT doc_id, unnest({words("replace(lower(text), '_', ' ')")}) AS w FROM documents),
h AS (SELECT doc_id, {HEX} AS h FROM w),
b AS (SELECT doc_id, ('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT % 384 AS bucket,
 CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END AS s FROM h),
v AS (SELECT doc_id, bucket, sum(s) AS v FROM b GROUP BY 1, 2)
SELECT doc_id, bucket, round(v / greatest(sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 1e-8), 6) AS weight FROM v QUALIFY v <> 0""")
def hash_embedding(t):
    return rounded(retrieval.hash_embedding(t("documents").select("doc_id", "text"), "text", "doc_id"), 6, "weight")


@query("vector_topk", """WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings),
c AS (SELECT label, p, avg(x) AS m FROM e GROUP BY 1, 2),
cn AS (SELECT label, sqrt(sum(m * m)) AS norm FROM c GROUP BY 1), vn AS (SELECT vec_id, sqrt(sum(x::DOUBLE * x)) AS norm FROM e GROUP BY 1),
s AS (SELECT c.label, e.vec_id, sum(c.m * e.x) / any_value(cn.norm * vn.norm) AS score FROM c JOIN e USING (p) JOIN cn ON cn.label = c.label JOIN vn ON vn.vec_id = e.vec_id GROUP BY 1, 2)
SELECT label, vec_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def vector_topk(t):
    vectors = t("embeddings")
    out = retrieval.vector_topk(vectors, retrieval.centroids(vectors, "label"), 5, "vec_id", "label")
    return rounded(out, 6, "score")


NEAREST = """WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings),
n AS (SELECT vec_id, sqrt(sum(x::DOUBLE * x)) AS norm FROM e GROUP BY 1),
s AS (SELECT q.vec_id AS asked, e.vec_id, sum(q.x::DOUBLE * e.x) / any_value(qn.norm * n.norm) AS score FROM e JOIN e q USING (p) JOIN n ON n.vec_id = e.vec_id JOIN n qn ON qn.vec_id = q.vec_id
 WHERE q.vec_id % 100 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id) AS rank FROM s)"""


def indexed_vectors(t):
    """The index of all embeddings, and as queries the rows whose id is divisible by 100."""
    vectors = t("embeddings")
    path = place(vectors.sparkSession, "vector-index")
    vectorindex.build_index(vectors, path, "vec_id")
    return vectors, path, vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("asked"), "embedding")


@query("vector_index_full", NEAREST + " SELECT asked, vec_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM r WHERE rank <= 10")
def vector_index_full(t):
    """All lists read: the exact answer."""
    vectors, path, asked = indexed_vectors(t)
    return rounded(vectorindex.search_index(vectors.sparkSession, path, asked, 10, "vec_id", "asked", probes=vectorindex.MOST_LISTS), 6, "score")


@query("vector_index", NEAREST + " SELECT count(*) AS wanted, true AS recalled, (SELECT count(*) FROM embeddings) AS indexed FROM r WHERE rank <= 10")
def vector_index(t):
    """As many lists read as the build found necessary: recall of at least 0.9 against the exact search, and every row in the index."""
    vectors, path, asked = indexed_vectors(t)
    found = vectorindex.search_index(vectors.sparkSession, path, asked, 10, "vec_id", "asked")
    exact = retrieval.vector_topk(vectors, asked, 10, "vec_id", "asked")
    indexed = vectorindex.read_lists(vectors.sparkSession, path).agg(F.count("*").alias("indexed"))
    return attach(vectorindex.recall(found, exact, "vec_id", "asked").select("wanted", (F.col("recall") >= 0.9).alias("recalled")), indexed)


SUBS = {d: s for d, s in domains.SUBSTRING_SIGNALS.items()}


def _by_substring(c: str) -> str:
    counts = {d: " + ".join(f"contains(lower({c}), '{s}')::INT" for s in sig) for d, sig in SUBS.items()}
    top = f"greatest({', '.join(counts.values())})"
    return f"CASE WHEN {top} = 0 THEN 'general' " + " ".join(f"WHEN {v} = {top} THEN '{d}'" for d, v in counts.items()) + " END"


def _by_tokens(c: str) -> str:
    bag = f"regexp_split_to_array(regexp_replace(lower({c}), '[^a-z0-9 ]', ' ', 'g'), ' +')"
    counts = {d: "len(list_intersect(bag, [" + ", ".join(f"'{s}'" for s in sig) + "]))" for d, sig in domains.TOKEN_SIGNALS.items()}
    top = f"greatest({', '.join(counts.values())})"
    return bag, f"CASE WHEN {top} = 0 THEN 'general' " + " ".join(f"WHEN {v} = {top} THEN '{d}'" for d, v in counts.items()) + " END"


BAG, BY_TOKENS = _by_tokens("text")


@query("infer_domain_substring", f"SELECT {_by_substring('text')} AS domain, count(*) AS docs, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM documents GROUP BY 1")
def infer_domain_substring(t):
    return t("documents").groupBy(domains.domain_by_substring(F.col("text")).alias("domain")).agg(F.count("*").alias("docs"), F.sum("doc_id").alias("id_sum"))


@query("infer_domain_tokens", f"""WITH b AS (SELECT doc_id, {BAG} AS bag FROM documents), d AS (SELECT doc_id, {BY_TOKENS} AS domain FROM b)
SELECT doc_id, domain, CASE domain {' '.join(f"WHEN '{d}' THEN '{u[0]}'" for d, u in domains.USE_CASES.items())} END AS use_case FROM d""")
def infer_domain_tokens(t):
    domain = domains.domain_by_tokens(F.col("text"))
    return t("documents").select("doc_id", domain.alias("domain")).withColumn("use_case", domains.use_case(F.col("domain"), True))


@query("looks_time_series", "SELECT doc_id, " + " OR ".join(f"contains(lower(text), '{w}')" for w in domains.TIME_SERIES_WORDS) + " AS is_time_series FROM documents")
def looks_time_series(t):
    return t("documents").select("doc_id", domains.looks_time_series(F.col("text")).alias("is_time_series"))


@query("tags_from_text", f"SELECT doc_id, array_to_string(list_concat([lang], list_slice(list_transform(list_filter(u, lambda x, i: list_position(u, x) = i), lambda x: replace(x, '_', '-')), 1, 5)), '|') AS tags FROM (SELECT doc_id, lang, list_transform({toks('text')}, lambda x: replace(x, '_', '-')) AS u FROM documents)")
def tags_from_text(t):
    return t("documents").select("doc_id", joined(retrieval.tags_from_text("text", F.col("lang"))).alias("tags"))


SLUG = "p_brand || CASE WHEN p_size > 25 THEN '__' ELSE '--' END || replace(p_name, ' ', '-') || '_' || p_type"


@query("slug_columns", f"""WITH f AS (SELECT p_partkey, p_brand AS owner, replace(p_name, ' ', '-') || '_' || p_type AS slug FROM part)
SELECT p_partkey, owner, slug, array_to_string(list_transform(list_filter(regexp_split_to_array(slug, '[-_]+'), lambda w: w <> ''), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS title FROM f""")
def slug_columns(t):
    mark = F.when(F.col("p_size") > 25, "__").otherwise("--")
    folder = F.concat("p_brand", mark, F.translate("p_name", " ", "-"), F.lit("_"), "p_type")
    return t("part").select("p_partkey", folder.alias("f")).select(
        "p_partkey", text.owner_of(F.col("f")).alias("owner"), text.slug_of(F.col("f")).alias("slug"), text.title_from_slug(text.slug_of(F.col("f"))).alias("title"))


@query("title_from_id", r"""SELECT p_partkey, array_to_string(list_transform(string_split(regexp_replace(p_name || ' sales', '[-_]', ' ', 'g'), ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS title FROM part""")
def title_from_id(t):
    ref = F.concat("p_brand", F.lit("/"), F.translate("p_name", " ", "-"), F.lit("_sales-dataset"))
    return t("part").select("p_partkey", text.title_from_id(ref).alias("title"))


# A catalog with one entry per document; copies from a second listing have a reference for some languages only.
CATALOG = """(SELECT 'd' || doc_id AS id, source AS title, text AS description, lang AS domain, [lang, source] AS tags, n_chars > 500 AS is_time_series, {ref} AS ref FROM documents)"""
FIRST, SECOND = CATALOG.format(ref="CASE WHEN lang = 'de' THEN 'a/' || doc_id END"), CATALOG.format(ref="CASE WHEN lang <> 'es' THEN 'b/' || doc_id END")
MERGED = f"(SELECT * EXCLUDE (o) FROM (SELECT 0 AS o, * FROM {FIRST} UNION ALL SELECT 1, * FROM {SECOND}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY ref IS NULL, o) = 1)"


def catalogs(t):
    base = t("documents").select(
        F.concat(F.lit("d"), "doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("description"), F.col("lang").alias("domain"),
        F.array("lang", "source").alias("tags"), (F.col("n_chars") > 500).alias("is_time_series"), "doc_id")
    first = base.withColumn("ref", F.when(F.col("domain") == "de", F.concat(F.lit("a/"), "doc_id"))).drop("doc_id")
    second = base.withColumn("ref", F.when(F.col("domain") != "es", F.concat(F.lit("b/"), "doc_id"))).drop("doc_id")
    return first, second


@query("merge_catalogs", f"SELECT id, title, domain, is_time_series, ref FROM {MERGED}")
def merge_catalogs(t):
    return pairing.merge_catalogs(*catalogs(t)).select("id", "title", "domain", "is_time_series", "ref")


@query("catalog_filter", "SELECT doc_id, lang FROM documents WHERE lang = 'en' AND n_chars > 500")
def catalog_filter(t):
    catalog = t("documents").select("doc_id", "lang", F.col("lang").alias("domain"), (F.col("n_chars") > 500).alias("is_time_series"))
    return tables.catalog_filter(catalog, "en", True).select("doc_id", "lang")


@query("catalog_text_filter", "SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'region') OR contains(lower(lang), 'region') OR contains(lower(source), 'src7')  OR contains(lower(source), 'region')")
def catalog_text_filter(t):
    catalog = t("documents").withColumn("tags", F.array("source", "lang"))
    hits = tables.catalog_text_filter(catalog, "Region", ["text", "lang"], "tags")
    return hits.unionByName(tables.catalog_text_filter(catalog, "SRC7", [], "tags")).select("doc_id", "lang", "source").distinct()


SEARCHED = "(SELECT *, title || ' ' || description || ' ' || array_to_string(tags, ' ') || ' ' || domain AS _text FROM {m} WHERE domain = 'en' AND is_time_series)"


@query("search_catalog", f"WITH cat AS {SEARCHED.format(m=MERGED)}, {_tfidf('cat', 'id', '_text', QUERY, 10)} SELECT id, domain, ref, round(score, 6) AS score FROM ranked")
def search_catalog(t):
    out = run_search(*catalogs(t), query=QUERY, domain="en", time_series_only=True, limit=10)
    return rounded(out.select("id", "domain", "ref", "score"), 6, "score")
