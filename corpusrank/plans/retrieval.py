"""Queries of the retrieval operators over whole tables, and the SQL that says the same.

The corpus is ``wiki_docs``; its stated queries are the turns of ``query_log`` whose id is divisible by 20.
"""

from __future__ import annotations

import re as _re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusrank.functions import text as t
from corpusrank.operators import checks, context, diffusion, fusion, lexical, linkgraph, metrics, oplog, vectors
from corpusrank.plans import ladder
from corpusrank.shared import materialise, spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# --- inputs ------------------------------------------------------------------------------------------------------------


def docs_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "wiki_docs")


def log_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_log").dropDuplicates(["id"])


def asked_of(spark: SparkSession, d: str, every: int = 20) -> DataFrame:
    """The logged queries whose id is divisible by ``every``."""
    log = log_of(spark, d).where(f"id % {every} = 0")
    usable = F.col("query_vector").isNotNull() & (F.size("query_vector") > 0) & F.forall("query_vector", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("query_vector", lambda x: x != 0)
    return log.select(F.col("id").alias("query_id"), "query", F.when(usable, F.col("query_vector")).alias("vector"))


def chunks_of(spark: SparkSession, d: str) -> DataFrame:
    """The newest version of each chunk, with a vector of as many numbers as it says."""
    whole = spread(table(spark, d, "chunks")).where("vector is not null and size(vector) = dims")
    newest = whole.groupBy("page_id", "chunk_index").agg(F.max("id").alias("id")).select("id")
    return whole.join(newest, "id", "left_semi").select("page_id", "chunk_index", "id", "heading_path", "text", "vector")


def mentions_of(spark: SparkSession, d: str) -> DataFrame:
    """(entity, key, tf) with deliveries counted once and paths in one spelling."""
    rows = table(spark, d, "mentions").select("mention_id", "entity", "doc_path", "tf")
    once = rows.where("mention_id is not null").dropDuplicates(["mention_id"]).unionAll(rows.where("mention_id is null"))
    once = once.where("tf > 0 and entity is not null and doc_path is not null")
    same = lambda c: F.concat(F.regexp_replace(F.lower(F.trim(t.normal_path(F.col(c)))), r"\.md$", ""), F.lit(".md"))
    return once.groupBy(same("entity").alias("entity"), F.col("doc_path").alias("key")).agg(F.sum("tf").alias("tf"))


def six(*columns: str):
    return [F.round(c, 6).alias(c) for c in columns]


# --- SQL pieces ----------------------------------------------------------------------------------------------------------

_TERMS = r"list_filter(string_split_regex(strip_accents(lower(coalesce({}, ''))), '[^\p{{L}}\p{{N}}\p{{Co}}]+'), lambda x: x <> '')"
_NAME = r"regexp_extract(replace({}, '\', '/'), '[^/]*$')"
_STEM = r"(CASE WHEN lower({0}) LIKE '%.md' THEN regexp_replace({0}, '(?i)\.md$', '') ELSE regexp_replace({0}, '\.[^.]*$', '') END)"
_STEM_OF = lambda p: _STEM.format(_NAME.format(p))
_HEADS = r"array_to_string(list_transform(list_filter(string_split(coalesce(content, ''), chr(10)), lambda l: trim(l) LIKE '#%'), lambda l: trim(regexp_replace(trim(l), '^#+', ''))), chr(10))"
_SEP = r"[\s!-/:-@\[-`{-~，。！？、；：“”‘’（）·～…]".replace("'", "''")
_STOPS = ", ".join(f"'{w}'" for w in t.STOP_WORDS)
_ALIAS = r"lower(replace(regexp_replace(replace(trim(string_split({}, '#')[1]), '\', '/'), '(?i)\.md$', ''), ' ', '-'))"

_ASKED = "asked AS (SELECT DISTINCT ON (id) id AS query_id, query, query_vector AS v FROM query_log WHERE id % 20 = 0)"
# Distinct tokens in order of their first place; CJK tokens are widened.
_QTOKENS = f"""raw AS (
  SELECT query_id, query, unnest(string_split_regex(lower(coalesce(query, '')), '{_SEP}+')) AS token, generate_subscripts(string_split_regex(lower(coalesce(query, '')), '{_SEP}+'), 1) AS i FROM asked
), wide AS (
  SELECT query_id, i, token AS w0, unnest(CASE WHEN regexp_matches(token, '{t.CJK}') AND length(token) > 2 THEN list_concat(list_transform(range(1, length(token)), lambda k: substr(token, k, 2)), list_filter(list_transform(range(1, length(token) + 1), lambda k: substr(token, k, 1)), lambda c: c NOT IN ({_STOPS})), [token]) ELSE [token] END) AS token
  FROM raw WHERE (length(token) > 1 OR regexp_matches(token, '^\\p{{Nd}}$')) AND token NOT IN ({_STOPS})
), firsts AS (SELECT query_id, token, min(i) AS i FROM wide GROUP BY ALL),
capped AS (SELECT query_id, token FROM firsts QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i, token) <= {t.MAX_QUERY_TOKENS}),
tokens AS (SELECT query_id, token FROM capped UNION ALL SELECT query_id, lower(trim(coalesce(query, ''))) FROM asked WHERE query_id NOT IN (SELECT query_id FROM capped))"""
_INDEX = f"""fields AS (
  SELECT path AS key, {_TERMS.format("title || ' ' || replace(" + _STEM_OF("path") + ", '-', ' ')")} AS a, {_TERMS.format(_HEADS)} AS b, {_TERMS.format("content")} AS c FROM wiki_docs
), lengths AS (SELECT key, len(a) + len(b) + len(c) AS dl FROM fields),
sizes AS (SELECT count(*) AS n, avg(dl) AS mean FROM lengths),
occurrences AS (SELECT key, unnest(a) AS term, 0 AS f FROM fields UNION ALL SELECT key, unnest(b), 1 FROM fields UNION ALL SELECT key, unnest(c), 2 FROM fields),
postings AS (SELECT key, term, count(*) FILTER (f = 0) AS tf_title, count(*) FILTER (f = 1) AS tf_headings, count(*) FILTER (f = 2) AS tf_body FROM occurrences GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term)"""


def _bm25(weights: tuple[float, float, float], tokens: str = "tokens", out: str = "bm25") -> str:
    f = f"({weights[0]} * tf_title + {weights[1]} * tf_headings + {weights[2]} * tf_body)"
    return f"""{out}_units AS (SELECT query_id, token, {_TERMS.format("token")} AS u FROM {tokens}),
{out}_phrases AS (SELECT DISTINCT u FROM {out}_units WHERE len(u) > 1),
{out}_found AS (
  SELECT u, key, len(list_filter(range(1, len(a) + 1), lambda i: list_slice(a, i, i + len(u) - 1) = u)) AS tf_title, len(list_filter(range(1, len(b) + 1), lambda i: list_slice(b, i, i + len(u) - 1) = u)) AS tf_headings,
    len(list_filter(range(1, len(c) + 1), lambda i: list_slice(c, i, i + len(u) - 1) = u)) AS tf_body FROM {out}_phrases, fields WHERE list_has_all(c, u) OR list_has_all(a, u) OR list_has_all(b, u)
), {out}_pdf AS (SELECT u, count(*) AS df FROM {out}_found WHERE tf_title + tf_headings + tf_body > 0 GROUP BY u),
{out}_hits AS (
  SELECT query_id, key, df, tf_title, tf_headings, tf_body FROM {out}_units JOIN dfs ON len(u) = 1 AND dfs.term = u[1] JOIN postings USING (term)
  UNION ALL SELECT query_id, key, df, tf_title, tf_headings, tf_body FROM {out}_units q JOIN {out}_pdf USING (u) JOIN {out}_found USING (u) WHERE len(q.u) > 1 AND tf_title + tf_headings + tf_body > 0
), {out}_scored AS (
  SELECT query_id, key, sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * {f} * 2.2 / ({f} + 1.2 * (0.25 + 0.75 * dl / mean))) AS score FROM {out}_hits JOIN lengths USING (key), sizes GROUP BY ALL
), {out} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM {out}_scored)"""


_LEXICAL = f"{_ASKED},\n{_QTOKENS},\n{_INDEX},\n{_bm25(lexical.WEIGHTS)}"
_PLAIN = f"NOT regexp_matches(coalesce(query, ''), '{t.CJK}')"


# --- L: words -----------------------------------------------------------------------------------------------------------


@query
def l1_query_tokens(spark, d):
    return log_of(spark, d).select(F.col("id").alias("query_id"), F.array_join(t.query_tokens(F.col("query")), "|").alias("tokens"))


SQL["l1_query_tokens"] = f"""WITH asked AS (SELECT DISTINCT ON (id) id AS query_id, query FROM query_log), {_QTOKENS}
SELECT a.query_id, coalesce(array_to_string(list_sort(list(c.token) FILTER (c.token IS NOT NULL)), '|'), '') AS tokens FROM asked a LEFT JOIN capped c USING (query_id) GROUP BY a.query_id"""


@query
def l2_query_phrases(spark, d):
    return log_of(spark, d).select(F.col("id").alias("query_id"), t.query_phrase(F.col("query")).alias("phrase"))


SQL["l2_query_phrases"] = f"SELECT DISTINCT ON (id) id AS query_id, regexp_replace(lower(coalesce(query, '')), '^{_SEP}+|{_SEP}+$', '', 'g') AS phrase FROM query_log"


@query
def l3_query_units(spark, d):
    return lexical.query_units(log_of(spark, d).select(F.col("id").alias("query_id"), "query")).select("query_id", "token", F.array_join("unit", "|").alias("unit"))


SQL["l3_query_units"] = f"WITH asked AS (SELECT DISTINCT ON (id) id AS query_id, query FROM query_log), {_QTOKENS} SELECT query_id, token, array_to_string({_TERMS.format('token')}, '|') AS unit FROM tokens WHERE len({_TERMS.format('token')}) > 0"


@query
def l4_bm25(spark, d):
    return lexical.bm25(lexical.index_documents(docs_of(spark, d)), asked_of(spark, d), 50).select("query_id", "key", *six("score"), "rank")


SQL["l4_bm25"] = f"WITH {_LEXICAL} SELECT query_id, key, round(score, 6) AS score, rank FROM bm25 WHERE rank <= 50"


@query
def l4_bm25_documented_weights(spark, d):
    return lexical.bm25(lexical.index_documents(docs_of(spark, d)), asked_of(spark, d), 50, lexical.DOCUMENTED_WEIGHTS).select("query_id", "key", *six("score"), "rank")


SQL["l4_bm25_documented_weights"] = f"WITH {_ASKED},\n{_QTOKENS},\n{_INDEX},\n{_bm25(lexical.DOCUMENTED_WEIGHTS)} SELECT query_id, key, round(score, 6) AS score, rank FROM bm25 WHERE rank <= 50"


@query
def l4_bm25_notes(spark, d):
    """BM25 over ``documents``: the corpus of raw notes, with the same queries."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("title"), F.col("text").alias("content"))
    return lexical.bm25(lexical.index_documents(docs), asked_of(spark, d), 10).select("query_id", "key", *six("score"), "rank")


SQL["l4_bm25_notes"] = f"WITH {_ASKED},\n{_QTOKENS},\n" + _INDEX.replace("wiki_docs", "(SELECT CAST(doc_id AS VARCHAR) AS path, coalesce(title, '') AS title, text AS content FROM documents)") + f",\n{_bm25(lexical.WEIGHTS)} SELECT query_id, key, round(score, 6) AS score, rank FROM bm25 WHERE rank <= 10"


@query
def l5_postings(spark, d):
    index = lexical.index_documents(docs_of(spark, d), keep=False)
    return index.postings.select("key", "term", "tf_title", "tf_headings", "tf_body", "dl")


SQL["l5_postings"] = f"WITH {_INDEX} SELECT key, term, tf_title, tf_headings, tf_body, dl FROM postings JOIN lengths USING (key)"


@query
def l6_vocabulary(spark, d):
    return table(spark, d, "documents").select(F.explode(t.index_terms(F.col("text"))).alias("term"), "doc_id").groupBy("term").agg(F.count(F.lit(1)).alias("tf"), F.countDistinct("doc_id").alias("df"))


SQL["l6_vocabulary"] = f"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents) GROUP BY term"


@query
def l7_lanes(spark, d):
    return log_of(spark, d).select(F.col("id").alias("query_id"), F.when(t.contains_cjk(F.col("query")), "substring").otherwise("bm25").alias("lane"))


SQL["l7_lanes"] = f"SELECT DISTINCT ON (id) id AS query_id, CASE WHEN {_PLAIN} THEN 'bm25' ELSE 'substring' END AS lane FROM query_log"

_SUBSTRING = f"""phrases AS (SELECT query_id, regexp_replace(lower(coalesce(query, '')), '^{_SEP}+|{_SEP}+$', '', 'g') AS p FROM asked),
words AS (SELECT query_id, list(token) AS w FROM tokens GROUP BY query_id),
low AS (SELECT path AS key, lower({_STEM_OF("path")}) AS stem, lower(coalesce(title, '') || ' ' || {_NAME.format("path")}) AS head, lower(coalesce(content, '')) AS body, kind FROM wiki_docs),
points AS (
  SELECT query_id, key, kind, p <> '' AND stem = p AS exact, p <> '' AND contains(head, p) AS titled, CASE WHEN p <> '' THEN least(10, (length(body) - length(replace(body, p, ''))) // length(p)) ELSE 0 END AS times,
    len(list_filter(w, lambda x: contains(head, x))) AS in_title, len(list_filter(w, lambda x: contains(body, x))) AS in_text
  FROM low, phrases JOIN words USING (query_id)
), substring AS (
  SELECT query_id, key, ((CASE WHEN exact THEN 200 ELSE 0 END) + (CASE WHEN titled THEN 50 ELSE 0 END) + 20 * times + 5 * in_title + in_text) * (CASE WHEN kind = 'source' THEN 0.6 ELSE 1.0 END) AS score, in_title > 0 OR titled AS title_match FROM points
)"""


@query
def l8_substring(spark, d):
    return lexical.substring_scores(docs_of(spark, d), asked_of(spark, d), 50).select("query_id", "key", *six("score"), "rank", "title_match")


SQL["l8_substring"] = f"""WITH {_ASKED}, {_QTOKENS}, {_SUBSTRING}
SELECT query_id, key, round(CAST(score AS DOUBLE), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank, title_match FROM substring WHERE score > 0 QUALIFY rank <= 50"""

_CALIBRATION = f"""numbered AS (SELECT path AS query_id, title AS query, row_number() OVER (ORDER BY path) - 1 AS i FROM wiki_docs),
asked AS (SELECT query_id, query FROM numbered, (SELECT greatest(1, count(*) // 400) AS step FROM wiki_docs) WHERE i % step = 0 AND i < step * 400),
{_QTOKENS}, {_INDEX}, {_bm25(lexical.WEIGHTS, "capped")},
calibration AS (SELECT c.query_id, coalesce(max(b.score), 0) AS score FROM (SELECT DISTINCT query_id FROM capped) c LEFT JOIN bm25 b USING (query_id) GROUP BY c.query_id)"""


@query
def l10_calibration(spark, d):
    docs = docs_of(spark, d)
    return lexical.calibrate(lexical.index_documents(docs), docs).select("query_id", *six("score"))


SQL["l10_calibration"] = f"WITH {_CALIBRATION} SELECT query_id, round(score, 6) AS score FROM calibration"


@query
def l11_fence(spark, d):
    docs = docs_of(spark, d)
    scores = lexical.calibrate(lexical.index_documents(docs), docs)
    scores = materialise(scores, "calibration")
    return spark.createDataFrame([(q, round(lexical.fence(scores, q), 6)) for q in (0.05, 0.25, 0.5)], "quantile double, fence double")


_FENCE = "fences AS (SELECT q AS quantile, (SELECT list_sort(list(score)) FROM calibration)[CAST(round_even(q * ((SELECT count(*) FROM calibration) - 1), 0) AS BIGINT) + 1] AS fence FROM (VALUES (CAST(0.05 AS DOUBLE)), (0.25), (0.5)) v(q))"
SQL["l11_fence"] = f"WITH {_CALIBRATION}, {_FENCE} SELECT quantile, round(fence, 6) AS fence FROM fences"


@query
def l12_abstentions(spark, d):
    docs, asked = docs_of(spark, d), asked_of(spark, d)
    index = lexical.index_documents(docs)
    limit = lexical.fence(lexical.calibrate(index, docs), 0.25)
    best = lexical.bm25(index, asked, 1).select("query_id", "score")
    return asked.select("query_id").join(best, "query_id", "left").select("query_id", lexical.abstains(F.col("score"), limit).alias("abstains"))


_CAL_AS = _CALIBRATION.replace("asked AS", "casked AS").replace("FROM asked", "FROM casked")
for _n in ("raw", "wide", "firsts", "capped", "tokens", "bm25_units", "bm25_phrases", "bm25_found", "bm25_pdf", "bm25_hits", "bm25_scored", "bm25"):
    _CAL_AS = _re.sub(rf"(?<![\w.]){_n}(?!\w)", f"c_{_n}", _CAL_AS)
SQL["l12_abstentions"] = f"WITH {_CAL_AS}, {_FENCE}, {_ASKED}, {_QTOKENS}, {_bm25(lexical.WEIGHTS)} SELECT a.query_id, (SELECT fence FROM fences WHERE quantile = 0.25) > 0 AND coalesce(max(b.score), 0) < (SELECT fence FROM fences WHERE quantile = 0.25) AS abstains FROM asked a LEFT JOIN bm25 b USING (query_id) GROUP BY a.query_id"

# --- V: vectors -----------------------------------------------------------------------------------------------------------

_CHUNKS = """chunk AS (SELECT page_id, chunk_index, arg_max(vector, id) AS v, arg_max(heading_path, id) AS heading_path, arg_max(text, id) AS text FROM chunks WHERE vector IS NOT NULL AND len(vector) = dims GROUP BY ALL),
normed AS (SELECT page_id, chunk_index, len(v) AS dims, sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * x))) AS n, CAST(v AS DOUBLE[]) AS v FROM chunk)"""
_NEAR = f"""{_CHUNKS}, {_ASKED},
probes AS (SELECT query_id, CAST(v AS DOUBLE[]) AS q, sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * x))) AS m FROM asked WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x))) = 0 AND list_max(list_transform(v, lambda x: abs(x))) > 0),
dots AS (SELECT query_id, page_id, chunk_index, round(CASE WHEN n > 0 THEN list_inner_product(v, q) / (n * m) ELSE 0 END, 12) AS score FROM normed JOIN probes ON len(v) = len(q)),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id, chunk_index) AS rank FROM dots)"""


@query
def v1_normalised(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 5).alias("norm"), F.round(vectors.norm(vectors.normalised(F.col("embedding"))), 6).alias("unit"))


SQL["v1_normalised"] = "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS norm, CASE WHEN list_max(list_transform(embedding, lambda x: abs(x))) > 0 THEN CAST(1.0 AS DOUBLE) ELSE 0.0 END AS unit FROM embeddings"


@query
def v2_nearest_chunks(spark, d):
    return vectors.nearest_chunks(chunks_of(spark, d), asked_of(spark, d), 30).select("query_id", "page_id", "chunk_index", *six("score"), "rank")


SQL["v2_nearest_chunks"] = f"WITH {_NEAR} SELECT query_id, page_id, chunk_index, round(score, 6) AS score, rank FROM near WHERE rank <= 30"

_PAGES = """grouped AS (SELECT query_id, page_id, max(score) AS score, list_slice(list(chunk_index ORDER BY score DESC, chunk_index), 1, 3) AS chunks FROM near WHERE rank <= {deep} GROUP BY ALL),
paged AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS prank FROM grouped)"""


@query
def v4_pages(spark, d):
    return vectors.pages_of(vectors.nearest_chunks(chunks_of(spark, d), asked_of(spark, d), 30), 10).select("query_id", "page_id", *six("score"), F.array_join(F.col("chunks").cast("array<string>"), "|").alias("chunks"), "rank")


SQL["v4_pages"] = f"WITH {_NEAR}, {_PAGES.format(deep=30)} SELECT query_id, page_id, round(score, 6) AS score, array_to_string(chunks, '|') AS chunks, prank AS rank FROM paged WHERE prank <= 10"


@query
def v5_vector_lane(spark, d):
    return vectors.vector_lane(chunks_of(spark, d), asked_of(spark, d), 20).select("query_id", "key", *six("score"), "rank")


SQL["v5_vector_lane"] = f"WITH {_NEAR}, {_PAGES.format(deep=120)} SELECT query_id, page_id AS key, round(score, 6) AS score, prank AS rank FROM paged WHERE prank <= 40"


@query
def v6_coverage(spark, d):
    return vectors.coverage(chunks_of(spark, d), docs_of(spark, d))


SQL["v6_coverage"] = f"WITH {_CHUNKS} SELECT count(*) FILTER (path IN (SELECT page_id FROM chunk)) AS covered, count(*) AS total FROM wiki_docs"


@query
def v8_embedding_text(spark, d):
    c = table(spark, d, "chunks").join(table(spark, d, "pages").select("page_id", "title"), "page_id", "left")
    return c.select("id", F.sha2(vectors.embedding_text(F.col("title"), F.col("heading_path"), F.col("text")), 256).alias("sha"))


SQL["v8_embedding_text"] = "SELECT c.id, sha256(CASE WHEN coalesce(p.title, '') = '' AND coalesce(heading_path, '') = '' THEN text ELSE concat_ws(' > ', nullif(p.title, ''), nullif(heading_path, '')) || chr(10) || chr(10) || text END) AS sha FROM chunks c LEFT JOIN pages p USING (page_id)"


def _wanted(spark, d) -> DataFrame:
    """Of each page the state offered last."""
    feed = table(spark, d, "page_feed").where("hash is not null")
    last = feed.groupBy("page_id").agg(F.max(F.struct("seen_at", "feed_id", "title", "hash", "model")).alias("x"))
    return last.select("page_id", "x.title", "x.hash", F.coalesce("x.model", F.lit("")).alias("model"))


_WANTED = "wanted AS (SELECT page_id, arg_max({'t': title, 'h': hash, 'm': coalesce(model, '')}, {'a': seen_at, 'b': feed_id}) AS x FROM page_feed WHERE hash IS NOT NULL GROUP BY page_id)"


@query
def v7_pending_pages(spark, d):
    return vectors.pending(_wanted(spark, d), table(spark, d, "pages")).select("page_id", "hash", "model")


SQL["v7_pending_pages"] = f"WITH {_WANTED} SELECT page_id, x.h AS hash, x.m AS model FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.page_id = w.page_id AND p.hash = x.h AND coalesce(p.model, '') = x.m)"


@query
def io14_upserted_pages(spark, d):
    stored = table(spark, d, "pages").select("page_id", "title", "hash", "model")
    return vectors.upserted(stored, vectors.pending(_wanted(spark, d), stored).select("page_id", "title", "hash", "model"))


SQL["io14_upserted_pages"] = f"""WITH {_WANTED}, fresh AS (SELECT page_id, x.t AS title, x.h AS hash, x.m AS model FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.page_id = w.page_id AND p.hash = x.h AND coalesce(p.model, '') = x.m))
SELECT page_id, title, hash, model FROM pages WHERE page_id NOT IN (SELECT page_id FROM fresh) UNION ALL SELECT * FROM fresh"""


@query
def io15_pruned_chunks(spark, d):
    return vectors.pruned(table(spark, d, "chunks"), docs_of(spark, d).select(F.col("path").alias("page_id"))).select("id", "page_id", "chunk_index")


SQL["io15_pruned_chunks"] = "SELECT id, page_id, chunk_index FROM chunks WHERE page_id IN (SELECT path FROM wiki_docs)"


@query
def io15_dropped_pages(spark, d):
    return vectors.dropped(table(spark, d, "pages"), docs_of(spark, d).select(F.col("path").alias("page_id"))).select("page_id")


SQL["io15_dropped_pages"] = "SELECT page_id FROM pages WHERE page_id NOT IN (SELECT path FROM wiki_docs)"


@query
def io16_store_counts(spark, d):
    return vectors.store_counts(table(spark, d, "chunks"), table(spark, d, "pages"))


SQL["io16_store_counts"] = "SELECT (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM chunks) AS chunks"

# --- G, E: graphs -----------------------------------------------------------------------------------------------------------

_LINKS = f"""page AS (SELECT * FROM wiki_docs WHERE kind = 'wiki'),
names AS (SELECT path, unnest([path, regexp_replace(path, '^wiki/', ''), {_STEM_OF("path")}, title]) AS name FROM page),
alias AS (SELECT {_ALIAS.format("name")} AS alias, max(path) AS key FROM names WHERE name <> '' GROUP BY 1),
directed AS (SELECT l.path AS src, a.key AS dst FROM (SELECT path, unnest(links) AS link FROM page) l JOIN alias a ON a.alias = {_ALIAS.format("link")} WHERE l.path <> a.key),
edges AS (SELECT src, dst FROM directed UNION SELECT dst, src FROM directed),
source_page AS (SELECT DISTINCT {_ALIAS.format("s")} AS source, path AS key FROM (SELECT path, unnest(sources) AS s FROM page) WHERE s IS NOT NULL),
degree AS (SELECT src AS node, count(*) AS degree FROM edges GROUP BY src)"""


def _relevance(pairs: str) -> str:
    return f"""signals AS (
  SELECT src, dst, 3.0 AS w FROM {pairs} p JOIN edges e USING (src, dst)
  UNION ALL SELECT DISTINCT p.src, p.dst, 4.0 FROM {pairs} p JOIN source_page a ON a.key = p.src JOIN source_page b ON b.key = p.dst AND a.source = b.source
  UNION ALL SELECT p.src, p.dst, sum(1.5 / ln(greatest(degree, 2))) FROM {pairs} p JOIN edges a ON a.src = p.src JOIN edges b ON b.src = a.dst AND b.dst = p.dst JOIN degree ON node = a.dst GROUP BY ALL
  UNION ALL SELECT p.src, p.dst, 1.0 FROM {pairs} p JOIN page a ON a.path = p.src JOIN page b ON b.path = p.dst WHERE a.page_type <> '' AND a.page_type = b.page_type
), relevance AS (SELECT src, dst, CAST(sum(w) AS DOUBLE) AS weight FROM signals GROUP BY ALL)"""


@query
def g1_aliases(spark, d):
    return linkgraph.alias_table(docs_of(spark, d)).select("alias", "key")


SQL["g1_aliases"] = f"WITH {_LINKS} SELECT alias, key FROM alias"


@query
def g2_link_edges(spark, d):
    return linkgraph.link_edges(docs_of(spark, d))


SQL["g2_link_edges"] = f"WITH {_LINKS} SELECT src, dst FROM edges"


@query
def g3_source_pages(spark, d):
    return linkgraph.source_pages(docs_of(spark, d)).select("source", "key")


SQL["g3_source_pages"] = f"WITH {_LINKS} SELECT source, key FROM source_page"


@query
def g4_degrees(spark, d):
    return linkgraph.degrees(linkgraph.link_edges(docs_of(spark, d)))


SQL["g4_degrees"] = f"WITH {_LINKS} SELECT node, degree FROM degree"


@query
def g5_relevance(spark, d):
    docs = docs_of(spark, d)
    edges = linkgraph.link_edges(docs)
    return linkgraph.relevance(docs, edges, edges).select("src", "dst", *six("weight"))


SQL["g5_relevance"] = f"WITH {_LINKS}, {_relevance('edges')} SELECT src, dst, round(weight, 6) AS weight FROM relevance"


@query
def g6_related_pages(spark, d):
    docs = docs_of(spark, d)
    return linkgraph.related_pages(docs, docs.where("kind = 'wiki'").select(F.col("path").alias("src"))).select("src", "dst", *six("weight"), "rank")


SQL["g6_related_pages"] = f"""WITH {_LINKS}, pairs AS (
  SELECT src, dst FROM edges UNION SELECT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src <> b.dst
  UNION SELECT a.key, b.key FROM source_page a JOIN source_page b USING (source) WHERE a.key <> b.key
), {_relevance("pairs")} SELECT src, dst, round(weight, 6) AS weight, row_number() OVER (PARTITION BY src ORDER BY round(weight, 9) DESC, dst) AS rank FROM relevance WHERE weight > 0 QUALIFY rank <= 10"""

_FORMS = f"""forms AS (SELECT lower(trim(f)) AS form, min(path) AS key FROM (SELECT path, unnest([title, {_STEM_OF("path")}, replace({_STEM_OF("path")}, '-', ' ')]) AS f FROM wiki_docs WHERE kind = 'wiki') WHERE length(lower(trim(f))) >= 3 GROUP BY 1)"""


@query
def e2_surface_forms(spark, d):
    return linkgraph.form_table(docs_of(spark, d)).select("form", "key")


SQL["e2_surface_forms"] = f"WITH {_FORMS} SELECT form, key FROM forms"


@query
def e3_scanned_mentions(spark, d):
    return linkgraph.scanned_mentions(docs_of(spark, d)).select("entity", "key", "tf")


_MENTIONS = """once AS (SELECT DISTINCT ON (mention_id) * FROM mentions),
found AS (SELECT regexp_replace(lower(trim(replace(entity, '\\', '/'))), '\\.md$', '') || '.md' AS entity, doc_path AS key, CAST(sum(tf) AS BIGINT) AS tf FROM once WHERE tf > 0 AND entity IS NOT NULL AND doc_path IS NOT NULL GROUP BY ALL),
anchored AS (SELECT entity, key, tf FROM found UNION ALL SELECT path, path, 1 FROM wiki_docs d WHERE kind = 'wiki' AND NOT EXISTS (SELECT 1 FROM found f WHERE f.entity = d.path AND f.key = d.path)),
n AS (SELECT count(*) AS n FROM wiki_docs),
df AS (SELECT entity, count(*) AS df FROM anchored GROUP BY entity),
hub AS (SELECT entity FROM (SELECT entity, df, row_number() OVER (ORDER BY df DESC, entity) AS r, count(*) OVER () AS c FROM df), n WHERE r <= floor(c * 0.01) OR df > greatest(2, floor(n * 0.5))),
kept AS (SELECT * FROM anchored WHERE entity NOT IN (SELECT entity FROM hub)),
weighed AS (SELECT entity, key, tf, tf * ln((n + 1.0) / (df + 1)) + 1 AS weight FROM kept JOIN df USING (entity), n),
strong AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(weight, 9) DESC, entity) AS r FROM weighed WHERE weight > 0),
mention_edge AS (SELECT key AS src, '@entity/' || entity AS dst, weight FROM strong WHERE r <= 4 UNION ALL SELECT '@entity/' || entity, key, weight FROM strong WHERE r <= 4)"""


def _kept(spark, d) -> tuple[DataFrame, int]:
    docs = docs_of(spark, d)
    n = docs.count()
    anchored = materialise(linkgraph.with_definitions(mentions_of(spark, d), docs), "anchored")
    return linkgraph.without_hubs(anchored, n), n


@query
def e4_definitions(spark, d):
    return linkgraph.with_definitions(mentions_of(spark, d), docs_of(spark, d)).select("entity", "key", "tf")


SQL["e4_definitions"] = f"WITH {_MENTIONS} SELECT entity, key, tf FROM anchored"


@query
def e5_hubs(spark, d):
    docs = docs_of(spark, d)
    return linkgraph.hubs(materialise(linkgraph.with_definitions(mentions_of(spark, d), docs), "anchored"), docs.count())


SQL["e5_hubs"] = f"WITH {_MENTIONS} SELECT entity FROM hub"


@query
def e6_mention_weights(spark, d):
    return linkgraph.mention_weights(*_kept(spark, d)).select("entity", "key", "tf", *six("weight"))


SQL["e6_mention_weights"] = f"WITH {_MENTIONS} SELECT entity, key, tf, round(weight, 6) AS weight FROM weighed"


@query
def e7_mention_edges(spark, d):
    return linkgraph.mention_edges(*_kept(spark, d)).select("src", "dst", *six("weight"))


SQL["e7_mention_edges"] = f"WITH {_MENTIONS} SELECT src, dst, round(weight, 6) AS weight FROM mention_edge"


def _merged(spark, d) -> DataFrame:
    kept, n = _kept(spark, d)
    return linkgraph.merged_edges(docs_of(spark, d), kept, n)


_GRAPH = f"{_LINKS}, {_relevance('edges')}, {_MENTIONS}, merged AS (SELECT src, dst, max(weight) AS weight FROM (SELECT src, dst, weight FROM relevance WHERE weight > 0 UNION ALL SELECT src, dst, weight * 0.05 FROM mention_edge) GROUP BY ALL)"
_MOVES = "totals AS (SELECT src, sum(weight) AS total FROM merged GROUP BY src HAVING sum(weight) > 0), moves AS (SELECT src, dst, sum(p) AS p FROM (SELECT src, dst, weight / (total * 2.0) AS p FROM merged JOIN totals USING (src) UNION ALL SELECT src, src, 0.5 FROM totals) GROUP BY ALL)"


@query
def g7_merged_edges(spark, d):
    return _merged(spark, d).select("src", "dst", *six("weight"))


SQL["g7_merged_edges"] = f"WITH {_GRAPH} SELECT src, dst, round(weight, 6) AS weight FROM merged"


@query
def g8_transitions(spark, d):
    return linkgraph.transitions(_merged(spark, d)).select("src", "dst", *six("p"))


SQL["g8_transitions"] = f"WITH {_GRAPH}, {_MOVES} SELECT src, dst, round(p, 6) AS p FROM moves"

# --- F: fusion and diffusion --------------------------------------------------------------------------------------------

_LANES = f"{_LEXICAL}, {_NEAR.replace(', ' + _ASKED, '')}, {_PAGES.format(deep=60)}"
_FUSED = f"""{_LANES}, parts AS (SELECT query_id, key, 1.0 / (3 + rank) AS part FROM bm25 WHERE rank <= 50 UNION ALL SELECT query_id, page_id, 1.0 / (3 + prank) FROM paged WHERE prank <= 20),
fused AS (SELECT query_id, key, CAST(sum(part) AS DOUBLE) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(part), 12) DESC, key) AS frank FROM parts WHERE key IN (SELECT path FROM wiki_docs) GROUP BY query_id, key)"""


def _fused(spark, d) -> DataFrame:
    docs, asked = docs_of(spark, d), asked_of(spark, d)
    words = lexical.bm25(lexical.index_documents(docs), asked, 50)
    near = vectors.vector_lane(chunks_of(spark, d), asked, 10)
    return fusion.fuse([(words, 1.0), (near, 1.0)], docs.select(F.col("path").alias("key")))


@query
def f1_fused(spark, d):
    return _fused(spark, d).select("query_id", "key", *six("score"), "rank")


SQL["f1_fused"] = f"WITH {_FUSED} SELECT query_id, key, round(score, 6) AS score, frank AS rank FROM fused"


@query
def f3_seed_masses(spark, d):
    return diffusion.seed_masses(_fused(spark, d), 10, 0.1).select("query_id", "node", *six("mass"))


SQL["f3_seed_masses"] = f"WITH {_FUSED} SELECT query_id, key AS node, round(CASE WHEN frank <= 10 THEN 1.0 / frank ELSE 0.1 / frank END, 6) AS mass FROM fused"

_ROUNDS = diffusion.ROUNDS


def _walk_sql(seeds: str) -> str:
    """``_ROUNDS`` rounds from ``seeds(query_id, node, mass)`` over ``moves``, unrolled; a query that moved by less than the tolerance stays as it is."""
    out = [f"restart AS (SELECT query_id, node, mass / sum(mass) OVER (PARTITION BY query_id) AS r FROM {seeds}), m0 AS (SELECT query_id, node, r AS mass FROM restart), live0 AS (SELECT DISTINCT query_id FROM m0)"]
    for i in range(_ROUNDS):
        out.append(f"""n{i + 1} AS MATERIALIZED (SELECT query_id, node, sum(mass) AS mass FROM (
  SELECT m.query_id, t.dst AS node, 0.85 * m.mass * t.p AS mass FROM m{i} m JOIN live{i} USING (query_id) JOIN moves t ON t.src = m.node
  UNION ALL SELECT r.query_id, r.node, (0.15 + 0.85 * coalesce(s.stuck, 0)) * r.r FROM restart r JOIN live{i} USING (query_id) LEFT JOIN (SELECT query_id, sum(mass) AS stuck FROM m{i} WHERE node NOT IN (SELECT src FROM moves) GROUP BY query_id) s USING (query_id)
) GROUP BY query_id, node),
live{i + 1} AS MATERIALIZED (SELECT query_id FROM (SELECT query_id, sum(mass) AS moved FROM (SELECT query_id, node, mass FROM n{i + 1} UNION ALL SELECT query_id, node, -mass FROM m{i} JOIN live{i} USING (query_id)) GROUP BY query_id, node) GROUP BY query_id HAVING sum(abs(moved)) >= {diffusion.TOLERANCE}),
m{i + 1} AS MATERIALIZED (SELECT query_id, node, mass FROM n{i + 1} UNION ALL SELECT query_id, node, mass FROM m{i} WHERE query_id NOT IN (SELECT query_id FROM live{i}))""")
    return ", ".join(out)


def _mass(spark, d) -> tuple[DataFrame, DataFrame]:
    fused = materialise(_fused(spark, d), "fused")
    return fused, diffusion.pagerank(diffusion.seed_masses(fused, 10), linkgraph.transitions(_merged(spark, d)))


_WALK = f"{_FUSED}, {_GRAPH}, {_MOVES}, seed AS (SELECT query_id, key AS node, 1.0 / frank AS mass FROM fused WHERE frank <= 10), {_walk_sql('seed')}"


@query
def f4_pagerank(spark, d):
    return _mass(spark, d)[1].select("query_id", "node", *six("mass"))


SQL["f4_pagerank"] = f"WITH {_WALK} SELECT query_id, node, round(mass, 6) AS mass FROM m{_ROUNDS}"


_RANKED = f"""{_WALK}, walked AS (
  SELECT coalesce(m.query_id, f.query_id) AS query_id, coalesce(m.node, f.key) AS key, coalesce(m.mass, 0) AS score, f.frank
  FROM (SELECT * FROM m{_ROUNDS} WHERE node IN (SELECT path FROM wiki_docs)) m FULL JOIN fused f ON f.query_id = m.query_id AND f.key = m.node
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, coalesce(frank, 2147483647), key) AS rank FROM walked)"""


@query
def f5_ranked_by_mass(spark, d):
    fused, mass = _mass(spark, d)
    return diffusion.ranked_by_mass(mass, fused, docs_of(spark, d).select(F.col("path").alias("key")), 10).select("query_id", "key", *six("score"), "rank")


SQL["f5_ranked_by_mass"] = f"WITH {_RANKED} SELECT query_id, key, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10"


@query
def f7_graph_hits(spark, d):
    fused, mass = _mass(spark, d)
    ranked = diffusion.ranked_by_mass(mass, fused, docs_of(spark, d).select(F.col("path").alias("key")), 50)
    return ranked.join(fused.select("query_id", "key"), ["query_id", "key"], "left_anti").groupBy("query_id").agg(F.count(F.lit(1)).alias("graph_hits"))


SQL["f7_graph_hits"] = f"WITH {_RANKED} SELECT query_id, count(*) AS graph_hits FROM ranked WHERE rank <= 50 AND frank IS NULL GROUP BY query_id"


@query
def f8_provenance(spark, d):
    fused, mass = _mass(spark, d)
    docs = docs_of(spark, d)
    ranked = diffusion.ranked_by_mass(mass, fused, docs.select(F.col("path").alias("key")), 50)
    loose = ranked.join(fused.select("query_id", "key"), ["query_id", "key"], "left_anti")
    return fusion.seeds_reached(loose, _merged(spark, d), fused.where("rank <= 10"), docs).select("query_id", "key", F.array_join("related", "|").alias("related"))


SQL["f8_provenance"] = f"""WITH {_RANKED}, loose AS (SELECT query_id, key FROM ranked WHERE rank <= 50 AND frank IS NULL),
hops AS (SELECT query_id, key, dst AS mid FROM loose JOIN merged ON src = key), ends AS (SELECT query_id, key, mid AS node FROM hops UNION SELECT h.query_id, h.key, m.dst FROM hops h JOIN merged m ON m.src = h.mid WHERE h.mid NOT IN (SELECT path FROM wiki_docs))
SELECT e.query_id, e.key, array_to_string(list_sort(list_distinct(list(d.title))), '|') AS related FROM ends e JOIN fused f ON f.query_id = e.query_id AND f.key = e.node AND f.frank <= 10 JOIN wiki_docs d ON d.path = e.node GROUP BY ALL"""


_LADDER = f"""{_CAL_AS}, {_FENCE}, {_LANES.replace(_INDEX + ",", "")}, {_SUBSTRING},
heard_all AS (SELECT query_id, key, score, rank FROM bm25 JOIN asked USING (query_id) WHERE {_PLAIN} AND rank <= 50
  UNION ALL SELECT query_id, key, CAST(s.score AS DOUBLE), row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, key) AS rank FROM substring s JOIN asked USING (query_id) WHERE NOT {_PLAIN} AND s.score > 0 QUALIFY rank <= 50),
counts AS (SELECT a.query_id, {_PLAIN} AS plain, (SELECT count(*) FROM heard_all h WHERE h.query_id = a.query_id) AS lexical_hits, (SELECT count(*) FROM paged p WHERE p.query_id = a.query_id AND prank <= 20) AS vector_hits, (SELECT max(score) FROM heard_all h WHERE h.query_id = a.query_id) AS top FROM asked a WHERE trim(coalesce(query, '')) <> ''),
gates AS (SELECT *, plain AND lexical_hits > 0 AND vector_hits > 0 AND (SELECT fence FROM fences WHERE quantile = 0.05) > 0 AND top < (SELECT fence FROM fences WHERE quantile = 0.05) AS abstained FROM counts),
parts AS (SELECT query_id, key, 1.0 / (3 + rank) AS part FROM heard_all JOIN gates USING (query_id) WHERE NOT abstained UNION ALL SELECT query_id, page_id, 1.0 / (3 + prank) FROM paged JOIN gates USING (query_id) WHERE prank <= 20),
fused AS (SELECT query_id, key, CAST(sum(part) AS DOUBLE) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(part), 12) DESC, key) AS frank FROM parts WHERE key IN (SELECT path FROM wiki_docs) GROUP BY query_id, key),
spread AS (SELECT f.* FROM fused f JOIN gates g USING (query_id) WHERE NOT abstained), {_GRAPH}, {_MOVES}, seed AS (SELECT query_id, key AS node, 1.0 / frank AS mass FROM spread WHERE frank <= 10), {_walk_sql("seed")},
walked AS (SELECT coalesce(m.query_id, f.query_id) AS query_id, coalesce(m.node, f.key) AS key, coalesce(m.mass, 0) AS score, f.frank FROM (SELECT * FROM m{_ROUNDS} WHERE node IN (SELECT path FROM wiki_docs)) m FULL JOIN spread f ON f.query_id = m.query_id AND f.key = m.node),
placed AS (SELECT query_id, key, score, frank, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, coalesce(frank, 2147483647), key) AS rank FROM walked),
ranked AS (SELECT query_id, key, score, frank, rank FROM placed WHERE rank <= 10 UNION ALL SELECT query_id, key, f.score, frank, frank FROM fused f JOIN gates USING (query_id) WHERE abstained AND frank <= 10)"""


@query
def f11_search(spark, d):
    """The whole ladder, with mentions as stored."""
    return _search(spark, d).results.select("query_id", "path", "rank", *six("score"), "kind", "title_match", F.round("vector_score", 6).alias("vector_score"), F.array_join("related", "|").alias("related"))


SQL["f11_search"] = f"""WITH {_LADDER}, hops AS (SELECT query_id, key, dst AS mid FROM ranked JOIN merged ON src = key WHERE frank IS NULL), ends AS (SELECT query_id, key, mid AS node FROM hops UNION SELECT h.query_id, h.key, m.dst FROM hops h JOIN merged m ON m.src = h.mid WHERE h.mid NOT IN (SELECT path FROM wiki_docs)),
behind AS (SELECT e.query_id, e.key, list_sort(list_distinct(list(d.title))) AS related FROM ends e JOIN fused f ON f.query_id = e.query_id AND f.key = e.node AND f.frank <= 10 JOIN wiki_docs d ON d.path = e.node GROUP BY ALL)
SELECT r.query_id, r.key AS path, r.rank, round(r.score, 6) AS score, l.kind, (p <> '' AND contains(head, p)) OR len(list_filter(w, lambda x: contains(head, x))) > 0 AS title_match, round(v.score, 6) AS vector_score, coalesce(array_to_string(related, '|'), '') AS related
FROM ranked r JOIN low l USING (key) JOIN phrases USING (query_id) JOIN words USING (query_id) LEFT JOIN (SELECT * FROM paged WHERE prank <= 20) v ON v.query_id = r.query_id AND v.page_id = r.key LEFT JOIN behind b ON b.query_id = r.query_id AND b.key = r.key"""


@query
def f10_modes(spark, d):
    return _search(spark, d).lanes


SQL["f10_modes"] = f"""WITH {_LADDER} SELECT query_id, lexical_hits, vector_hits, (SELECT count(*) FROM ranked r WHERE r.query_id = g.query_id AND frank IS NULL) AS graph_hits, abstained,
CASE WHEN vector_hits > 0 AND lexical_hits > 0 AND NOT abstained THEN 'hybrid' WHEN vector_hits > 0 THEN 'vector' ELSE 'keyword' END AS mode FROM gates g"""


@query
def f9_results(spark, d):
    """Texts of the results of every logged query: their titles, snippets and provenance."""
    return _search(spark, d, 1).results.select("query_id", "path", "title", "snippet", "related")


def _search(spark, d, every: int = 20) -> ladder.Found:
    docs = docs_of(spark, d)
    mentions = linkgraph.with_definitions(mentions_of(spark, d), docs)
    corpus = ladder.build(docs, chunks_of(spark, d), materialise(mentions, "mentions"))
    return ladder.search(corpus, asked_of(spark, d, every), 10)


# --- B, Q, M, K: context, log, measures, checks ---------------------------------------------------------------------------


@query
def b1_budgets(spark, d):
    sizes = spark.createDataFrame([(0,), (8_000,), (32_000,), (128_000,), (1_000_000,)], "size long")
    return sizes.select("size", *context.budget_columns(F.col("size")))


SQL["b1_budgets"] = """SELECT size, CAST(floor(s * 0.15) AS BIGINT) AS reserve, CAST(floor(s * 0.05) AS BIGINT) AS index_budget, CAST(floor(s * 0.5) AS BIGINT) AS page_budget, least(CAST(floor(s * 0.5) AS BIGINT), greatest(5000, CAST(floor(floor(s * 0.5) * 0.3) AS BIGINT))) AS max_page
FROM (SELECT size, CASE WHEN size > 0 THEN size ELSE 204800 END AS s FROM (VALUES (0), (8000), (32000), (128000), (1000000)) v(size))"""


def _ranked_results(spark, d) -> DataFrame:
    best = table(spark, d, "search_results").where("score is not null and not isnan(score)").groupBy("query_id", "path").agg(F.max("score").alias("score"))
    placed = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "path")))
    return placed.join(docs_of(spark, d).select("path", "title", "content", "kind"), "path").withColumn("related", F.array().cast("array<string>"))


@query
def b3_packed_context(spark, d):
    packed = context.packed_context(_ranked_results(spark, d), 6_000, 2_000)
    return packed.select("query_id", "number", "path", F.length("block").alias("size"))


SQL["b3_packed_context"] = """WITH RECURSIVE best AS (SELECT query_id, path, max(score) AS score FROM search_results WHERE NOT isnan(score) GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM best),
bodies AS (SELECT p.query_id, p.path, row_number() OVER (PARTITION BY p.query_id ORDER BY p.rank) AS i, d.title, d.kind, regexp_replace(d.content, '^\\s+|\\s+$', '', 'g') AS c FROM placed p JOIN wiki_docs d USING (path)),
sized AS (SELECT query_id, path, i, 6 + length(title) + 2 + length(CASE WHEN kind = 'source' THEN 'source' ELSE 'wiki page' END) + 2 + length(path) + 3 + (CASE WHEN length(c) > 2000 THEN length(regexp_replace(substr(c, 1, 2000), '\\s+$', '')) + 35 ELSE length(c) END) + 2 AS rest FROM bodies),
walk AS (
  SELECT query_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS number, '' AS path, CAST(0 AS BIGINT) AS size, false AS took FROM (SELECT DISTINCT query_id FROM sized)
  UNION ALL
  SELECT query_id, i, used + (CASE WHEN fits THEN size ELSE 0 END), number + fits::INT, path, size, fits FROM (
    SELECT w.query_id, s.i, w.used, w.number, s.path, CASE WHEN w.used = 0 THEN least(6000, s.rest + length(CAST(w.number + 1 AS VARCHAR))) ELSE s.rest + length(CAST(w.number + 1 AS VARCHAR)) END AS size,
      w.used + CASE WHEN w.used = 0 THEN least(6000, s.rest + length(CAST(w.number + 1 AS VARCHAR))) ELSE s.rest + length(CAST(w.number + 1 AS VARCHAR)) END <= 6000 AS fits
    FROM walk w JOIN sized s ON s.query_id = w.query_id AND s.i = w.i + 1)
) SELECT query_id, number, path, size FROM walk WHERE took"""


@query
def b4_citations(spark, d):
    """Answers that cite what the log says was cited, read back."""
    log = log_of(spark, d).where("cited is not null")
    # each alone, then all in one pair of brackets, then the first and the last once more
    numbers = F.transform("cited", lambda p, i: (i + 1).cast("string"))
    alone = F.array_join(F.transform(numbers, lambda n: F.concat(F.lit("["), n, F.lit("]"))), " ")
    together = F.when(F.size("cited") > 0, F.concat(F.lit(" or ["), F.array_join(numbers, ", "), F.lit("], [1 ,"), F.size("cited").cast("string"), F.lit("] [x]"))).otherwise(" [] [a]")
    odd = F.col("id") % 2 == 1
    said = log.select(F.col("id").alias("query_id"), F.concat(F.lit("So it is "), F.when(odd, alone).otherwise(""), together).alias("answer"))
    return said.select("query_id", F.array_join(context.cited_numbers(F.col("answer")).cast("array<string>"), "|").alias("numbers"))


SQL["b4_citations"] = "SELECT DISTINCT ON (id) id AS query_id, array_to_string(range(1, len(cited) + 1), '|') AS numbers FROM query_log WHERE cited IS NOT NULL"


@query
def b11_stage_percentiles(spark, d):
    log = oplog.decoded(log_of(spark, d)).select(F.explode("stage_ms").alias("stage", "ms"))
    return oplog.percentiles(log)


SQL["b11_stage_percentiles"] = """WITH log AS (SELECT DISTINCT ON (id) id, stage_ms FROM query_log), each AS (SELECT k AS stage, CAST(json_extract(stage_ms, '$."' || k || '"') AS DOUBLE) AS ms FROM (SELECT stage_ms, unnest(json_keys(stage_ms)) AS k FROM log WHERE json_valid(stage_ms))),
sorted AS (SELECT stage, list_sort(list(ms)) AS l, count(*) AS n FROM each WHERE ms IS NOT NULL GROUP BY stage)
SELECT stage, n, round(l[CAST(round_even(0.5 * (n - 1), 0) AS BIGINT) + 1], 3) AS p50, round(l[CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1], 3) AS p95, round(l[CAST(round_even(0.99 * (n - 1), 0) AS BIGINT) + 1], 3) AS p99 FROM sorted"""


@query
def q2_log_stats(spark, d):
    return oplog.stats(log_of(spark, d)).select("turns", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first"), F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"))


SQL["q2_log_stats"] = "SELECT count(*) AS turns, strftime(min(ts) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS last FROM (SELECT DISTINCT ON (id) * FROM query_log)"


@query
def q3_recent_turns(spark, d):
    return oplog.decoded(oplog.recent(log_of(spark, d), 20)).select("id", "query", "profile", F.col("lanes")["lexical"].alias("lexical"), F.size("retrieved").alias("retrieved"))


SQL["q3_recent_turns"] = "SELECT id, query, profile, json_extract_string(lanes, '$.lexical') AS lexical, len(retrieved) AS retrieved FROM (SELECT DISTINCT ON (id) * FROM query_log) ORDER BY id DESC LIMIT 20"


def _gold(spark, d) -> DataFrame:
    return log_of(spark, d).select(F.col("id").alias("query_id"), F.explode("cited").alias("key")).distinct()


def _retrieved(spark, d) -> DataFrame:
    placed = log_of(spark, d).select(F.col("id").alias("query_id"), F.posexplode("retrieved").alias("at", "key"))
    return placed.groupBy("query_id", "key").agg((F.min("at") + 1).alias("rank"))


_GOLD = """log AS (SELECT DISTINCT ON (id) id AS query_id, retrieved, cited FROM query_log), gold AS (SELECT DISTINCT query_id, unnest(cited) AS key FROM log),
placed AS (SELECT query_id, key, min(i) AS rank FROM (SELECT query_id, unnest(retrieved) AS key, generate_subscripts(retrieved, 1) AS i FROM log) GROUP BY ALL),
measured AS (SELECT query_id, count(*) AS n, count(*) FILTER (rank <= 5) AS found, min(rank) AS first FROM gold LEFT JOIN placed USING (query_id, key) GROUP BY query_id)"""


@query
def m1_recall_at_5(spark, d):
    return metrics.recall_at(_retrieved(spark, d), _gold(spark, d), 5).select("query_id", *six("recall"), "recall_all", "hit", *six("rr"))


SQL["m1_recall_at_5"] = f"WITH {_GOLD} SELECT query_id, round(found / n, 6) AS recall, CAST(found = n AS INT) AS recall_all, CAST(found > 0 AS INT) AS hit, round(coalesce(1.0 / first, 0), 6) AS rr FROM measured"


@query
def m3_summary(spark, d):
    return metrics.summary(_retrieved(spark, d), _gold(spark, d), 5).select("queries", *six("recall_any", "recall_all", "hit", "mrr"))


SQL["m3_summary"] = f"WITH {_GOLD} SELECT count(*) AS queries, round(avg(found / n), 6) AS recall_any, round(avg(CAST(found = n AS INT)), 6) AS recall_all, round(avg(CAST(found > 0 AS INT)), 6) AS hit, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM measured"


@query
def m4_recall_in_context(spark, d):
    packed = context.packed_context(_ranked_results(spark, d), 6_000, 2_000)
    return metrics.recall_in_context(packed, _gold(spark, d)).select("query_id", *six("recall"))


@query
def m5_bootstrap(spark, d):
    five = metrics.recall_at(_retrieved(spark, d), _gold(spark, d), 5).select("query_id", F.col("recall").alias("b"))
    one = metrics.recall_at(_retrieved(spark, d), _gold(spark, d), 1).select("query_id", F.col("recall").alias("a"))
    return metrics.paired_bootstrap(one.join(five, "query_id"), 500).select(*six("difference", "low", "high"))


@query
def k1_conformance(spark, d):
    return checks.conformance(docs_of(spark, d), materialise(_merged(spark, d), "edges"))


def _sums(self_weight: float) -> str:
    """Rows whose transitions do not sum to 1, by SQL."""
    return f"(SELECT count(*) FROM (SELECT src, sum(p) AS p FROM (SELECT src, weight / (total * {1 + self_weight}) AS p FROM merged JOIN totals USING (src) UNION ALL SELECT src, {self_weight} / {1 + self_weight} FROM totals WHERE {self_weight} > 0) GROUP BY src) WHERE abs(p - 1) > 1e-6)"


SQL["k1_conformance"] = f"""WITH {_GRAPH}, totals AS (SELECT src, sum(weight) AS total FROM merged GROUP BY src HAVING sum(weight) > 0)
SELECT 'keys are not empty' AS "check", count(*) AS violations FROM wiki_docs WHERE path IS NULL OR trim(path) = ''
UNION ALL SELECT 'keys are unique', count(*) FROM (SELECT path FROM wiki_docs GROUP BY path HAVING count(*) > 1)
UNION ALL SELECT 'edges have ends', count(*) FROM merged WHERE src IS NULL OR dst IS NULL
UNION ALL SELECT 'edges lead elsewhere', count(*) FROM merged WHERE src = dst
UNION ALL SELECT 'weights are finite', count(*) FROM merged WHERE weight IS NULL OR NOT isfinite(weight)
UNION ALL SELECT 'weights are positive', count(*) FROM merged WHERE isfinite(weight) AND weight <= 0
UNION ALL SELECT 'edges are unique', count(*) FROM (SELECT src, dst FROM merged GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'edges go both ways', count(*) FROM merged m WHERE NOT EXISTS (SELECT 1 FROM merged b WHERE b.src = m.dst AND b.dst = m.src)
UNION ALL SELECT 'rows sum to 1 at self weight 0', {_sums(0)}
UNION ALL SELECT 'rows sum to 1 at self weight 0.15', {_sums(0.15)}
UNION ALL SELECT 'nodes keep a self edge', (SELECT count(*) FROM totals WHERE src IS NULL)"""

SQL["m4_recall_in_context"] = f"""WITH RECURSIVE {SQL["b3_packed_context"].removeprefix("WITH RECURSIVE ").rsplit(") SELECT", 1)[0]}), gold AS (SELECT DISTINCT id AS query_id, unnest(cited) AS key FROM (SELECT DISTINCT ON (id) id, cited FROM query_log)),
packed AS (SELECT DISTINCT query_id, path AS key, 1 AS inside FROM walk WHERE took)
SELECT query_id, round(count(inside) / count(*), 6) AS recall FROM gold LEFT JOIN packed USING (query_id, key) GROUP BY query_id"""
