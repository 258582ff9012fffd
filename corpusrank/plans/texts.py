"""Queries of the text, file and chunk operators over whole tables, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusrank.functions import formats, generated, markdown
from corpusrank.functions import text as t
from corpusrank.operators import fusion, vectors
from corpusrank.plans import ingest
from corpusrank.plans.retrieval import _ASKED, _HEADS, _NAME, _QTOKENS, _STEM_OF, _SUBSTRING, asked_of, docs_of, log_of
from corpusrank.shared import table
from corpusrank.sources import corpus

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


_FRONT = r"'(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)'"
_BODY = f"regexp_replace(content, {_FRONT}, '')"
_RAW = f"regexp_extract(content, {_FRONT}, 1)"


def _value(key: str) -> str:
    found = rf"coalesce(list_last(regexp_extract_all({_RAW}, '(?m)^{key}[ \t]*:[ \t]*(.*?)[ \t\r]*$', 1)), '')"
    return rf"trim(regexp_replace(CASE WHEN {found} LIKE '[%' THEN regexp_extract({found}, '^\[\s*([^,\]]*?)\s*[,\]]', 1) ELSE {found} END, '^[\x22\x27](.*)[\x22\x27]$', '\1'))"


@query
def io3_page_documents(spark, d):
    pages = docs_of(spark, d).where("kind = 'wiki'").select("path", "content")
    return corpus.page_documents(pages).select("path", "title", F.size("links").alias("n_links"), F.array_join("sources", "|").alias("sources"), "page_type")


_SOURCES = rf"array_to_string(list_filter(list_transform(string_split(regexp_replace(coalesce(list_last(regexp_extract_all({_RAW}, '(?m)^sources[ \t]*:[ \t]*(.*?)[ \t\r]*$', 1)), ''), '^\[|\]$', '', 'g'), ','), lambda v: trim(v)), lambda v: v <> ''), '|')"
_TITLE = rf"coalesce(nullif({_value('title')}, ''), nullif(trim(regexp_extract({_BODY}, '(?m)^#[ \t]+(\S.*?)[ \t\r]*$', 1)), ''), replace({_STEM_OF('path')}, '-', ' '))"
_LINKLIST = r"list_filter(list_transform(regexp_extract_all(coalesce(content, ''), '\[\[([^\]]+)\]\]', 1), lambda v: trim(regexp_extract(v, '^([^|#]*)', 1))), lambda v: v <> '')"
SQL["io3_page_documents"] = f"SELECT path, {_TITLE} AS title, len({_LINKLIST}) AS n_links, {_SOURCES} AS sources, {_value('type')} AS page_type FROM wiki_docs WHERE kind = 'wiki' AND lower(path) NOT IN ('wiki/index.md', 'wiki/log.md', 'wiki/reviews.md')"


@query
def io10_fingerprint(spark, d):
    files = docs_of(spark, d).select("path", F.length("content").alias("length"), F.lit("2031-01-01").alias("modified"))
    return corpus.fingerprint(files)


_SLICES = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8))
SQL["io10_fingerprint"] = f"SELECT n || '|' || substr(sha256(sums), 1, 16) AS fingerprint FROM (SELECT CAST(count(*) AS VARCHAR) AS n, concat_ws('-', {_SLICES}) AS sums FROM (SELECT sha256(path || ':' || CAST(length(content) AS VARCHAR) || ':2031-01-01') AS h FROM wiki_docs))"


@query
def io11_content_hashes(spark, d):
    return corpus.content_hashes(docs_of(spark, d))


SQL["io11_content_hashes"] = "SELECT path, sha256(content) AS hash FROM wiki_docs"


@query
def io8_html_as_markdown(spark, d):
    """Every page read as HTML."""
    files = docs_of(spark, d).select(F.concat(t.file_stem(F.col("path")), F.lit(".html")).alias("path"), F.encode("content", "UTF-8").alias("content"))
    return formats.file_texts(files).select("path", F.length("text").alias("size"), "problem")


@query
def io4_file_texts(spark, d):
    """Every document as the file its path says it is; office files are no text."""
    files = docs_of(spark, d).select("path", F.encode("content", "UTF-8").alias("content"))
    return formats.file_texts(files).groupBy(F.lower(F.regexp_extract("path", r"\.[^./]*$", 0)).alias("suffix")).agg(F.count(F.lit(1)).alias("files"), F.count("text").alias("texts"), F.count("problem").alias("problems"))


@query
def n4_cached_sources(spark, d):
    """Pages as a cache: which of the states offered last are known with all their chunks' pages present."""
    feed = table(spark, d, "page_feed").where("hash is not null").select(F.col("page_id").alias("identity"), "hash").distinct()
    cache = table(spark, d, "pages").select(F.col("page_id").alias("identity"), "hash", F.array("page_id").alias("files"))
    return corpus.cached_sources(feed, cache, docs_of(spark, d))


SQL["n4_cached_sources"] = "SELECT DISTINCT p.page_id AS identity FROM pages p JOIN page_feed f ON f.page_id = p.page_id AND f.hash = p.hash WHERE p.page_id IN (SELECT path FROM wiki_docs)"


@query
def p1_front_matter_pages(spark, d):
    data = markdown.parsed_pages(docs_of(spark, d))
    return data.select(F.col("key").alias("path"), "present", F.coalesce(F.get(F.col("data")["title"], F.lit(0)), F.lit("")).alias("title"))


QUERIES["fm1_front_matter"] = QUERIES.pop("p1_front_matter_pages")
SQL["fm1_front_matter"] = f"SELECT path, regexp_matches(content, {_FRONT}) AS present, {_value('title')} AS title FROM wiki_docs"


@query
def fm3_rewritten_sources(spark, d):
    """The front matter's sources as a canonical list, anchored to the page's own summary slug."""
    rows = docs_of(spark, d).select("path", t.canonical_sources(F.col("sources"), t.source_identity(F.col("path"))).alias("s"))
    return rows.select("path", F.array_join("s", "|").alias("sources"))


SQL["fm3_rewritten_sources"] = rf"""WITH s AS (SELECT path, CASE WHEN regexp_extract(path, '(?:^|/)raw/sources/(.+)$', 1) <> '' THEN regexp_extract(path, '(?:^|/)raw/sources/(.+)$', 1) ELSE {_NAME.format("path")} END AS id, list_transform(coalesce(sources, []), lambda v: regexp_replace(replace(v, '\', '/'), '^(\./)+', '')) AS v FROM wiki_docs),
ok AS (SELECT path, id, list_transform(list_filter(v, lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(/|[a-z]:/)|(^|/)\.\.(/|$)|^wiki/(index|overview|log)\.md$|^\.[^/]*-wiki(/|$)')), lambda x: CASE WHEN lower(x) = lower(id) OR (NOT contains(x, '/') AND lower(x) = lower({_NAME.format("id")})) THEN id ELSE x END) AS v FROM s),
whole AS (SELECT path, CASE WHEN list_contains(list_transform(v, lambda x: lower(x)), lower(id)) THEN v ELSE list_append(v, id) END AS v FROM ok)
SELECT path, array_to_string(list_filter(v, lambda x, i: list_position(list_transform(v, lambda y: lower(y)), lower(x)) = i), '|') AS sources FROM whole"""


@query
def t4_titles(spark, d):
    return docs_of(spark, d).select("path", t.page_title(F.col("content"), F.col("path")).alias("title"))


SQL["t4_titles"] = f"SELECT path, {_TITLE} AS title FROM wiki_docs"


@query
def t5_bodies(spark, d):
    body = t.without_front_matter(F.col("content"))
    return docs_of(spark, d).select("path", (F.length("content") - F.length(body)).alias("begins"), F.sha2(body, 256).alias("sha"))


SQL["t5_bodies"] = f"SELECT path, length(content) - length({_BODY}) AS begins, sha256({_BODY}) AS sha FROM wiki_docs"


@query
def t6_wikilinks(spark, d):
    return docs_of(spark, d).select("path", F.array_join(t.wikilinks(F.col("content")), "|").alias("links"))


SQL["t6_wikilinks"] = f"SELECT path, array_to_string({_LINKLIST}, '|') AS links FROM wiki_docs"


@query
def t7_headings(spark, d):
    return docs_of(spark, d).select("path", t.heading_lines(F.col("content")).alias("headings"))


SQL["t7_headings"] = f"SELECT path, {_HEADS} AS headings FROM wiki_docs"


@query
def t9_path_parts(spark, d):
    m = table(spark, d, "mentions").where("entity is not null").select("entity").distinct()
    return m.select("entity", t.alias(F.col("entity")).alias("alias"), t.file_name(F.col("entity")).alias("name"), t.file_stem(F.col("entity")).alias("stem"))


SQL["t9_path_parts"] = rf"SELECT DISTINCT entity, lower(replace(regexp_replace(replace(trim(string_split(entity, '#')[1]), '\', '/'), '(?i)\.md$', ''), ' ', '-')) AS alias, {_NAME.format('entity')} AS name, {_STEM_OF('entity')} AS stem FROM mentions WHERE entity IS NOT NULL"


@query
def t10_safe_paths(spark, d):
    m = table(spark, d, "mentions").where("entity is not null").select("entity").distinct()
    return m.select("entity", t.safe_page_path(F.col("entity")).alias("safe"))


SQL["t10_safe_paths"] = r"""SELECT DISTINCT entity, trim(entity) <> '' AND replace(entity, '\', '/') LIKE 'wiki/%' AND NOT regexp_matches(entity, '[\x00-\x1f\x7f]|^[A-Za-z]:|^[/\\]')
AND len(list_filter(string_split(replace(entity, '\', '/'), '/'), lambda s: s = '' OR s = '..' OR regexp_matches(s, '[<>:"|?*]|[ .]$|^\.') OR regexp_matches(s, '(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.|$)'))) = 0 AS safe FROM mentions WHERE entity IS NOT NULL"""


@query
def t11_slugs(spark, d):
    return docs_of(spark, d).select("path", t.slug(F.col("title")).alias("slug"), t.summary_slug(t.source_identity(F.col("path"))).alias("summary"))


_SLUG = r"coalesce(nullif(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(trim({}), '[\-_ \t/\\.,:;!?''\x22()\[\]{{}}]', '-', 'g'), '[^\p{{L}}\p{{N}}\-]', '', 'g')), '-{{2,}}', '-', 'g'), '^-|-$', '', 'g'), ''), 'untitled')"
_IDENTITY = rf"(CASE WHEN regexp_extract(path, '(?:^|/)raw/sources/(.+)$', 1) <> '' THEN regexp_extract(path, '(?:^|/)raw/sources/(.+)$', 1) ELSE {_NAME.format('path')} END)"
SQL["t11_slugs"] = f"SELECT path, {_SLUG.format('title')} AS slug, {_SLUG.format(rf"replace(regexp_replace({_IDENTITY}, '\.[^./]*$', ''), '/', '-')")} AS summary FROM wiki_docs"


@query
def t14_languages(spark, d):
    return table(spark, d, "documents").select("doc_id", t.language(F.col("text")).alias("language"), t.contains_cjk(F.col("text")).alias("cjk"))


SQL["t14_languages"] = r"""WITH c AS (SELECT doc_id, length(s) AS n, length(regexp_replace(s, '[^぀-ヿ]', '', 'g')) AS ja, length(regexp_replace(s, '[^가-힯]', '', 'g')) AS ko, length(regexp_replace(s, '[^一-鿿]', '', 'g')) AS zh, coalesce(regexp_matches(text, '[㐀-鿿]'), false) AS cjk FROM (SELECT doc_id, text, substr(coalesce(text, ''), 1, 2000) AS s FROM documents))
SELECT doc_id, CASE WHEN ja > 0 THEN 'Japanese' WHEN ko > n * 0.05 AND ko >= zh THEN 'Korean' WHEN zh > n * 0.05 THEN 'Chinese' ELSE 'English' END AS language, cjk FROM c"""


@query
def t15_snippets(spark, d):
    """Of every stated query and document that holds its phrase or a token: the snippet there."""
    return fusion.all_snippets(docs_of(spark, d), asked_of(spark, d))


_SNIP_BODY = f"regexp_replace({_BODY}, '^\\s+|\\s+$', '', 'g')"
SQL["t15_snippets"] = rf"""WITH {_ASKED}, {_QTOKENS}, {_SUBSTRING}, w2 AS (SELECT query_id, list_sort(list(token)) AS w FROM capped GROUP BY query_id),
hit AS (SELECT w2.query_id, path, CASE WHEN p <> '' AND contains(lower(content), p) THEN p ELSE list_filter(w, lambda x: contains(lower(content), x))[1] END AS anchor, {_SNIP_BODY} AS body FROM wiki_docs, w2 JOIN phrases USING (query_id) WHERE len(list_filter(w, lambda x: contains(lower(content), x))) > 0),
spot AS (SELECT *, greatest(0, strpos(lower(body), lower(anchor)) - 1) AS spot_ FROM hit), cut AS (SELECT *, greatest(0, spot_ - 80) AS s, least(length(body), spot_ + length(anchor) + 80) AS e FROM spot)
SELECT query_id, path, (CASE WHEN s > 0 THEN '...' ELSE '' END) || regexp_replace(replace(substr(body, s + 1, e - s), chr(10), ' '), '^\s+|\s+$', '', 'g') || (CASE WHEN e < length(body) THEN '...' ELSE '' END) AS snippet FROM cut"""


@query
def t17_title_matches(spark, d):
    return fusion.all_title_matches(docs_of(spark, d), asked_of(spark, d))


SQL["t17_title_matches"] = f"WITH {_ASKED}, {_QTOKENS}, {_SUBSTRING}, w2 AS (SELECT query_id, list(token) AS w FROM capped GROUP BY query_id) SELECT query_id, key AS path FROM low, w2 JOIN phrases USING (query_id) WHERE (p <> '' AND contains(head, p)) OR len(list_filter(w, lambda x: contains(head, x))) > 0"


@query
def t18_trimmed(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(t.trimmed(F.col("text"), 500)).alias("size"))


SQL["t18_trimmed"] = r"SELECT doc_id, CASE WHEN length(text) > 500 THEN length(regexp_replace(substr(text, 1, 500), '\s+$', '')) + 19 ELSE length(text) END AS size FROM documents"


@query
def t19_dates(spark, d):
    rows = docs_of(spark, d).select("path", t.front_matter_value(F.col("content"), "created").alias("c"))
    return rows.select("path", t.dated(F.col("c"), F.lit("2031-03-15")).alias("created"))


SQL["t19_dates"] = rf"SELECT path, CASE WHEN regexp_full_match(trim({_value('created')}), '\d{{4}}-\d{{2}}-\d{{2}}') THEN {_value('created')} ELSE '2031-03-15' END AS created FROM wiki_docs"


@query
def c1_blocks(spark, d):
    return markdown.block_table(docs_of(spark, d)).groupBy("key").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.col("whole").cast("int")).alias("whole"))


@query
def c2_chunks(spark, d):
    return markdown.chunk_table(docs_of(spark, d)).select("key", "chunk_index", "heading_path", F.length("text").alias("size"), "oversized")


@query
def c3_sections(spark, d):
    return markdown.section_table(table(spark, d, "documents").withColumn("doc_id", F.col("doc_id").cast("string")), 4000, 200, "doc_id", "text").select("key", "part", "total", F.length("main").alias("size"), F.length("overlap_before").alias("before"))


@query
def p21_generated_blocks(spark, d):
    """Every page as a model would hand it over, read back."""
    # by the length of its path: whole, with a path that leads out, or broken off
    kind = F.length("path") % 3
    path = F.when(kind == 1, F.concat(F.lit("../"), "path")).otherwise(F.col("path"))
    text = F.concat(F.lit("---FILE: "), path, F.lit("---\n"), F.regexp_replace("content", "[`~]", "'"), F.when(kind == 2, "\n").otherwise("\n---END FILE---\n"))
    docs = docs_of(spark, d).where("kind = 'wiki'").select(F.col("path").alias("id"), text.alias("text"))
    return generated.generated_table(docs).select("id", F.size("files").alias("files"), F.size("truncated").alias("truncated"))


QUERIES["n5_generated_blocks"] = QUERIES.pop("p21_generated_blocks")
SQL["n5_generated_blocks"] = "SELECT path AS id, CAST(length(path) % 3 = 0 AS INT) AS files, CAST(length(path) % 3 = 2 AS INT) AS truncated FROM wiki_docs WHERE kind = 'wiki'"


@query
def n6_index_additions(spark, d):
    """Pages that no page links to yet, as lines for the index: at most 200, by path."""
    docs = docs_of(spark, d).where("kind = 'wiki'")
    linked = docs.select(F.explode(t.wikilinks(F.col("content"))).alias("l")).select(t.alias(F.col("l")).alias("target")).distinct()
    new = docs.select("path", "title", t.alias(F.regexp_replace("path", "^wiki/", "")).alias("target")).join(linked, "target", "left_anti")
    first = [(r["target"], r["title"]) for r in new.orderBy("path").limit(200).select("target", "title").collect()]  # as many as an index lists
    lines = ingest.updated_index("# Wiki Index\n", first).split(ingest.RECENT)[-1].strip("\n").split("\n") if first else []
    return spark.createDataFrame([(x,) for x in lines], "line string")


SQL["n6_index_additions"] = rf"""WITH page AS (SELECT * FROM wiki_docs WHERE kind = 'wiki'), linked AS (SELECT DISTINCT lower(replace(regexp_replace(replace(trim(l), '\', '/'), '(?i)\.md$', ''), ' ', '-')) AS target FROM (SELECT unnest({_LINKLIST}) AS l FROM page)),
new_ AS (SELECT path, title, lower(replace(regexp_replace(regexp_replace(path, '^wiki/', ''), '(?i)\.md$', ''), ' ', '-')) AS target FROM page)
SELECT '- [[' || target || ']] — ' || title AS line FROM new_ WHERE target NOT IN (SELECT target FROM linked) ORDER BY path LIMIT 200"""
