"""The queries of this subpackage, by name, and the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusrank.llm import markup, mixing, neardup, neighbours, packing, ranking, repetition, terms, tokens
from corpusrank.operators.skew import join_statistics
from corpusrank.shared import materialise, table

CAPACITY = 4096


def _collections(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    docs = table(spark, d, "wiki_docs").select(F.col("path").alias("key"), F.col("content").alias("text"))
    chunks = table(spark, d, "chunks").select(F.col("id").cast("string").alias("key"), "text")
    return [("document", docs), ("chunk", chunks)]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [neardup.similar_pairs(df, "key", "text", 3, 0.5, 20).select(F.lit(o).alias("origin"), "key_a", "key_b") for o, df in _collections(spark, d)]
    return parts[0].unionAll(parts[1])


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row a record: the least keys of its class and of its group, and how many other classes its class is linked to."""
    parts = []
    for origin, df in _collections(spark, d):
        groups = materialise(neardup.duplicate_groups(df, "key", "text").where("key is not null"), "groups")
        classes = materialise(groups.groupBy("class_id").agg(F.min("key").alias("class_key"), F.count(F.lit(1)).alias("n"), F.min("group_id").alias("of")), "classes")
        least = classes.groupBy(F.col("of")).agg(F.min("class_key").alias("group_key"))
        classes = materialise(classes.join(least, "of").drop("of"), "classes")
        named = join_statistics(groups, classes, "class_id", "n", F.col("key"))
        parts.append(named.select(F.lit(origin).alias("origin"), "key", "class_key", "group_key", "n_links"))
    return parts[0].unionAll(parts[1])


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "mentions").select("mention_id", terms.same_path(F.col("entity")).alias("entity"), "doc_path", "tf")
    return rows.where("mention_id is not null").dropDuplicates(["mention_id"]).unionAll(rows.where("mention_id is null"))


def _characteristic(spark: SparkSession, d: str, least_tf: int, most_df: int | None = None) -> DataFrame:
    a = terms.characteristic_values(_mentions(spark, d), "doc_path", "entity", "tf", least_tf, most_df=most_df)
    b = terms.characteristic_terms(table(spark, d, "wiki_docs"), "path", ["title", "content"], least_tf, most_df=most_df)
    return a.withColumn("origin", F.lit("mention")).unionByName(b.withColumn("origin", F.lit("content")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    # by score first: what no term of five records can fall below; the rule itself decides among those
    found = _characteristic(spark, d, 4, most_df=5).where(F.col("df").between(2, 5))
    return found.select("origin", F.col("doc").alias("doc_path"), "term")


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    return _characteristic(spark, d, 1).select("origin", F.col("doc").alias("doc_path"), "term", "tf", "df", F.round("score", 6).alias("score"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The markups of all labelled blocks of a record, content or not."""
    cleaned = markup.clean_markup(table(spark, d, "wiki_docs"), "path", "content")
    return cleaned.select(F.col("key").alias("path"), F.explode(F.array_union("content_markups", "other_markups")).alias("markup"))


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_markup(table(spark, d, "wiki_docs"), "path", "content").select(F.col("key").alias("path"), "clean", "n_blocks", "n_dropped")


def _scored(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, list[str]]]:
    results = ranking.ideal_point(table(spark, d, "search_results"), "query_id", "path", ["score", "vector_score"])
    turns = ranking.ideal_point(table(spark, d, "query_log"), "session_id", "id", ["lexical_top", "vector_top"])
    return [("result", results, ["score", "vector_score"]), ("turn", turns, ["lexical_top", "vector_top"])]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [ranking.agreed(df, s).select(F.lit(o).alias("origin"), F.col("group").cast("long").alias("group_id"), "item") for o, df, s in _scored(spark, d)]
    return parts[0].unionAll(parts[1])


def p5_ranking(spark: SparkSession, d: str) -> DataFrame:
    parts = [ranking.ranked(df).select(F.lit(o).alias("origin"), F.col("group").cast("long").alias("group_id"), "item", F.round("closeness", 6).alias("closeness"), "rank") for o, df, _ in _scored(spark, d)]
    return parts[0].unionAll(parts[1])


def _chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where(F.col("dims").isin(64, 96) & (F.size("vector") == F.col("dims"))).select("id", "vector")


def _asked_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_log").where(F.size("query_vector").isin(64, 96)).select(F.lit("query").alias("kind"), "id", F.col("query_vector").alias("vector"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = neighbours.similar_vectors(_chunk_vectors(spark, d), _asked_vectors(spark, d))
    return found.select(F.when(F.col("probe_kind") == "item", "chunk").otherwise(F.col("probe_kind")).alias("probe_kind"), "probe_id", "neighbour_id")


#: Items in a leaf of the forest in p6_recall: so few that every tree has many leaves, as in a large collection.
_RECALL_LEAF = 2048


def p6_recall(spark: SparkSession, d: str) -> DataFrame:
    """Of the true neighbours, by brute force over all chunks, of every chunk whose id is divisible by 20 and of every logged query: how many the forest
    finds when each tree has many leaves."""
    vectors, asked = _chunk_vectors(spark, d), _asked_vectors(spark, d)
    found = neighbours.similar_vectors(vectors, asked, leaf_rows=_RECALL_LEAF).select("probe_kind", "probe_id", "neighbour_id")
    probes = vectors.where(F.col("id") % 20 == 0).select(F.lit("item").alias("kind"), "id", "vector").unionAll(asked.dropDuplicates(["id"]))
    # one number a probe, negative for queries, so that no query is taken for the chunk of its id
    named = probes.select(F.when(F.col("kind") == "item", F.col("id")).otherwise(-1 - F.col("id")).alias("id"), "vector")
    true = neighbours.exact_neighbours(vectors, named)
    kind = F.when(F.col("probe_id") < 0, "query").otherwise("item")
    true = true.select(kind.alias("probe_kind"), F.when(F.col("probe_id") < 0, -1 - F.col("probe_id")).otherwise(F.col("probe_id")).alias("probe_id"), "neighbour_id")
    both = materialise(true, "true").join(found.withColumn("hit", F.lit(1)), ["probe_kind", "probe_id", "neighbour_id"], "left")
    out = both.groupBy("probe_kind").agg(F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_found"))
    return out.select(F.when(F.col("probe_kind") == "item", "chunk").otherwise("query").alias("probe_kind"), "n_true", "n_found", F.round(F.col("n_found") / F.col("n_true"), 4).alias("recall"))


def _frequencies(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(table(spark, d, "wiki_docs"), ["title", "content"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _frequencies(spark, d).where("mark is not null").select(F.explode(F.split("mark", ",")).alias("mark"), "term")


def p7_terms(spark: SparkSession, d: str) -> DataFrame:
    return _frequencies(spark, d).select("term", "occurrences", "records", F.coalesce("mark", F.lit("")).alias("mark"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sized = tokens.token_sizes(table(spark, d, "documents"), "text", ["doc_id"])
    return packing.packed(materialise(sized, "sized"), "doc_id", "n_tokens", CAPACITY)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the packing puts into several containers."""
    spread = _packed(spark, d).groupBy(F.col("key").alias("doc_id")).agg(F.min("container").alias("first"), F.max("container").alias("last"))
    return spread.where("first <> last").select("doc_id")


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).select(F.col("key").alias("doc_id"), "piece", "pieces", "n_tokens", "container")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    each = _packed(spark, d).groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return each.agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("most"), F.round(F.sum("used") / (F.count(F.lit(1)) * CAPACITY), 4).alias("filled"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return mixing.sized_documents(table(spark, d, "documents"), "doc_id", "text", "source", "lang", "page_type")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.falling_short(p9_shares(spark, d))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    sized = _sized(spark, d)
    plan = mixing.source_plan(sized, table(spark, d, "mix_targets"))
    return mixing.shares(plan, mixing.drawn(sized, plan))


def p9_sample(spark: SparkSession, d: str) -> DataFrame:
    sized = _sized(spark, d)
    return mixing.drawn(sized, mixing.source_plan(sized, table(spark, d, "mix_targets"))).select(F.col("key").alias("doc_id"), "source", "n_tokens", "copies")


def _repetition(spark: SparkSession, d: str) -> DataFrame:
    return repetition.measured(table(spark, d, "documents"), "doc_id", "text", "lang")


def _is_repetitive():
    return (F.col("n_words") >= 20) & (10 * (F.col("n_sequences") - F.col("n_distinct")) >= 3 * F.col("n_sequences"))


def _holdout(measures: DataFrame, half: int) -> DataFrame:
    """Labelled documents of one half that the rule applies to; shorter texts are neither good nor repetitive."""
    return measures.where(F.col("n_words") >= 20).where(F.pmod(F.xxhash64("key"), F.lit(2)) == half).withColumn("label", _is_repetitive())


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the certified cut-offs of shorter sequences reject, or that they leave open, are checked by the rule; no other is."""
    measures = materialise(_repetition(spark, d), "measures")
    cutoffs = repetition.certified_cutoffs(_holdout(measures, 0), ["short_share"])
    doubt = {"short_share": repetition.least_short_share(0.3, 20) - 1e-9}
    suspects = repetition.flagged(measures, cutoffs, ["short_share"], doubt).where(F.col("flag").isNull() | F.col("flag"))
    return suspects.where(_is_repetitive()).select(F.col("key").alias("doc_id"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return _repetition(spark, d).select(F.col("key").alias("doc_id"), "n_words", "n_sequences", "n_distinct", F.round("phrase_share", 6).alias("phrase_share"))


def p10_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Cut-offs from one half of the documents, and the false rejections they give on the other."""
    measures = materialise(_repetition(spark, d), "measures")
    cutoffs = repetition.certified_cutoffs(_holdout(measures, 0))
    limits = spark.createDataFrame([tuple(c) for c in cutoffs], "stratum string, measure string, cutoff double, rejected long, good long, bound double")
    other = _holdout(measures, 1).where(~F.col("label"))
    stacked = other.select("stratum", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in repetition.MEASURES))).alias("x")).select("stratum", "x.measure", "x.value")
    tested = stacked.join(F.broadcast(limits), ["stratum", "measure"]).groupBy("stratum", "measure").agg(F.count(F.lit(1)).alias("tested"), F.count(F.when(F.col("value") >= F.col("cutoff") - 1e-9, 1)).alias("wrong"))
    return limits.join(F.broadcast(tested), ["stratum", "measure"], "left")


QUERIES = {name: f for name, f in list(globals().items()) if name[0] == "p" and name[1:2].isdigit()}

_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_LETTERS = r"regexp_extract_all(lower(nfc_normalize(replace(replace({}, chr(173), ''), chr(8203), ''))), '\p{{L}}+')"

_PAIRS = f"""
WITH texts AS (
  SELECT 'document' AS origin, path AS key, {_WORDS.format("content")} AS w FROM wiki_docs
  UNION ALL SELECT 'chunk', CAST(id AS VARCHAR), {_WORDS.format("text")} FROM chunks
), sets AS (
  SELECT origin, key, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM texts WHERE len(w) >= 20
), rows_ AS (SELECT origin, key, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.origin, a.key AS key_a, b.key AS key_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS o
  FROM rows_ a JOIN rows_ b ON a.origin = b.origin AND a.g = b.g AND a.key < b.key GROUP BY ALL
)
SELECT origin, key_a, key_b FROM shared WHERE 2 * o >= na + nb - o"""

_GRAMS = "list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))))"
_GROUPS = f"""
WITH RECURSIVE texts AS (
  SELECT 'document' AS origin, path AS key, {_WORDS.format("content")} AS w FROM wiki_docs
  UNION ALL SELECT 'chunk', CAST(id AS VARCHAR), {_WORDS.format("text")} FROM chunks
), sets AS (SELECT origin, key, {_GRAMS} AS s FROM texts WHERE len(w) >= 5 AND key IS NOT NULL),
class AS (SELECT origin, s, min(key) AS class_key FROM sets GROUP BY ALL),
rows_ AS (SELECT origin, class_key, len(s) AS n, unnest(s) AS g FROM class),
shared AS (SELECT a.origin, a.class_key AS a, b.class_key AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS o FROM rows_ a JOIN rows_ b ON a.origin = b.origin AND a.g = b.g AND a.class_key < b.class_key GROUP BY ALL),
link AS (SELECT origin, a, b FROM shared WHERE 5 * o >= 4 * (na + nb - o)),
ways AS (SELECT origin, a, b FROM link UNION ALL SELECT origin, b, a FROM link),
reached AS (SELECT origin, class_key AS a, class_key AS root FROM class UNION SELECT r.origin, w.b, r.root FROM reached r JOIN ways w ON w.origin = r.origin AND w.a = r.a),
groups_ AS (SELECT origin, a AS class_key, min(root) AS group_key FROM reached GROUP BY ALL),
links AS (SELECT origin, a AS class_key, count(*) AS n FROM ways GROUP BY ALL)
SELECT origin, key, class_key, group_key, coalesce(n, 0) AS n_links FROM sets JOIN class USING (origin, s) JOIN groups_ USING (origin, class_key) LEFT JOIN links USING (origin, class_key)"""

_TERMS = f"""
WITH words AS (SELECT path, unnest(list_concat({_LETTERS.format("coalesce(title, '')")}, {_LETTERS.format("coalesce(content, '')")})) AS term FROM wiki_docs),
each_ AS (SELECT path, term, count(*) AS tf FROM words GROUP BY ALL),
stats AS (SELECT term, CAST(sum(tf) AS BIGINT) AS occurrences, count(*) AS records FROM each_ GROUP BY term),
marked AS (SELECT *, records <= 2 AS rare, records > 0.5 * (SELECT count(*) FROM wiki_docs) AS common FROM stats)"""

_SCORES = f"""
WITH mention AS (
  SELECT DISTINCT ON (mention_id) mention_id, doc_path, tf, regexp_replace(lower(replace(entity, '\\', '/')), '^\\s+|\\s+$', '', 'g') AS e FROM mentions
), occurrences AS (
  SELECT 'mention' AS origin, doc_path, CASE WHEN e LIKE '%.md' THEN e ELSE e || '.md' END AS term, CAST(sum(tf) AS BIGINT) AS tf FROM mention WHERE tf > 0 AND e IS NOT NULL AND doc_path IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT 'content', path, term, count(*) FROM (SELECT path, unnest(list_concat({_LETTERS.format("coalesce(title, '')")}, {_LETTERS.format("coalesce(content, '')")})) AS term FROM wiki_docs) GROUP BY ALL
), sizes AS (SELECT origin, doc_path, sum(tf) AS length FROM occurrences GROUP BY ALL),
records AS (SELECT 'content' AS origin, count(*) AS n FROM wiki_docs UNION ALL SELECT 'mention', count(*) FROM sizes WHERE origin = 'mention'),
means AS (SELECT origin, any_value(n) AS n, sum(length) / any_value(n) AS mean FROM sizes JOIN records USING (origin) GROUP BY origin),
stats AS (SELECT origin, term, count(*) AS df, sum(tf) AS cf FROM occurrences GROUP BY ALL),
parts AS (SELECT o.*, s.df, s.cf / m.n AS rate, o.tf * log2(1 + m.mean / z.length) AS tfn FROM occurrences o JOIN stats s USING (origin, term) JOIN sizes z USING (origin, doc_path) JOIN means m USING (origin)),
scored AS (SELECT origin, doc_path, term, tf, df, (log2(1 + rate) + tfn * log2((1 + rate) / rate)) / (tfn + 1) AS score FROM parts)"""

_RANKS = """
WITH rows_ AS (
  SELECT 'result' AS origin, query_id AS group_id, path AS item, score AS x, vector_score AS y FROM search_results
  UNION ALL SELECT 'turn', session_id, CAST(id AS VARCHAR), lexical_top, vector_top FROM query_log
), best AS (
  SELECT origin, group_id, item, max(x) FILTER (isfinite(x)) AS x, max(y) FILTER (isfinite(y)) AS y FROM rows_ WHERE group_id IS NOT NULL AND item IS NOT NULL GROUP BY ALL
)"""

_WINSOR = (
    _RANKS
    + """,
cuts AS (SELECT origin, group_id, quantile_disc(x, 0.05) AS x0, quantile_disc(x, 0.95) AS x1, quantile_disc(y, 0.05) AS y0, quantile_disc(y, 0.95) AS y1 FROM best GROUP BY ALL),
clipped AS (SELECT b.origin, b.group_id, item, CASE WHEN x IS NOT NULL THEN least(greatest(x, x0), x1) END AS x, CASE WHEN y IS NOT NULL THEN least(greatest(y, y0), y1) END AS y FROM best b JOIN cuts USING (origin, group_id)),
ends AS (SELECT origin, group_id, sqrt(sum(x * x)) AS nx, sqrt(sum(y * y)) AS ny, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM clipped GROUP BY ALL),
unit AS (SELECT c.origin, c.group_id, item,
  CASE WHEN nx > 0 THEN coalesce(x, lx) / nx ELSE 0 END AS x, CASE WHEN ny > 0 THEN coalesce(y, ly) / ny ELSE 0 END AS y,
  CASE WHEN nx > 0 THEN lx / nx ELSE 0 END AS lx, CASE WHEN nx > 0 THEN hx / nx ELSE 0 END AS hx, CASE WHEN ny > 0 THEN ly / ny ELSE 0 END AS ly, CASE WHEN ny > 0 THEN hy / ny ELSE 0 END AS hy
  FROM clipped c JOIN ends USING (origin, group_id)),
far AS (SELECT origin, group_id, item, sqrt((hx - x) * (hx - x) + (hy - y) * (hy - y)) AS up, sqrt((x - lx) * (x - lx) + (y - ly) * (y - ly)) AS down FROM unit)"""
)

SQL = {
    "p2_found": _PAIRS,
    "p2_groups": _GROUPS,
    "p3_found": _SCORES + "\nSELECT origin, doc_path, term FROM scored WHERE tf >= 4 AND df BETWEEN 2 AND 5",
    "p3_scores": _SCORES + "\nSELECT origin, doc_path, term, tf, df, round(score, 6) AS score FROM scored",
    "p5_found": _RANKS
    + """,
placed AS (
  SELECT origin, group_id, item, CASE WHEN x IS NOT NULL THEN rank() OVER (PARTITION BY origin, group_id ORDER BY x DESC NULLS LAST) END AS px, CASE WHEN y IS NOT NULL THEN rank() OVER (PARTITION BY origin, group_id ORDER BY y DESC NULLS LAST) END AS py FROM best
)
SELECT origin, group_id, min(item) AS item FROM placed WHERE px <= 2 AND py <= 2 GROUP BY origin, group_id HAVING count(*) = 1""",
    "p5_ranking": _WINSOR + "\nSELECT origin, group_id, item, round(CASE WHEN up + down > 0 THEN down / (up + down) ELSE 0 END, 6) AS closeness, row_number() OVER (PARTITION BY origin, group_id ORDER BY CASE WHEN up + down > 0 THEN down / (up + down) ELSE 0 END DESC, item) AS rank FROM far",
    "p6_found": """
WITH v AS (
  SELECT 'chunk' AS kind, id, vector AS v FROM chunks WHERE len(vector) = dims AND dims IN (64, 96)
  UNION SELECT 'query', id, query_vector FROM query_log WHERE len(query_vector) IN (64, 96)
), ok AS (
  SELECT kind, id, len(v) AS n, CAST(v AS DOUBLE[]) AS v, sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * x))) AS norm FROM v WHERE list_max(list_transform(v, lambda x: abs(x))) > 0
), near AS (
  SELECT p.kind AS probe_kind, p.id AS probe_id, c.id AS neighbour_id, round(list_inner_product(p.v, c.v) / (p.norm * c.norm), 9) AS s
  FROM ok p JOIN ok c ON p.n = c.n AND c.kind = 'chunk' AND NOT (p.kind = 'chunk' AND p.id = c.id)
), placed AS (SELECT *, row_number() OVER (PARTITION BY probe_kind, probe_id ORDER BY s DESC, neighbour_id) AS r FROM near WHERE s >= 0.85)
SELECT probe_kind, probe_id, neighbour_id FROM placed WHERE r <= 5""",
    "p7_found": _TERMS + "\nSELECT 'rare' AS mark, term FROM marked WHERE rare UNION ALL SELECT 'common', term FROM marked WHERE common",
    "p7_terms": _TERMS + "\nSELECT term, occurrences, records, CASE WHEN rare AND common THEN 'rare,common' WHEN rare THEN 'rare' WHEN common THEN 'common' ELSE '' END AS mark FROM marked",
    "p10_rates": f"""
WITH w AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
s AS (SELECT doc_id, len(w) AS n, list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]) AS s FROM w)
SELECT doc_id, n AS n_words, CAST(len(s) AS BIGINT) AS n_sequences, CAST(len(list_distinct(s)) AS BIGINT) AS n_distinct, CASE WHEN len(s) > 0 THEN round(1 - len(list_distinct(s)) / len(s), 6) ELSE 0 END AS phrase_share FROM s""",
}
SQL["p10_found"] = f"SELECT doc_id FROM ({SQL['p10_rates']}) WHERE n_words >= 20 AND 10 * (n_sequences - n_distinct) >= 3 * n_sequences"
