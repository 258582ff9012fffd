"""The graphs of a corpus: curated links between pages, mentions of pages in texts, and the two merged for diffusion.

Documents are ``docs(path, title, content, kind, links, sources, page_type)``; where several claim one name, order of ``path`` decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusrank.functions import text as t
from corpusrank.operators import blocks
from corpusrank.operators.skew import group_positions, join_statistics
from corpusrank.shared import materialise, partitions, spread

# Signal weights, edge limits and pruning of the two graphs.
DIRECT_LINK, SHARED_SOURCE, COMMON_NEIGHBOUR, SAME_TYPE = 3.0, 4.0, 1.5, 1.0
LEAST_FORM, HUB_FRACTION, HUB_SHARE, MENTIONS_PER_DOCUMENT, MENTION_SCALE = 3, 0.01, 0.5, 4, 0.05
ENTITY = "@entity/"
#: Links and sources that are sent to the tasks, some 80 MB at most.
KERNEL_ROWS = 5_000_000


@dataclass(frozen=True)
class Naming:
    """How a corpus names its documents, as functions of its columns: key, aliases and surface forms (arrays), and what is a page."""

    key: Callable[[], Column] = lambda: F.col("path")
    aliases: Callable[[], Column] = lambda: F.array("path", F.regexp_replace("path", "^wiki/", ""), t.file_stem(F.col("path")), "title")
    surface_forms: Callable[[], Column] = lambda: F.array("title", t.file_stem(F.col("path")), F.translate(t.file_stem(F.col("path")), "-", " "))
    title_field: Callable[[], Column] = lambda: t.search_title(F.col("title"), F.col("path"))
    is_page: Callable[[], Column] = lambda: F.col("kind") == "wiki"


# --- curated links -------------------------------------------------------------------------------------------------------


def alias_table(docs: DataFrame, naming: Naming = Naming()) -> DataFrame:
    """(alias, key): what a link may call a page; of several pages the last by path has the name."""
    names = docs.where(naming.is_page()).select(naming.key().alias("key"), F.explode(F.filter(naming.aliases(), lambda a: a.isNotNull() & (a != ""))).alias("name"))
    return names.select("key", t.alias(F.col("name")).alias("alias")).groupBy("alias").agg(F.max("key").alias("key"))


def link_edges(docs: DataFrame, naming: Naming = Naming()) -> DataFrame:
    """(src, dst): links between pages, both ways, each once; links to nothing or to oneself lead nowhere."""
    links = docs.where(naming.is_page()).select(naming.key().alias("src"), F.explode("links").alias("link")).where("link is not null")
    directed = links.select("src", t.alias(F.col("link")).alias("alias")).join(alias_table(docs, naming), "alias").select("src", F.col("key").alias("dst")).where("src <> dst")
    return directed.unionAll(directed.select("dst", "src")).distinct()


def source_pages(docs: DataFrame, naming: Naming = Naming()) -> DataFrame:
    """(source, key): pages written from a source."""
    return docs.where(naming.is_page()).select(F.explode("sources").alias("s"), naming.key().alias("key")).where("s is not null").select(t.alias(F.col("s")).alias("source"), "key").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree)."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def relevance(docs: DataFrame, pairs: DataFrame, edges: DataFrame, naming: Naming = Naming()) -> DataFrame:
    """(src, dst, weight) of each of ``pairs(src, dst)``, by direct link, any shared source, common neighbours (Adamic-Adar) and type.

    Common neighbours are counted for the given pairs only: pair -> neighbours of its end with fewer -> is it one of the other end. So a hub's
    neighbours are only gone through for a pair of hubs. Degrees are joined with hubs split.
    """
    pairs, edges = materialise(pairs.where("src <> dst").distinct(), "pairs"), materialise(edges.select("src", "dst"), "links")
    direct = edges.select("src", "dst", F.lit(DIRECT_LINK).alias("weight")).join(pairs, ["src", "dst"], "left_semi")
    sources = source_pages(docs, naming)
    shared = pairs.join(sources.select(F.col("key").alias("src"), "source"), "src").join(sources.select(F.col("key").alias("dst"), "source"), ["dst", "source"])
    shared = shared.select("src", "dst").distinct().select("src", "dst", F.lit(SHARED_SOURCE).alias("weight"))
    deg = materialise(degrees(edges), "degrees")
    weighed = join_statistics(edges.select(F.col("src").alias("low"), F.col("dst").alias("node")), deg, "node", "degree", F.col("low"))
    weighed = weighed.select("low", F.col("node").alias("mid"), (F.lit(COMMON_NEIGHBOUR) / F.log(F.greatest(F.col("degree"), F.lit(2)))).alias("weight"))
    ends = join_statistics(pairs.select(F.col("src").alias("node"), "dst"), deg, "node", "degree", F.col("dst")).select(F.col("node").alias("src"), F.col("dst").alias("node"), F.col("degree").alias("of_src"))
    ends = join_statistics(ends, deg, "node", "degree", F.col("src")).select("src", F.col("node").alias("dst"), (F.col("of_src") <= F.col("degree")).alias("first"))
    sides = ends.select("src", "dst", F.when(F.col("first"), F.col("src")).otherwise(F.col("dst")).alias("low"), F.when(F.col("first"), F.col("dst")).otherwise(F.col("src")).alias("high"))
    common = sides.join(weighed, "low").join(edges.select(F.col("src").alias("mid"), F.col("dst").alias("high")), ["mid", "high"])
    common = common.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    kinds = docs.where(naming.is_page()).select(naming.key().alias("k"), "page_type").where("page_type <> ''")
    same = pairs.join(kinds.toDF("src", "a"), "src").join(kinds.toDF("dst", "b"), "dst").where("a = b").select("src", "dst", F.lit(SAME_TYPE).alias("weight"))
    signals = direct.unionByName(shared).unionByName(common.select("src", "dst", "weight")).unionByName(same)
    return signals.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def related_pages(docs: DataFrame, of: DataFrame, limit: int = 10, naming: Naming = Naming(), kernel_rows: int = KERNEL_ROWS) -> DataFrame:
    """(src, dst, weight, rank): for each page of ``of(src)`` the most relevant ones among its neighbours, theirs, and pages of its sources.

    A hub makes as many pairs as the square of its degree. Links and sources of at most ``kernel_rows`` rows, which are counted first, are sent to the
    tasks, and each page's pairs are added up and cut to ``limit`` where they are made; more are joined and shuffled.
    """
    edges, sources = materialise(link_edges(docs, naming), "links"), materialise(source_pages(docs, naming), "sources")
    if edges.count() + sources.count() <= kernel_rows:
        return _related_in_tasks(docs, of, edges, sources, limit, naming)
    one = of.join(edges, "src").select("src", "dst")
    two = one.select("src", F.col("dst").alias("mid")).join(edges.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
    along = of.join(sources.select(F.col("key").alias("src"), "source"), "src").join(sources.select(F.col("key").alias("dst"), "source"), "source").select("src", "dst")
    scored = relevance(docs, one.unionAll(two).unionAll(along), edges, naming).where("weight > 0")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc(F.round("weight", 9)), "dst")))
    return ranked.where(F.col("rank") <= limit)


def _related_in_tasks(docs: DataFrame, of: DataFrame, edges: DataFrame, sources: DataFrame, limit: int, naming: Naming) -> DataFrame:
    """Pages are numbered by key; a task goes through the neighbours' neighbours of one page after the other."""
    spark = docs.sparkSession
    pages = materialise(blocks.numbered(docs.where(naming.is_page()).select(naming.key().alias("key"), "page_type"), "key"), "pages")
    known = pages.select("item", "page_type").toArrow().sort_by("item")
    number = known.column("item").to_numpy()
    kinds = known.column("page_type").combine_chunks().dictionary_encode()
    kind = kinds.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    kind[np.isin(kind, [i for i, x in enumerate(kinds.dictionary.to_pylist()) if not x])] = -1
    numbers = lambda c, n: pages.select(F.col("key").alias(c), F.col("item").alias(n))
    links = edges.join(numbers("src", "a"), "src").join(numbers("dst", "b"), "dst").select("a", "b").toArrow()
    written = sources.join(numbers("key", "b"), "key").select("source", "b").toArrow()
    place = lambda t, c: np.searchsorted(number, t.column(c).to_numpy())
    group = written.column("source").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    groups = int(group.max()) + 1 if len(group) else 0
    near, origin, members = _lists(place(links, "a"), place(links, "b"), len(number)), _lists(place(written, "b"), group, len(number)), _lists(group, place(written, "b"), groups)
    sent = spark.sparkContext.broadcast((number, kind, near, origin, members))

    def related(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, kind, near, origin, members = sent.value
        common = COMMON_NEIGHBOUR / np.log(np.maximum(np.diff(near[0]), 2))
        for batch in it:
            out = []
            for src in np.searchsorted(number, batch.column("item").to_numpy()).tolist():
                dst, weight = _relevant(src, kind, near, origin, members, common)
                rounded = np.round(weight, 9)
                at = np.flatnonzero(rounded >= np.partition(rounded, -limit)[-limit]) if len(dst) > limit else np.arange(len(dst))
                at = at[np.lexsort((dst[at], -rounded[at]))[:limit]]
                out.append((np.full(len(at), number[src]), number[dst[at]], weight[at], np.arange(1, len(at) + 1, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["a", "b", "weight", "rank"])

    asked = of.select("src").distinct().join(numbers("src", "item"), "src").select("item").repartition(partitions(spark, spark.sparkContext.defaultParallelism))
    found = asked.mapInArrow(related, "a long, b long, weight double, rank int")
    return found.join(numbers("src", "a"), "a").join(numbers("dst", "b"), "b").select("src", "dst", "weight", "rank")


def _lists(of: np.ndarray, what: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(ends, values): what belongs to i is values[ends[i]:ends[i + 1]]."""
    order = np.argsort(of, kind="stable")
    return np.searchsorted(of[order], np.arange(n + 1)), what[order]


def _relevant(src: int, kind: np.ndarray, near: tuple, origin: tuple, members: tuple, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dst, weight) of all pages that a page has to do with."""
    of = lambda lists, i: lists[1][lists[0][i] : lists[0][i + 1]]
    direct = of(near, src)
    along = np.unique(np.concatenate([of(members, g) for g in of(origin, src)])) if len(of(origin, src)) else direct[:0]
    beyond = [of(near, mid) for mid in direct.tolist()]
    parts = [direct, along, *beyond]
    dst = np.concatenate(parts)
    weight = np.repeat(np.r_[DIRECT_LINK, SHARED_SOURCE, common[direct]], [len(x) for x in parts])
    if len(dst) * 8 > len(kind):
        total = np.bincount(dst, weight, len(kind))
        total[src] = 0
        dst = np.flatnonzero(total)
        weight = total[dst]
    else:
        dst, back = np.unique(dst, return_inverse=True)
        weight = np.bincount(back, weight, len(dst))
        dst, weight = dst[dst != src], weight[dst != src]
    return dst, weight + SAME_TYPE * ((kind[dst] == kind[src]) & (kind[src] >= 0))


# --- mentions -------------------------------------------------------------------------------------------------------------


def form_table(docs: DataFrame, naming: Naming = Naming()) -> DataFrame:
    """(form, key): lower-cased strings that mean a page in prose; of several pages the first by path has the form."""
    forms = docs.where(naming.is_page()).select(naming.key().alias("key"), F.explode(naming.surface_forms()).alias("f")).where("f is not null")
    return forms.select("key", F.lower(F.trim("f")).alias("form")).where(F.length("form") >= LEAST_FORM).groupBy("form").agg(F.min("key").alias("key"))


def scanned_mentions(docs: DataFrame, naming: Naming = Naming()) -> DataFrame:
    """(entity, key, tf): how often each page is named in each document: whole words in any letter case, the leftmost longest form first,
    none overlapping; and each page once in itself if it never names itself.

    Forms meet runs of as many words as they have in an equi-join, so neither side has to fit in memory. A form that begins or ends with
    punctuation is no whole word and is never found.
    """
    words = r"(?U)\w+|\W+"
    forms = form_table(docs, naming).withColumn("n", F.size(F.regexp_extract_all("form", F.lit(r"(?U)\w+"), 0))).where(F.col("form").rlike(r"(?U)^\w(.*\w)?$"))
    lengths = sorted(r["n"] for r in forms.select("n").distinct().collect())  # numbers of words in a name
    pieces = spread(docs.select("path", "content")).select(F.col("path").alias("key"), F.regexp_extract_all(F.lower(F.coalesce("content", F.lit(""))), F.lit(words), 0).alias("w"))
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0))), lambda i: F.get("w", i).rlike(r"(?U)^\w"))
    placed = pieces.select("key", "w", F.explode(at).alias("at"))
    runs = F.array(*(F.struct(F.lit(n).alias("n"), F.array_join(F.slice("w", F.col("at") + 1, 2 * n - 1), "").alias("form")) for n in lengths)) if lengths else F.array().cast("array<struct<n:int,form:string>>")
    found = placed.select("key", "at", F.explode(runs).alias("r")).select("key", "at", "r.form", "r.n").join(forms.select("form", "n", F.col("key").alias("entity")), ["form", "n"])
    listed = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("less"), "entity"))).alias("m"))  # of one document
    start = F.struct(F.lit(-1).alias("end"), F.array().cast("array<string>").alias("kept"))
    fold = F.aggregate("m", start, lambda s, x: F.when(x["at"] > s["end"], F.struct((x["at"] - 2 * x["less"] - 2).alias("end"), F.concat(s["kept"], F.array(x["entity"])).alias("kept"))).otherwise(s))
    counted = listed.select("key", F.explode(fold["kept"]).alias("entity")).groupBy("entity", "key").agg(F.count(F.lit(1)).alias("tf"))
    return with_definitions(counted, docs, naming)


def with_definitions(mentions: DataFrame, docs: DataFrame, naming: Naming = Naming()) -> DataFrame:
    """``mentions(entity, key, tf)`` and each page as mentioned once in itself where it isn't."""
    own = docs.where(naming.is_page()).select(naming.key().alias("entity"), naming.key().alias("key"), F.lit(1).cast("long").alias("tf"))
    return mentions.unionByName(own.join(mentions, ["entity", "key"], "left_anti"))


def hubs(mentions: DataFrame, documents: int) -> DataFrame:
    """(entity): the top 1 % by number of documents, and all in more than half of the documents (and more than two)."""
    df = materialise(mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("df")), "df")
    cut = int(df.count() * HUB_FRACTION)
    placed = group_positions(df.select("entity", (-F.col("df")).alias("_less"), F.lit(0).alias("_one")), "_one", ["_less", "entity"], "_at")
    most = placed.where(F.col("_at") <= cut).select("entity")
    return most.unionAll(df.where(F.col("df") > max(2, int(documents * HUB_SHARE))).select("entity")).distinct()


def without_hubs(mentions: DataFrame, documents: int) -> DataFrame:
    return mentions.join(hubs(mentions, documents), "entity", "left_anti")


def mention_weights(mentions: DataFrame, documents: int) -> DataFrame:
    """(entity, key, tf, weight): tf * ln((N + 1) / (df + 1)) + 1."""
    df = mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("df"))
    return mentions.join(df, "entity").select("entity", "key", "tf", (F.col("tf") * F.log(F.lit(documents + 1.0) / (F.col("df") + 1)) + 1).alias("weight"))


def mention_edges(mentions: DataFrame, documents: int, per_document: int = MENTIONS_PER_DOCUMENT) -> DataFrame:
    """(src, dst, weight) between documents and the entities they mention most, both ways; entity nodes begin with '@entity/'."""
    strongest = Window.partitionBy("key").orderBy(F.desc(F.round("weight", 9)), "entity")
    kept = mention_weights(mentions, documents).where("weight > 0").withColumn("r", F.row_number().over(strongest)).where(F.col("r") <= per_document)
    out = kept.select(F.col("key").alias("src"), F.concat(F.lit(ENTITY), "entity").alias("dst"), "weight")
    return out.unionAll(out.select("dst", "src", "weight"))


def merged_edges(docs: DataFrame, mentions: DataFrame | None, documents: int, curated_links: bool = True, per_document: int = MENTIONS_PER_DOCUMENT, scale: float = MENTION_SCALE, naming: Naming = Naming()) -> DataFrame:
    """(src, dst, weight): curated links by relevance and mentions by scaled weight; of both, the greater."""
    parts = []
    if curated_links:
        edges = link_edges(docs, naming)
        parts.append(relevance(docs, edges, edges, naming).where("weight > 0").select("src", "dst", "weight"))
    if mentions is not None:
        parts.append(mention_edges(mentions, documents, per_document).withColumn("weight", F.col("weight") * scale))
    if not parts:
        return docs.sparkSession.createDataFrame([], "src string, dst string, weight double")
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def transitions(edges: DataFrame, self_weight: float = 1.0) -> DataFrame:
    """(src, dst, p): rows that sum to 1, with a share of self_weight / (1 + self_weight) staying; nodes without weight have no row."""
    total = F.sum("weight").over(Window.partitionBy("src"))
    rows = edges.where("weight is not null").withColumn("total", total).where("total > 0")
    out = rows.select("src", "dst", (F.col("weight") / (F.col("total") * (1 + self_weight))).alias("p"))
    if not self_weight:
        return out
    stay = rows.select("src").distinct().select("src", F.col("src").alias("dst"), F.lit(self_weight / (1 + self_weight)).alias("p"))
    return out.unionByName(stay).groupBy("src", "dst").agg(F.sum("p").alias("p"))
