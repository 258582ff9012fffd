"""Budgets in characters, packing results into a context, and counting what an answer cites."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusrank.functions import text as t

# A context's size and its shares.
DEFAULT_CONTEXT, RESERVE, INDEX, PAGES, ONE_PAGE, ONE_PAGE_LEAST = 204_800, 0.15, 0.05, 0.50, 0.30, 5_000
SINGLE_PASS_MOST, SINGLE_PASS_LEAST, RESERVED_LEAST = 600_000, 20_000, 12_000
# The generation's token limits from a context size on.
GENERATION_TOKENS = ((512_000, 32_000), (256_000, 24_000), (128_000, 16_000), (0, 8_192))
TRIM_MARKER = "\n\n[...trimmed for prompt budget...]"


@dataclass(frozen=True)
class ContextBudget:
    """Characters for a whole context, the reply, the index, all pages and one page."""

    size: int
    reserve: int
    index: int
    pages: int
    page: int


def context_budget(size: int | None = None) -> ContextBudget:
    size = size if size and size > 0 else DEFAULT_CONTEXT
    pages = int(size * PAGES)
    return ContextBudget(size, int(size * RESERVE), int(size * INDEX), pages, min(pages, max(ONE_PAGE_LEAST, int(pages * ONE_PAGE))))


def budget_columns(size: Column) -> list[Column]:
    """``context_budget`` as columns reserve, index_budget, page_budget and max_page."""
    size = F.when(size > 0, size).otherwise(DEFAULT_CONTEXT)
    part = lambda share: F.floor(size * share).cast("long")
    pages = part(PAGES)
    return [part(RESERVE).alias("reserve"), part(INDEX).alias("index_budget"), pages.alias("page_budget"), F.least(pages, F.greatest(F.lit(ONE_PAGE_LEAST).cast("long"), F.floor(pages * ONE_PAGE).cast("long"))).alias("max_page")]


def source_budget(size: int | None, stable: int) -> int:
    """Characters of a source that one analysis takes beside ``stable`` ones that are always there."""
    b = context_budget(size)
    kept = min(int(b.size * 0.25), max(RESERVED_LEAST, stable)) + max(RESERVED_LEAST, int(b.size * 0.08))
    most = min(SINGLE_PASS_MOST, max(SINGLE_PASS_LEAST, int(b.size * 0.6)))
    return max(SINGLE_PASS_LEAST, min(b.size - b.reserve - kept, most))


def generation_tokens(size: int | None = None) -> int:
    return next(tokens for least, tokens in GENERATION_TOKENS if context_budget(size).size >= least)


def packed_context(results: DataFrame, page_budget: int, max_page: int) -> DataFrame:
    """(query_id, number, path, block) of the results that fit, in order of rank: ``results(query_id, rank, path, title, kind, content, related)``.

    A result that doesn't fit is passed over and the next ones are tried; the first is cut to the budget if it alone is too long. Numbers run
    from 1 without gaps. A query has few results, so each is folded within its row; null contents count as empty.
    """
    body = t.trimmed(F.regexp_replace(F.coalesce("content", F.lit("")), r"(?U)^\s+|\s+$", ""), max_page, TRIM_MARKER)
    head = F.concat(F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n("), F.when(F.col("kind") == "source", "source").otherwise("wiki page"), F.lit(": "), F.col("path"), F.lit(")"))
    related = F.when(F.size("related") > 0, F.concat(F.lit("\nRelated via: "), F.array_join("related", ", "))).otherwise("")
    rest = F.concat(head, related, F.lit("\n\n"), body, F.lit("\n"))
    listed = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "path", rest.alias("rest")))).alias("r"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<number:int,path:string,block:string>>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        number = F.size(s["kept"]) + 1
        block = F.concat(F.lit("### ["), number.cast("string"), x["rest"])
        cut = F.when((s["used"] == 0) & (F.length(block) > page_budget), F.substring(block, 1, page_budget)).otherwise(block)
        fits = s["used"] + F.length(cut) <= page_budget
        added = F.concat(s["kept"], F.array(F.struct(number.alias("number"), x["path"].alias("path"), cut.alias("block"))))
        return F.when(fits, F.struct((s["used"] + F.length(cut)).alias("used"), added.alias("kept"))).otherwise(s)

    return listed.select("query_id", F.explode(F.aggregate("r", start, step)["kept"]).alias("x")).select("query_id", "x.number", "x.path", "x.block")


def cited_numbers(answer: Column) -> Column:
    """The distinct numbers that an answer cites as [1], [1][2] or [1, 2], ascending."""
    groups = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), 1)
    numbers = F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda v: F.trim(v).cast("int"))))
    return F.array_sort(F.array_distinct(numbers))


def marked_citations(packed: DataFrame, answers: DataFrame) -> DataFrame:
    """``packed`` with ``cited``: whether ``answers(query_id, answer)`` cites the number; false without an answer."""
    cites = answers.select("query_id", cited_numbers(F.col("answer")).alias("_cites"))
    joined = packed.join(cites, "query_id", "left")
    return joined.withColumn("cited", F.coalesce(F.array_contains("_cites", F.col("number")), F.lit(False))).drop("_cites")
