"""The vector lane and the vector store's tables: ``chunks(page_id, chunk_index, heading_path, text, vector)`` and ``pages(page_id, title, hash, model)``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusrank.operators import blocks
from corpusrank.operators.lexical import top
from corpusrank.shared import materialise

#: Chunks that a task holds at once; how much single precision may be off: more than the error of any dot product of unit vectors of up to 256 numbers.
BLOCK_CHUNKS, SLACK = 130_000, np.float32(4e-5)


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """The vector divided by its length; a zero vector as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def nearest_chunks(chunks: DataFrame, queries: DataFrame, k: int = 30) -> DataFrame:
    """(query_id, page_id, chunk_index, score, rank): the ``k`` chunks of greatest cosine for each of ``queries(query_id, vector)``.

    A stated set of queries against all chunks of as many dims: each task multiplies its chunks with the queries, and only the best of each task are
    shuffled. Single precision only leaves out what cannot be among the best; scores are exact. Texts are not read; join them to the winners. Ties go
    to the smaller (page_id, chunk_index). Null vectors take no part; zero vectors score 0.
    """
    c = materialise(blocks.numbered(chunks.where("vector is not null").select("page_id", "chunk_index", "vector"), "page_id", "chunk_index"), "vectors")
    n = c.count()

    def score(table: pa.Table, pack: Callable) -> DataFrame:
        lists = table.column("vector").combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        asked = {}
        for dims in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == dims)
            v = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, int(dims))
            asked[int(dims)] = (at, _unit(v))
        sent = c.sparkSession.sparkContext.broadcast(asked)

        def near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for batch in it:
                rows = batch.column("vector")
                sizes = np.diff(np.asarray(rows.offsets))
                flat, item = rows.flatten().to_numpy(zero_copy_only=False), batch.column("item").to_numpy()
                dim = np.repeat(sizes, sizes)
                for d in set(sizes.tolist()) & set(sent.value):
                    held.setdefault(d, []).append((flat[dim == d].reshape(-1, d), item[sizes == d]))
            for d, some in held.items():
                at, q = sent.value[d]
                yield from _near_best(np.concatenate([v for v, _ in some]), np.concatenate([i for _, i in some]), at, q, k, pack)

        return blocks.in_blocks(c.select("item", "vector"), n, BLOCK_CHUNKS).mapInArrow(near, blocks._FOUND)

    asked = queries.where("vector is not null").select("query_id", "vector")
    found = blocks.best(asked, score, k, k * c.sparkSession.sparkContext.defaultParallelism, 12)
    return found.join(c.select("item", "page_id", "chunk_index"), "item").select("query_id", "page_id", "chunk_index", "score", "rank")


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows in double precision, divided by their lengths; zero rows as they are."""
    v = v.astype(np.float64)
    n = np.sqrt(np.einsum("ij,ij->i", v, v))
    return v / np.where(n > 0, n, 1)[:, None]


def _near_best(v: np.ndarray, item: np.ndarray, at: np.ndarray, q: np.ndarray, k: int, pack: Callable) -> Iterator[pa.RecordBatch]:
    """The ``k`` best of ``v`` for each row of ``q``, some queries at a time; ``v`` is met in pieces, and what a query's k-th best so far excludes is
    not looked at again."""
    unit = np.empty(v.shape, dtype=np.float32)
    for a in range(0, len(v), 8192):
        unit[a : a + 8192] = _unit(v[a : a + 8192])
    for b in range(0, len(q), 1024):
        own = q[b : b + 1024]
        small, limit = own.astype(np.float32), np.full(len(own), -np.inf, dtype=np.float32)
        got, loose = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)), []
        for a in range(0, len(v), 4096):
            near = small @ unit[a : a + 4096].T
            if a == 0 and near.shape[1] > k:
                limit = np.partition(near, -k, axis=1)[:, -k] - SLACK
            row, col = np.nonzero(~(near < limit[:, None]))
            loose.append((row, col + a, _dots(own, v, row, col + a)))
            if a + 4096 >= len(v) or sum(len(x[0]) for x in loose) > 4 * k * len(own):
                got = tuple(np.concatenate(x) for x in zip(got, *loose, strict=True))
                order, rank = blocks.first(got[0], item[got[1]], got[2], k, 12)
                got, loose = tuple(x[order] for x in got), []
                full = rank == k
                limit[got[0][full]] = np.maximum(limit[got[0][full]], np.nan_to_num(got[2][full], nan=np.inf) - SLACK)
        yield from pack(at[got[0] + b], item[got[1]], got[2])


def _dots(q: np.ndarray, v: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Exact cosines of pairs of rows, some at a time."""
    out = np.empty(len(row))
    for a in range(0, len(row), 50_000):
        out[a : a + 50_000] = np.einsum("ij,ij->i", q[row[a : a + 50_000]], _unit(v[col[a : a + 50_000]]))
    return out


def pages_of(hits: DataFrame, k: int = 10, kept: int = 3) -> DataFrame:
    """(query_id, page_id, score, chunks, rank): pages by their best chunk, with their ``kept`` best chunk indexes; the ``k`` best pages."""
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.round("score", 12)).alias("s"), "chunk_index"))), 1, kept)  # hits of one page and query
    grouped = hits.groupBy("query_id", "page_id").agg(F.max("score").alias("score"), F.transform(best, lambda x: x["chunk_index"]).alias("chunks"))
    return top(grouped, "query_id", [F.desc(F.round("score", 12)), F.col("page_id")], k)


def vector_lane(chunks: DataFrame, queries: DataFrame, k: int = 10, depth: int = 0) -> DataFrame:
    """(query_id, key, score, rank) of pages, ``depth`` deep (0: max(2 k, 20)), from three times as many chunks, 30 at least."""
    deep = depth or max(2 * k, 20)
    return pages_of(nearest_chunks(chunks, queries, max(3 * deep, 30)), deep).select("query_id", F.col("page_id").alias("key"), "score", "rank")


# --- the store's tables -------------------------------------------------------------------------------------------------


def pending(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of ``documents(page_id, hash, model, ...)`` whose page is unknown or stored with another hash or model."""
    known = pages.select("page_id", "hash", F.coalesce("model", F.lit("")).alias("model"))
    mine = documents.withColumn("model", F.coalesce("model", F.lit("")))
    return mine.join(known, ["page_id", "hash", "model"], "left_anti")


def upserted(stored: DataFrame, new: DataFrame, key: str = "page_id") -> DataFrame:
    """``stored`` with all rows of the pages of ``new`` replaced by those of ``new``."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def pruned(stored: DataFrame, keep: DataFrame, key: str = "page_id") -> DataFrame:
    """Rows of ``stored`` whose page is in ``keep``."""
    return stored.join(keep.select(key).distinct(), key, "left_semi")


def dropped(stored: DataFrame, keep: DataFrame, key: str = "page_id") -> DataFrame:
    """Rows of ``stored`` whose page is not in ``keep``: what ``pruned`` removes."""
    return stored.join(keep.select(key).distinct(), key, "left_anti")


def store_counts(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """(pages, chunks): one row."""
    return pages.agg(F.count(F.lit(1)).alias("pages")).join(chunks.agg(F.count(F.lit(1)).alias("chunks")))


def embedding_text(title: Column, heading_path: Column, text: Column) -> Column:
    """What is embedded of a chunk: where it stands, a blank line, and its text."""
    place = F.concat_ws(" > ", F.when(title != "", title), F.when(heading_path != "", heading_path))
    return F.when(place != "", F.concat(place, F.lit("\n\n"), text)).otherwise(text)


def coverage(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(covered, total): documents that have a chunk with a vector, and all."""
    have = chunks.where("vector is not null").select(F.col("page_id").alias("path")).distinct()
    return documents.join(have.withColumn("has", F.lit(1)), "path", "left").agg(F.count("has").alias("covered"), F.count(F.lit(1)).alias("total"))
