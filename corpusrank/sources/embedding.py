"""Embedding texts: a provider with retries and halving, an offline embedder, and the job that embeds what changed."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusrank.functions.markdown import ChunkSizes, chunk_table
from corpusrank.operators import vectors
from corpusrank.shared import materialise

#: texts -> vectors, in their order.
Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


class Rejected(Exception):
    """The provider refuses a batch; a smaller one may pass."""


class Unreachable(Exception):
    """The provider can't be reached just now."""


def hashing_embedder(dims: int = 64) -> Embedder:
    """Offline: each word adds a sign at a place that its hash says; vectors of length one."""

    def embed(texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(dims)
            for w in text.lower().split():
                h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
                v[h % dims] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32).tolist())
        return out

    return embed


def embed_all(texts: Sequence[str], embed: Embedder, attempts: int = 3, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> list[list[float] | None]:
    """Vectors of the texts; None for one that is rejected even alone. Unreachable providers are tried again with doubled waits, rejected
    batches are halved."""
    if not texts:
        return []
    for turn in range(attempts):
        try:
            out = [list(map(float, v)) for v in embed(texts)]
            if len(out) != len(texts):
                raise Rejected(f"{len(out)} vectors for {len(texts)} texts")
            return out
        except Unreachable:
            if turn == attempts - 1:
                raise
            sleep(wait * 2**turn)
        except Rejected:
            if len(texts) == 1:
                return [None]
            half = len(texts) // 2
            return embed_all(texts[:half], embed, attempts, wait, sleep) + embed_all(texts[half:], embed, attempts, wait, sleep)
    return []


def embedded(texts: DataFrame, text: str, embed: Embedder, batch: int = 64) -> DataFrame:
    """``texts`` with ``vector``, by batches across rows; rows keep their other columns. Null where the provider rejects a text."""
    names = [f.name for f in texts.schema]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema) + ", vector array<float>"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for at in range(0, rb.num_rows, batch):
                part = rb.slice(at, batch)
                found = embed_all([s or "" for s in part.column(text).to_pylist()], embed)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.float32()))], [*names, "vector"])

    return texts.mapInArrow(run, ddl)


def embed_changes(docs: DataFrame, chunks: DataFrame, pages: DataFrame, model: str, embed: Embedder, sizes: ChunkSizes = ChunkSizes()) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """The store's new ``chunks`` and ``pages`` and counts: pages whose hash or model is new are chunked and embedded, gone ones are dropped.

    Deterministic for a given provider, so a run that failed can be repeated; nothing is replaced until the caller writes the result.
    """
    hashed = docs.select(F.col("path").alias("page_id"), "title", "content", F.sha2("content", 256).alias("hash"), F.lit(model).alias("model"))
    todo = materialise(vectors.pending(hashed, pages), "todo")
    cut = chunk_table(todo, "page_id", "content", sizes).withColumnRenamed("key", "page_id").join(todo.select("page_id", "title"), "page_id")
    ready = cut.select("page_id", "chunk_index", "heading_path", "text", vectors.embedding_text(F.col("title"), F.col("heading_path"), F.col("text")).alias("said"))
    new = embedded(ready, "said", embed).drop("said").withColumn("vector", F.transform(vectors.normalised(F.col("vector")), lambda x: x.cast("float"))).withColumn("dims", F.size("vector"))
    new = materialise(new, "embedded")
    keep = docs.select(F.col("path").alias("page_id"))
    stale = todo.select("page_id")
    out_chunks = vectors.pruned(chunks.join(stale, "page_id", "left_anti"), keep).unionByName(new.select(*chunks.columns))
    out_pages = vectors.pruned(pages.join(stale, "page_id", "left_anti"), keep).unionByName(todo.select(*pages.columns))
    counts = {"embedded": todo.count(), "chunks": new.count(), "unchanged": hashed.count() - todo.count(), "removed": vectors.dropped(pages, keep).count()}
    return out_chunks, out_pages, counts
