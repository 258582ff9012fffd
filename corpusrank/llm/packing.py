"""Filling containers of fixed capacity with texts, by multiway differencing (Karmarkar and Karp)."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusrank.operators.skew import numbered_copies
from corpusrank.shared import partitions

#: Pieces that one task packs at a time. Containers are as full as their average, so more would hardly fill them better.
CELL_ITEMS = 2048


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Splits items over ``k`` windows of near-equal sums: (window of each item, sums).

    A partial partition is k sums in descending order. The two with the widest gap between greatest and least sum are merged,
    the greatest of one with the least of the other, until one is left.
    """
    n = len(sizes)
    if k == 1:
        return np.zeros(n, dtype=np.int64), np.array([sizes.sum()])
    left, right = np.full(2 * n + 2, -1, dtype=np.int64), np.full(2 * n + 2, -1, dtype=np.int64)
    fresh = n  # nodes: items, then pairs of nodes
    heap = []
    for i, s in enumerate(sizes):
        sums, nodes = np.zeros(1, dtype=np.int64) + s, np.array([i])
        heap.append((-int(s), i, sums, nodes))
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, sa, na = heapq.heappop(heap)
        _, _, sb, nb = heapq.heappop(heap)
        # only sums above zero are kept; in descending order, the last `over` of each share a window
        over = max(0, len(sa) + len(sb) - k)
        ka, kb = len(sa) - over, len(sb) - over
        made = np.arange(fresh, fresh + over)
        left[made], right[made] = na[ka:], nb[kb:][::-1]
        fresh += over
        sums = np.concatenate([sa[:ka], sb[:kb], sa[ka:] + sb[kb:][::-1]])
        nodes = np.concatenate([na[:ka], nb[:kb], made])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        spread = int(sums[0] - (sums[-1] if len(sums) == k else 0))
        heapq.heappush(heap, (-spread, serial, sums, nodes))
        serial += 1
    _, _, sums, nodes = heap[0]
    window = np.full(fresh, -1, dtype=np.int64)
    window[nodes] = np.arange(len(nodes))
    for node in range(fresh - 1, n - 1, -1):  # pairs come after what they hold
        window[left[node]] = window[right[node]] = window[node]
    return window[:n], sums


def pack_cell(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item so that no window exceeds ``capacity``; no item may exceed it alone."""
    k = max(1, math.ceil(int(sizes.sum()) / capacity))
    while True:
        window, sums = difference(sizes, k)
        excess = int(np.maximum(0, sums - capacity).sum())
        if not excess:
            return window
        k = min(len(sizes), k + max(1, excess // capacity))


def packed(items: DataFrame, key: str, size: str, capacity: int = 4096, cell_items: int = CELL_ITEMS) -> DataFrame:
    """(key, piece, pieces, n_tokens, container): every item in containers of ``capacity``.

    An item above the capacity is cut into pieces that fill a container each, and one rest; no other is cut. ``container`` is unique
    over all. Items of size null or below 1 take no container and are left out. Rows that repeat a key are items of their own; a
    null key is kept; an empty table gives no rows. Items are spread evenly over cells, each packed on its own, so no task
    grows with the input.
    """
    kept = items.select(F.col(key).alias("key"), F.col(size).cast("long").alias("size")).where("size > 0")
    pieces = F.ceil(F.col("size") / F.lit(capacity))
    cells = max(1, math.ceil((kept.agg(F.sum(pieces)).first()[0] or 0) / cell_items))
    # rows that repeat a key must not share a cell
    cut = numbered_copies(kept, "copy")
    cut = cut.select("key", "copy", pieces.alias("pieces"), "size", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("piece"))
    rest = F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("piece") * capacity)
    cut = cut.select(F.pmod(F.xxhash64("key", "piece", "size", "copy"), F.lit(cells)).alias("cell"), "key", "piece", "pieces", rest.alias("n_tokens"))
    kind = items.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "key", "piece"], ascending=[False, True, True], kind="stable")
        sizes = pdf["n_tokens"].to_numpy().astype(np.int64)
        full = sizes >= capacity
        window = np.arange(len(sizes))
        if (~full).any():
            window[~full] = full.sum() + pack_cell(sizes[~full], capacity)
        return pdf.assign(container=(int(pdf["cell"].iloc[0]) << 24) + window)[["key", "piece", "pieces", "n_tokens", "container"]]

    # a cell is little data but much work, so its size must not decide how many tasks there are
    tasks = min(cells, partitions(items.sparkSession, math.ceil(cells / 8)))
    return cut.repartition(tasks, "cell").groupBy("cell").applyInPandas(run, f"key {kind}, piece long, pieces long, n_tokens long, container long")
