"""The k most similar vectors of every vector: a forest of sorted hash strings.

Each vector has a string of 64 bits in every tree, of random hyperplanes of that tree's own. A tree is the sorted array of the strings of
all items. It is cut into leaves, sets of strings with a common prefix, as short as the number of items allows and longer
where one holds more; so cuts depend on the strings alone, not on samples or on the order of rows, and no prefix,
however frequent, makes a large task. In every tree a probe descends to its longest match; then all trees ascend together to the
longest prefix length at which they hold enough candidates, and each gives all items with that prefix. That length is read off a few
pilot trees first. Candidates are compared by 256 bits of their strings, and only pairs near by these by their vectors.

Equal vectors are one class throughout, so copies neither crowd the arrays nor cost comparisons. Probes that are no items lie in no array.

In a dense place the ascent ends while it still meets near strings, and the nearest may lie beyond it. Such probes ('dense') are
compared with all items instead, exactly, in blocks of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusrank.llm.arrays import mix
from corpusrank.shared import materialise

#: Bits by which candidates are compared: the strings of the first trees.
BITS, WORDS = 256, 4
#: Least number of trees; candidates that a tree gives a probe, about; trees that tell how far to ascend (their strings are the BITS too).
TREES, CANDIDATES, PILOTS = 21, 128, 4
#: Share of pairs that are just near enough that all trees together may miss.
MISSED = 0.05
#: Items in a leaf, about; bits by which a leaf of four times as many is divided, and how often; vectors that such leaves are found by (which
#: decides about the size of tasks only).
LEAF_ROWS, LEAF_BITS, LEAF_LEVELS, LAYOUT_ROWS = 32_768, 4, 6, 20_000
#: Pairs of strings compared at a time.
_AT_ONCE = 1 << 19
_U = np.uint64
#: Probes and items in a block of the exact comparison; blocks of probes that come to one copy of a block of items.
_PROBES, _ITEMS, _IN_TURN = 2048, 16384, 16
_SEED = 20240


def usable(vector: Column) -> Column:
    """Whether a vector can have a direction: no null, NaN or infinite number, and one that is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def trees_for(n: int, least: float, candidates: int = CANDIDATES, missed: float = MISSED) -> int:
    """How many trees find all but a share ``missed`` of the pairs of cosine ``least`` among ``n`` items: it grows as a power of n below 1."""
    agree = 1 - math.acos(least) / math.pi
    hit = agree ** max(0.0, math.log2(max(1, n) / candidates))
    return max(TREES, 1 if hit >= 1 else math.ceil(math.log(missed) / math.log1p(-hit)))


def _planes(dims: int, trees: int) -> np.ndarray:
    return np.concatenate([np.random.default_rng([_SEED, dims, t]).standard_normal((dims, 64)) for t in range(trees)], axis=1)


def _prefix(key: np.ndarray, depth: np.ndarray) -> np.ndarray:
    return np.where(depth > 0, key >> (_U(64) - np.maximum(depth, 1).astype(_U)), _U(0))


def _code(dims: int, tree: np.ndarray, depth: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A number of the set of strings of a tree that begin as ``key`` does up to ``depth``."""
    h = mix(_prefix(key, depth) * _U(0x9E3779B97F4A7C15) + depth.astype(_U))
    return mix(h + tree.astype(_U) * _U(0xD1B54A32D192ED03) + _U(dims)).view(np.int64)


def _leaves(dims: int, tree: np.ndarray, key: np.ndarray, bits: int, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, depth) of the leaf of each string: ``bits`` deep, or deeper where shorter prefixes are among ``heavy``."""
    depth = np.full(len(key), bits, dtype=np.int64)
    code = _code(dims, tree, depth, key)
    for _ in range(LEAF_LEVELS if len(heavy) else 0):
        hot = np.isin(code, heavy)
        if not hot.any():
            break
        depth[hot] += LEAF_BITS
        code[hot] = _code(dims, tree[hot], depth[hot], key[hot])
    return code, depth


def _strings(it: Iterator[pa.RecordBatch], trees: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(dims, batch, rows, strings[row, tree]) for some rows of equal length at a time."""
    planes: dict[int, np.ndarray] = {}
    for batch in it:
        if not batch.num_rows:
            continue
        lists = batch.column("vector")
        offsets = np.asarray(lists.offsets).astype(np.int64)
        values, starts = lists.values.to_numpy(zero_copy_only=False), offsets[:-1]
        length = np.diff(offsets)
        for dims in np.unique(length):
            if dims not in planes:
                planes[dims] = _planes(int(dims), trees)
            rows = np.flatnonzero(length == dims)
            for at in range(0, len(rows), 1024):
                part = rows[at : at + 1024]
                x = values[starts[part][:, None] + np.arange(dims)].astype(np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                bits = (x @ planes[dims]) > 0
                yield int(dims), batch, part, np.packbits(bits, axis=1).view(">u8").astype(_U)


def _heavy_counts(trees: int, bits: int):
    """(code, n): how many of the task's strings lie in each set that might be a leaf."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, _, part, strings in _strings(it, trees):
            tree, key = np.tile(np.arange(trees), len(part)), strings.ravel()
            codes = np.concatenate([_code(dims, tree, np.full(len(key), bits + LEAF_BITS * level), key) for level in range(LEAF_LEVELS)])
            code, n = np.unique(codes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    return run


_FOREST = "part long, key long, cls long, info int, " + ", ".join(f"s{w} long" for w in range(WORDS))
_PILOT = "part long, key long, cls long, info int"


def _forest(trees: int, bits: int, heavy: np.ndarray, pilot: bool):
    """A row for each vector and tree. ``info``: bit 0 item, bit 1 asked besides; then depth of the leaf, depth of the ascent, tree."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, batch, part, strings in _strings(it, trees):
            cls, asked = (batch.column(c).to_numpy()[part].astype(np.int64) for c in ("cls", "asked"))
            depth = np.zeros(len(part), dtype=np.int64) if pilot else batch.column("depth").to_numpy()[part].astype(np.int64)
            tree, key = np.tile(np.arange(trees), len(part)), strings.ravel()
            code, leaf = _leaves(dims, tree, key, bits, heavy)
            info = np.repeat(asked | depth << 9, trees) | leaf << 2 | tree << 16
            columns = [code, key.view(np.int64), np.repeat(cls, trees), info.astype(np.int32)]
            if not pilot:
                columns += [np.repeat(strings[:, w].view(np.int64), trees) for w in range(WORDS)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "key", "cls", "info", *(f"s{w}" for w in range(WORDS))][: len(columns)])

    return run


def _parts(it: Iterator[pa.RecordBatch], words: int) -> Iterator[dict[str, np.ndarray]]:
    """The task's leaves, one after the other: strings in order, a row a class."""
    batches = [b for b in it if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    part, cls, info = (table.column(c).to_numpy() for c in ("part", "cls", "info"))
    key = table.column("key").to_numpy().view(_U)
    order = np.lexsort((cls, key, part))
    part, key, cls, info = part[order], key[order], cls[order], info[order]
    first = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (cls[1:] != cls[:-1])])
    info = np.bitwise_or.reduceat(info, first)
    part, key, cls = part[first], key[first], cls[first]
    sketch = np.stack([table.column(f"s{w}").to_numpy().view(_U)[order][first] for w in range(words)]) if words else None
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        i = info[a:b].astype(np.int64)
        yield {"key": key[a:b], "cls": cls[a:b], "item": i & 1, "leaf": i >> 2 & 127, "depth": i >> 9 & 127, "tree": i >> 16, "sketch": sketch[:, a:b] if words else None}


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of the common prefix of strings."""
    x = a ^ b
    high, low = (x >> _U(32)).astype(np.float64), (x & _U(0xFFFFFFFF)).astype(np.float64)
    return 64 - np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1]).astype(np.int64)


def _own_depth(items: np.ndarray, probes: np.ndarray, places: np.ndarray, among: bool, candidates: int) -> np.ndarray:
    """The longest prefix of each probe that ``candidates`` of the sorted ``items`` share, itself not counted; 0 if so many share none.

    ``places`` are where the probes lie among the items, and ``among`` says whether they are items.
    """
    n = len(items)
    out = np.zeros(len(probes), dtype=np.int64)
    if among:
        if n <= candidates:
            return out
        ends = np.r_[np.zeros(candidates, np.int64), _common(items[: n - candidates], items[candidates:]), np.zeros(candidates, np.int64)]
        width = 1  # the greatest of candidates + 1 neighbouring values, by doubling
        while 2 * width <= candidates + 1:
            ends = np.maximum(ends[:-width], ends[width:])
            width *= 2
        rest = candidates + 1 - width
        ends = np.maximum(ends[: len(ends) - rest], ends[rest:]) if rest else ends
        return ends[places]
    for left in range(candidates + 1 if n >= candidates else 0):
        a = places - left
        ok = (a >= 0) & (a + candidates <= n)
        low, high = items[a[ok]], items[a[ok] + candidates - 1]
        out[ok] = np.maximum(out[ok], _common(np.minimum(low, probes[ok]), np.maximum(high, probes[ok])))
    return out


def _depths(candidates: int):
    """(cls, depth): for each probe, the longest prefix at which a pilot tree holds enough candidates."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _parts(it, 0):
            own = p["item"] == 1
            items = p["key"][own]
            depth = np.zeros(len(own), dtype=np.int64)
            depth[own] = _own_depth(items, items, np.arange(len(items)), True, candidates)
            asked = p["key"][~own]
            depth[~own] = _own_depth(items, asked, np.searchsorted(items, asked), False, candidates)
            yield pa.RecordBatch.from_arrays([pa.array(p["cls"]), pa.array(np.maximum(depth, p["leaf"]).astype(np.int32))], ["cls", "depth"])

    return run


def _candidates(far: int, near_word: int, candidates: int):
    """Pairs (a, b), a < b, of a probe and an item that share a prefix as long as the ascent's and whose strings are near.

    A tree that is far denser about a probe than the pilots were ascends two bits beyond its own depth. A row (a, a) says that a is dense: of the
    items met last, which share the least, at least an eighth, and four, were near, so that more will lie beyond. (Fewer are chance.)
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _parts(it, WORDS):
            own = p["item"] == 1
            items, item_cls, words = p["key"][own], p["cls"][own], p["sketch"][:, own]
            if not len(items):
                continue
            word = (int(p["tree"][0]) + 1) % WORDS  # not the tree's own string, of which candidates share a part
            depth = np.maximum(p["depth"], p["leaf"])
            places = np.searchsorted(items, p["key"])
            places[own] = np.arange(len(items))
            for who, among in ((np.flatnonzero(own), True), (np.flatnonzero(~own), False)):
                if len(who):
                    depth[who] = np.maximum(depth[who], _own_depth(items, p["key"][who], places[who], among, candidates) - 2)
            reach = []
            for d in (depth, np.minimum(64, depth + 1)):
                mask = np.where(d > 0, ~_U(0) << (_U(64) - np.maximum(d, 1).astype(_U)), _U(0))
                reach += [np.searchsorted(items, p["key"] & mask), np.searchsorted(items, p["key"] | ~mask, "right")]
            low, high, inner_low, inner_high = reach
            size, ends = high - low, np.cumsum(high - low)
            near_last = np.zeros(len(low), dtype=np.int64)
            found = []
            at = 0
            while at < len(low):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + _AT_ONCE, "right")))
                probe = np.repeat(np.arange(at, to), size[at:to])
                item = np.arange(len(probe)) - np.repeat(ends[at:to] - size[at:to] - (ends[at] - size[at]), size[at:to]) + np.repeat(low[at:to], size[at:to])
                some = np.flatnonzero(np.bitwise_count(p["sketch"][word][probe] ^ words[word][item]) <= near_word)
                probe, item = probe[some], item[some]
                apart = np.zeros(len(probe), dtype=np.uint16)
                for w in range(WORDS):
                    apart += np.bitwise_count(p["sketch"][w][probe] ^ words[w][item])
                hit = (apart <= far) & (p["cls"][probe] != item_cls[item])
                probe, item = probe[hit], item[hit]
                near_last += np.bincount(probe[(item < inner_low[probe]) | (item >= inner_high[probe])], minlength=len(low))
                a, b = p["cls"][probe], item_cls[item]
                found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
                at = to
            last = size - (inner_high - inner_low)
            dense = p["cls"][(near_last >= 4) & (8 * near_last >= last)]
            ab = np.unique(np.concatenate([*found, np.stack([dense, dense], axis=1)]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0], pa.int64()), pa.array(ab[:, 1], pa.int64())], ["a", "b"])

    return run


def _cosines(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        if not batch.num_rows:
            continue
        va, vb = batch.column("va"), batch.column("vb")
        la, lb = np.diff(np.asarray(va.offsets)), np.diff(np.asarray(vb.offsets))
        out = np.full(batch.num_rows, -2.0)
        fa, fb = (v.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for v in (va, vb))
        sa, sb = np.r_[0, np.cumsum(la)], np.r_[0, np.cumsum(lb)]
        for dims in np.unique(la):
            rows = np.flatnonzero((la == dims) & (lb == dims))
            x, y = fa[sa[rows][:, None] + np.arange(dims)], fb[sb[rows][:, None] + np.arange(dims)]
            x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))  # no overflow or underflow of the squares
            out[rows] = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out)], ["a", "b", "cosine"])


def similar_vectors(items: DataFrame, probes: DataFrame | None = None, k: int = 5, least: float = 0.85, trees: int | None = None, candidates: int = CANDIDATES, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(probe_kind, probe_id, neighbour_id, cosine): for each probe the ``k`` items of greatest cosine, of at least ``least``.

    Every row of ``items(id, vector)`` is a probe of kind 'item' and not its own neighbour; ``probes(kind, id, vector)`` are
    asked besides. Vectors only meet vectors of equally many numbers. Unusable vectors (see ``usable``) and null ids take no
    part. Ties of cosine go to the smaller id; rows that repeat (kind, id) count once. Approximate: a neighbour may be missing, none is wrong
    (a pair as near as ``least`` survives the comparison of strings with probability 0.9996, nearer ones more surely), and the same in every run. Equal
    vectors always find each other, and probes in dense places get their exact neighbours, at a cost of dense probes x items. Cosines
    equal to 9 digits are ties. Empty inputs give no rows. Other columns are ignored. ``trees``: as ``trees_for`` says, if not given.
    """
    cls = F.xxhash64(F.size("vector"), F.col("vector"))

    def ready(df: DataFrame, kind: Column) -> DataFrame:
        df = df.select(kind.alias("kind"), "id", F.col("vector").cast("array<float>").alias("vector"))
        return df.where(usable(F.col("vector")) & F.col("id").isNotNull()).select("kind", "id", cls.alias("cls"), "vector")

    pool = ready(items, F.lit("item"))
    if probes is not None:
        pool = pool.unionAll(ready(probes, F.col("kind")))
    n = items.count()
    trees, bits = trees or trees_for(n, least, candidates), max(0, math.ceil(math.log2(max(1, n) / leaf_rows)))
    angle = math.acos(least) / math.pi
    far = round(BITS * angle + 3.4 * math.sqrt(BITS * angle * (1 - angle)))
    near_word = math.ceil(64 * angle + 4 * math.sqrt(64 * angle * (1 - angle)))
    asked = F.when(F.col("kind") == "item", 1).otherwise(2).alias("asked")
    every = math.ceil(n / LAYOUT_ROWS)
    some = pool.where((F.col("kind") == "item") & (F.pmod(F.hash("cls"), F.lit(every)) == 0)) if every else pool.where("false")
    counts = some.select("vector").mapInArrow(_heavy_counts(trees, bits), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    # fewer than trees x levels x n / leaf_rows of them
    heavy = np.sort(np.array([r["code"] for r in counts.where(F.col("n") * every > 4 * leaf_rows).select("code").collect()], dtype=np.int64))

    def tasks(of: int) -> int:
        return max(pool.sparkSession.sparkContext.defaultParallelism, math.ceil(of * n / (2 * leaf_rows)))

    pilots = pool.select("cls", asked, "vector").mapInArrow(_forest(PILOTS, bits, heavy, True), _PILOT).repartition(tasks(PILOTS), "part")
    depths = pilots.mapInArrow(_depths(candidates), "cls long, depth int").groupBy("cls").agg(F.floor(F.avg("depth")).cast("int").alias("depth"))
    vectors = pool.groupBy("cls").agg(F.first("vector").alias("v"), F.min(F.when(F.col("kind") == "item", F.col("id"))).alias("low"), F.max(F.when(F.col("kind") == "item", 1).otherwise(0)).alias("item"), F.max(F.when(F.col("kind") != "item", 2).otherwise(0)).alias("besides"))
    vectors = materialise(vectors.join(depths, "cls").select("cls", "v", "low", (F.col("item") + F.col("besides")).alias("asked"), "depth"), "vectors")
    forest = vectors.select("cls", "asked", "depth", F.col("v").alias("vector")).mapInArrow(_forest(trees, bits, heavy, False), _FOREST).repartition(tasks(trees), "part")
    pairs = materialise(forest.mapInArrow(_candidates(far, near_word, candidates), "a long, b long").distinct(), "pairs")
    dense, pairs = pairs.where("a = b").select(F.col("a").alias("cls")), pairs.where("a <> b")
    close = (
        pairs.join(vectors.select(F.col("cls").alias("a"), F.col("v").alias("va")), "a")
        .join(vectors.select(F.col("cls").alias("b"), F.col("v").alias("vb")), "b")
        .mapInArrow(_cosines, "a long, b long, cosine double")
        .where(F.col("cosine") >= least)
    )
    close = materialise(close, "close")
    both = close.select(F.col("a").alias("p"), F.col("b").alias("q"), "cosine").unionAll(close.select("b", "a", "cosine"))
    asking = vectors.join(dense, "cls").select("cls", F.col("v").alias("vector"))
    asking = materialise(asking, "dense")
    if n_dense := asking.count():
        items_of = materialise(vectors.where("low is not null").select("cls", "low", F.col("v").alias("vector")), "dense_items")
        exact = _in_blocks(asking, items_of, n_dense, items_of.count(), k + 1, least)
        both = both.join(dense, both["p"] == dense["cls"], "left_anti").unionAll(exact)
    members = materialise(pool.select("kind", "id", "cls").distinct(), "classes")
    # of each class the k + 1 least ids, as a probe may be one of them
    smallest = members.where("kind = 'item'").withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy("id")))
    smallest = smallest.where(F.col("r") <= k + 1).select(F.col("cls").alias("q"), F.col("id").alias("n"))
    same = smallest.select(F.col("q").alias("p"), F.lit(1.0).alias("cosine"), "n")
    best = both.join(smallest, "q").select("p", "cosine", "n").unionAll(same)
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy(F.desc(F.round("cosine", 9)), "n"))).where(F.col("r") <= k + 1)
    lists = best.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("r", "n", "cosine"))).alias("near"))  # k + 1 at most
    near = F.slice(F.filter("near", lambda x: (F.col("kind") != "item") | (x["n"] != F.col("id"))), 1, k)
    found = members.join(lists, members["cls"] == lists["p"]).select(F.col("kind").alias("probe_kind"), F.col("id").alias("probe_id"), F.explode(near).alias("x"))
    return found.select("probe_kind", "probe_id", F.col("x.n").alias("neighbour_id"), F.col("x.cosine").alias("cosine"))


def _in_blocks(probes: DataFrame, items: DataFrame, n_probes: int, n_items: int, k: int, least: float, probe_block: int = _PROBES, item_block: int = _ITEMS, in_turn: int = _IN_TURN) -> DataFrame:
    """(p, q, cosine) with the ``k`` nearest of ``items(cls, low, vector)`` for each of ``probes(cls, vector)``, and more: the ``k`` best of every block.

    None is missing: of each block those of greatest cosine to 9 digits stay, ties to the smaller ``low``. A class is not its own neighbour. A task holds
    one block of either side at a time: a block of items, to which up to ``in_turn`` blocks of probes come one after the other. They meet by their
    place in a sorted partition, not by a join: a block of probes is small, its copies for all blocks of items are not, and Spark judges by the
    former whether to gather them in the driver for a broadcast.
    """
    pb, cb = max(1, math.ceil(n_probes / probe_block)), max(1, math.ceil(n_items / item_block))
    cores = probes.sparkSession.sparkContext.defaultParallelism
    turns = min(pb, max(math.ceil(pb / in_turn), math.ceil(2 * cores / cb)))  # few blocks of items come to more tasks

    def pack(df: DataFrame, blocks: int, low: Column, side: int) -> DataFrame:
        keyed = df.select(F.size("vector").alias("dims"), F.pmod(F.xxhash64("cls"), F.lit(blocks)).alias("block"), F.struct("cls", low.alias("low"), "vector").alias("x"))
        xs = keyed.repartition(max(cores, blocks), "dims", "block").groupBy("dims", "block").agg(F.collect_list("x").alias("xs"))  # a block, about
        return xs.select("dims", "block", F.lit(side).alias("side"), F.col("xs.cls").alias("cls"), F.col("xs.low").alias("low"), F.flatten("xs.vector").alias("flat"))

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    held = pack(items, cb, F.col("low"), 0).withColumns({"cb": F.col("block"), "turn": each(turns)})
    asked = pack(probes, pb, F.lit(None).cast("long"), 1).withColumns({"cb": each(cb), "turn": F.pmod("block", F.lit(turns))})
    both = held.unionByName(asked).repartition(min(cb * turns * 2, 4096), "dims", "cb", "turn").sortWithinPartitions("dims", "cb", "turn", "side", "block")

    def units(flat, dims: int) -> np.ndarray:
        x = flat.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ci, low, y = None, None, None, None
        for batch in it:
            for i in range(batch.num_rows):
                dims, *place, side = (batch.column(n)[i].as_py() for n in ("dims", "cb", "turn", "side"))
                if side == 0:  # copied, as the batch is not kept
                    here, ci, low = (dims, *place), batch.column("cls")[i].values.to_numpy().copy(), batch.column("low")[i].values.to_numpy().copy()
                    y = units(batch.column("flat")[i], dims)
                    continue
                if here != (dims, *place):  # no items there of that length
                    continue
                pi, x = batch.column("cls")[i].values.to_numpy(), units(batch.column("flat")[i], dims)
                for at in range(0, len(x), 256):
                    ids = pi[at : at + 256]
                    s = x[at : at + 256] @ y.T
                    s[ids[:, None] == ci[None, :]] = -2
                    floor = np.full(len(s), least)
                    full = np.flatnonzero((s >= least).sum(axis=1) > k)
                    if len(full):
                        kth = np.partition(s[full], -k, axis=1)[:, -k]
                        floor[full] = np.maximum(least, kth - 2e-9)  # ties to 9 digits stay in
                    r, q = np.nonzero(s >= floor[:, None])
                    c = s[r, q]
                    order = np.lexsort((low[q], -np.round(c, 9), r))
                    r, q, c = r[order], q[order], c[order]
                    starts = np.searchsorted(r, np.arange(len(s)))
                    keep = np.arange(len(r)) - starts[r] < k
                    yield pa.RecordBatch.from_arrays([pa.array(ids[r[keep]]), pa.array(ci[q[keep]]), pa.array(c[keep])], ["p", "q", "cosine"])

    return both.mapInArrow(run, "p long, q long, cosine double")


def exact_neighbours(items: DataFrame, probes: DataFrame, k: int = 5, least: float = 0.85, block: int = 4096) -> DataFrame:
    """(probe_id, neighbour_id, cosine) by comparing every probe with every item, both ``(id, vector)``, in blocks of vectors.

    What ``similar_vectors`` approximates, for measuring it; a probe is not its own neighbour. Each item block is sent to each block of
    probes of its number of dims; a task only ever holds two blocks and the k best so far of each of its probes.
    """

    def ready(df: DataFrame) -> DataFrame:
        df = df.select("id", F.col("vector").cast("array<float>").alias("vector")).where(usable(F.col("vector")) & F.col("id").isNotNull())
        return df.select("id", F.size("vector").alias("dims"), "vector")

    def pack(df: DataFrame, count: int) -> DataFrame:
        blocks = max(1, math.ceil(count / block))
        keyed = df.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
        return keyed.groupBy("dims", "block").agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("vector")).alias("flat"))  # ``block`` vectors, about

    probes, items = ready(probes), ready(items)
    p, c = pack(probes, probes.count()), pack(items, items.count())
    both = p.select("dims", F.col("ids").alias("pi"), F.col("flat").alias("pv")).join(c.select("dims", F.col("ids").alias("ci"), F.col("flat").alias("cv")), "dims")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                dims = batch.column("dims")[i].as_py()
                pi, ci = (batch.column(n)[i].values.to_numpy() for n in ("pi", "ci"))
                x, y = (batch.column(n)[i].values.to_numpy().astype(np.float64).reshape(-1, dims) for n in ("pv", "cv"))
                x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
                x, y = (v / np.sqrt((v * v).sum(axis=1, keepdims=True)) for v in (x, y))
                for at in range(0, len(x), 512):
                    s = x[at : at + 512] @ y.T
                    s[pi[at : at + 512][:, None] == ci[None, :]] = -2
                    r, q = np.nonzero(s >= least)
                    yield pa.RecordBatch.from_arrays([pa.array(pi[at : at + 512][r]), pa.array(ci[q]), pa.array(s[r, q])], ["probe_id", "neighbour_id", "cosine"])

    near = both.mapInArrow(run, "probe_id long, neighbour_id long, cosine double")
    placed = near.withColumn("r", F.row_number().over(Window.partitionBy("probe_id").orderBy(F.desc(F.round("cosine", 9)), "neighbour_id")))
    return placed.where(F.col("r") <= k).drop("r")
