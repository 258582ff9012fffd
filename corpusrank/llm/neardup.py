"""Groups of records that share most of their word sequences: an exact prefix-tree similarity join.

Every record is the set of its distinct sequences of ``shingle_words`` words, as 40-bit hashes ("tokens"), under one
global order: rarest token first. Two sets of similarity at least t (Jaccard) have to share a token among the first
|x| - ceil(t |x|) + 1 of that order. So:

1. ``token_sets`` reads every text once and writes its set; everything after works on that table.
2. ``token_order`` counts tokens into a sketch of as many counters as there are tokens, 2**24 at most (beyond, counters hold several tokens
   each; what they hold on average is taken off, so that only tokens far commoner than that count as common). Any order is correct; this
   one is near that by frequency and costs one small shuffle. A token counted once matches nothing and is dropped.
3. ``candidate_links``: the first level of the tree, a token each, is spread over the cluster by groups of tokens; within
   a token, records lie in order of size, and a branch ends where the remaining lengths cannot reach the overlap
   that the sizes demand. An odd sketch (parity bits) of the whole set bounds the difference from below and drops nearly all
   chance pairs at once; neither bound can drop a true one. Tokens of very many records are split into cells of blocks x blocks.
4. ``verified_links`` puts the partners of a record into a trie of their sets in the global order and traverses it depth first: partial overlaps
   are shared along common prefixes, and a subtree is left where neither the rest of its sets nor the rest of the record can reach the
   demanded overlap. Records of very many partners are split over tasks.

Records with equal sets are one class throughout (its id is a hash of the set), so copies cost no comparisons.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusrank.llm.arrays import WordHashes, batches, binary, flat_binary, mix, word_shingles
from corpusrank.operators.graphs import connected_components
from corpusrank.shared import materialise, partitions, spread

#: The sketch has between 2**16 and 2**24 counters.
_LEAST_BITS, _MOST_BITS, _BLOCK_BITS = 16, 24, 16
_U = np.uint64
#: Records of one token in one cell; a token of more is split.
CELL_ROWS = 4096
#: Tokens that one task joins, about.
TASK_TOKENS = 1_000_000
#: Partners of one record that one task compares, about.
PARTNERS = 4096
#: A record or class is hot if it has more than one of so many of all rows; so there are fewer hot ones than this.
_HOT_SHARE = 2000
#: Bits of the filter that keeps sets of records without any candidate from being moved.
_FILTER_BITS = 24


class _Sets:
    """Sets of a batch, of at least one token each: sizes, starts and sorted 40-bit tokens."""

    def __init__(self, tokens: np.ndarray, starts: np.ndarray):
        self.tokens, self.starts = tokens, starts.astype(np.int64)
        self.sizes = np.diff(self.starts)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)

    @classmethod
    def of_column(cls, column: pa.Array) -> _Sets:
        raw, starts = flat_binary(column, np.uint8)
        return cls(_unpack(raw), starts // 5)


def _sets_of_texts(texts: list, k: int, least: int, hashes: WordHashes) -> tuple[np.ndarray, _Sets]:
    """(rows, sets) of the texts that have enough words."""
    rows, h = word_shingles(texts, k, hashes, least)
    key = np.sort((rows.astype(_U) << _U(40)) | (h >> _U(24)))  # batches have fewer than 2**24 rows
    if len(key):
        key = key[np.r_[True, key[1:] != key[:-1]]]
    doc = (key >> _U(40)).astype(np.int64)
    rows, first = np.unique(doc, return_index=True)
    return rows, _Sets(key & _U((1 << 40) - 1), np.r_[first, len(doc)])


def _unpack(raw) -> np.ndarray:
    """Tokens of five bytes each."""
    five = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 5)
    eight = np.zeros((len(five), 8), dtype=np.uint8)
    eight[:, :5] = five
    return eight.view(_U).ravel()


def _demanded(t: Fraction, total: np.ndarray) -> np.ndarray:
    """Least overlap of two sets of ``total`` elements together: ceil(t / (1 + t) * total)."""
    return -(-t.numerator * total // (t.numerator + t.denominator))


def token_sets(records: DataFrame, k: int, least: int) -> DataFrame:
    """(key, rid, n, tokens) of each record with at least ``least`` words, written once: its class, its number of tokens and these, five
    bytes each, in order of their value. Records with equal sets share a class."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches(it, "text"):
            rows, s = _sets_of_texts(batch.column("text").to_pylist(), k, least, hashes)
            if len(rows):
                five = np.ascontiguousarray(s.tokens.view(np.uint8).reshape(-1, 8)[:, :5])
                raw = five.tobytes()
                ids = np.array([xxhash.xxh3_64_intdigest(raw[5 * a : 5 * b]) >> 1 for a, b in zip(s.starts[:-1], s.starts[1:], strict=True)], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows)), pa.array(ids), pa.array(s.sizes), binary(five, s.starts)], ["key", "rid", "n", "tokens"])

    return materialise(records.select("key", "text").mapInArrow(run, "key string, rid long, n long, tokens binary"), "sets")


def token_order(sets: DataFrame, tokens: int) -> np.ndarray:
    """Rank of each group of tokens by frequency (0: counted once): 64 kB to 16 MB, by the number of tokens."""
    bits = min(_MOST_BITS, max(_LEAST_BITS, math.ceil(math.log2(max(1, tokens)))))
    size, load = 1 << bits, tokens >> bits

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, dtype=np.uint32)
        for batch in it:
            if batch.num_rows:
                s = _Sets.of_column(batch.column("tokens"))
                np.add.at(counts, (s.tokens >> _U(40 - bits)).astype(np.int64), 1)
        blocks = counts.reshape(-1, 1 << _BLOCK_BITS)
        some = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([zlib.compress(blocks[b].tobytes(), 1) for b in some], pa.binary())], ["block", "counts"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << _BLOCK_BITS, dtype=np.int64)
        for c in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(c), dtype=np.uint32)
        rank = np.where(total <= 1, 0, np.minimum(255, 1 + np.floor(9 * np.log2(np.maximum(total - load, 2) / 2)))).astype(np.uint8)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "ranks": [zlib.compress(rank.tobytes(), 1)]})

    parts = sets.select("tokens").mapInArrow(count, "block int, counts binary")
    ranks = np.zeros(size, dtype=np.uint8)
    for r in parts.groupBy("block").applyInPandas(merge, "block int, ranks binary").collect():  # at most 256 rows
        ranks[r["block"] << _BLOCK_BITS : (r["block"] + 1) << _BLOCK_BITS] = np.frombuffer(zlib.decompress(bytes(r["ranks"])), dtype=np.uint8)
    return ranks


def _ranks(sent) -> tuple[np.ndarray, _U]:
    """The broadcast ranks, and how far to shift a token for its place in them."""
    ranks = np.frombuffer(sent.value, dtype=np.uint8)
    return ranks, _U(40 - (len(ranks).bit_length() - 1))


def _in_order(tokens: np.ndarray, ranks: np.ndarray, shift: _U) -> np.ndarray:
    """Tokens with their rank before them: numbers in the global order."""
    return (ranks[(tokens >> shift).astype(np.int64)].astype(_U) << _U(40)) | tokens


def _least_count(rank: np.ndarray) -> np.ndarray:
    """A frequency about that of the rank, for splitting only."""
    return np.exp2((rank.astype(np.float64) - 1) / 9) * 2


def _tree_roots(sets: DataFrame, t: Fraction, sent, groups: int, words: int) -> DataFrame:
    """(part, rid, n, sketch, tokens): the prefix tokens of each record in each group of tokens, as token << 24 | position."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ranks, shift), seen = _ranks(sent), set()
        for batch in batches(it, "tokens"):
            for at in range(0, batch.num_rows, 1 << 14):
                piece = batch.slice(at, 1 << 14)
                s, ids = _Sets.of_column(piece.column("tokens")), piece.column("rid").to_numpy()
                ordered = _in_order(s.tokens, ranks, shift)
                order = np.argsort((s.doc.astype(_U) << _U(48)) | ordered)
                token, rank = s.tokens[order], (ordered[order] >> _U(40)).astype(np.uint8)
                position = np.arange(len(token)) - np.repeat(s.starts[:-1], s.sizes)
                bits = mix(s.tokens + _U(77)) % _U(64 * words)
                parity = np.zeros((len(s.sizes), 64 * words), dtype=np.uint8)
                np.add.at(parity, (s.doc, bits.astype(np.int64)), 1)
                sketch = np.packbits(parity & 1, axis=1, bitorder="little")
                prefix = s.sizes - -(-t.numerator * s.sizes // t.denominator) + 1
                fresh = np.array([not (i in seen or seen.add(i)) for i in ids])  # a class once a task
                if len(seen) > 2_000_000:
                    seen = set()
                kept = (position < prefix[s.doc]) & (rank > 0) & fresh[s.doc]
                token, rank, position, doc = token[kept], rank[kept], position[kept], s.doc[kept]
                blocks = np.maximum(1, np.ceil(_least_count(rank) / CELL_ROWS)).astype(np.int64)
                if (blocks > 1).any():  # one copy in each cell of the record's row of blocks
                    copy = np.repeat(np.arange(len(token)), blocks)
                    other = np.arange(len(copy)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    token, position, doc, blocks = token[copy], position[copy], doc[copy], blocks[copy]
                    own = ids[doc] % blocks
                    low, high = np.minimum(own, other).astype(_U), np.maximum(own, other).astype(_U)
                    cell = mix(mix(token + low * _U(0x9E3779B1)) + high) >> _U(24)
                    token = np.where(blocks > 1, cell, token)
                part = (mix(token) % _U(groups)).astype(np.int64)
                order = np.lexsort((token, part, doc))
                token, position, doc, part = token[order], position[order], doc[order], part[order]
                if not len(token):
                    continue
                new = np.r_[True, (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])]
                starts = np.r_[np.flatnonzero(new), len(token)]
                head = starts[:-1]
                packed = (token << _U(24)) | np.minimum(position, (1 << 24) - 1).astype(_U)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part[head], pa.int32()),
                        pa.array(ids[doc[head]], pa.int64()),
                        pa.array(s.sizes[doc[head]], pa.int32()),
                        binary(sketch[doc[head]], np.arange(len(head) + 1)),
                        binary(packed, starts),
                    ],
                    ["part", "rid", "n", "sketch", "tokens"],
                )

    return sets.select("rid", "tokens").mapInArrow(run, "part int, rid long, n int, sketch binary, tokens binary")


def _joined(t: Fraction, words: int):
    """Joins the records of a task by their tokens: rows (a, b), a < b, that may be similar."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rids, sizes, sketches, tokens, owners, n = [], [], [], [], [], 0
        for batch in it:
            if not batch.num_rows:
                continue
            flat, starts = flat_binary(batch.column("tokens"), _U)
            rids.append(batch.column("rid").to_numpy())
            sizes.append(batch.column("n").to_numpy().astype(np.int64))
            sketches.append(flat_binary(batch.column("sketch"), _U)[0].reshape(-1, words))
            tokens.append(flat)
            owners.append(np.repeat(np.arange(n, n + batch.num_rows, dtype=np.int32), np.diff(starts)))
            n += batch.num_rows
        if not n:
            return
        rid, size, sketch = np.concatenate(rids), np.concatenate(sizes), np.concatenate(sketches)
        packed, owner = np.concatenate(tokens), np.concatenate(owners)
        token = packed >> _U(24)
        order = np.lexsort((rid[owner], size[owner], token))
        token, owner, position = token[order], owner[order], (packed[order] & _U((1 << 24) - 1)).astype(np.int64)
        again = np.r_[False, (token[1:] == token[:-1]) & (rid[owner[1:]] == rid[owner[:-1]])]  # a class sent by several tasks
        token, owner, position = token[~again], owner[~again], position[~again]
        s, left = size[owner], size[owner] - position  # left: what remains of the set, this token included
        live, step = np.arange(len(token)), 0
        found: list[np.ndarray] = []
        waiting = 0
        while True:
            step += 1
            live = live[live + step < len(token)]
            far = live + step
            # in order of size: beyond a size of |x| / t no record of the token can match
            ok = (token[live] == token[far]) & (t.numerator * s[far] <= t.denominator * s[live])
            live, far = live[ok], far[ok]
            if not len(live):
                break
            need = _demanded(t, s[live] + s[far])
            good = np.minimum(left[live], left[far]) >= need
            a, b, need = owner[live[good]], owner[far[good]], need[good]
            for at in range(0, len(a), 1 << 18):
                x, y, least = a[at : at + (1 << 18)], b[at : at + (1 << 18)], need[at : at + (1 << 18)]
                apart = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64)
                hit = apart <= size[x] + size[y] - 2 * least
                p, q = rid[x[hit]], rid[y[hit]]
                found.append(np.stack([np.minimum(p, q), np.maximum(p, q)], axis=1))
                waiting += len(p)
            if waiting > 2_000_000:
                yield _pairs(found)
                found, waiting = [], 0
        if found:
            yield _pairs(found)

    return run


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    ab = np.concatenate(found)
    ab = ab[np.lexsort((ab[:, 1], ab[:, 0]))]
    if len(ab):
        ab = ab[np.r_[True, (ab[1:] != ab[:-1]).any(axis=1)]]
    return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])


def candidate_links(sets: DataFrame, t: Fraction, sent, tokens: int, n: int) -> DataFrame:
    """(a, b): distinct pairs of classes that no bound could rule out; every pair of similarity at least t is among them."""
    # odd sketches twice as long as the average set keep chance pairs apart
    words = int(min(64, max(2, 2 ** math.ceil(math.log2(max(1, 2 * tokens / max(1, n) / 64))))))
    groups = partitions(sets.sparkSession, math.ceil(tokens / (2 * TASK_TOKENS)))
    roots = _tree_roots(sets, t, sent, groups, words)
    return roots.repartitionById(groups, F.col("part")).mapInArrow(_joined(t, words), "a long, b long").distinct()


def _traversed(record: np.ndarray, partners: list[tuple[int, np.ndarray]], t: Fraction) -> list[tuple[int, int, int]]:
    """(a, overlap, union) of the partners that reach t; sets are numbers in the global order, sorted.

    The partners' sets, in order, are the trie depth first. Along the current path lie the overlap so far and how much of the record is
    behind; both are kept for the prefix that the next set shares.
    """
    partners = sorted(partners, key=lambda p: p[1].astype(">u8").tobytes())
    out, path = [], np.empty(0, _U)
    shared = behind = np.zeros(1, dtype=np.int64)  # at depth d: overlap of the path's first d tokens, tokens of the record up to them
    left = None  # depth of the subtree that was left
    for a, own in partners:
        m = min(len(own), len(path))
        differ = np.flatnonzero(own[:m] != path[:m])
        depth = int(differ[0]) if len(differ) else m
        need = int(_demanded(t, np.int64(len(own) + len(record))))
        at = min(depth, len(shared) - 1)
        if shared[at] + min(len(own) - at, len(record) - behind[at]) < need:
            if left is None or depth < left:  # a set of another branch; below ``left`` the path stays what it was
                path, shared, behind, left = own[:depth], shared[: at + 1], behind[: at + 1], at
            continue
        left = None
        rest = own[at:]
        place = np.searchsorted(record, rest)
        hit = record[np.minimum(place, len(record) - 1)] == rest
        shared = np.r_[shared[: at + 1], shared[at] + np.cumsum(hit)]
        behind = np.r_[behind[: at + 1], place + hit]
        path = own
        # where the bound first fails, the subtree ends
        depths = np.arange(at, len(own) + 1)
        ends = np.flatnonzero(shared[at:] + np.minimum(len(own) - depths, len(record) - behind[at:]) < need)
        if len(ends):
            stop = at + int(ends[0])
            path, shared, behind, left = own[:stop], shared[: stop + 1], behind[: stop + 1], stop
        else:
            out.append((a, int(shared[-1]), len(own) + len(record) - int(shared[-1])))
    return out


def _hot(rows: DataFrame, key: str) -> DataFrame:
    """(key, salts): keys that hold more than ``PARTNERS`` rows and more than 1 / ``_HOT_SHARE`` of all, and over how many tasks to split each."""
    counts = materialise(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > PARTNERS), "hot")
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return counts.where(F.col("_n") * _HOT_SHARE > total).select(key, F.ceil(F.col("_n") / PARTNERS).alias("salts"))


def _copies():
    """The salts of a row of a key that may be hot."""
    return F.explode(F.when(F.col("salts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))


def _salt(by: str):
    return F.coalesce(F.pmod(F.xxhash64(by), F.col("salts")), F.lit(0).cast("long"))


def verified_links(sets: DataFrame, links: DataFrame, t: Fraction, sent) -> DataFrame:
    """(a, b, overlap, n_union) of the links whose similarity really is at least t."""
    spark = sets.sparkSession
    size = 1 << _FILTER_BITS

    def marks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, dtype=bool)
        for batch in it:
            for c in ("a", "b"):
                bits[batch.column(c).to_numpy() % size] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], ["bits"])

    def union(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size // 8, dtype=np.uint8)
        for batch in it:
            for b in batch.column("bits").to_pylist():
                total |= np.frombuffer(zlib.decompress(b), dtype=np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["bits"])

    few = max(1, math.isqrt(partitions(spark)))
    rows = links.mapInArrow(marks, "bits binary").repartition(few).mapInArrow(union, "bits binary").collect()  # 2 MB each at most
    wanted = np.zeros(size // 8, dtype=np.uint8)
    for r in rows:
        wanted |= np.frombuffer(zlib.decompress(bytes(r["bits"])), dtype=np.uint8)
    wanted = spark.sparkContext.broadcast(wanted.tobytes())

    def needed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.unpackbits(np.frombuffer(wanted.value, dtype=np.uint8)).view(bool), set()
        for batch in it:
            if len(seen) > 2_000_000:
                seen = set()
            ids = batch.column("rid").to_numpy()
            kept = np.array([i for i in np.flatnonzero(bits[ids % size]) if not (ids[i] in seen or seen.add(ids[i]))], dtype=np.int64)
            yield batch.take(pa.array(kept))

    own = sets.select("rid", "tokens").mapInArrow(needed, "rid long, tokens binary")

    def at(keyed: DataFrame, hot: DataFrame, walk: bool) -> DataFrame:
        """Brings the rows ``keyed(rid, other, tokens)`` to the sets of their ``rid``: those are added, or the trie is traversed."""

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ranks, shift = _ranks(sent)
            ordered = lambda raw: np.sort(_in_order(_unpack(raw), ranks, shift))
            rid, mine, raw, partners = None, None, None, []
            out: list[tuple] = []

            def compare() -> None:
                out.extend((a, rid[0], o, u) for a, o, u in _traversed(mine, partners, t))
                partners.clear()

            for batch in it:
                for r, salt, kind, other, tokens in zip(*(batch.column(c).to_pylist() for c in ("rid", "salt", "kind", "other", "tokens")), strict=True):
                    if (r, salt) != rid:
                        if partners:
                            compare()
                        rid, mine, raw = (r, salt), None, None
                    if kind == 0:
                        if raw is None:
                            raw, mine = tokens, ordered(tokens) if walk else None
                    elif walk:
                        partners.append((other, ordered(tokens)))
                        if len(partners) >= 512:
                            compare()
                    else:
                        out.append((other, r, raw))
                if len(out) > (20_000 if walk else 500):
                    yield pack(out)
                    out.clear()
            if partners:
                compare()
            if out:
                yield pack(out)

        names = ["a", "b", "overlap", "n_union"] if walk else ["rid", "other", "tokens"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64()] if walk else [pa.int64(), pa.int64(), pa.binary()]

        def pack(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        few = F.broadcast(hot)
        sets_ = own.join(few, "rid", "left").select("rid", _copies().alias("salt"), F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("other"), "tokens")
        asked = keyed.join(few, "rid", "left").select("rid", _salt("other").alias("salt"), F.lit(1).alias("kind"), "other", "tokens")
        both = sets_.unionByName(asked).repartition(partitions(spark), "rid", "salt").sortWithinPartitions("rid", "salt", "kind")
        return both.mapInArrow(run, "a long, b long, overlap long, n_union long" if walk else "rid long, other long, tokens binary")

    # the pair goes to a, takes a's set along to b, and is decided there
    first = links.select(F.col("a").alias("rid"), F.col("b").alias("other"), F.lit(None).cast("binary").alias("tokens"))
    return at(at(first, _hot(first, "rid"), walk=False), _hot(links.select(F.col("b").alias("rid")), "rid"), walk=True)


def near_duplicates(records: DataFrame, key: str, text: str, shingle_words: int = 5, threshold: float = 0.8, least_words: int = 0) -> tuple[DataFrame, DataFrame]:
    """Classes of records with equal sets of word sequences, and the links between classes of similarity >= ``threshold``.

    Returns ``members(key, rid, n)`` (one row a record with at least ``least_words`` words and one sequence; others have no
    set and are similar to nothing; rows that repeat a key stay as often as they are) and ``links(a, b, overlap, n_union)`` with a < b,
    class ids of ``members``. Complete: no pair of classes that reaches the threshold is missing. A null text has no words;
    a null key is kept as null. Other columns are ignored, whatever their names.
    """
    t = Fraction(threshold).limit_denominator(1000)
    records = spread(records.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text")))
    sets = token_sets(records, shingle_words, max(least_words, shingle_words))
    n, tokens = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    sent = sets.sparkSession.sparkContext.broadcast(token_order(sets, tokens).tobytes())
    links = materialise(candidate_links(sets, t, sent, tokens, n), "links")
    return sets.select("key", "rid", "n"), verified_links(sets, links, t, sent)


def similar_pairs(records: DataFrame, key: str, text: str, shingle_words: int = 5, threshold: float = 0.8, least_words: int = 0) -> DataFrame:
    """(key_a, key_b), key_a < key_b: all pairs of records that reach the threshold, copies of one text included.

    A class of very many copies has as many rows as pairs; it is spread over tasks on both sides.
    """
    members, links = near_duplicates(records, key, text, shingle_words, threshold, least_words)
    members = materialise(members.where("key is not null").select("key", "rid").distinct(), "members")
    few = F.broadcast(_hot(members, "rid"))
    several = members.groupBy("rid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("rid").alias("a"), F.col("rid").alias("b"))
    wanted = links.select("a", "b").unionAll(several)
    named = few.withColumnRenamed("rid", "a")
    left = wanted.join(named, "a", "left").select("a", "b", _copies().alias("salt"))
    left = left.join(members.join(few, "rid", "left").select(F.col("rid").alias("a"), _salt("key").alias("salt"), F.col("key").alias("ka")), ["a", "salt"]).select("a", "b", "ka")
    # on the other side the rows at hand are split, and the members sent to each part
    right = left.join(few.withColumnRenamed("rid", "b"), "b", "left").select("a", "b", "ka", _salt("ka").alias("salt"))
    both = right.join(members.join(few, "rid", "left").select(F.col("rid").alias("b"), "key", _copies().alias("salt")), ["b", "salt"])
    both = both.where("a <> b or ka < key")
    return both.select(F.least("ka", "key").alias("key_a"), F.greatest("ka", "key").alias("key_b"))


def duplicate_groups(records: DataFrame, key: str, text: str, shingle_words: int = 5, threshold: float = 0.8, least_words: int = 0) -> DataFrame:
    """(key, class_id, group_id, n_links): one row a record with a set. Classes linked to each other, directly or not, are a group;
    ``n_links`` is the number of other classes that the record's class is linked to."""
    members, links = near_duplicates(records, key, text, shingle_words, threshold, least_words)
    links = materialise(links.select("a", "b"), "verified")
    groups = connected_components(links.toDF("src", "dst")).toDF("rid", "group_id")
    degree = links.select(F.col("a").alias("rid")).unionAll(links.select("b")).groupBy("rid").agg(F.count(F.lit(1)).alias("n_links"))
    out = members.join(groups, "rid", "left").join(degree, "rid", "left")
    return out.select("key", F.col("rid").alias("class_id"), F.coalesce("group_id", "rid").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
