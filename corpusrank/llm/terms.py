"""Terms of a collection: how often each occurs and in how many records, and how characteristic one is of a record.

A term is a maximal run of letters after removing soft hyphens and zero-width spaces, composing characters and lower-casing.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusrank.llm.arrays import batches
from corpusrank.operators.skew import join_statistics
from corpusrank.shared import materialise, spread

_LETTERS = regex.compile(r"\p{L}+")
_INVISIBLE = {0xAD: None, 0x200B: None}
#: Postings that a task gathers before it sends its bitmaps on.
FLUSH_POSTINGS = 3_000_000
#: Above so many records, a container of 2**16 records is a bit set and no list.
_DENSE = 4096


def terms_of(text: str | None) -> list[str]:
    """The terms of one text in order; none of a null or empty one."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFC", text.translate(_INVISIBLE))
    return _LETTERS.findall(text.lower())


# --- frequencies, by bitmaps of records -------------------------------------------------------------------------------


def _container(low: np.ndarray) -> bytes:
    """Sorted distinct 16-bit record numbers as bytes: a list, or a bit set where that is shorter."""
    if len(low) <= _DENSE:
        return low.astype("<u2").tobytes()
    bits = np.zeros(1 << 16, dtype=np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").tobytes() + b"d"


def _records(raw: bytes) -> np.ndarray:
    if len(raw) % 2:
        return np.flatnonzero(np.unpackbits(np.frombuffer(raw[:-1], dtype=np.uint8), bitorder="little"))
    return np.frombuffer(raw, dtype="<u2").astype(np.int64)


def union(first: bytes, second: bytes) -> bytes:
    """The container of the records in either."""
    return _container(np.union1d(_records(first), _records(second)))


def cardinality(raw: bytes) -> int:
    return int(np.bitwise_count(np.frombuffer(raw[:-1], dtype=np.uint8)).sum()) if len(raw) % 2 else len(raw) // 2


def _bitmaps(columns: list[str]):
    """(term, chunk, bits, occurrences): for each term and 2**16 records, those that have it."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {}
        term, record, count = [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            t, r, c = np.array(term, dtype=np.int64), np.array(record, dtype=np.int64), np.array(count, dtype=np.int64)
            names = list(numbers)
            order = np.lexsort((r, t))
            t, r, c = t[order], r[order], c[order]
            new = np.r_[True, (t[1:] != t[:-1]) | (r[1:] >> 16 != r[:-1] >> 16)]
            starts = np.flatnonzero(new)
            ends = np.r_[starts[1:], len(t)]
            totals = np.add.reduceat(c, starts)
            low = r & 0xFFFF
            for at in range(0, len(starts), 20_000):
                a, b = starts[at : at + 20_000], ends[at : at + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i] for i in t[a]], pa.string()), pa.array(r[a] >> 16), pa.array([_container(low[x:y]) for x, y in zip(a, b, strict=True)], pa.binary()), pa.array(totals[at : at + 20_000])],
                    ["term", "chunk", "bits", "occurrences"],
                )

        for batch in it:
            for rec, *texts in zip(*(batch.column(c).to_pylist() for c in ["record", *columns]), strict=True):
                found = Counter()
                for text in texts:
                    found.update(terms_of(text))
                for name, n in found.items():
                    term.append(numbers.setdefault(name, len(numbers)))
                    record.append(rec)
                    count.append(n)
                if len(term) >= FLUSH_POSTINGS:
                    yield from flush()
                    numbers.clear()
                    term, record, count = [], [], []
        if term:
            yield from flush()

    return run


def _merged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unites the containers of one term and chunk, which lie next to each other, and reads their cardinality."""
    key, bits, total = None, b"", 0
    terms, cards, totals = [], [], []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(cards, pa.int64()), pa.array(totals, pa.int64())], ["term", "records", "occurrences"])

    for batch in it:
        for term, chunk, raw, n in zip(*(batch.column(c).to_pylist() for c in ("term", "chunk", "bits", "occurrences")), strict=True):
            if (term, chunk) == key:
                bits, total = union(bits, raw), total + n
                continue
            if key:
                terms.append(key[0])
                cards.append(cardinality(bits))
                totals.append(total)
            key, bits, total = (term, chunk), raw, n
        if len(terms) > 50_000:
            yield out()
            terms, cards, totals = [], [], []
    if key:
        terms.append(key[0])
        cards.append(cardinality(bits))
        totals.append(total)
    if terms:
        yield out()


def term_frequencies(docs: DataFrame, texts: list[str], rare_most: int = 2, common_share: float = 0.5) -> DataFrame:
    """(term, occurrences, records, mark) of every term of the columns ``texts``, each row a record.

    ``mark`` is 'rare' for a term in at most ``rare_most`` records, 'common' for one in more than ``common_share`` of all rows,
    else null; a term that is both (tiny collections) is 'rare,common'. Rows without terms count as records. Nulls hold no terms;
    repeated rows are records of their own; an empty table gives no rows. Other columns are ignored.

    Vertical layout: a task numbers its records, builds one compressed bitmap per term and 2**16 records with a counter beside it;
    bitmaps of equal (term, chunk) are united and their cardinalities summed. A term in every record is spread over chunks, so it
    takes no larger task than others.
    """
    n = docs.count()
    kept = spread(docs.select(*(F.col(c).cast("string").alias(f"t{i}") for i, c in enumerate(texts)))).withColumn("record", F.monotonically_increasing_id())
    parts = kept.mapInArrow(_bitmaps([f"t{i}" for i in range(len(texts))]), "term string, chunk long, bits binary, occurrences long")
    parts = parts.repartition("term", "chunk").sortWithinPartitions("term", "chunk").mapInArrow(_merged, "term string, records long, occurrences long")
    out = parts.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    rare, common = F.col("records") <= rare_most, F.col("records") > F.lit(common_share) * n
    mark = F.when(rare & common, "rare,common").when(rare, "rare").when(common, "common")
    return out.withColumn("mark", mark)


# --- how characteristic a term is ---------------------------------------------------------------------------------------


def _postings(columns: list[str], least: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, columns[-1]):
            keys, terms, tfs, lengths = [], [], [], []
            for key, *texts in zip(*(batch.column(c).to_pylist() for c in ["doc", *columns]), strict=True):
                found = Counter()
                for text in texts:
                    found.update(terms_of(text))
                length = found.total()
                for name, n in found.items():
                    if n >= least:
                        keys.append(key)
                        terms.append(name)
                        tfs.append(n)
                        lengths.append(length)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(terms, pa.string()), pa.array(tfs, pa.int64()), pa.array(lengths, pa.int64())], ["doc", "term", "tf", "length"])

    return run


def _counts(columns: list[str]):
    """(term, df, cf) within the task's records, so that little is moved."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, cf = Counter(), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64()), pa.array([cf[t] for t in df], pa.int64())], ["term", "df", "cf"])

        for batch in it:
            for texts in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                found = Counter()
                for text in texts:
                    found.update(terms_of(text))
                df.update(found.keys())
                cf.update(found)
            if len(df) > 500_000:
                yield out()
                df, cf = Counter(), Counter()
        yield out()

    return run


def _dfr(tfn: Column, rate: Column) -> Column:
    """Information content of ``tfn`` occurrences under a geometric distribution of mean ``rate``, times the Laplace after-effect gain."""
    return (F.log2(1 + rate) + tfn * F.log2((1 + rate) / rate)) / (tfn + 1)


def _scored(postings: DataFrame, stats: DataFrame, n: int, c: float, most_df: int | None) -> DataFrame:
    """Joins the statistics and scores; see ``characteristic_terms``."""
    stats = materialise(stats, "terms")
    mean = (stats.agg(F.sum("cf")).first()[0] or 0) / max(1, n)
    joined = join_statistics(postings, stats, "term", "df", F.col("doc"))
    tfn = F.col("tf") * F.log2(1 + F.lit(float(c) * mean) / F.col("length"))
    joined = joined.withColumn("score", _dfr(tfn, F.col("cf") / F.lit(float(max(1, n)))))
    if most_df is not None:
        # the score falls as the rate rises up to tfn and rises beyond: its least value for rates up to that of the commonest rare term
        rate = (stats.where(F.col("df") <= most_df).agg(F.max("cf")).first()[0] or 0) / max(1, n)
        joined = joined.where(F.col("score") >= _dfr(tfn, F.least(F.lit(float(rate)), tfn)) - 1e-9) if rate else joined.where("false")
    return joined.select("doc", "term", "tf", "length", "df", "cf", "score")


def characteristic_terms(docs: DataFrame, key: str, texts: list[str], least_tf: int = 1, c: float = 1.0, most_df: int | None = None) -> DataFrame:
    """(doc, term, tf, length, df, cf, score) of each term that occurs at least ``least_tf`` times in a record.

    Divergence from randomness: tfn = tf * log2(1 + c * mean length / length), the information content of tfn occurrences under a
    geometric distribution of mean rate = cf / records, log2(1 + rate) + tfn * log2((1 + rate) / rate), times the Laplace after-effect gain
    1 / (tfn + 1). Statistics cover every record, whatever ``least_tf``. Null texts hold no terms but are records; a null key is kept;
    repeated keys are records of their own; an empty table gives no rows. Other columns are ignored. With ``most_df``, only terms that
    score at least what any term of at most so many records would score in their place: all those, and few others.
    """
    names = [f"t{i}" for i in range(len(texts))]
    kept = spread(docs.select(F.col(key).cast("string").alias("doc"), *(F.col(x).cast("string").alias(a) for x, a in zip(texts, names, strict=True))))
    stats = kept.select(*names).mapInArrow(_counts(names), "term string, df long, cf long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    postings = kept.mapInArrow(_postings(names, least_tf), "doc string, term string, tf long, length long")
    return _scored(postings, stats, docs.count(), c, most_df)


def characteristic_values(counted: DataFrame, doc: str, term: str, tf: str, least_tf: int = 1, c: float = 1.0, most_df: int | None = None) -> DataFrame:
    """As ``characteristic_terms``, of rows that say how often a term occurs: several rows of one (doc, term) are summed.

    Rows with a null doc or term, or a tf that is null or not positive, are no occurrences. Records are the docs that have any.
    """
    rows = counted.select(F.col(doc).cast("string").alias("doc"), F.col(term).cast("string").alias("term"), F.col(tf).cast("long").alias("tf"))
    summed = materialise(rows.where("doc is not null and term is not null and tf > 0").groupBy("doc", "term").agg(F.sum("tf").alias("tf")), "summed")
    stats = summed.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    lengths = materialise(summed.groupBy("doc").agg(F.sum("tf").alias("length"), F.count(F.lit(1)).alias("terms")), "lengths")
    postings = join_statistics(summed.where(F.col("tf") >= least_tf), lengths, "doc", "terms", F.col("term")).drop("terms")
    return _scored(postings, stats, lengths.count(), c, most_df)


def same_path(path: Column) -> Column:
    """A path regardless of letter case, slash direction, surrounding blanks and a missing '.md'."""
    plain = F.regexp_replace(F.lower(F.translate(path, "\\", "/")), r"^\s+|\s+$", "")
    return F.when(plain.endswith(".md"), plain).otherwise(F.concat(plain, F.lit(".md")))
