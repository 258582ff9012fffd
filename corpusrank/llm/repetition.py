"""Repetition inside a document, with cut-offs whose false rejections are bounded."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusrank.llm.arrays import WORD, batches
from corpusrank.shared import spread

_SENTENCE, _PARAGRAPH, _SPACE = re.compile(r"[.!?。]+(?:\s+|\Z)|\n+"), re.compile(r"(?:\r?\n[ \t]*){2,}"), re.compile(r"\s+")
MEASURES = ("short_share", "sentence_share", "paragraph_share")
STRATA = ("en", "de", "fr", "es")
#: Strata too small to be certified alone share the cut-offs of this one, which holds for their documents taken together.
POOLED = "pooled"


def repeated_share(parts: list[str]) -> float:
    """Share of characters in parts that occurred before in the list."""
    seen: set[str] = set()
    again = total = 0
    for p in parts:
        total += len(p)
        if p in seen:
            again += len(p)
        seen.add(p)
    return again / total if total else 0.0


def _parts(pattern: re.Pattern, text: str) -> list[str]:
    return [p for x in pattern.split(text) if (p := _SPACE.sub(" ", x).strip().lower())]


def measured(docs: DataFrame, key: str, text: str, stratum: str, words: int = 5, short: int = 3, strata: Sequence[str] = STRATA) -> DataFrame:
    """(key, stratum, n_words, n_sequences, n_distinct, phrase_share, short_share, sentence_share, paragraph_share) of each document.

    ``phrase_share`` is 1 - distinct / all sequences of ``words`` words (0 without one), ``short_share`` the same of ``short`` words; the other two are the
    share of characters in sentences and paragraphs that occurred before. ``stratum`` folds to ``strata`` or 'other'. A null or empty text has zeros everywhere.
    Whole texts are measured, one at a time; rows that repeat a key stay as they are; an empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, "text"):
            out = []
            for s in batch.column("text").to_pylist():
                w = WORD.findall(s.lower()) if s else []
                n = max(0, len(w) - words + 1)
                distinct = len(set(zip(*(w[i:] for i in range(words))))) if n else 0  # noqa: B905
                few = max(0, len(w) - short + 1)
                some = len(set(zip(*(w[i:] for i in range(short))))) if few else 0  # noqa: B905
                out.append((len(w), n, distinct, 1 - distinct / n if n else 0.0, 1 - some / few if few else 0.0, repeated_share(_parts(_SENTENCE, s)) if s else 0.0, repeated_share(_parts(_PARAGRAPH, s)) if s else 0.0))
            columns = list(zip(*out, strict=True))
            arrays = [pa.array(c, pa.int64() if i < 3 else pa.float64()) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("stratum"), *arrays], ["key", "stratum", "n_words", "n_sequences", "n_distinct", "phrase_share", *MEASURES])

    name = F.lower(F.trim(F.col(stratum)))
    kept = docs.select(F.col(key).alias("key"), F.when(name.isin(*strata), name).otherwise("other").alias("stratum"), F.col(text).cast("string").alias("text"))
    return spread(kept).mapInArrow(run, f"key {kind}, stratum string, n_words long, n_sequences long, n_distinct long, phrase_share double, short_share double, sentence_share double, paragraph_share double")


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    total = d
    for m in range(1, 1_000_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * total


def upper_bound(failures: int, n: int, level: float) -> float:
    """Exact (Clopper-Pearson) upper confidence bound of a binomial probability: where P(X <= failures) falls to ``level``."""
    if failures >= n:
        return 1.0
    low, high = failures / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if beta_share(1 - mid, n - failures, failures + 1) > level:
            low = mid
        else:
            high = mid
    return high


def needed(most: float, level: float) -> int:
    """The least number of good documents, none of them rejected, that certifies a rate of at most ``most``."""
    return math.ceil(math.log(level) / math.log1p(-most))


def certified_cutoffs(labelled: DataFrame, measures: Sequence[str] = MEASURES, strata: Sequence[str] = STRATA, most: float = 0.02, level: float = 0.05, steps: int = 100) -> list[tuple[str, str, float | None, int, int, float]]:
    """(stratum, measure, cutoff, false rejections, good documents, bound) of every stratum and measure.

    ``labelled`` has ``stratum``, the measures and ``label`` (true: the document really is repetitive). The cut-off is the least on
    a grid of 1 / ``steps`` at which the exact upper bound of the share of good documents rejected stays within ``most``; with
    probability 1 - ``level`` that holds for all of them at once: strata and measures share ``level`` equally (Bonferroni), and within one the
    grid is tested from strict to loose until the first failure (fixed sequence), which costs nothing. Strata with fewer good documents than any
    certificate needs are pooled into one more stratum, ``POOLED``, by their number alone; None: nothing can be certified, which abstains.
    Only counts per stratum and grid step are gathered, from every row.
    """
    bins = [F.floor(F.col(m) * steps + 1e-9).cast("int").alias(m) for m in measures]
    stacked = labelled.where(~F.col("label")).select("stratum", *bins).select("stratum", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("bin")) for m in measures))).alias("x"))
    groups = [*strata, "other", POOLED]
    counts: dict[tuple[str, str], list[int]] = {(s, m): [0] * (steps + 1) for s in groups for m in measures}
    for r in stacked.groupBy("stratum", "x.measure", "x.bin").count().collect():  # strata x measures x (steps + 1) at most
        counts[r["stratum"], r["measure"]][r["bin"]] += r["count"]
    each = level / len(counts)
    least = needed(most, each)
    small = [s for s in groups[:-1] if sum(counts[s, measures[0]]) < least]
    for m in measures:
        counts[POOLED, m] = [sum(x) for x in zip(*(counts[s, m] for s in small), strict=True)] if small else counts[POOLED, m]
    out = {}
    for (s, m), by_bin in counts.items():
        n, best, rejected = sum(by_bin), None, by_bin[steps]
        for b in range(steps - 1, 0, -1):
            rejected += by_bin[b]
            bound = upper_bound(rejected, n, each) if n >= least else 1.0
            if bound > most:
                break
            best = (b / steps, rejected, bound)
        out[s, m] = (best[0] if best else None, best[1] if best else 0, n, best[2] if best else 1.0)
    return [(s, m, *(out[POOLED, m] if s in small else x)) for (s, m), x in out.items()]


def flagged(documents: DataFrame, cutoffs: list[tuple[str, str, float | None, int, int, float]], measures: Sequence[str] = MEASURES, doubt: dict[str, float] | None = None) -> DataFrame:
    """``documents`` with ``flag``: true where a measure reaches its stratum's cut-off, null where none does but it needs another look, else false.

    A document needs another look if some measure has no certified cut-off in its stratum, or, for measures named in ``doubt``, if it reaches that value;
    below it, a measure tells without a cut-off that the document is good.
    """
    hit, unsure = F.lit(False), F.lit(False)
    for s, m, cut, *_ in cutoffs:
        if m in measures:
            here, floor = F.col("stratum") == s, (doubt or {}).get(m)
            if cut is not None:
                hit = hit | (here & (F.floor(F.col(m) * 100 + 1e-9) >= round(cut * 100)))
            elif floor is None:
                unsure = unsure | here
            if floor is not None:
                unsure = unsure | (here & (F.col(m) >= floor))
    return documents.withColumn("flag", F.when(hit, True).when(unsure, F.lit(None)).otherwise(False))


def least_short_share(share: float, least_words: int, words: int = 5, short: int = 3) -> float:
    """What ``short_share`` a text of at least ``least_words`` words has if ``share`` of its sequences of ``words`` words are repeats: the first
    ``short`` words of a repeat are a repeat themselves, and there are ``words`` - ``short`` more of them in all."""
    n = least_words - words + 1
    return share * n / (n + words - short)
