"""Mixing sources to target weights: raking to source, language and topic marginals, then calibrated sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusrank.llm.tokens import token_sizes
from corpusrank.operators.skew import numbered_copies
from corpusrank.shared import materialise

#: Values of the language and of the topic marginal, at most: those of most tokens. The others, null included, count as 'other'; this bounds the cells.
MOST_VALUES = 32
#: Documents whose copies one task decides at a time.
SLICE_DOCUMENTS = 4096


def plain(name: Column) -> Column:
    """A name without case and surrounding blanks."""
    return F.lower(F.regexp_replace(name, r"(?U)^\s+|\s+$", ""))


def sized_documents(docs: DataFrame, key: str, text: str, source: str, language: str, topic: str) -> DataFrame:
    """(key, source, language, topic, n_tokens), written once to the shared folder."""
    kept = docs.select(F.col(key).alias("key"), *(plain(F.col(c)).alias(n) for c, n in ((source, "source"), (language, "language"), (topic, "topic"))), F.col(text).cast("string").alias("text"))
    return materialise(token_sizes(kept, "text", ["key", "source", "language", "topic"]), "sized")


def _values(sized: DataFrame, column: str, most: int) -> list[str]:
    """The values of a marginal, 'other' last."""
    known = sized.where(F.col(column).isNotNull() & (F.col(column) != "other")).groupBy(column).agg(F.sum("n_tokens").alias("n"))
    return [r[0] for r in known.orderBy(F.desc("n"), column).limit(most).collect()] + ["other"]


def source_plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, weight, max_repeats, size, target, reach, short) of each target source.

    ``target`` is its weight of all tokens (those without a source included), ``reach`` what it can give: the target, or its size
    ``max_repeats`` times where that is less; then ``short`` is true. A source without documents has size 0. Targets that repeat a
    source (without case and blanks) are summed, with the greatest ``max_repeats``; null weights count 0, null repeats 1.
    """
    wanted = targets.select(plain(F.col("source")).alias("source"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    wanted = wanted.where("source is not null").groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    sizes = sized.groupBy("source").agg(F.sum("n_tokens").alias("size"))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total")).first()["total"]
    plan = wanted.join(sizes, "source", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    target, most = F.col("weight") * F.lit(float(total)), F.col("max_repeats") * F.col("size")
    return plan.select("source", "weight", "max_repeats", "size", target.alias("target"), F.least(target, most.cast("double")).alias("reach"), (most < target).alias("short"))


def rake(sizes: np.ndarray, reach: np.ndarray, repeats: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Tokens to draw from each cell [source, language, topic] of ``sizes`` tokens.

    Iterative proportional fitting to what each source can give and to the natural shares of language and topic; no cell beyond
    ``repeats`` of its source. The source marginal is met exactly, the others as nearly as sources and caps allow.
    """
    x = sizes.astype(float).copy()
    total = reach.sum()
    if not total or not sizes.sum():
        return np.zeros_like(x)
    natural = [sizes.sum(axis=(0, 2)) / sizes.sum() * total, sizes.sum(axis=(0, 1)) / sizes.sum() * total]
    cap = sizes * repeats[:, None, None]

    def scale(x: np.ndarray, want: np.ndarray, axes: tuple[int, int], shape: tuple[int, ...]) -> np.ndarray:
        have = x.sum(axis=axes)
        return x * np.divide(want, have, out=np.ones_like(want), where=have > 0).reshape(shape)

    def to_sources(x: np.ndarray) -> np.ndarray:
        for _ in range(50):  # what a full cell cannot take goes to the source's others
            x = np.minimum(x, cap)
            missing = reach - x.sum(axis=(1, 2))
            if (missing <= 1e-9 * total).all():
                break
            free = np.where(x < cap, np.maximum(x, 1e-9 * cap), 0)
            have = free.sum(axis=(1, 2))
            x = x + free * np.divide(np.maximum(missing, 0), have, out=np.zeros_like(have), where=have > 0)[:, None, None]
        return scale(np.minimum(x, cap), reach, (1, 2), (-1, 1, 1))

    for _ in range(rounds):
        before = x
        x = scale(x, natural[0], (0, 2), (1, -1, 1))
        x = scale(x, natural[1], (0, 1), (1, 1, -1))
        x = to_sources(scale(x, reach, (1, 2), (-1, 1, 1)))
        if np.abs(x - before).max() <= 1e-6 * total:
            break
    return x


def copies_of(sizes: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """How often each document is drawn so that tokens come as near as they can to the sum of sizes x rates; in the order given.

    Each is taken floor(rate) times. What its fraction asks for is carried on, and the document is taken once more when at least half of it
    is owed. Documents of equal rate and near sizes are so taken in proportion to their fraction.
    """
    whole = np.floor(rates + 1e-9).astype(np.int64)
    owed, out = 0.0, whole.copy()
    for i, (size, part) in enumerate(zip(sizes, np.maximum(0.0, rates - whole), strict=True)):
        if part > 1e-9:
            owed += size * part
            if 2 * owed >= size:
                out[i] += 1
                owed -= size
    return out


def drawn(sized: DataFrame, plan: DataFrame, seed: int = 7, most_values: int = MOST_VALUES, slice_documents: int = SLICE_DOCUMENTS) -> DataFrame:
    """(key, source, n_tokens, copies) of the documents drawn at least once.

    Every cell of source, language and topic has a rate, its raked tokens by its size. A source's documents are cut into slices by a hash of their key
    and decided from large to small, by that hash within a size class, see ``copies_of``: a slice misses its tokens by about half its least document,
    none is drawn more than ``max_repeats`` times, and every run draws the same. Rows that repeat are documents of their own.
    """
    rows = {r["source"]: r for r in plan.collect()}  # one row a target source
    names = sorted(rows)
    langs, topics = _values(sized, "language", most_values), _values(sized, "topic", most_values)
    fold = lambda c, known: F.when(F.col(c).isin(known), F.col(c)).otherwise("other").alias(c)
    kept = sized.where(F.col("source").isin(*names) & (F.col("n_tokens") > 0)).select("key", "source", fold("language", langs), fold("topic", topics), F.col("n_tokens").cast("long").alias("n_tokens"))
    sizes = np.zeros((len(names), len(langs), len(topics)))
    number: dict[str, int] = {}
    for r in kept.groupBy("source", "language", "topic").agg(F.sum("n_tokens").alias("size"), F.count(F.lit(1)).alias("n")).collect():  # a row a cell
        sizes[names.index(r["source"]), langs.index(r["language"]), topics.index(r["topic"])] = r["size"]
        number[r["source"]] = number.get(r["source"], 0) + r["n"]
    key = sized.schema["key"].dataType.simpleString()
    if not number:
        return sized.select("key", "source", "n_tokens", F.lit(0).cast("long").alias("copies")).where("false")
    x = rake(sizes, np.array([rows[s]["reach"] for s in names]), np.array([rows[s]["max_repeats"] for s in names]))
    rates = [(s, a, b, float(x[i, j, k] / sizes[i, j, k]), -(-number[s] // slice_documents)) for i, s in enumerate(names) for j, a in enumerate(langs) for k, b in enumerate(topics) if sizes[i, j, k]]
    table = sized.sparkSession.createDataFrame(rates, "source string, language string, topic string, rate double, slices long")
    chance = F.xxhash64(F.lit(seed), "key", "copy")
    sliced = numbered_copies(kept, "copy").join(F.broadcast(table), ["source", "language", "topic"]).select("key", "source", "n_tokens", "rate", F.pmod(chance, F.col("slices")).alias("slice"), chance.alias("chance"))

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(kind=np.floor(np.log2(pdf["n_tokens"].to_numpy()))).sort_values(["kind", "chance"], ascending=[False, True], kind="stable")
        pdf = pdf.assign(copies=copies_of(pdf["n_tokens"].to_numpy(), pdf["rate"].to_numpy()))
        return pdf.loc[pdf["copies"] > 0, ["key", "source", "n_tokens", "copies"]]

    return sliced.groupBy("source", "slice").applyInPandas(decide, f"key {key}, source string, n_tokens long, copies long")


def shares(plan: DataFrame, sample: DataFrame) -> DataFrame:
    """(source, weight, max_repeats, size, target, reach, short, drawn, share, unfilled): what each source really contributes, and by how many tokens its
    cap on repeats keeps it from its target."""
    got = materialise(sample.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("drawn")), "drawn")
    everything = got.agg(F.coalesce(F.sum("drawn"), F.lit(0))).first()[0]
    out = plan.join(got, "source", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    out = out.withColumn("share", F.when(F.lit(everything > 0), F.col("drawn") / F.lit(float(max(1, everything)))).otherwise(0.0))
    return out.withColumn("unfilled", F.greatest(F.lit(0.0), F.col("target") - F.col("reach")))


def falling_short(shared: DataFrame) -> DataFrame:
    """(source) of ``shares``: sources whose drawn tokens miss their target because all their documents, as often as allowed, do not suffice.

    A capped source is drawn whole at every repeat, so its draw is below its target; ``short`` then tells it from one that a draw missed by a document.
    """
    return shared.where((F.col("drawn") < F.col("target")) & F.col("short")).select("source")
