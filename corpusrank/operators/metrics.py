"""Measures of rankings against gold: ``ranking(query_id, key, rank)`` and ``gold(query_id, key)``, both without repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hits(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, key, rank) of every gold row; rank null where it was not found."""
    return gold.join(ranking.select("query_id", "key", "rank"), ["query_id", "key"], "left")


def recall_at(ranking: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, recall_all, hit, rr) of each query with gold: the share found within ``k``, whether all or any were, and 1 / the
    first gold rank (0 if none)."""
    found = F.count(F.when(F.col("rank") <= k, 1))
    by = hits(ranking, gold).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), found.alias("found"), F.min("rank").alias("first"))
    return by.select("query_id", (F.col("found") / F.col("n")).alias("recall"), (F.col("found") == F.col("n")).cast("int").alias("recall_all"), (F.col("found") > 0).cast("int").alias("hit"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def summary(ranking: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(queries, recall_any, recall_all, hit, mrr): means over the queries with gold."""
    return recall_at(ranking, gold, k).agg(F.count(F.lit(1)).alias("queries"), F.avg("recall").alias("recall_any"), F.avg("recall_all").alias("recall_all"), F.avg("hit").alias("hit"), F.avg("rr").alias("mrr"))


def recall_in_context(packed: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, recall): the share of gold pages that were packed into the context, ``packed(query_id, path)``."""
    inside = packed.select("query_id", F.col("path").alias("key"), F.lit(1).alias("in")).distinct()
    return gold.join(inside, ["query_id", "key"], "left").groupBy("query_id").agg((F.count("in") / F.count(F.lit(1))).alias("recall"))


def paired_bootstrap(scores: DataFrame, rounds: int = 1000, level: float = 0.95, seed: int = 11) -> DataFrame:
    """(difference, low, high) of the mean of b - a over ``scores(query_id, a, b)``.

    Each query is drawn a Poisson(1) number of times in each round, decided by a hash of query and round, so that rounds are partial sums and no
    task holds all queries.
    """
    cdf, total, term = [], 0.0, 2.718281828459045**-1
    for n in range(9):
        total += term
        cdf.append(total)
        term /= n + 1
    u = F.pmod(F.xxhash64(F.lit(seed), "query_id", "round"), F.lit(1 << 40)) / float(1 << 40)
    times = sum(((u >= c).cast("int") for c in cdf), F.lit(0))
    drawn = scores.select("query_id", (F.col("b") - F.col("a")).alias("d"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).withColumn("w", times)
    means = drawn.groupBy("round").agg((F.sum(F.col("w") * F.col("d")) / F.greatest(F.sum("w"), F.lit(1))).alias("m"))
    tail = (1 - level) / 2
    bounds = means.agg(F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"))
    return scores.agg(F.avg(F.col("b") - F.col("a")).alias("difference")).join(bounds)
