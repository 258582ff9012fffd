"""One order from several differently scaled scores: closeness to an ideal point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusrank.operators.skew import group_positions, join_statistics
from corpusrank.shared import materialise


def finite(x: Column) -> Column:
    """The number, or null where it is NaN or infinite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _reached(rows: DataFrame, score: str, places: int, salts: int = 64) -> DataFrame:
    """(group, n, least_<score>): a group's rows, and the value that ``places`` of them reach or exceed (the least one in smaller groups).

    In two steps, so that no task sees a whole large group.
    """
    kept = rows.where(F.col(score).isNotNull()).select("group", score, F.pmod(F.xxhash64("item"), F.lit(salts)).alias("salt"))
    for by in (["group", "salt"], ["group"]):
        kept = kept.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score)))).where(F.col("r") <= places).drop("r")
    least = kept.groupBy("group").agg(F.min(score).alias(f"least_{score}"))
    return rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).join(least, "group")


def _cuts(kept: DataFrame, scores: Sequence[str], tails: float, top: int) -> DataFrame:
    """(group, low_cut_<score>, high_cut_<score>, least_<score>...): the values at the ranks of the two tails and of place ``top``, exactly.

    All values of all scores are ranked in one range-partitioned pass, so large groups span several tasks.
    """
    values = F.array(*(F.struct(F.lit(i).alias("which"), F.col(s).alias("value")) for i, s in enumerate(scores)))
    long = kept.select("group", F.explode(values).alias("x")).where("x.value is not null").select(F.struct("group", "x.which").alias("key"), "x.value")
    placed = group_positions(long, "key", ["value"], "at", "of")
    rank = lambda share: F.greatest(F.lit(1), F.col("of") - F.floor(F.col("of") - F.col("of") * share))
    wanted = {"low_cut": rank(tails), "high_cut": rank(1 - tails), "least": F.greatest(F.lit(1), F.col("of") - top + 1)}
    hits = [F.when(F.col("at") == at, F.col("value")).alias(name) for name, at in wanted.items()]
    picked = placed.select("key.*", *hits).where("low_cut is not null or high_cut is not null or least is not null")
    return picked.groupBy("group").agg(*(F.max(F.when(F.col("which") == i, F.col(name))).alias(f"{name}_{s}") for i, s in enumerate(scores) for name in wanted))


def ideal_point(rows: DataFrame, group: str, item: str, scores: Sequence[str], weights: Sequence[float] | None = None, tails: float = 0.05, top: int = 2) -> DataFrame:
    """(group, item, *scores, closeness, top_<score>...) of each item of each group.

    A repeated item counts once with its greatest finite value of each score. Scores are clipped to the group's values at the ranks
    ``tails`` and 1 - ``tails`` (rounded up), exactly, divided by the group's vector norm and weighted; closeness is d- / (d+ + d-), of the distances to the
    anti-ideal (least of each score) and the ideal (greatest). A missing, NaN or infinite score counts as the anti-ideal; closeness is 0 where
    a group has no spread. ``top_<score>``: fewer than ``top`` items of the group have a greater value (false without one).
    Rows with a null group or item are left out; an empty table gives no rows. Groups of any size are spread over tasks.
    """
    weights = list(weights or [1.0] * len(scores))
    kept = rows.select(F.col(group).alias("group"), F.col(item).cast("string").alias("item"), *(finite(F.col(s)).alias(s) for s in scores))
    kept = kept.where("`group` is not null and item is not null").groupBy("group", "item").agg(*(F.max(s).alias(s) for s in scores))
    kept = materialise(kept, "scores")
    stats = materialise(kept.groupBy("group").agg(F.count(F.lit(1)).alias("n")).join(_cuts(kept, scores, tails, top), "group", "left"), "limits")
    spread = F.col("item")

    def clipped(s: str) -> Column:
        return F.least(F.greatest(F.col(s), F.col(f"low_cut_{s}")), F.col(f"high_cut_{s}"))

    limited = join_statistics(kept, stats, "group", "n", spread)
    limited = limited.select("group", "item", *scores, *(F.when(F.col(s).isNotNull(), clipped(s)).alias(f"c_{s}") for s in scores), *(F.coalesce(F.col(s) >= F.col(f"least_{s}"), F.lit(False)).alias(f"top_{s}") for s in scores))
    limited = materialise(limited, "clipped")
    norms = [F.count(F.lit(1)).alias("n")]
    for s in scores:
        big = F.max(F.abs(f"c_{s}"))  # squares of very great or small numbers stay finite below
        norms += [F.min(f"c_{s}").alias(f"low_{s}"), F.max(f"c_{s}").alias(f"high_{s}"), big.alias(f"big_{s}")]
    ends = materialise(limited.groupBy("group").agg(*norms), "ends")
    scaled = join_statistics(limited, ends, "group", "n", spread)
    scaled = materialise(scaled.select("group", "item", *scores, *(f"top_{s}" for s in scores), *(x for s in scores for x in (_over(f"c_{s}", s).alias(f"c_{s}"), _over(f"low_{s}", s).alias(f"low_{s}"), _over(f"high_{s}", s).alias(f"high_{s}")))), "scaled")
    lengths = materialise(scaled.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *(F.sqrt(F.sum(F.col(f"c_{s}") * F.col(f"c_{s}"))).alias(f"norm_{s}") for s in scores)), "norms")
    whole = join_statistics(scaled, lengths, "group", "n", spread)
    to_best = to_worst = F.lit(0.0)
    for s, w in zip(scores, weights, strict=True):
        unit = lambda c, s=s, w=w: F.when(F.col(f"norm_{s}") > 0, F.col(c) * w / F.col(f"norm_{s}")).otherwise(0.0)
        low, high = F.coalesce(unit(f"low_{s}"), F.lit(0.0)), F.coalesce(unit(f"high_{s}"), F.lit(0.0))
        value = F.when(F.col(f"c_{s}").isNull(), low).otherwise(unit(f"c_{s}"))
        to_best = to_best + (high - value) * (high - value)
        to_worst = to_worst + (value - low) * (value - low)
    both = F.sqrt(to_best) + F.sqrt(to_worst)
    return whole.select("group", "item", *scores, F.when(both > 0, F.sqrt(to_worst) / both).otherwise(0.0).alias("closeness"), *(f"top_{s}" for s in scores))


def _over(column: str, score: str) -> Column:
    return F.when(F.col(f"big_{score}") > 0, F.col(column) / F.col(f"big_{score}")).otherwise(F.col(column))


def ranked(scored: DataFrame) -> DataFrame:
    """``scored`` (of ``ideal_point``) with ``rank``, 1 for the greatest closeness of the group; ties go to the smaller item."""
    return group_positions(scored.withColumn("_down", -F.col("closeness")), "group", ["_down", "item"], "rank").drop("_down")


def agreed(scored: DataFrame, scores: Sequence[str], top: int = 2) -> DataFrame:
    """(group, item) of the groups in which exactly one item is at the top by every score; ``scored`` and ``top`` as in ``ideal_point``.

    Candidates come from the ranking: closeness grows with every score, so an item placed within ``top`` by each has at most ``top`` - 1 items
    a score before it, and is among the first 1 + scores x (``top`` - 1) by closeness, ties included. Only those are checked score by score.
    """
    scored = materialise(scored, "scored")
    limits = materialise(_reached(scored, "closeness", 1 + len(scores) * (top - 1)), "first")
    first = join_statistics(scored, limits, "group", "n", F.col("item")).where(F.col("closeness") >= F.col("least_closeness") - 1e-9)
    both = F.lit(True)
    for s in scores:
        both = both & F.col(f"top_{s}")
    return first.where(both).groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("item")).where("n = 1").select("group", "item")
