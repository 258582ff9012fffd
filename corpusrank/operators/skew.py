"""Joining rows with statistics of their keys when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusrank.shared import materialise


def join_statistics(rows: DataFrame, stats: DataFrame, key: str, count: str, spread: Column, share: int = 2_000, salts: int = 64) -> DataFrame:
    """``rows`` joined with the one row that ``stats`` has of each ``key``; rows without one are dropped.

    ``stats[count]`` is the number of rows of the key. A key with more than 1 / ``share`` of all rows is hot: its rows go to
    ``salts`` tasks by ``spread`` and its statistics to each of them. There are fewer than ``share`` hot keys by definition, so
    their list is broadcast. ``stats`` should be materialised; it is read twice.
    """
    total = stats.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = stats.where(F.col(count) * share > F.lit(total)).select(key, F.lit(True).alias("_hot"))
    rows = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0).cast("long"))).drop("_hot")
    copies = F.when(F.col(count) * share > F.lit(total), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return rows.join(stats.withColumn("_salt", F.explode(copies)), [key, "_salt"]).drop("_salt")


def group_positions(df: DataFrame, group: str, order: list[str], name: str, count: str | None = None) -> DataFrame:
    """``df`` with ``name``: the row's place (1, 2, ...) in its group by ``order``, without gathering a group in one task; and with ``count``, if
    named: the group's number of rows.

    Rows are range-partitioned by group and order and numbered within their range; a group that spans several ranges adds the
    counts of the earlier ones. Fewer groups span ranges than there are ranges, so those counts are broadcast.
    """
    spread = materialise(df.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = spread.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    several = Window.partitionBy(group)
    counts = counts.withColumn("_of", F.count(F.lit(1)).over(several)).where("_of > 1")
    before = counts.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), (F.sum("_n").over(several.orderBy("_range")) - F.col("_n")).alias("_before"), F.sum("_n").over(several).alias("_total"))
    here = Window.partitionBy("_range", group)
    numbered = spread.withColumn("_at", F.row_number().over(here.orderBy(*order)))
    if count:
        numbered = numbered.withColumn("_here", F.count(F.lit(1)).over(here))
    joined = numbered.join(F.broadcast(before), (F.col(group) == F.col("_g")) & (F.col("_range") == F.col("_r")), "left")
    joined = joined.withColumn(name, (F.col("_at") + F.coalesce("_before", F.lit(0))).cast("long"))
    if count:
        joined = joined.withColumn(count, F.coalesce("_total", "_here"))
    return joined.drop("_range", "_at", "_here", "_g", "_r", "_before", "_total")


def numbered_copies(df: DataFrame, name: str, at_once: int = 4096) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... for rows that are equal in all columns, so that they can be told apart and spread over tasks.

    Equal rows are counted, not gathered, and multiplied again in pieces of ``at_once``, each piece wherever its hash puts it.
    """
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    pieces = counted.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / at_once))))
    pieces = pieces.repartition(*df.columns, "_piece")
    last = F.least(F.col("_n"), (F.col("_piece") + 1) * at_once) - 1
    return pieces.withColumn(name, F.explode(F.sequence(F.col("_piece") * at_once, last))).drop("_n", "_piece")
