"""The query log as an append-only table, and the times of its stages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = """ts timestamp, query string, raw_query string, profile string, lanes map<string,string>, gate_fired boolean, lexical_top double, vector_top double,
retrieved array<string>, cited array<string>, stage_ms map<string,double>, query_vector array<float>"""


def append(spark: SparkSession, path: str, turns: list[dict]) -> str | None:
    """Adds turns to the log at ``path``; returns a note instead of raising, as a log must not fail a query.

    ``raw_query`` is kept only where it differs from ``query``; ``cited`` null says that nothing was answered, [] that the answer cites nothing.
    """
    try:
        rows = [{"ts": dt.datetime.now(dt.timezone.utc), **t, "raw_query": t.get("raw_query") if t.get("raw_query") != t.get("query") else None} for t in turns]
        names = [f.name for f in spark.createDataFrame([], SCHEMA).schema]
        spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    except Exception as e:
        return f"the turn was not logged: {type(e).__name__}: {e}"
    return None


def stats(log: DataFrame) -> DataFrame:
    """(turns, first, last)."""
    return log.agg(F.count(F.lit(1)).alias("turns"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def recent(log: DataFrame, n: int, order: str = "id") -> DataFrame:
    """The last ``n`` turns, newest first."""
    return log.orderBy(F.desc(order)).limit(n)


def decoded(log: DataFrame) -> DataFrame:
    """A log whose lanes and stage_ms are JSON texts, with both as maps; broken texts give null."""
    return log.withColumn("lanes", F.from_json("lanes", "map<string,string>")).withColumn("stage_ms", F.from_json("stage_ms", "map<string,double>"))


def rank_at(quantile: float, n: Column) -> Column:
    """The 1-based place of a quantile among ``n`` values: round-half-even(quantile * (n - 1)) + 1."""
    return F.bround(F.lit(float(quantile)) * (n - 1)).cast("long") + 1


def percentiles(times: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(stage, n, p50, p95, ...) of ``times(stage, ms)``, rounded to 3; nulls don't count.

    Equal times are counted first and ranks read from running counts, so a stage's times need not fit in one task unless all differ.
    """
    counted = times.where("ms is not null").groupBy("stage", "ms").agg(F.count(F.lit(1)).alias("c"))
    up = Window.partitionBy("stage").orderBy("ms")
    placed = counted.withColumn("last", F.sum("c").over(up)).withColumn("n", F.sum("c").over(Window.partitionBy("stage")))
    picks = [F.max(F.when((F.col("last") >= rank_at(q, F.col("n"))) & (F.col("last") - F.col("c") < rank_at(q, F.col("n"))), F.round("ms", 3))).alias(f"p{round(q * 100)}") for q in quantiles]
    return placed.groupBy("stage").agg(F.max("n").alias("n"), *picks)
