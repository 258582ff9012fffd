"""What a corpus has to satisfy, as counts of violations: one row a check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusrank.operators.linkgraph import transitions


def conformance(docs: DataFrame, edges: DataFrame, symmetric: bool = True) -> DataFrame:
    """(check, violations) over ``docs(path, ...)`` and ``edges(src, dst, weight)``: keys are there and unique, weights finite and positive, edges
    symmetric, and transition rows sum to 1 with and without a self weight and hold a self edge with one."""
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")
    finite = F.col("weight").isNotNull() & ~F.isnan("weight") & (F.abs("weight") < float("inf"))
    parts = [
        one("keys are not empty", docs.where("path is null or trim(path) = ''")),
        one("keys are unique", docs.groupBy("path").count().where("count > 1")),
        one("edges have ends", edges.where("src is null or dst is null")),
        one("edges lead elsewhere", edges.where("src = dst")),
        one("weights are finite", edges.where(~finite)),
        one("weights are positive", edges.where(finite & (F.col("weight") <= 0))),
        one("edges are unique", edges.groupBy("src", "dst").count().where("count > 1")),
    ]
    if symmetric:
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        parts.append(one("edges go both ways", edges.select("src", "dst").join(back, ["src", "dst"], "left_anti")))
    for s in (0.0, 0.15):
        rows = transitions(edges, s)
        parts.append(one(f"rows sum to 1 at self weight {s:g}", rows.groupBy("src").agg(F.sum("p").alias("p")).where(F.abs(F.col("p") - 1) > 1e-6)))
        if s:
            parts.append(one("nodes keep a self edge", rows.select("src").distinct().join(rows.where("src = dst"), "src", "left_anti")))
    return reduce(DataFrame.unionByName, parts)
