"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusrank.shared import materialise, release


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(src, dst)``; the component is its least node.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until nothing changes: O(log n) rounds in practice. Neighbours are
    reduced to their minimum by partial aggregates; the joins that carry a minimum back to the edges of a hub rely on adaptive
    execution to split it. Each round is written to the shared folder, and the one before deleted. Nulls and self-loops of the input are ignored; an empty graph gives no rows.
    """
    pairs = materialise(edges.where("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "star")
    for _ in range(most_rounds):
        # large star: every larger neighbour of u joins the least of u's neighbourhood
        both = pairs.select("u", "v").unionAll(pairs.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour of u, and u itself, join the least of them
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(small_least.select("u", F.col("m").alias("v"))).distinct()
        now = materialise(small, "star")
        # done when every node points at a root that points nowhere, and nothing moved
        changed = now.exceptAll(pairs).limit(1).count() or pairs.exceptAll(now).limit(1).count()
        release(pairs)
        pairs = now
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
