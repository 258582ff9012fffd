"""Which pages each index run has to embed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusrank.operators.incremental import IncrementalState, replay
from corpusrank.shared import delete_path, fresh_path, table


def plain_hash(name: str):
    """A hash without case and surrounding blanks."""
    return F.lower(F.regexp_replace(F.col(name), r"(?U)^\s+|\s+$", ""))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """(run_no, page_id): pages whose hash or model is new against the last successful run, by run, with the failures of ``index_runs``."""
    fields = [plain_hash("hash").alias("hash"), F.coalesce("model", F.lit("")).alias("model")]
    start = table(spark, d, "pages").select("page_id", *fields, F.col("indexed_at").alias("seen_at"), F.lit(0).cast("long").alias("feed_id"))
    feed = table(spark, d, "page_feed").where("hash is not null").select("run_no", "page_id", *fields, "seen_at", F.col("feed_id").cast("long").alias("feed_id"))
    runs = [(r["run_no"], r["status"]) for r in table(spark, d, "index_runs").where("run_no is not null").orderBy("run_no").collect()]
    state = IncrementalState(spark, fresh_path(spark, "index"), "page_id", ["hash", "model"], ["seen_at", "feed_id"])
    found = replay(state, start, feed, "run_no", runs).select(F.col("run").cast("int").alias("run_no"), "page_id")
    delete_path(spark, f"{state.path}/state")  # only the changes are read from here on
    return found


QUERIES = {"p1_found": p1_found}

SQL = {
    "p1_found": """
WITH feed AS (
  SELECT 0 AS run_no, page_id, lower(regexp_replace(hash, '^\\s+|\\s+$', '', 'g')) AS hash, coalesce(model, '') AS model, indexed_at AS seen_at, 0 AS feed_id FROM pages
  UNION ALL SELECT run_no, page_id, lower(regexp_replace(hash, '^\\s+|\\s+$', '', 'g')), coalesce(model, ''), seen_at, feed_id FROM page_feed WHERE hash IS NOT NULL
), ok AS (SELECT run_no, lag(run_no, 1, 0) OVER (ORDER BY run_no) AS before FROM index_runs WHERE status = 'ok'),
states AS (SELECT o.run_no, page_id, arg_max({'h': hash, 'm': model}, {'a': seen_at, 'b': feed_id}) AS s FROM (SELECT run_no FROM ok UNION ALL SELECT 0) o JOIN feed f ON f.run_no <= o.run_no GROUP BY ALL)
SELECT n.run_no, n.page_id FROM states n JOIN ok USING (run_no) LEFT JOIN states p ON p.run_no = ok.before AND p.page_id = n.page_id WHERE p.s IS NULL OR p.s IS DISTINCT FROM n.s""",
}
