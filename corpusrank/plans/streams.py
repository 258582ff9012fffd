"""Queries of the streaming operators, run over all there is now."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusrank.shared import delete_path, fresh_path, table
from corpusrank.streaming.index import STATE, PageStore

SQL = {
    "s1_streamed_pages": """SELECT page_id, x.h AS hash, x.m AS model FROM (SELECT page_id, arg_max({'h': lower(trim(hash)), 'm': coalesce(model, '')}, {'a': seen_at, 'b': feed_id}) AS x FROM page_feed WHERE hash IS NOT NULL AND page_id IS NOT NULL GROUP BY page_id)""",
}


def s1_streamed_pages(spark, d):
    """page_feed as a stream of files, one a run, merged into the store run by run."""
    base = fresh_path(spark, "stream")
    feed = table(spark, d, "page_feed").selectExpr("page_id", "title", "hash", "model", "seen_at", "feed_id", "run_no")
    feed.repartition("run_no").write.partitionBy("run_no").parquet(f"{base}/feed")
    states = spark.readStream.schema(f"{STATE}, run_no int").option("maxFilesPerTrigger", 4).parquet(f"{base}/feed").drop("run_no")
    store = PageStore(spark, f"{base}/store")
    query = store.follow(states, f"{base}/checkpoint")
    query.awaitTermination()
    out = store.read().select("page_id", F.col("hash"), "model")
    delete_path(spark, f"{base}/feed")
    return out


QUERIES = {"s1_streamed_pages": s1_streamed_pages}
