"""Keeping the store of pages up to date from a stream of page states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STATE = "page_id string, title string, hash string, model string, seen_at timestamp, feed_id long"


class PageStore:
    """The newest state of every page, as parquet files in ``buckets`` folders.

    A micro-batch is merged by rewriting only the buckets it touches, through dynamic partition overwrite. Merging is idempotent (the state of
    the greatest (seen_at, feed_id) wins), so a batch that is delivered again after a failure changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path, buckets

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(f"{STATE}, bucket int").parquet(f"{self.path}/pages")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], f"{STATE}, bucket int")

    def merge(self, batch: DataFrame, batch_id: int = 0) -> None:
        """Takes the readable states of ``batch`` in."""
        new = batch.where("page_id is not null and hash is not null").selectExpr("page_id", "title", "lower(trim(hash)) hash", "coalesce(model, '') model", "seen_at", "feed_id")
        new = new.withColumn("bucket", F.pmod(F.xxhash64("page_id"), F.lit(self.buckets)).cast("int"))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # ``buckets`` at most
        if not touched:
            return
        both = self.read().where(F.col("bucket").isin(touched)).unionByName(new)
        rest = [c for c in both.columns if c not in ("page_id", "bucket", "seen_at", "feed_id")]
        best = both.groupBy("bucket", "page_id").agg(F.max(F.struct("seen_at", "feed_id", *rest)).alias("x")).select("page_id", "x.title", "x.hash", "x.model", "x.seen_at", "x.feed_id", "bucket")
        staged = f"{self.path}/staged"  # the pages must not be read while they are replaced
        best.write.mode("overwrite").parquet(staged)
        ready = self.spark.read.schema(best.schema).parquet(staged)
        ready.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/pages")

    def follow(self, states: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        """Merges a stream of page states; ``once``: all there is now, then ends."""
        writer = states.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()


def stage_times(turns: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, stage, n, mean_ms) of a stream of ``turns(ts, stage_ms MAP)``; turns later than ``late`` no longer count."""
    each = turns.withWatermark("ts", late).select("ts", F.explode("stage_ms").alias("stage", "ms"))
    return each.groupBy(F.window("ts", width), "stage").agg(F.count(F.lit(1)).alias("n"), F.avg("ms").alias("mean_ms"))
