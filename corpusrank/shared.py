"""Tables, shared folders and other small helpers used by every operator."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows per output file are left to Spark; this names the subfolder below the cluster's shared folder.
_SUBFOLDER = "corpusrank"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where that is unset.

    The temporary folder is meant for local sessions (tests); a cluster has to name its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpusrank-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{_SUBFOLDER}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back: its lineage ends there.

    Unlike ``checkpoint()`` the plan runs once only, and the files are columnar and compressed. They outlive executors, and are deleted by
    ``release`` or when the process ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    cut = spark.read.schema(df.schema).parquet(path)
    cut.cut_path = path
    _cuts.append((spark, path))
    return cut


#: Tables written by this process that are to be deleted at its end.
_cuts: list[tuple[SparkSession, str]] = []


def release(cut: DataFrame) -> None:
    """Deletes a table that ``materialise`` wrote, once nothing that is still to run reads it."""
    path = getattr(cut, "cut_path", None)
    if path:
        delete_path(cut.sparkSession, path)
        _cuts[:] = [c for c in _cuts if c[1] != path]


@atexit.register
def _release_all() -> None:
    for spark, path in _cuts:
        with contextlib.suppress(Exception):  # the session may be over
            delete_path(spark, path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, on whatever file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession, least: int = 1) -> int:
    """Shuffle partitions of the session, at least ``least``."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: Plan nodes that shuffle: asking for the partitions of such a plan would run it.
_SHUFFLES = re.compile(r"^[\s:+\-]*(?:Aggregate|Join|Window|Sort|Repartition|RebalancePartitions|Deduplicate|Distinct|GlobalLimit|Intersect|Except|FlatMap|MapGroups|CoGroup)", re.M)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for work that is heavy a row. Tables of many files stay as they are, and so do
    frames that come out of a shuffle, whose partitions Spark chooses while it runs."""
    if _SHUFFLES.search(df._jdf.queryExecution().optimizedPlan().toString()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
