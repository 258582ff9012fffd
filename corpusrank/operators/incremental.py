"""Processing only new or changed records, run after run, with nothing lost or repeated when runs fail.

Keys are spread over buckets, as many as the rows ask for. A bucket's fingerprint is the count and the sum of the hashes of the rows
offered to it; both are additive, so they come from one partial aggregate, and those of newly offered rows are added to the
committed ones without reading anything older. A run reads and recomputes only buckets whose fingerprint differs from the
committed one, and replaces each by dynamic partition overwrite.

Folders below the state's path (an *attempt* is one try of a run, with a name of its own):

- ``state/of=n/bucket=b``: of n buckets, the newest version of every key, beside it the version committed before, and the attempt that wrote
  the bucket. The last commit names the attempt of every bucket. A reader takes the first version if the bucket was written by that attempt,
  else the second. So an attempt that dies after any of its writes leaves a state that still reads as the last commit.
- ``staged/<attempt>``: what an attempt is about to put into the state, kept until that is done. ``pending/<attempt>.json`` says that the replacing of
  buckets has begun and not ended; the next run finishes it first, as a crash may have left a bucket deleted but not yet replaced.
- ``changes/run=r/<attempt>``: keys that are new or changed. Only the attempt that the commit of run r names counts.
- ``commits/run=r.json``: bucket count, fingerprint and attempt of each bucket; written last, under another name that is then changed. That
  renaming is the commit.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from corpusrank.shared import delete_path


class Interrupted(Exception):
    """Raised at the point where a run was asked to die."""


class IncrementalState:
    """The last known version of every key, and which keys each run changed.

    ``key`` names the key column, ``fields`` those whose change counts, ``order`` those whose greatest value (as a tuple) picks a
    key's version among its rows; rows that are equal in ``order`` are told apart by ``fields``. Rows with a null key are left out.
    Rows that repeat add nothing; nulls in fields are values of their own; further columns are ignored, whatever their names.

    There is a bucket for every ``bucket_rows`` offered rows or begun part of it, rounded up to a power of two and ``most_buckets`` at most (they
    then grow instead, and are written in several files). When four times as many rows came, the state is laid out anew, once.
    A state must not be run by two processes at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, fields: Sequence[str], order: Sequence[str], bucket_rows: int = 25_000, most_buckets: int = 1 << 14):
        self.spark, self.path, self.key, self.fields, self.order = spark, path, key, list(fields), list(order)
        self.bucket_rows, self.most_buckets = bucket_rows, most_buckets

    # --- files ---

    def _at(self, name: str):
        """The file system and path of a file or folder of the state."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, root = self._at(folder)
        return [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []

    def _save(self, name: str, content: dict) -> None:
        """Writes a small file so that it is there wholly or not at all."""
        fs, draft = self._at(f"drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(content), "ascii"))
        out.close()
        target = self._at(name)[1]
        fs.mkdirs(target.getParent())
        if not fs.rename(draft, target):
            raise OSError(f"{name} could not be written")

    def _load(self, name: str) -> dict:
        fs, path = self._at(name)
        stream = fs.open(path)
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    # --- what is committed ---

    def committed(self) -> list[int]:
        """Numbers of the committed runs, ascending."""
        return sorted(int(n[4:-5]) for n in self._names("commits") if n.startswith("run=") and n.endswith(".json"))

    def changes(self, after: int | None = None) -> DataFrame:
        """(run, key, *fields) of all committed runs, or of those after a number; no rows if they changed nothing. An error before the first commit."""
        done = self.committed()
        if not done:
            raise ValueError(f"no run is committed below {self.path}")
        commits = {n: self._load(f"commits/run={n}.json") for n in done if after is None or n > after or n == done[-1]}
        named = StructType.fromJson(commits[done[-1]]["schema"])
        kinds = StructType([StructField("run", IntegerType()), named[self.key], *(named[f] for f in self.fields)])
        folders = [f"{self.path}/changes/run={n}/{commits[n]['attempt']}" for n in commits if commits[n]["attempt"] and (after is None or n > after)]
        if not folders:
            return self.spark.createDataFrame([], kinds)
        return self.spark.read.schema(kinds).parquet(*folders)

    # --- one run ---

    def _bucket(self, key: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def fingerprints(self, rows: DataFrame, buckets: int) -> DataFrame:
        """(bucket, n, digest) of ``rows``, of as many ``buckets``."""
        rows = rows.where(F.col(self.key).isNotNull())
        row = F.xxhash64(*(F.struct(F.col(c).isNull(), c) for c in [self.key, *self.fields, *self.order])).cast("decimal(38,0)")
        return rows.groupBy(self._bucket(self.key, buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(row).cast("string").alias("digest"))

    def run(self, number: int, offered: DataFrame, whole: bool = False, die_after: str | None = None) -> list[int]:
        """Processes ``offered`` as run ``number``; returns the buckets that were read and recomputed.

        ``offered`` are the rows that came since the last committed run (older ones may be among them and change nothing); what a failed
        run was offered has to be offered again. If ``whole``, they are all rows there are: a key's version is then picked among them alone,
        and buckets with equal fingerprints are not recomputed. Keys that are no longer offered keep their version. A committed number does nothing; a failed one may be run
        again with other rows. ``die_after`` ('changes' or 'state') ends the run there, as a crash would.
        """
        done = self.committed()
        if number in done:
            return []
        self._recover()
        delete_path(self.spark, f"{self.path}/changes/run={number}")  # of attempts that died
        last = self._load(f"commits/run={done[-1]}.json") if done else None
        buckets = last["of"] if last else self._fitting(offered.where(F.col(self.key).isNotNull()).count())
        now = {r["bucket"]: [r["n"], int(r["digest"])] for r in self.fingerprints(offered, buckets).collect()}  # a row a bucket
        before = {b: (n, int(d)) for b, n, d, _ in last["buckets"]} if last else {}
        prints = {b: (n, d) for b, (n, d) in now.items()}
        for b, (n, d) in before.items():
            if not whole or b not in now:
                more = now.get(b, (0, 0))
                prints[b] = (n + more[0], d + more[1])
        changed = sorted(b for b in now if before.get(b) != prints[b])
        wanted = self._fitting(sum(n for n, _ in prints.values()))
        regrown = bool(last) and wanted >= 4 * buckets
        attempt = uuid.uuid4().hex if changed else ""
        wrote = {b: a for b, _, _, a in last["buckets"]} if last else {}
        if changed:
            staged = self._stage(attempt, offered, whole, buckets, None if regrown else changed, wanted if regrown else buckets, wrote)
            if regrown:  # fingerprints of the rows kept, as the old ones cannot be divided
                buckets, wrote = wanted, {}
                kept = staged.select(F.col("_key").alias(self.key), "now.fields.*", "now.at.*")
                prints = {r["bucket"]: (r["n"], int(r["digest"])) for r in self.fingerprints(kept, buckets).collect()}
                changed = sorted(prints)
            fields, known = F.col("now.fields"), F.col("base.fields")
            new = staged.where(F.col("base").isNull() | ~fields.eqNullSafe(known))
            new.select(F.lit(number).alias("run"), F.col("_key").alias(self.key), "now.fields.*").write.parquet(f"{self.path}/changes/run={number}/{attempt}")
            if die_after == "changes":
                raise Interrupted
            self._save(f"pending/{attempt}.json", {"of": buckets})
            self._replace(staged, buckets, sum(prints[b][0] for b in changed))
            self._forget(attempt)
            wrote |= dict.fromkeys(changed, attempt)
        if die_after:
            raise Interrupted
        schema = StructType([offered.schema[self.key], *(offered.schema[f] for f in self.fields)])
        rows = [[b, n, str(d), wrote.get(b, "")] for b, (n, d) in sorted(prints.items())]
        self._save(f"commits/run={number}.json", {"attempt": attempt, "of": buckets, "schema": json.loads(schema.json()), "buckets": rows})
        if regrown:
            delete_path(self.spark, f"{self.path}/state/of={last['of']}")
        return changed

    def _fitting(self, rows: int) -> int:
        return min(self.most_buckets, 1 << max(0, -(-rows // self.bucket_rows) - 1).bit_length())

    def _stage(self, attempt: str, offered: DataFrame, whole: bool, buckets: int, changed: list[int] | None, into: int, wrote: dict[int, str]) -> DataFrame:
        """Writes (_key, now, base, attempt, bucket) of the changed buckets (None: of all): the version after this run and the committed one."""
        key = StructField("_key", offered.schema[self.key].dataType)
        at, fields = StructType([offered.schema[c] for c in self.order]), StructType([offered.schema[c] for c in self.fields])
        version = StructType([StructField("at", at), StructField("fields", fields)])
        came = offered.where(F.col(self.key).isNotNull()).select(F.col(self.key).alias("_key"), F.struct(F.struct(*self.order).alias("at"), F.struct(*self.fields).alias("fields")).alias("came"), F.lit(None).cast(version).alias("base"))
        if changed is not None:
            came = came.where(self._bucket("_key", buckets).isin(changed))
        if wrote:
            kinds = StructType([key, StructField("now", version), StructField("base", version), StructField("attempt", StringType()), StructField("bucket", IntegerType())])
            named = [(b, a) for b, a in wrote.items() if changed is None or b in set(changed)]  # one row a bucket
            old = self.spark.read.schema(kinds).parquet(f"{self.path}/state/of={buckets}")
            if changed is not None:
                old = old.where(F.col("bucket").isin(changed))  # the folders of other buckets are not read
            known = F.when(F.col("attempt") == F.col("committed"), F.col("now")).otherwise(F.col("base"))
            old = old.join(F.broadcast(self.spark.createDataFrame(named, "bucket int, committed string")), "bucket").select("_key", F.lit(None).cast(version).alias("came"), known.alias("base"))
            came = came.unionByName(old.where("base is not null"))
        # one aggregate merges offered and committed versions; both are reduced before they move
        merged = came.groupBy("_key").agg(F.max("came").alias("came"), F.max("base").alias("base"))
        now = F.coalesce("came", "base") if whole else F.greatest("came", "base")
        staged = merged.select("_key", now.alias("now"), "base", F.lit(attempt).alias("attempt"), self._bucket("_key", into).alias("bucket"))
        path = f"{self.path}/staged/{attempt}"
        staged.write.parquet(path)
        return self.spark.read.schema(staged.schema).parquet(path)

    def _replace(self, staged: DataFrame, buckets: int, rows: int) -> None:
        """Replaces the buckets of ``staged``, of about ``rows`` rows, in the state; a bucket of many rows goes to several files."""
        files = max(1, -(-rows // (8 * self.bucket_rows * buckets)))
        tasks = max(1, min(buckets * files, -(-rows // self.bucket_rows)))
        spread = staged.repartition(tasks, "bucket", F.pmod(F.hash("_key"), F.lit(files)))
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/state/of={buckets}")

    def _recover(self) -> None:
        """Finishes the replacing that a dead attempt began: its rows read as the last commit, but none may be missing."""
        for name in self._names("pending"):
            staged = self.spark.read.parquet(f"{self.path}/staged/{name.removesuffix('.json')}")
            self._replace(staged, self._load(f"pending/{name}")["of"], staged.count())
            self._forget(name.removesuffix(".json"))
        delete_path(self.spark, f"{self.path}/staged")

    def _forget(self, attempt: str) -> None:
        delete_path(self.spark, f"{self.path}/pending/{attempt}.json")
        delete_path(self.spark, f"{self.path}/staged/{attempt}")


def replay(state: IncrementalState, start: DataFrame, feed: DataFrame, run_column: str, runs: Sequence[tuple[int, str]]) -> DataFrame:
    """Runs ``runs`` (number, status) in order, each over the rows of ``feed`` offered since the last committed one; returns the changes.

    ``start`` is what was known before, as run 0 (runs are numbered from 1). Status 'ok' commits. 'killed' dies with its changes written and its state not, any other
    status with both written.
    """
    state.run(0, start)
    last = None  # offered before any run: with the first
    for number, status in runs:
        came = feed.where((F.col(run_column) <= number) & (F.lit(True) if last is None else F.col(run_column) > last))
        try:
            state.run(number, came.select(*start.columns), die_after=None if status == "ok" else "changes" if status == "killed" else "state")
            last = number
        except Interrupted:
            pass
    return state.changes(after=0)
