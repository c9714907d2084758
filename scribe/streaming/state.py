"""The state of jobs as a table in hash buckets, of which a micro-batch rewrites only those that it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from scribe.operators import runs
from scribe.sources.versions import VersionedTable

HISTORY = "job_id string, batch long, ts timestamp, history_entry string"


class JobStore:
    """Latest state of every job in `buckets` parts, and history entries, each written once.

    Batch k makes version k of the states out of the newest version before it: only buckets with a job of the batch get
    new files, so its cost depends on the jobs it names and on the size of their buckets, not on k. A batch that is run
    again starts from the same version and gives the same one. Old versions go after `keep` batches; history entries of
    every `block` batches are put together into one folder, which counts from when it is whole.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, keep: int = 8, block: int = 32):
        self.spark, self.path, self.buckets, self.keep, self.block = spark, path.rstrip("/"), buckets, keep, block
        self.table = VersionedTable(spark, f"{self.path}/states", "job_id")

    def merge(self, batch: DataFrame, number: int) -> None:
        """Takes a batch of events(job_id, ts, field..., history_entry) in."""
        bucket = F.pmod(F.xxhash64("job_id"), F.lit(self.buckets)).cast("int")
        fields = [c for c in batch.columns if c not in ("job_id", "ts", "history_entry")]
        # a later batch is later for the state, whatever its times; within a batch times decide
        now = runs.upsert_jobs(batch).drop("history").withColumn("_batch", F.lit(number).cast("long"))
        now = now.select("job_id", "ts", *fields, "_batch", bucket.alias("_bucket"))
        base = self.table.latest(below=number)
        touched = [str(r["_bucket"]) for r in now.select("_bucket").distinct().collect()]  # at most `buckets`
        listed = self.table.files(base)
        files = [r["file"] for r in listed.where(F.col("part").isin(touched)).select("file").collect()] if touched else []
        if files:
            before = self.table.read(base, files).withColumn("_bucket", bucket)
            latest = [F.max(F.when(F.col(c).isNotNull(), F.struct("_batch", F.col(c))))[c].alias(c) for c in fields]
            now = before.unionByName(now).groupBy("job_id").agg(F.max("ts").alias("ts"), *latest, F.max("_batch").alias("_batch"), F.first("_bucket").alias("_bucket"))
        new = self.table.write(now.repartition(max(1, len(touched)), "_bucket").sortWithinPartitions("_bucket"), "_bucket")
        for version in [v for v in self.table.numbers() if v >= number]:
            self.table.drop_version(version)
        self.table.commit(number, listed.where(~F.col("part").isin(touched)).unionByName(new) if touched else listed)
        entries = batch.where("history_entry is not null").select(F.col("job_id").cast("string").alias("job_id"), F.lit(number).cast("long").alias("batch"), "ts", F.col("history_entry").cast("string").alias("history_entry"))
        entries.write.mode("overwrite").parquet(f"{self.path}/history/batch-{number:08d}")
        if number % self.block == self.block - 1:
            self.put_together(number // self.block)
        self.table.expire(self.keep)

    def put_together(self, block: int) -> None:
        parts = [f for f in self._folders() if f.startswith("batch-") and int(f[6:]) // self.block == block]
        if parts:
            told = self.spark.read.schema(HISTORY).parquet(*[f"{self.path}/history/{f}" for f in parts])
            told.coalesce(max(1, len(told.inputFiles()) // self.block)).write.mode("overwrite").parquet(f"{self.path}/history/block-{block:08d}")
            for f in parts:
                self._delete(f)

    def _folders(self) -> list[str]:
        """Folders of history entries that are whole; a block stands for its batches."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/history")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        whole = [n for n in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/history/{n}/_SUCCESS"))]
        blocks = {int(n[6:]) for n in whole if n.startswith("block-")}
        return sorted(n for n in whole if n.startswith("block-") or int(n[6:]) // self.block not in blocks)

    def _delete(self, folder: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/history/{folder}")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def states(self) -> DataFrame:
        """(job_id, ts, field...), one row for each job."""
        return self.table.read().drop("_batch", "_bucket")

    def history(self) -> DataFrame:
        """(job_id, batch, ts, history_entry), all entries."""
        folders = self._folders()
        return self.spark.read.schema(HISTORY).parquet(*[f"{self.path}/history/{f}" for f in folders]) if folders else self.spark.createDataFrame([], HISTORY)

    def jobs(self) -> DataFrame:
        """The states with each job's history entries in an array, by batch and time."""
        entries = F.transform(F.array_sort(F.collect_list(F.struct("batch", "ts", "history_entry"))), lambda e: e["history_entry"])
        states = self.states()
        told = self.history().groupBy(F.col("job_id").alias("_job")).agg(entries.alias("history"))
        out = states.join(told, F.col("job_id").cast("string") == F.col("_job"), "left").drop("_job")
        return out.withColumn("history", F.coalesce("history", F.array().cast("array<string>")))


def track_jobs(events: DataFrame, path: str, buckets: int = 64) -> DataStreamWriter:
    """Keeps a JobStore up to date with a stream of events(job_id, ts, field..., history_entry)."""
    return events.writeStream.foreachBatch(lambda batch, number: JobStore(batch.sparkSession, path, buckets).merge(batch, number))
