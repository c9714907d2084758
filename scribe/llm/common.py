"""What the operators share: saved intermediate tables, free column names and connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the five controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of our own in local mode and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-scribe-")
        spark.conf.set("spark.checkpoint.dir", where)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(where)
    return where.rstrip("/")


def saved(df: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
    """Cuts the lineage by a Parquet table in the shared folder; the write's own shuffle files go when it is done.

    An aggregate that is to meet a hot key in a join is saved first: Spark splits a join's large partitions only where
    both sides come from plain shuffles.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    back = spark.read.parquet(path)
    back._saved_in = path
    return back


def forget(*frames: DataFrame | None) -> None:
    """Deletes saved tables that no plan reads any more."""
    for df in frames:
        path = getattr(df, "_saved_in", None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def free_name(columns: Iterable[str], name: str) -> str:
    """`name` with as many underscores before it as no column of a table has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let_go() -> None:
    """Gives what a task has freed back to the system: Python workers stay for later tasks, and would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def hash_filter(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """The first `bits` bits of the 64-bit hashes in a column as a set of bits: 2 ** bits / 8 bytes, however many there are."""
    slot = F.shiftrightunsigned(column, 64 - bits) + 1
    pages = hashes.groupBy(F.bitmap_bucket_number(slot).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros((max(1, (1 << bits) >> 15), 4096), np.uint8)
    for row in pages.collect():  # at most 2 ** bits / 2 ** 15 pages of 4 kB
        out[row["page"] - 1] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def in_filter(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in a hash_filter(); those that are in it always are."""
    bits = max(15, (len(filter_) * 8).bit_length() - 1)
    slot = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return (filter_[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs of longs -> (id, component), component being the smallest id that is reachable.

    Contracts the graph: every id goes to the least of itself and its neighbours, in later rounds also on from there,
    edges are drawn between where their ends went, and so on until none is left; then the steps are followed back. The smallest id of a component never
    moves. Each round is one aggregate and one equi-join for each end of the edges; the aggregate is saved before, so an
    id with many edges is a join whose large partitions Spark splits. Ids without an edge to another id have no row.
    """
    e = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    steps = []
    while not steps or not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        for _ in steps:  # twice as far with each jump, so that a chain takes the logarithm of its length in rounds
            near, m = m, saved(m.join(m.select(F.col("u").alias("m"), F.col("m").alias("far")), "m").select("u", F.col("far").alias("m")), "least")
            forget(near)
        steps.append(m)
        to = lambda end: steps[-1].select(F.col("u").alias(end), F.col("m").alias(f"{end}_to"))
        moved = e.join(to("u"), "u").join(to("v"), "v").where("u_to <> v_to")
        before, e = e, saved(moved.select(F.greatest("u_to", "v_to").alias("u"), F.least("u_to", "v_to").alias("v")).distinct(), "edges")
        forget(before)
    where = steps.pop()
    while steps:
        step = steps.pop()
        back = step.join(where.select(F.col("u").alias("m"), F.col("m").alias("end")), "m", "left").select("u", F.coalesce("end", "m").alias("m"))
        before, where = where, saved(back, "least") if steps else back
        if steps:
            forget(step, before)
    return where.select(F.col("u").alias("id"), F.col("m").alias("component"))
