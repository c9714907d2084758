"""Latency and throughput of batched recognition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribe.operators.quantiles import exact_percentiles


def number_batches(rows: DataFrame, size: int, warmup: int, order: str = "ord") -> DataFrame:
    """rows with a 0-based input order -> batch and warm: the first min(warmup, batches - 1) batches."""
    last = rows.agg(F.max(order).alias("_last"))
    numbered = rows.crossJoin(F.broadcast(last)).withColumn("batch", F.floor(F.col(order) / size))  # one row is broadcast
    return numbered.withColumn("warm", F.col("batch") < F.least(F.lit(warmup), F.floor(F.col("_last") / size))).drop("_last")


def latency_stats(batches: DataFrame, *keys: str, nominal: int = 32) -> DataFrame:
    """batches(ms, size, warm, load_ms?, failed?) -> exact latency figures over the batches that are not warm-up.

    Mean, median and 95th percentile a sample, each batch weighing its size, and samples a second; zeros without a batch.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    timed = batches.where(~F.col("warm"))
    ms, size, more = F.col("ms"), F.col("size"), []
    if "load_ms" in batches.columns:
        more.append(F.coalesce(F.avg("load_ms") / nominal, F.lit(0.0)).alias("avg_load_ms"))
    if "failed" in batches.columns:
        more.append(F.count_if("failed").alias("failed"))
    grouped = timed.groupBy(*keys) if keys else timed.groupBy()
    sums = grouped.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("timed_samples"), zero(F.sum(ms) / F.sum(size)).alias("avg_ms"), zero(F.try_divide(F.sum(size) * 1000.0, F.sum(ms))).alias("throughput_per_s"), *more)
    middle = exact_percentiles(timed, list(keys), ms / size, size, {"median_ms": 0.5, "p95_ms": 0.95})
    if keys:
        right = middle.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], "median_ms", "p95_ms")
        out = sums.join(right, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)], "left")
    else:
        out = sums.join(middle, how="left")  # one row and one or none
    names = [c for c in ("avg_load_ms", "failed") if c in out.columns]
    return out.select(*keys, "timed_samples", "avg_ms", zero(F.col("median_ms")).alias("median_ms"), zero(F.col("p95_ms")).alias("p95_ms"), "throughput_per_s", *names)
