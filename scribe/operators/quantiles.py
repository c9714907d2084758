"""Exact weighted percentiles by narrowing ranges, without a buffer that grows with the distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribe.session import scratch

#: Bins that a range of values is cut into in one round: at most so many rows for each group and rank.
BINS = 4096


def exact_percentiles(rows: DataFrame, keys: list[str], value: Column, weight: Column, at: dict[str, float]) -> DataFrame:
    """(keys..., one column for each name in `at`): percentiles of `value`, each row counting `weight` times.

    As with the built-in, a percentile lies between the two values whose ranks surround at * (total weight - 1). For each
    rank a range of values is kept, at first all; a round counts the range's values in equal bins, takes the bin with
    the rank and its least and greatest value as the next range, until these are one value. A round is an aggregate
    with partial sums and a window over at most BINS rows of a group and rank; only ranges are kept between rounds.
    Null values and weights under 1 count nowhere; a group without any has no row, but without keys there is one, of nulls.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    base = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], value.cast("double").alias("_v"), weight.cast("long").alias("_w")).where("_v is not null and _w > 0")
    total = base.groupBy(*names).agg(F.sum("_w").alias("total"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    place = lambda p: F.lit(p) * (F.col("total") - 1)
    ranks = F.array_distinct(F.array(*[f(place(p)).cast("long") for p in at.values() for f in (F.floor, F.ceil)]))
    found = None
    # ranges: the rank-th smallest value is in [lo, hi], `below` counts what is less than lo
    ranges = _kept(total.where("total is not null").select(*names, F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below")), "ranges")
    while True:
        done = ranges.where("lo = hi or isnan(lo)").select(*names, "rank", F.col("lo").alias("v"))
        found = done if found is None else found.unionByName(done)
        ranges = ranges.where("lo < hi")
        if ranges.isEmpty():
            break
        on = [F.col(f"r.{n}").eqNullSafe(F.col(f"b.{n}")) for n in names] + [F.col("b._v") >= F.col("r.lo"), F.col("b._v") <= F.col("r.hi")]
        inside = base.alias("b").join(F.broadcast(ranges).alias("r") if not names else ranges.alias("r"), on)  # without keys at most two rows a percentile
        # halves, so that no difference overflows; where they do not differ, only the greatest value parts from the others
        step = F.coalesce(F.try_divide(F.col("_v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2), F.lit(0.0))
        bins = inside.select(*[F.col(f"r.{n}").alias(n) for n in names], "rank", "below", F.when(F.col("_v") < F.col("hi"), F.least(F.floor(step * BINS), F.lit(BINS - 1))).otherwise(BINS).alias("bin"), "_v", "_w")
        bins = bins.groupBy(*names, "rank", "below", "bin").agg(F.sum("_w").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        up_to = F.sum("n").over(Window.partitionBy(*names, "rank").orderBy("bin"))
        hit = bins.withColumn("up_to", up_to + F.col("below")).where((F.col("rank") < F.col("up_to")) & (F.col("rank") >= F.col("up_to") - F.col("n")))
        ranges = _kept(hit.select(*names, "rank", "lo", "hi", (F.col("up_to") - F.col("n")).alias("below")), "ranges")
    values = found.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("v"))  # two ranks a percentile
    right = values.select(*[F.col(n).alias(f"{n}_") for n in names], "v")
    # without keys either side is one row
    out = total.join(right, [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names]) if names else total.crossJoin(right)
    low = lambda p: F.element_at("v", F.floor(place(p)).cast("long"))
    high = lambda p: F.element_at("v", F.ceil(place(p)).cast("long"))
    part = lambda p: place(p) - F.floor(place(p))
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], *[F.when(low(p) == high(p), low(p)).otherwise(low(p) * (1 - part(p)) + high(p) * part(p)).alias(name) for name, p in at.items()])


def _kept(df: DataFrame, tag: str) -> DataFrame:
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
