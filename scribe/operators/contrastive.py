"""Metrics of two-view embedding batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contrastive_metrics(emb: DataFrame, temperature: float = 0.5) -> DataFrame:
    """emb(batch, img, view, z) -> (batch, loss, accuracy, positive_similarity, negative_similarity).

    Every vector is compared with the others of its batch, whose size is a parameter of training: one equi-join by
    batch. A batch needs two images and each image both views, else the result raises an error.
    """
    norm = lambda z: F.sqrt(F.aggregate(z, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    unit = emb.select("batch", "img", "view", F.transform("z", lambda v: v.cast("double") / F.greatest(norm(F.col("z")), F.lit(1e-12))).alias("u"))
    sizes = emb.groupBy("batch").agg(F.countDistinct("img").alias("images"), F.count(F.lit(1)).alias("n"))
    pair = unit.alias("a").join(unit.alias("b"), (F.col("a.batch") == F.col("b.batch")) & ((F.col("a.img") != F.col("b.img")) | (F.col("a.view") != F.col("b.view"))))
    dot = F.aggregate(F.zip_with("a.u", "b.u", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    pair = pair.select(F.col("a.batch").alias("batch"), F.col("a.img").alias("img"), F.col("a.view").alias("view"), (F.col("a.img") == F.col("b.img")).alias("positive"), dot.alias("similarity"))
    scaled = F.col("similarity") / temperature
    rows = pair.groupBy("batch", "img", "view").agg(
        F.max(scaled).alias("top"),
        F.sum(F.exp(scaled - 1 / temperature)).alias("mass"),
        F.max(F.when(F.col("positive"), F.col("similarity"))).alias("positive"),
        F.sum(F.when(~F.col("positive"), F.col("similarity"))).alias("negative"),
        F.count_if(~F.col("positive")).alias("negatives"),
    )
    loss = F.ln("mass") + 1 / temperature - F.col("positive") / temperature
    out = rows.groupBy("batch").agg(F.avg(loss).alias("loss"), F.avg((F.col("positive") / temperature >= F.col("top")).cast("double")).alias("accuracy"), F.avg("positive").alias("positive_similarity"), (F.sum("negative") / F.sum("negatives")).alias("negative_similarity"))
    bad = (F.col("images") < 2) | (F.col("n") != F.col("images") * 2)
    checked = F.when(bad, F.raise_error(F.lit("a batch needs two images and both views of each")).cast("double")).otherwise(F.col("loss"))
    return sizes.join(out, "batch", "left").select("batch", checked.alias("loss"), "accuracy", "positive_similarity", "negative_similarity")
