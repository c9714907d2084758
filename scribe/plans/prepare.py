"""Whole preparation jobs: clean, check files, sample, split, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribe.functions.text import Charset
from scribe.operators import corpus


def prepare_corpus(labels: DataFrame, files: DataFrame, charset: Charset, caps: dict[str, int], most: int, unlabeled: int = 0, seed: int = 42, dataset: str = "corpus") -> dict[str, DataFrame]:
    """labels(split, path, label) with official splits -> manifest, unlabeled, report.

    Rows are cleaned and those without a file dropped before the caps, so a cap counts usable rows; what decodes images
    should run on the manifest only. The pool of unlabelled files leaves out those of every labelled split.
    """
    cleaned = corpus.clean_labels(labels, charset, most)
    report = corpus.reject_report(cleaned, "split")
    good = corpus.present(corpus.accepted(cleaned), files)
    chosen = corpus.split_caps(good, caps, seed, "path")
    pool = corpus.draw_pool(files, labels, unlabeled, seed) if unlabeled else files.limit(0).select("path")
    return {"manifest": chosen.withColumn("dataset", F.lit(dataset)), "unlabeled": pool, "report": report}


def prepare_unsplit(labels: DataFrame, files: DataFrame, charset: Charset, most: int, seed: int = 42, dataset: str = "corpus") -> dict[str, DataFrame]:
    """labels(path, label, reason?) without splits -> the same, split 80 to 10 to 10."""
    if "reason" in labels.columns:
        labels = labels.where("reason is null").drop("reason")
    cleaned = corpus.clean_labels(labels.withColumn("split", F.lit("all")), charset, most)
    good = corpus.present(corpus.accepted(cleaned), files).drop("split")
    parts = corpus.split_by_ratio(good, seed=seed, key="path").withColumn("dataset", F.lit(dataset))
    return {"manifest": parts, "unlabeled": corpus.leftover(files, good).select("path"), "report": corpus.reject_report(cleaned, "split")}


def prepare_train_test(labels: DataFrame, files: DataFrame, charset: Charset, most: int, seed: int = 42, dataset: str = "corpus") -> dict[str, DataFrame]:
    """labels(split, path, label) of train and test only: a tenth of train becomes val."""
    cleaned = corpus.clean_labels(labels, charset, most)
    good = corpus.present(corpus.accepted(cleaned), files)
    train = corpus.carve_validation(good.where("split = 'train'").drop("split"), seed=seed, key="path")
    parts = train.unionByName(good.where("split = 'test'")).withColumn("dataset", F.lit(dataset))
    return {"manifest": parts, "unlabeled": corpus.leftover(files, good).select("path"), "report": corpus.reject_report(cleaned, "split")}


def dataset_detail(manifest: DataFrame, charset: Charset, sample: int = 2000, top: int = 20) -> DataFrame:
    """For each dataset: the first `top` characters outside the alphabet among its first `sample` rows, and label lengths."""
    from pyspark.sql import Window

    first = manifest.withColumn("place", F.row_number().over(Window.partitionBy("dataset").orderBy("ord"))).where(F.col("place") <= sample)
    odd = first.select("dataset", F.explode(charset.unsupported(F.col("label"))).alias("character")).groupBy("dataset", "character").agg(F.count(F.lit(1)).alias("rows"))
    ranked = odd.withColumn("place", F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("rows"), "character"))).where(F.col("place") <= top)
    tops = ranked.groupBy("dataset").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "character", "rows"))), lambda x: F.struct(x["character"].alias("character"), x["rows"].alias("rows"))).alias("unsupported"))
    n = charset.encoded_length(F.col("label"))
    lengths = first.groupBy("dataset").agg(F.min(n).alias("shortest"), F.max(n).alias("longest"), F.avg(n).alias("mean_length"))
    return lengths.join(tops, "dataset", "left")
