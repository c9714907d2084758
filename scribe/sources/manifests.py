"""Manifests: lines of path and label, or of paths alone."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribe.functions.text import sanitise_label


class MalformedManifest(ValueError):
    """Lines without a tab or with an empty field."""


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files that are neither blank nor comments, with the file they come from."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return rows.where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))


def read_manifest(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good rows (file, path, label), malformed rows (file, value)); strict: malformed or no rows raise an error."""
    lines = scan_lines(spark, path)
    parts = F.split("value", "\t", 2)
    rows = lines.select("file", "value", F.trim(F.get(parts, 0)).alias("path"), F.trim(F.get(parts, 1)).alias("label"))
    good = F.coalesce((F.col("path") != "") & (F.col("label") != ""), F.lit(False))
    bad = rows.where(~good).select("file", "value")
    fine = rows.where(good).select("file", "path", "label")
    if strict:
        first = [r["value"] for r in bad.limit(5).collect()]
        if first:
            raise MalformedManifest(f"lines without path, tab and label: {first}")
        if fine.isEmpty():
            raise MalformedManifest("the manifest has no rows")
    return fine, bad


def read_unlabeled(spark: SparkSession, path: str) -> DataFrame:
    return scan_lines(spark, path).select("file", F.trim("value").alias("path"))


def write_manifest(rows: DataFrame, path: str) -> None:
    """rows(path, label) as tab-separated lines; an empty label is an error."""
    rows.select(F.concat_ws("\t", F.replace("path", F.lit("\\"), F.lit("/")), sanitise_label(F.col("label"), strict=True)).alias("value")).write.mode("overwrite").text(path)


def write_manifest_table(rows: DataFrame, path: str) -> None:
    """rows(dataset, split, ord, path, label) as Parquet by dataset and split."""
    rows.write.mode("overwrite").partitionBy("dataset", "split").parquet(path)


def write_unlabeled(rows: DataFrame, path: str) -> None:
    rows.select(F.col("path").alias("value")).write.mode("overwrite").text(path)


def write_info(spark: SparkSession, info: dict, path: str) -> None:
    """The provenance of a dataset, one JSON row beside it."""
    spark.createDataFrame([(json.dumps(info, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_info(spark: SparkSession, path: str) -> DataFrame:
    """Provenance rows; files that are not JSON give none."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return rows.where(F.get_json_object("value", "$").isNotNull())


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """Words, one a line; without any an error."""
    words = scan_lines(spark, path).select(F.trim("value").alias("word"))
    if words.isEmpty():
        raise ValueError("the word list is empty")
    return words
