"""The run store as Parquet tables, JSON reports and text exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribe.functions.text import line_endings, safe_filename

TABLES = ("ocr_requests", "comparison_runs", "comparison_results", "evaluation_runs", "training_jobs")


def append(rows: DataFrame, root: str, name: str) -> None:
    """Appends rows to a table of the store; rows without an id get a random one."""
    if name not in TABLES:
        raise ValueError(f"the store has no table {name!r}")
    rows = rows if "id" in rows.columns else rows.withColumn("id", F.expr("uuid()"))
    rows.write.mode("append").parquet(f"{root}/{name}")


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(f"{root}/{name}")


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def report_column(rows: DataFrame, *keys: str) -> DataFrame:
    """One JSON document for each row, beside its keys."""
    return rows.select(*keys, F.to_json(F.struct(*rows.columns)).alias("report"))


def export_texts(rows: DataFrame, path: str) -> None:
    """rows(name, text): one folder for each name, Windows line endings and a byte order mark."""
    rows.select(safe_filename(F.col("name")).alias("file"), line_endings(F.col("text"), mark=True).alias("value")).write.mode("overwrite").partitionBy("file").option("lineSep", "\n").text(path)


def joined_export(rows: DataFrame, by: str, order: str = "name") -> DataFrame:
    """All texts of a group as one, each under a line with its name."""
    part = F.struct(order, F.concat(F.lit("===== "), F.col("name"), F.lit(" =====\n"), F.col("text")).alias("part"))
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["part"]), "\n\n").alias("text"))


def provenance_block(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Adds a block of 'field: value' lines; empty fields are left out."""
    lines = [F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", F.concat(F.lit(f + ": "), F.col(f).cast("string"))) for f in fields]
    return rows.withColumn("provenance_block", F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n"))
