"""Sources of labelled images: CSV splits, a line index, annotation tables, nested benchmark and history files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribe.functions.text import line_image_path
from scribe.sources.whole_files import known, read_files, write_files


def read_csv_splits(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """CSV files with FILENAME and IDENTITY, one for each split -> (split, path, label)."""
    schema, out = "FILENAME string, IDENTITY string", None
    for split, path in paths.items():
        rows = spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").option("escape", '"').csv(path).select(F.lit(split).alias("split"), F.col("FILENAME").alias("path"), F.col("IDENTITY").alias("label"))
        out = rows if out is None else out.unionByName(rows)
    return out


def read_line_index(spark: SparkSession, path: str) -> DataFrame:
    """Lines of id, status, seven or more fields and a transcription with | for spaces -> (path, label, reason).

    Lines of fewer than nine fields are 'short', those with a status of err are 'segmentation_error'.
    """
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    fields = F.split(F.trim("value"), r"\s+")
    rows = lines.select(fields.alias("f"))
    reason = F.when(F.size("f") < 9, "short").when(F.col("f")[1] == "err", "segmentation_error")
    return rows.select(line_image_path(F.col("f")[0]).alias("path"), F.replace(F.element_at("f", -1), F.lit("|"), F.lit(" ")).alias("label"), reason.alias("reason"))


def from_annotations(table: DataFrame) -> DataFrame:
    """Any table with ImgName and GroundTruth -> (path, label)."""
    return table.select(F.replace("ImgName", F.lit("\\"), F.lit("/")).alias("path"), F.col("GroundTruth").alias("label"))


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """JSON with entries of file, page, capture, lines and text -> one row each."""
    schema = "entries array<struct<file:string,page:int,capture:string,lines:array<string>,text:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("entries"))


def write_histories(rows: DataFrame, path: str) -> None:
    """rows(run, value): a folder run=<run> with a history.json for each run; 256 folders above hold them, by hash."""
    if not known(rows.sparkSession, path):
        rows.select("run", "value").write.partitionBy("run").text(path)
        return
    unfit = F.col("run").isNull() | F.contains("run", F.lit("/"))
    name = F.when(unfit, F.raise_error(F.concat(F.lit("no folder can have the name of run "), F.coalesce("run", F.lit("null"))))).otherwise(F.concat(F.lit("run="), "run"))
    write_files(rows.select(F.concat_ws("/", F.lpad((F.crc32("run") % 256).cast("string"), 3, "0"), name, F.lit("history.json")).alias("file"), "value"), path)


def read_histories(spark: SparkSession, path: str) -> DataFrame:
    """history.json files of runs -> (run, epoch, metrics map); missing or broken files give no rows."""
    schema = "run_name string, monitor string, monitor_mode string, epochs array<map<string,string>>"
    run = lambda file: F.regexp_extract(file, r"([^/]+)/[^/]*$", 1).alias("run")
    if known(spark, path):
        files = read_files(spark, path).select(run("file"), F.inline(F.from_json("value", f"array<struct<{schema}>>")))
    else:
        files = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path).select(run("_metadata.file_path"), "*")
    rows = files.select("run", "monitor", "monitor_mode", F.explode("epochs").alias("e"))
    # numbers that JSON lacks come from from_json() in quotes
    number = lambda v: F.regexp_replace(v, '^"(NaN|-?Infinity)"$', "$1").try_cast("double")
    numbers = F.map_filter(F.transform_values("e", lambda k, v: number(v)), lambda k, v: v.isNotNull() & ~k.isin("epoch", "timestamp"))
    return rows.select("run", "monitor", "monitor_mode", F.try_element_at("e", F.lit("epoch")).try_cast("int").alias("epoch"), numbers.alias("metrics"))
