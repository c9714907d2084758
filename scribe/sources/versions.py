"""Tables whose files are listed by numbered versions, so that a change rewrites only the files that hold its keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scribe.operators.runs import NotFound

FILES = "file string, part string, rows long, low string, high string"


class VersionedTable:
    """Parquet files under data/ and, under versions/, one small table for each version that names the files it has.

    A version counts when it is written as a whole, so readers see all of a change or nothing, and a change that failed
    leaves only files that no version names. `key` is the column by which changes find rows; its least and greatest value
    in each file are listed, and `part` may name the part (a hash bucket) that a file belongs to.
    """

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def numbers(self) -> list[int]:
        """The versions that have been written as a whole, in order."""
        at = self._at("versions")
        found = [s.getPath().getName() for s in self._files.listStatus(at)] if self._files.exists(at) else []
        return sorted(int(n) for n in found if n.isdigit() and self._files.exists(self._at(f"versions/{n}/_SUCCESS")))

    def latest(self, below: int | None = None) -> int | None:
        numbers = [n for n in self.numbers() if below is None or n < below]
        return numbers[-1] if numbers else None

    def files(self, version: int | None) -> DataFrame:
        """(file, part, rows, low, high) of a version; none of None."""
        if version is None:
            return self.spark.createDataFrame([], FILES)
        return self.spark.read.schema(FILES).parquet(f"{self.path}/versions/{version:08d}")

    def read(self, version: int | None = None, files: list[str] | None = None) -> DataFrame:
        """The rows of a version, the newest if none is given, or of some of its files."""
        version = self.latest() if version is None else version
        if version is None:
            raise NotFound(f"{self.path} has no version")
        names = [r["file"] for r in self.files(version).select("file").collect()] if files is None else files
        kind = StructType.fromJson(__import__("json").loads(self.spark.read.text(f"{self.path}/schema.json").first()[0]))
        return self.spark.read.schema(kind).parquet(*names) if names else self.spark.createDataFrame([], kind)

    def write(self, rows: DataFrame, part: str | None = None) -> DataFrame:
        """New files with the rows, laid out as the frame is partitioned; of what they are a version can be made by commit()."""
        if not self._files.exists(self._at("schema.json/_SUCCESS")):
            kind = StructType([f for f in rows.schema.fields if f.name != part])
            self.spark.createDataFrame([(kind.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/schema.json")
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        (rows.write.partitionBy(part) if part else rows.write).parquet(folder)
        back = self.spark.read.schema(StructType([*rows.schema.fields])).parquet(folder)
        listed = back.groupBy(F.col("_metadata.file_path").alias("file"), (F.col(part).cast("string") if part else F.lit(None).cast("string")).alias("part"))
        key = F.col(self.key)
        return listed.agg(F.count(F.lit(1)).alias("rows"), F.min(key).cast("string").alias("low"), F.max(key).cast("string").alias("high"))

    def commit(self, version: int, files: DataFrame) -> int:
        """Makes a version of the listed files; one that is there already is an error, so of two writers one wins."""
        files.select("file", "part", "rows", "low", "high").coalesce(1).write.mode("error").parquet(f"{self.path}/versions/{version:08d}")
        return version

    def drop_version(self, version: int) -> None:
        self._files.delete(self._at(f"versions/{version:08d}"), True)

    def create(self, rows: DataFrame) -> int:
        return self.commit(0, self.write(rows))

    def holding(self, keys: DataFrame, version: int) -> list[str]:
        """Files of a version that hold a row with one of the keys(key).

        Files whose range of keys does not meet that of the keys asked for are not opened; of the others the key column
        alone is read.
        """
        kind = dict(keys.dtypes)[self.key]
        least, most = keys.agg(F.min(self.key), F.max(self.key)).first()
        if least is None:
            return []
        near = self.files(version).where((F.col("high").cast(kind) >= F.lit(least)) & (F.col("low").cast(kind) <= F.lit(most)))
        names = [r["file"] for r in near.select("file").collect()]
        if not names:
            return []
        rows = self.read(version, names).where(F.col(self.key).between(least, most)).select(self.key, F.col("_metadata.file_path").alias("file"))
        return [r["file"] for r in rows.join(keys.select(self.key).distinct(), self.key, "left_semi").select("file").distinct().collect()]

    def rewrite(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
        """A new version in which the files that hold the keys(key) give way to what `change` makes of their rows."""
        version = self.latest()
        if version is None:
            raise NotFound(f"{self.path} has no version")
        touched = self.holding(keys, version)
        stay = self.files(version).where(~F.col("file").isin(touched)) if touched else self.files(version)
        if touched:
            changed = change(self.read(version, touched)).repartitionByRange(len(touched), self.key)
            stay = stay.unionByName(self.write(changed))
        return self.commit(version + 1, stay)

    def expire(self, keep: int) -> int:
        """Leaves the newest versions only and deletes the files that none of them names; gives the number of files gone."""
        numbers = self.numbers()
        old, new = numbers[:-keep], numbers[-keep:]
        if not old:
            return 0
        names = lambda versions: {r["file"] for v in versions for r in self.files(v).select("file").collect()}
        gone = names(old) - names(new)
        for version in old:
            self.drop_version(version)
        for file in gone:
            self._files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(file), False)
        return len(gone)


def delete_ids(table: VersionedTable, ids: DataFrame, strict: bool = False) -> int:
    """A version without the rows of ids(key); only files that hold one are written anew."""
    if strict and not ids.join(table.read(), table.key, "left_anti").isEmpty():
        raise NotFound("an id to delete has no row")
    return table.rewrite(ids, lambda rows: rows.join(ids, table.key, "left_anti"))


def cascade(table: VersionedTable, gone: DataFrame) -> int:
    """A version without the children of parents that are gone(key), `key` being the children's column for their parent."""
    return delete_ids(table, gone)


def correct(table: VersionedTable, corrections: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
    """A version with corrections(key, ...) applied to the rows of the files that hold their keys."""
    return table.rewrite(corrections.select(table.key).distinct(), lambda rows: apply(rows, corrections).select(*rows.columns))


def prune(table: VersionedTable, old: Callable[[DataFrame], DataFrame]) -> int:
    """A version without the rows that `old` picks; files without any stay as they are."""
    version = table.latest()
    touched = [r["file"] for r in old(table.read(version).withColumn("_file", F.col("_metadata.file_path"))).select(F.col("_file").alias("file")).distinct().collect()]
    stay = table.files(version).where(~F.col("file").isin(touched)) if touched else table.files(version)
    if touched:
        rows = table.read(version, touched)
        going = old(rows).select(table.key).distinct()
        stay = stay.unionByName(table.write(rows.join(going, table.key, "left_anti").repartitionByRange(len(touched), table.key)))
    return table.commit(version + 1, stay)
