"""The history of requests as files in order of time: pages by key, and text search that skips files by trigrams."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scribe.operators import runs
from scribe.sources.versions import VersionedTable

PLACE = "place"


def place_of(created_at: Column, id_: Column) -> Column:
    """A string whose order is that of (created_at, id): microseconds and id, each in twenty digits. Neither may be negative."""
    digits = lambda c: F.lpad(c.cast("string"), 20, "0")
    return F.concat(digits(F.unix_micros(created_at.cast("timestamp"))), digits(id_))


class History:
    """Requests(id, created_at, ...) in files that each hold a stretch of time, with an index of the trigrams in their texts.

    A page is found from the files' row counts or, behind a cursor, from their ranges, so it opens the one or two files
    that hold it whatever its number. A search opens the files that hold all trigrams of the text that is looked for,
    and compares their rows as runs.search() does.
    """

    TEXTS = ("text", "original_filename")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.table = VersionedTable(spark, f"{self.path}/requests", PLACE)

    def create(self, requests: DataFrame, files: int) -> None:
        placed = requests.withColumn(PLACE, place_of(F.col("created_at"), F.col("id")))
        self.table.create(placed.repartitionByRange(files, PLACE).sortWithinPartitions(PLACE))
        self.index()

    def index(self) -> None:
        """Writes (trigram, file) for the newest version, in order of trigrams, so that few parts of it hold those asked for."""
        version = self.table.latest()
        rows = self.table.read(version)
        texts = [F.lower(c) for c in self.TEXTS if c in rows.columns]
        # one text after another, so that a trigram across two of them can only let a file through in vain
        grams = rows.select(F.col("_metadata.file_path").alias("file"), F.explode(trigrams(F.concat_ws("\n", *texts))).alias("trigram")).distinct()
        grams.repartitionByRange(8, "trigram").sortWithinPartitions("trigram").write.parquet(f"{self.path}/trigrams/{version:08d}")

    def _listed(self, version: int) -> list:
        return sorted(self.table.files(version).collect(), key=lambda r: r["high"], reverse=True)  # as many rows as files

    def _page(self, files: list[str]) -> DataFrame:
        return self.table.read(files=files).orderBy(F.desc(PLACE))

    def page(self, offset: int, size: int, most: int = 200) -> DataFrame:
        """Rows offset .. offset + size, newest first."""
        size, offset = min(max(1, size), most), max(0, offset)
        files = self._listed(self.table.latest())
        before = [0, *accumulate(r["rows"] for r in files)]
        first, last = bisect_right(before, offset) - 1, bisect_right(before, offset + size - 1) - 1
        chosen = files[first : last + 1] if first < len(files) else []
        return self._page([r["file"] for r in chosen]).offset(offset - before[min(first, len(files))] if chosen else 0).limit(size).drop(PLACE)

    def after(self, cursor: str | None, size: int, most: int = 200) -> tuple[DataFrame, list[str]]:
        """(the next `size` rows behind a cursor with their `place`, the files opened); the last row's place is the next cursor."""
        size = min(max(1, size), most)
        files = [r for r in self._listed(self.table.latest()) if cursor is None or r["low"] < cursor]
        chosen, whole = [], 0
        for r in files:
            chosen.append(r["file"])
            whole += r["rows"] if cursor is None or r["high"] < cursor else 0  # of the file with the cursor any number may be left
            if whole >= size:
                break
        rows = self._page(chosen)
        return (rows if cursor is None else rows.where(F.col(PLACE) < cursor)).limit(size), chosen

    def candidates(self, text: str) -> list[str] | None:
        """Files that hold all trigrams of a search text; None if it has none, as wildcards and short texts do."""
        parts = [p for p in re.split(r"[%_]", text.lower()) if len(p) >= 3]
        grams = sorted({p[i : i + 3] for p in parts for i in range(len(p) - 2)})
        if not grams:
            return None
        index = self.spark.read.parquet(f"{self.path}/trigrams/{self.table.latest():08d}")
        held = index.where(F.col("trigram").isin(grams)).groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams))
        return [r["file"] for r in held.select("file").collect()]

    def search(self, text: str, **wanted) -> DataFrame:
        """runs.search() over the files that may hold the text; % and _ are wildcards."""
        return runs.search(self.table.read(files=self.candidates(text)), text=text, **wanted).drop(PLACE)


def trigrams(text: Column) -> Column:
    """All stretches of three characters, each once."""
    n = F.length(text)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 2)), lambda i: F.substring(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))
