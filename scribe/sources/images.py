"""Image folders: discovery by metadata alone, decoding checks, admissibility."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: File endings that are taken for images.
EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp", "ppm", "pgm")
DECODED = ("png", "jpg", "jpeg", "bmp", "gif", "tif", "tiff", "ppm", "pgm")
PORTABLE = ("ppm", "pgm")


def extension(path):
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def discover(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, modificationTime) of image files below the paths; contents are not read. Sorted and distinct."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "length", "modificationTime")
    return files.where(extension(F.col("path")).isin(*EXTENSIONS)).dropDuplicates(["path"]).orderBy("path")


def decode(spark: SparkSession, path: str) -> DataFrame:
    """Images with recursion: one row per file, height -1 where it cannot be decoded.

    By Spark's image source, but for portable pixmaps and graymaps, which it does not know.
    """
    read = spark.read.format("image").option("recursiveFileLookup", True).load(path).select("image.*")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("origin"), "content")
    portable = files.where(extension(F.col("origin")).isin(*PORTABLE)).mapInPandas(_portable, read.schema)
    return read.where(~extension(F.col("origin")).isin(*PORTABLE)).unionByName(portable)


def _portable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Binary and plain forms of both kinds, one byte a sample; rows as the image source gives them, colours as BGR."""
    import re

    for files in batches:
        out = []
        for origin, content in zip(files["origin"], files["content"]):
            row = (origin, -1, -1, -1, -1, b"")
            head = re.match(rb"P([2356])((?:\s+|#[^\n]*\n)+)(\d+)((?:\s+|#[^\n]*\n)+)(\d+)((?:\s+|#[^\n]*\n)+)(\d+)\s", content)
            if head:
                kind, width, height, top = (int(head[k]) for k in (1, 3, 5, 7))
                channels = 3 if kind in (3, 6) else 1
                size, rest = width * height * channels, content[head.end() :]
                if kind > 3:
                    pixels = np.frombuffer(rest[:size], np.uint8)
                else:
                    values = np.array(rest.split()[:size])
                    pixels = values.astype(np.uint8) if all(v.isdigit() and int(v) < 256 for v in values.tolist()) else values[:0].astype(np.uint8)
                if 0 < top < 256 and size and len(pixels) == size:
                    pixels = pixels.reshape(height, width, channels)[:, :, ::-1]
                    row = (origin, height, width, channels, 16 if channels == 3 else 0, pixels.tobytes())
            out.append(row)
        yield pd.DataFrame(out, columns=["origin", "height", "width", "nChannels", "mode", "data"])


@F.pandas_udf(IntegerType())
def contrast(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Highest minus lowest byte of the pixels."""
    for s in batches:
        yield s.map(lambda b: None if b is None or not len(b) else int(np.ptp(np.frombuffer(b, np.uint8))))


def screen(images: DataFrame, least_side: int = 6, least_contrast: int = 8) -> DataFrame:
    """Adds reason (null: usable): unsupported_format, undecodable, too_small or flat."""
    kind = extension(F.col("origin"))
    big = (F.col("height") >= least_side) & (F.col("width") >= least_side)
    level = contrast(F.when(big, F.col("data")))
    reason = F.when(~kind.isin(*DECODED), "unsupported_format").when(F.col("height") < 0, "undecodable").when(~big, "too_small").when(F.col("contrast") < least_contrast, "flat")
    return images.withColumn("contrast", level).withColumn("reason", reason)


def admit(files: DataFrame, images: DataFrame, most_bytes: int = 15_000_000, most_pixels: int = 50_000_000) -> DataFrame:
    """files(path, length, ...) with images(origin, width, height): accepted, reject_reason; the first fault counts."""
    # the two readers write the slashes after a scheme differently
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
    sizes = images.select(plain(F.col("origin")).alias("_at"), "width", "height")
    reason = (
        F.when(~extension(F.col("path")).isin(*EXTENSIONS), "extension")
        .when(F.col("length") == 0, "empty")
        .when(F.col("length") > most_bytes, "too_large")
        .when(F.col("height").isNull() | (F.col("height") < 0), "undecodable")
        .when(F.col("width").cast("long") * F.col("height") > most_pixels, "too_many_pixels")
    )
    return files.withColumn("_at", plain(F.col("path"))).join(sizes, "_at", "left").drop("_at").withColumn("reject_reason", reason).withColumn("accepted", F.col("reject_reason").isNull())
