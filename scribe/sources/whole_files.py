"""Many small files that are read and written as a whole, thousands of them in a task."""

from __future__ import annotations

import json
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribe.session import dealt
from scribe.sources.manifest_source import HIDDEN, names_of, opened

#: Bytes of text that a task holds before it hands them on.
PIECE = 8 << 20


def known(spark: SparkSession, path: str) -> bool:
    """Whether Arrow opens the file system of a path, and takes no part of the path for something else."""
    if any(c in path for c in "[]{}\\") or (":/" in path and any(c in path for c in "%# ")):
        return False
    if ":/" not in path:
        return (spark._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:").startswith("file:")
    try:
        opened(split(path)[0])
    except (ValueError, OSError, NotImplementedError):
        return False
    return True


def split(path: str) -> tuple[str, list[str]]:
    """The folder before the first * or ? of a path, and the names and patterns from there on."""
    parts = path.rstrip("/").split("/")
    k = next((k for k, p in enumerate(parts) if "*" in p or "?" in p), len(parts))
    return "/".join(parts[:k]) or ("/" if path.startswith("/") else "."), parts[k:]


def matches(system: fs.FileSystem, at: str, names: list[str]) -> list[str]:
    """Paths below a folder by a name or pattern for each level."""
    found = [at]
    for name in names:
        if "*" in name or "?" in name:
            folders = [f.path for f in system.get_file_info(found) if f.type == fs.FileType.Directory]
            found = [f.path for d in folders for f in system.get_file_info(fs.FileSelector(d)) if fnmatchcase(f.base_name, name)]
        else:
            found = [f.path for f in system.get_file_info([f"{d.rstrip('/')}/{name}" for d in found]) if f.type != fs.FileType.NotFound]
    return found


def text_of(content: bytes) -> str:
    """The text of a JSON file in UTF-8, -16 or -32; none if its bytes are no text."""
    try:
        return content.decode(json.detect_encoding(content))
    except UnicodeDecodeError:
        return ""


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of the files under a folder, of one file, or of what a path with * and ? names; hidden ones do not count.

    The driver lists one level only. Tasks list what is below, and the files are dealt to all cores, so that neither the
    layout nor the session's size of a split makes a task of a file or two.
    """
    at, names = split(path)
    system, root = opened(at)
    kind = system.get_file_info(root).type
    if names:
        tops = matches(system, root, names[:1])
    elif kind == fs.FileType.Directory:
        tops = [f.path for f in system.get_file_info(fs.FileSelector(root)) if not f.base_name.startswith(HIDDEN)]
    else:
        tops = [root]
    if kind == fs.FileType.NotFound or (names and not tops):
        raise FileNotFoundError(path)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = opened(at)
        for batch in batches:
            for top in batch["top"].to_pylist():
                files = [name for found in matches(system, top, names[1:]) for name, _ in names_of(system, found)]
                yield pa.record_batch({"file": pa.array(files, pa.string())})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = opened(at)
        for batch in batches:
            files, values, held = [], [], 0
            for name in batch["file"].to_pylist():
                with system.open_input_stream(name) as file:
                    content = file.read()
                files.append(name)
                values.append(text_of(content))
                held += len(content)
                if held >= PIECE:
                    yield pa.record_batch([pa.array(files, pa.string()), pa.array(values, pa.string())], ["file", "value"])
                    files, values, held = [], [], 0
            yield pa.record_batch([pa.array(files, pa.string()), pa.array(values, pa.string())], ["file", "value"])

    below = dealt(spark.createDataFrame(pa.table({"top": pa.array(tops, pa.string())}))).mapInArrow(listed, "file string")
    return dealt(below).mapInArrow(read, "file string, value string")


def write_files(rows: DataFrame, path: str) -> None:
    """rows(file, value): each value as the file of that name below a new path, by the tasks that have the rows.

    A task that is tried again writes its files again.
    """
    system, root = opened(path)
    if system.get_file_info(root).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    system.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(path)
        for batch in batches:
            for name, value in zip(batch["file"].to_pylist(), batch["value"].to_pylist()):
                system.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{root}/{name}") as out:
                    out.write(value.encode())
            yield pa.record_batch({"files": pa.array([batch.num_rows], pa.int64())})

    rows.select("file", "value").mapInArrow(write, "files long").agg(F.sum("files")).collect()
