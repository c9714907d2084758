"""Manifests as a data source: spark.read.format("manifest") and df.write.format("manifest")."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from scribe.functions.text import sanitise_label

HEADER = "# path<TAB>label\n"
SPLIT = 64 << 20
#: Splits smaller than SPLIT grow with the table beyond so many: a task costs more than reading a few kilobytes.
SPLITS = 256
HIDDEN = ("_", ".")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def names_of(system: fs.FileSystem, root: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files under a folder, or of the one file; those in hidden folders do not count."""
    info = system.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    shown = lambda f: not any(p.startswith(HIDDEN) for p in f.path[len(root.rstrip("/")) :].split("/") if p)
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and shown(f))


def lines_from(file, start: int) -> Iterator[tuple[int, bytes]]:
    """(where it begins, line) of the lines that begin at `start` or behind it, read in pieces."""
    at, rest = max(0, start - 1), b""
    file.seek(at)
    skip = start > 0  # the line that holds the byte before belongs to the split before
    while True:
        piece = file.read(1 << 16)
        *rows, rest = (rest + piece).split(b"\n")
        rows = [r + b"\n" for r in rows] if piece else [rest] if rest else []
        for raw in rows:
            if not skip:
                yield at, raw
            skip, at = False, at + len(raw)
        if not piece:
            return


@dataclass
class Split(InputPartition):
    """Lines that begin in [start, end) of a file."""

    file: str
    start: int
    end: int


class ManifestReader(DataSourceReader):
    """Files in splits; filters on `file` leave files out, the beginning of `path` leaves lines out before they are sent."""

    def __init__(self, options: dict):
        self.root, self.strict = options["path"], options.get("mode", "strict") != "permissive"
        self.split, self.files, self.begins = int(options.get("split", SPLIT)), None, ""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("file",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.files = wanted if self.files is None else self.files & wanted
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",) and not self.begins:
                self.begins = f.value
            else:
                yield f

    def partitions(self) -> list[Split]:
        system, root = opened(self.root)
        chosen = [(f, n) for f, n in names_of(system, root) if self.files is None or f in self.files]
        split = max(self.split, min(SPLIT, sum(n for _, n in chosen) // SPLITS))
        return [Split(f, at, min(n, at + split)) for f, n in chosen for at in range(0, n, split)] or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator[tuple]:
        if not partition.file:
            return
        system, _ = opened(self.root)
        with system.open_input_file(partition.file) as file:
            for at, raw in lines_from(file, partition.start):
                if at >= partition.end:
                    break
                line = raw.decode().rstrip("\r\n")
                if line.strip() and not line.lstrip().startswith("#"):
                    path, tab, label = (x.strip(" ") for x in line.partition("\t"))
                    if tab and path and label:
                        if path.startswith(self.begins):
                            yield partition.file, path, label, None
                    elif self.strict:
                        raise ValueError(f"{partition.file}:{self.number(system, partition.file, at)}: no path, tab and label in {line!r}")
                    elif not self.begins:
                        yield partition.file, None, None, line

    @staticmethod
    def number(system: fs.FileSystem, name: str, at: int) -> int:
        """The number of the line that begins at a byte; only malformed lines ask for it."""
        lines = 1
        with system.open_input_file(name) as file:
            while at > 0:
                part = file.read(min(at, 1 << 20))
                lines, at = lines + part.count(b"\n"), at - len(part)
        return lines


@dataclass
class Written(WriterCommitMessage):
    file: str


class ManifestWriter(DataSourceWriter):
    """Each task writes a file in a hidden folder; the commit moves all files to their place, an abort removes the folder."""

    def __init__(self, options: dict, overwrite: bool):
        self.root, self.overwrite, self.folder = options["path"], overwrite, f"_writing-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        system, root = opened(self.root)
        system.create_dir(f"{root}/{self.folder}", recursive=True)
        name = f"part-{uuid.uuid4().hex}.txt"
        with system.open_output_stream(f"{root}/{self.folder}/{name}") as out:
            out.write(HEADER.encode())
            for row in rows:
                path, label = row["path"], row["label"]
                if not path or not label or "\t" in path or any(c in f"{path}{label}" for c in "\r\n"):
                    raise ValueError(f"not a row of a manifest: {path!r}, {label!r}")
                out.write(f"{path}\t{label}\n".encode())
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.root)
        before = names_of(system, root) if self.overwrite else []
        for m in messages:
            if m:
                system.move(f"{root}/{self.folder}/{m.file}", f"{root}/{m.file}")
        for name, _ in before:
            system.delete_file(name)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = opened(self.root)
        if system.get_file_info(f"{root}/{self.folder}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.folder}")


class ManifestSource(DataSource):
    """Columns file, path, label, and malformed, which has the lines without path, tab and label in mode "permissive".

    In the other mode, "strict", such a line is an error that names file and line. `split` is the least size of a
    split in bytes; splits grow with the table where there would be too many.
    """

    @classmethod
    def name(cls) -> str:
        return "manifest"

    def schema(self) -> str:
        return "file string, path string, label string, malformed string"

    def reader(self, schema) -> ManifestReader:
        return ManifestReader(self.options)

    def writer(self, schema, overwrite: bool) -> ManifestWriter:
        return ManifestWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets filters reach it."""
    spark.dataSource.register(ManifestSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_rows(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """rows(path, label) as a manifest: paths with slashes, labels on one line."""
    clean = rows.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), sanitise_label(F.col("label"), strict=True).alias("label"))
    register(rows.sparkSession)
    empty = F.lit(None).cast("string")
    clean.select(empty.alias("file"), "path", "label", empty.alias("malformed")).write.format("manifest").mode(mode).save(path)
