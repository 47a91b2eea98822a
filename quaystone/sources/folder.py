"""A folder of messages and documents as a source of Spark.

spark.read.format("folder") scans all files below a folder, readStream follows
it, and named() opens just the files that rows ask for. Paths are relative to
the folder, as messages name them. Files are reached by pyarrow's file systems
(local, HDFS, S3, GCS), so by executors wherever the folder is.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

SCHEMA = "path string, format string, length long, modified timestamp, content binary"
_ARROW = pa.schema([("path", pa.string()), ("format", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("content", pa.binary())])
#: Bytes of the files of a partition, of a batch, and of the largest file whose content is read.
PARTITION = 64 << 20
BATCH = 8 << 20
LARGEST = 256 << 20
#: Seconds a file must have lain before a stream takes it, so that none of the same instant is passed over.
SETTLE = 2.0


def _reached(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and its path there."""
    if "://" not in folder and folder.startswith("file:"):
        folder = folder.removeprefix("file:")
    if "://" not in folder:
        return fs.LocalFileSystem(), os.path.abspath(folder)
    system, root = fs.FileSystem.from_uri(folder)
    return system, root.rstrip("/")


def _format(path: str) -> str:
    return path.rpartition("/")[2].rpartition(".")[2].lower()


def _listed(folder: str) -> list[tuple[str, int, int]]:
    """(path, length, time in ns) of every file below the folder, by path;
    names that begin with a dot or underscore are being written."""
    system, root = _reached(folder)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    rows = [(x.path[len(root) :].lstrip("/"), x.size, x.mtime_ns) for x in found if x.type == fs.FileType.File]
    return sorted(x for x in rows if not any(part[:1] in "._" for part in x[0].split("/")))


class Files(InputPartition):
    """Some files of a folder."""

    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


def _dealt(files: list[tuple[str, int, int]], size: int) -> list[Files]:
    """Files in order, as many a partition as size holds, one at least."""
    out: list[Files] = []
    held = 0
    for file in files:
        if not out or held + file[1] > size:
            out.append(Files([]))
            held = 0
        out[-1].files.append(file)
        held += file[1]
    return out


def _content(system: fs.FileSystem, at: str, length: int, largest: int) -> bytes | None:
    """Null for a file that is too large, or gone since it was listed."""
    if length > largest:
        return None
    try:
        with system.open_input_stream(at) as f:
            return f.read()
    except FileNotFoundError:
        return None


def _read(folder: str, files: list[tuple[str, int, int]], largest: int) -> Iterator[pa.RecordBatch]:
    system, root = _reached(folder)
    rows, held = [], 0
    for path, length, at in files:
        rows.append((path, _format(path), length, datetime.fromtimestamp(at / 1e9, timezone.utc), _content(system, f"{root}/{path}", length, largest)))
        held += length
        if held >= BATCH:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class FolderReader(DataSourceReader):
    """One partition for every so many bytes of files. Conditions on path that
    are pushed here leave other files unopened."""

    def __init__(self, options: dict):
        self.folder, self.size, self.largest = options["path"], int(options.get("partition", PARTITION)), int(options.get("largest", LARGEST))
        self.wanted: list[Callable[[str], bool]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) in (("path",), ("format",)):
                of = (lambda path: path) if f.attribute == ("path",) else _format
                if isinstance(f, EqualTo):
                    self.wanted.append(lambda path, v=f.value, of=of: of(path) == v)
                    continue
                if isinstance(f, In):
                    self.wanted.append(lambda path, v=frozenset(f.value), of=of: of(path) in v)
                    continue
                if isinstance(f, StringStartsWith):
                    self.wanted.append(lambda path, v=f.value, of=of: of(path).startswith(v))
                    continue
                if isinstance(f, StringEndsWith):
                    self.wanted.append(lambda path, v=f.value, of=of: of(path).endswith(v))
                    continue
            yield f

    def partitions(self) -> list[InputPartition]:
        return _dealt([x for x in _listed(self.folder) if all(holds(x[0]) for holds in self.wanted)], self.size) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _read(self.folder, partition.files, self.largest)


class FolderStream(DataSourceStreamReader):
    """Files in order of time and path, each once; the offset is the last one
    taken. A file that is written under a time before that is not seen: move
    finished files into the folder."""

    def __init__(self, options: dict):
        self.folder, self.size, self.largest = options["path"], int(options.get("partition", PARTITION)), int(options.get("largest", LARGEST))
        self.settle = float(options.get("settle", SETTLE))

    def initialOffset(self) -> dict:
        return {"at": 0, "path": ""}

    def latestOffset(self) -> dict:
        settled = int((time.time() - self.settle) * 1e9)
        at, path = max(((t, p) for p, _, t in _listed(self.folder) if t <= settled), default=(0, ""))
        return {"at": at, "path": path}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, upto = (start["at"], start["path"]), (end["at"], end["path"])
        return _dealt([x for x in _listed(self.folder) if after < (x[2], x[0]) <= upto], self.size)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _read(self.folder, partition.files, self.largest)

    def commit(self, end: dict) -> None:
        pass


class FolderSource(DataSource):
    """Options: path; partition (bytes), largest (bytes), settle (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FolderStream(dict(self.options))


def scanned(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """Every file below the folder: SCHEMA. Only with Spark's setting
    spark.sql.python.filterPushdown.enabled do conditions on path and format
    keep other files from being opened."""
    spark.dataSource.register(FolderSource)
    return spark.read.format("folder").options(**options).load(folder)


def followed(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """The files that come into the folder, as a stream: SCHEMA."""
    spark.dataSource.register(FolderSource)
    return spark.readStream.format("folder").options(**options).load(folder)


def named(folder: str, largest: int = LARGEST) -> Callable[[DataFrame], DataFrame]:
    """A function from rows (path) to rows (path, content), one a path, that
    opens those files below the folder and no other: content is null where no
    such file is, it is too large, or the path leads out of the folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _reached(folder)
        for batch in batches:
            rows, held = [], 0
            for path in batch["path"].to_pylist():
                inside = path and ".." not in path.split("/") and not path.startswith("/")
                info = system.get_file_info(f"{root}/{path}") if inside else None
                there = info is not None and info.type == fs.FileType.File
                rows.append((path, _content(system, info.path, info.size, largest) if there else None))
                held += info.size if there else 0
                if held >= BATCH:
                    yield _named(rows)
                    rows, held = [], 0
            if rows:
                yield _named(rows)

    return lambda paths: paths.select("path").where("path is not null").distinct().mapInArrow(run, "path string, content binary")


def _named(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([p for p, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.binary())], ["path", "content"])


