"""Binary snapshots as a data source: ``spark.read.format("particles").load(path)`` and ``df.write.format("particles")``.

A snapshot is a file, or a folder of parts that are snapshots themselves. All rows have the same length, so a file is read
in ranges of rows, a partition each, and only the headers are looked at where the query is planned. When writing, each task
writes its rows to a part of its own; the parts take their names when all tasks are done, and those of a failed job are
removed. The header's count is filled in when the last row of the part is known. Paths may be of any file system that
pyarrow opens, and must be seen by all executors.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import ship

#: Header (magic, version, step, count, flags) and row of the binary snapshot, little-endian and packed.
HEADER, MAGIC, VERSION = struct.Struct("<4sIQQI"), b"PART", 1
ROW = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("type", "<u4"), ("id", "<u4"), ("state", "u1")])
SCHEMA = "step long, x double, y double, z double, type int, id long, state int"
COLUMNS = ("x", "y", "z", "type", "id", "state")
#: Rows of a partition, and of a batch on its way to Spark.
SPLIT, BATCH = 4_000_000, 65_536


class SnapshotError(ValueError):
    """A file that is no particle snapshot, or one that ends before its last row."""


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    where, name = _opened(path)
    prefix = path[: len(path) - len(name)] if path.endswith(name) else ""
    info = where.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    found = where.get_file_info(fs.FileSelector(name))
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def header(path: str) -> tuple[int, int]:
    """(step, rows) of a snapshot file."""
    where, name = _opened(path)
    with where.open_input_file(name) as f:
        raw, size = f.read(HEADER.size), f.size()
    if len(raw) < HEADER.size or raw[:4] != MAGIC:
        raise SnapshotError(f"{path} is no particle snapshot")
    _, version, step, n, _ = HEADER.unpack(raw)
    if version != VERSION or size < HEADER.size + n * ROW.itemsize:
        raise SnapshotError(f"{path} has another version, or ends before its last row")
    return step, n


@dataclass
class Rows(InputPartition):
    """Rows [start, stop) of a file."""

    path: str
    step: int
    start: int
    stop: int


class SnapshotReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Rows]:
        out = []
        for f in _files(self.path):
            step, n = header(f)
            out += [Rows(f, step, a, min(n, a + self.split)) for a in range(0, n, self.split)]
        return out or [Rows("", 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        where, name = _opened(partition.path)
        with where.open_input_file(name) as f:
            for a in range(partition.start, partition.stop, BATCH):
                n = min(BATCH, partition.stop - a)
                rows = np.frombuffer(f.read_at(n * ROW.itemsize, HEADER.size + a * ROW.itemsize), ROW)
                kinds = {"type": np.int32, "id": np.int64, "state": np.int32}
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, partition.step, np.int64)), *[pa.array(rows[c].astype(kinds.get(c, np.float64))) for c in COLUMNS]], ["step", *COLUMNS])


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


class SnapshotWriter(DataSourceArrowWriter):
    def __init__(self, path: str, step: int, overwrite: bool):
        self.path, self.step, self.overwrite, self.job = path, step, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        where, folder = _opened(self.path)
        where.create_dir(folder)
        task = TaskContext.get()
        name, n, chunks = f"_{self.job}-{task.partitionId():05}-{task.taskAttemptId()}", 0, 0
        body = f"{folder}/{name}.rows"
        with where.open_output_stream(body) as out:
            for batch in iterator:
                rows = np.zeros(batch.num_rows, ROW)
                for c in COLUMNS:
                    rows[c] = batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                out.write(rows.tobytes())
                n += len(rows)
        # streams only go forward, so the part is the header and then its rows
        with where.open_output_stream(f"{folder}/{name}") as out, where.open_input_stream(body) as rows:
            out.write(HEADER.pack(MAGIC, VERSION, self.step, n, 0))
            while chunk := rows.read(1 << 22):
                out.write(chunk)
                chunks += 1
        where.delete_file(body)
        return Part(name, n)

    def commit(self, messages: list[Part | None]) -> None:
        where, folder = _opened(self.path)
        parts = [m for m in messages if m is not None]
        if self.overwrite:
            for f in where.get_file_info(fs.FileSelector(folder)):
                if f.type == fs.FileType.File and not f.base_name.startswith("_"):
                    where.delete_file(f.path)
        for i, m in enumerate(sorted(parts, key=lambda m: m.name)):
            if m.rows or not i:
                where.move(f"{folder}/{m.name}", f"{folder}/part-{self.job[:8]}-{i:05}.bin")
        self._clear(where, folder)

    def abort(self, messages: list[Part | None]) -> None:
        where, folder = _opened(self.path)
        if where.get_file_info(folder).type == fs.FileType.Directory:
            self._clear(where, folder)

    def _clear(self, where: fs.FileSystem, folder: str) -> None:
        """Parts of attempts that came to nothing."""
        for f in where.get_file_info(fs.FileSelector(folder)):
            if f.base_name.startswith(f"_{self.job}"):
                where.delete_file(f.path)


class Snapshots(DataSource):
    """Options: ``step`` for writing, ``rows`` of a partition for reading."""

    @classmethod
    def name(cls) -> str:
        return "particles"

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        if not self.options.get("path"):
            raise SnapshotError("a snapshot needs a path")
        return self.options["path"].rstrip("/")

    def reader(self, schema: StructType) -> SnapshotReader:
        return SnapshotReader(self._path(), int(self.options.get("rows", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> SnapshotWriter:
        if missing := set(COLUMNS) - set(schema.names):
            raise SnapshotError(f"a snapshot has the columns {sorted(missing)}")
        return SnapshotWriter(self._path(), int(self.options.get("step", 0)), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    ship(spark).dataSource.register(Snapshots)


def write_snapshot(df: DataFrame, path: str, step: int, mode: str = "overwrite", parts: int | None = None) -> None:
    """The particles by id, a part for each range of ids."""
    register(df.sparkSession)
    rows = df.select(*COLUMNS)
    rows = rows.repartitionByRange(parts, "id") if parts else rows.repartitionByRange("id")
    rows.sortWithinPartitions("id").write.format("particles").option("step", step).mode(mode).save(path)


def read_snapshot(spark: SparkSession, path: str, rows: int = SPLIT) -> DataFrame:
    """(step, x, y, z, type, id, state) of a snapshot file or folder."""
    register(spark)
    return spark.read.format("particles").option("rows", rows).load(path)
