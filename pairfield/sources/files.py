"""Frames of a run for viewers and for going on: Parquet by step, XYZ text, VTK PolyData; binary ones are in ``snapshots``.

Frames are written by the executors, in parts whose names are in the order of the rows. An XYZ frame is a folder of text
parts that make the frame when they are put together by name; a VTK frame is a small master file and pieces that viewers
read together.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from contextlib import contextmanager
from math import ceil
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .snapshots import _opened

#: Most rows of a piece of a frame.
PIECE_ROWS = 1_000_000


def _number(v: float) -> str:
    return f"{v:.17g}"


def xyz_lines(df: DataFrame) -> DataFrame:
    """(id, value): the line of each particle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, t, x, y, z = (c.to_pylist() for c in batch.columns)
            lines = [f"T{b} {_number(c)} {_number(d)} {_number(e)}" for b, c, d, e in zip(t, x, y, z, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.string())], ["id", "value"])

    ship(df.sparkSession)
    return df.select(F.col("id").cast("long"), F.col("type").cast("int"), *[F.col(a).cast("double") for a in "xyz"]).mapInArrow(run, "id long, value string")


def write_xyz(df: DataFrame, folder: str, step: int, time: float) -> str:
    """A frame: the count, the clock, then a line per particle by id. Its parts, in order of their names, are the frame's text."""
    to = f"{folder}/step={step:05}"
    head = df.agg(F.count("*").alias("n")).select(F.lit(None).cast("long").alias("id"), F.array(F.col("n").cast("string"), F.lit(f"step={step} time={_number(time)}")).alias("lines"))
    head = head.select("id", F.posexplode("lines").alias("place", "value"))
    rows = head.unionByName(xyz_lines(df).withColumn("place", F.lit(0)))
    rows.repartitionByRange(F.col("id").asc_nulls_first(), "place").sortWithinPartitions(F.col("id").asc_nulls_first(), "place").select("value").write.mode("overwrite").text(to)
    return to


class XMLWriter:
    """Elements with attributes, indented, texts escaped; ``with`` closes what it opens."""

    def __init__(self, out):
        self.out, self.depth = out, 0
        out.write('<?xml version="1.0"?>\n')

    def _line(self, text: str) -> None:
        self.out.write(f"{'  ' * self.depth}{text}\n")

    @staticmethod
    def _head(name: str, attributes: dict) -> str:
        return name + "".join(f" {k}={quoteattr(str(v))}" for k, v in attributes.items())

    @contextmanager
    def element(self, name: str, **attributes) -> Iterator[None]:
        self._line(f"<{self._head(name, attributes)}>")
        self.depth += 1
        yield
        self.depth -= 1
        self._line(f"</{name}>")

    def empty(self, name: str, **attributes) -> None:
        self._line(f"<{self._head(name, attributes)}/>")

    def text(self, text: str) -> None:
        self.out.write(f"{escape(text)}\n")


#: Point data by field name, as (VTK type, columns).
VTP_FIELDS = {"velocity": ("Float64", ("vx", "vy", "vz")), "force": ("Float64", ("fx", "fy", "fz")), "type": ("Int32", ("type",)), "id": ("Int64", ("id",))}


def _piece(out, table: dict[str, list], fields: tuple[str, ...]) -> None:
    """One PolyData file: the chosen fields, positions, and a vertex cell for each row."""
    n, xml = len(table["x"]), XMLWriter(out)

    def array(name: str, kind: str, lines, width: int = 1) -> None:
        with xml.element("DataArray", type=kind, Name=name, NumberOfComponents=width, format="ascii"):
            for line in lines:
                xml.text(line)

    def rows(kind: str, columns: tuple[str, ...]):
        for values in zip(*[table[c] for c in columns], strict=True):
            yield " ".join(_number(v) if kind == "Float64" else str(v) for v in values)

    with xml.element("VTKFile", type="PolyData", version="0.1", byte_order="LittleEndian"), xml.element("PolyData"):
        with xml.element("Piece", NumberOfPoints=n, NumberOfVerts=n, NumberOfLines=0, NumberOfStrips=0, NumberOfPolys=0):
            with xml.element("PointData"):
                for name in fields:
                    kind, columns = VTP_FIELDS[name]
                    array(name, kind, rows(kind, columns), len(columns))
            with xml.element("Points"):
                array("Points", "Float64", rows("Float64", ("x", "y", "z")), 3)
            with xml.element("Verts"):
                array("connectivity", "Int64", map(str, range(n)))
                array("offsets", "Int64", map(str, range(1, n + 1)))


def write_vtp(df: DataFrame, folder: str, base: str, step: int, fields: tuple[str, ...] = ("velocity", "force", "type", "id"), rows: int = PIECE_ROWS) -> str:
    """A frame of PolyData pieces, rows by id: tasks write a piece each, of about ``rows`` rows, and the driver the list of them.
    Positions are always there."""
    name, spark = f"{base}_{step:05}", df.sparkSession
    wanted = tuple(dict.fromkeys(c for f in fields for c in VTP_FIELDS[f][1]))
    columns = tuple(dict.fromkeys((*wanted, "x", "y", "z")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = list(batches)  # a piece is as large as its rows allow
        if not held:
            return
        got = pa.Table.from_batches(held)
        where, to = _opened(f"{folder}/{name}")
        where.create_dir(to)
        task, text = TaskContext.get(), io.StringIO()
        _piece(text, {c: got.column(c).to_pylist() for c in columns}, fields)
        piece = f"piece-{task.partitionId():05}.vtp"
        # a second attempt of a task writes the same rows under the same name
        with where.open_output_stream(f"{to}/_{task.taskAttemptId()}") as out:
            out.write(text.getvalue().encode())
        where.move(f"{to}/_{task.taskAttemptId()}", f"{to}/{piece}")
        yield pa.RecordBatch.from_arrays([pa.array([piece])], ["piece"])

    parts = max(1, ceil(df.count() / rows))
    ship(spark)
    placed = df.select("id", *[c for c in columns if c != "id"]).repartitionByRange(parts, "id").sortWithinPartitions("id")
    pieces = sorted(r["piece"] for r in placed.mapInArrow(run, "piece string").collect())  # one row a piece
    where, to = _opened(f"{folder}/{name}.pvtp")
    text = io.StringIO()
    xml = XMLWriter(text)
    with xml.element("VTKFile", type="PPolyData", version="0.1", byte_order="LittleEndian"), xml.element("PPolyData", GhostLevel=0):
        with xml.element("PPointData"):
            for f in fields:
                xml.empty("PDataArray", type=VTP_FIELDS[f][0], Name=f, NumberOfComponents=len(VTP_FIELDS[f][1]))
        with xml.element("PPoints"):
            xml.empty("PDataArray", type="Float64", Name="Points", NumberOfComponents=3)
        for piece in pieces:
            xml.empty("Piece", Source=f"{name}/{piece}")
    with where.open_output_stream(to) as out:
        out.write(text.getvalue().encode())
    return f"{folder}/{name}.pvtp"


def write_pvd(folder: str, base: str, frames: list[tuple[float, str]]) -> str:
    """The collection that names a run's frames with their times, one line a frame."""
    text = io.StringIO()
    xml = XMLWriter(text)
    with xml.element("VTKFile", type="Collection", version="0.1"), xml.element("Collection"):
        for t, path in frames:
            xml.empty("DataSet", timestep=_number(t), file=Path(path).name)
    where, to = _opened(f"{folder}/{base}.pvd")
    with where.open_output_stream(to) as out:
        out.write(text.getvalue().encode())
    return f"{folder}/{base}.pvd"


def write_parquet(df: DataFrame, folder: str, step: int, time: float) -> str:
    """A frame as a Parquet partition step=..., written by the executors."""
    to = f"{folder}/step={step}"
    df.withColumn("time", F.lit(float(time))).write.mode("overwrite").parquet(to)
    return to


def read_parquet(spark: SparkSession, folder: str, step: int | None = None) -> DataFrame:
    """All frames of a folder, or one to start from: positions, velocities, old positions and forces as they were."""
    return spark.read.parquet(folder) if step is None else spark.read.parquet(f"{folder}/step={step}").drop("time")


def colour_range(df: DataFrame) -> DataFrame:
    """Types scaled to 0..1 for a viewer; a single type is 0."""
    ends = df.agg(F.min("type").alias("lo"), F.max("type").alias("hi"))
    return df.join(F.broadcast(ends)).withColumn("shade", (F.col("type") - F.col("lo")) / F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.col("hi") - F.col("lo"))).drop("lo", "hi")
