"""Particle tables stored along a space-filling curve, and region queries that read only what a region needs.

``store`` numbers the cells of a cube of 2^bits cells a side by Morton or Hilbert key, sorts the rows by that key range by
range and writes Parquet, so a row group holds a short stretch of the curve. ``region`` takes a box apart into octants of the
curve (an octant is one range of keys), merges neighbouring ranges and filters by them: the ranges reach Parquet's row-group
and page statistics, and an exact test follows. Rows outside the cube have no key; they are read whenever the region reaches
beyond it. How a table was numbered is kept with its key column.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from math import floor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cells import hilbert, hilbert_steps, morton

KEY = "curve_key"
#: Most ranges of keys that a filter names; a finer cover is cut off there, which costs rows that are read and not kept.
RANGES = 64
#: Rows of a row group, by Parquet's size of a block.
GROUP_BYTES = 1 << 20


@dataclass(frozen=True)
class Curve:
    """A cube at ``low`` with 2^bits cells of ``size`` a side."""

    low: tuple[float, float, float]
    size: float
    bits: int
    kind: str = "hilbert"

    def __post_init__(self):
        if self.kind not in ("hilbert", "morton") or not 1 <= self.bits <= 21 or self.size <= 0:
            raise ValueError("no such curve")

    def with_key(self, df: DataFrame) -> DataFrame:
        """df with the key of each row's cell; null outside the cube."""
        cell = {a: F.floor((F.col(a) - F.lit(float(lo))) / F.lit(float(self.size))).cast("long") for a, lo in zip("xyz", self.low, strict=True)}
        inside = F.lit(True)
        for c in cell.values():
            inside = inside & c.between(0, (1 << self.bits) - 1)
        out = df.withColumns({f"__c{a}": c for a, c in cell.items()} | {"__inside": F.coalesce(inside, F.lit(False))})
        if self.kind == "morton":
            out = out.withColumn("__key", morton(*[F.col(f"__c{a}") for a in "xyz"], self.bits))
        else:
            out = hilbert(out, "__cx", "__cy", "__cz", self.bits, "__key")
        key = F.when(F.col("__inside"), F.col("__key"))
        return out.withColumn(KEY, key).drop("__key", "__inside", "__cx", "__cy", "__cz")

    def cells_of(self, low: tuple, high: tuple) -> tuple[list[int], list[int], bool]:
        """First and last cell per axis that a closed box meets, and whether it reaches beyond the cube."""
        top = (1 << self.bits) - 1
        a, b = ([floor((v - lo) / self.size) for v, lo in zip(corner, self.low, strict=True)] for corner in (low, high))
        beyond = any(x < 0 for x in a) or any(y > top for y in b)
        return [max(x, 0) for x in a], [min(y, top) for y in b], beyond

    def ranges(self, low: tuple, high: tuple, most: int = RANGES) -> list[tuple[int, int]]:
        """Ranges of keys [first, last] that cover the cells of a box. Octants on the box's edge are opened level by level until more
        would take over ``most`` ranges."""
        a, b, _ = self.cells_of(low, high)
        if any(x > y for x, y in zip(a, b, strict=True)):
            return []
        steps = hilbert_steps() if self.kind == "hilbert" else None
        whole: list[tuple[int, int]] = []
        edge = [(0, 0, 0, 0, 0)]  # key so far, state, octant's place at its level
        for level in range(self.bits + 1):
            width = self.bits - level
            shut, ajar = [], []
            for key, state, *at in edge:
                first = [x << width for x in at]
                last = [f + (1 << width) - 1 for f in first]
                if any(la < x or f > y for f, la, x, y in zip(first, last, a, b, strict=True)):
                    continue
                (shut if all(f >= x and la <= y for f, la, x, y in zip(first, last, a, b, strict=True)) else ajar).append((key, state, *at))
            whole += [(key << 3 * width, ((key + 1) << 3 * width) - 1) for key, *_ in shut]
            if not ajar:
                break
            # each open octant may leave up to 8 parts, which merge to 4 ranges at most
            if width == 0 or len(whole) + 4 * len(ajar) > most and level:
                whole += [(key << 3 * width, ((key + 1) << 3 * width) - 1) for key, *_ in ajar]
                break
            edge = []
            for key, state, x, y, z in ajar:
                for octant in range(8):
                    step = steps[state * 8 + octant] if steps else octant
                    edge.append((key * 8 + (step & 7), step >> 3 if steps else 0, 2 * x + (octant & 1), 2 * y + (octant >> 1 & 1), 2 * z + (octant >> 2)))
        out: list[tuple[int, int]] = []
        for first, last in sorted(whole):
            if out and first <= out[-1][1] + 1:
                out[-1] = out[-1][0], max(last, out[-1][1])
            else:
                out.append((first, last))
        return out


def curve_for(low: tuple, high: tuple, cell: float, kind: str = "hilbert") -> Curve:
    """The least cube from ``low`` with cells of this width that holds a box."""
    longest = max(h - a for a, h in zip(low, high, strict=True))
    return Curve(tuple(map(float, low)), float(cell), max(1, min(21, floor(longest / cell).bit_length())), kind)


def store(df: DataFrame, path: str, curve: Curve, group_bytes: int = GROUP_BYTES, files: int | None = None) -> None:
    """Writes the table in order of the curve, in ``files`` parts (or as many as shuffles have)."""
    rows = curve.with_key(df)
    order = F.col(KEY).asc_nulls_first(), F.col("id")
    placed = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    keyed = placed.sortWithinPartitions(*order).withColumn(KEY, F.col(KEY).alias(KEY, metadata={"curve": asdict(curve)}))
    keyed.write.mode("overwrite").option("parquet.block.size", group_bytes).option("parquet.page.size", 1 << 14).parquet(path)


def curve_of(table: DataFrame) -> Curve:
    """How a stored table was numbered."""
    kept = table.schema[KEY].metadata.get("curve")
    if kept is None:
        raise ValueError("the table has no curve")
    return Curve(tuple(kept["low"]), kept["size"], kept["bits"], kept["kind"])


def between_keys(curve: Curve, low: tuple, high: tuple, most: int = RANGES) -> Column:
    """A condition on the key alone that every row of the closed box meets."""
    test = F.lit(False)
    for first, last in curve.ranges(low, high, most):
        test = test | ((F.col(KEY) >= first) & (F.col(KEY) <= last))
    return test | F.col(KEY).isNull() if curve.cells_of(low, high)[2] else test


def region(spark: SparkSession, path: str, low: tuple, high: tuple, most: int = RANGES) -> DataFrame:
    """The rows of a stored table in a closed box, whatever their state."""
    table = spark.read.parquet(path)
    test = between_keys(curve_of(table), low, high, most)
    for a, lo, hi in zip("xyz", low, high, strict=True):
        test = test & F.col(a).between(float(lo), float(hi))
    return table.filter(test).drop(KEY)
