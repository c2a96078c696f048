"""Cells, bins and space-filling curves."""

from __future__ import annotations

from functools import cache
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def cell_index(df: DataFrame, low: dict[str, float], size: float, counts: dict[str, int]) -> DataFrame:
    """cx, cy, cz and the flat index; -1 outside (the upper faces are outside)."""
    cell = {a: F.floor((F.col(a) - F.lit(low[a])) / F.lit(size)).cast("long") for a in "xyz"}
    inside = F.lit(True)
    for a in "xyz":
        inside = inside & cell[a].between(0, counts[a] - 1)
    flat = cell["z"] * counts["x"] * counts["y"] + cell["y"] * counts["x"] + cell["x"]
    return df.withColumns({f"c{a}": cell[a] for a in "xyz"} | {"cell": F.when(inside, flat).otherwise(F.lit(-1))})


#: Cells per cutoff of the named strategies.
STRATEGIES = {"cutoff": 1.0, "half": 0.5, "third": 1 / 3}


def cell_width(reach: float, strategy: str | tuple[str, float] = "cutoff") -> float:
    """``cutoff``, ``half`` or ``third`` of the reach, or ("factor", f) of it, or ("absolute", width)."""
    if isinstance(strategy, str):
        return reach * STRATEGIES[strategy]
    kind, value = strategy
    if value <= 0:
        raise ValueError("a cell has a positive width")
    return {"factor": reach * value, "absolute": value}[kind]


def grid_size(extent: tuple[float, float, float], reach: float, strategy: str | tuple[str, float] = "cutoff", skin: float = 0.0) -> tuple[tuple[int, int, int], tuple[float, float, float]]:
    """Cells per axis and their stretched widths: the reach is at most half the least extent that is not 0, and an axis has two cells or more."""
    some = [e for e in extent if e > 0]
    reach = min(reach, min(some) / 2) if some else reach
    target = cell_width(reach, strategy) + skin
    counts = tuple(max(2, floor(e / target)) for e in extent)
    return counts, tuple(e / n for e, n in zip(extent, counts, strict=True))


def grid_sizes(grids: DataFrame, strategies: dict[str, str | tuple[str, float]]) -> DataFrame:
    """A table of grids (ex, ey, ez, reach, skin) with a row for each strategy: its name and ``grid_size``'s cells nx, ny, nz."""
    some = F.least(*[F.when(F.col(f"e{a}") > 0, F.col(f"e{a}")) for a in "xyz"])
    reach = F.when(some.isNotNull(), F.least(F.col("reach"), some / 2)).otherwise(F.col("reach"))
    # the width is linear in the reach: what it is for a reach of 0, and how much it grows
    plans = F.array(*[F.struct(F.lit(n).alias("strategy"), F.lit(cell_width(0.0, s)).alias("base"), F.lit(cell_width(1.0, s) - cell_width(0.0, s)).alias("slope")) for n, s in strategies.items()])
    rows = grids.select("*", reach.alias("__reach"), F.inline(plans))
    width = F.col("base") + F.col("slope") * F.col("__reach") + F.col("skin")
    return rows.withColumns({f"n{a}": F.greatest(F.lit(2), F.floor(F.col(f"e{a}") / width)).cast("int") for a in "xyz"}).drop("base", "slope", "__reach")


def reordered(df: DataFrame, bin_: Column) -> DataFrame:
    """The rows in order of a bin number, stored range by range, so that rows of one bin lie together."""
    return df.repartitionByRange(bin_).sortWithinPartitions(bin_, "id")


def region_by_cells(df: DataFrame, low: dict[str, float], size: float, counts: dict[str, int], region: tuple[tuple, tuple]) -> DataFrame:
    """Rows of ``cell_index`` in the cells that a region overlaps, and outside the grid where the region reaches beyond it: what
    a table kept by cell need read before the exact test."""
    lo, hi = (dict(zip("xyz", corner, strict=True)) for corner in region)
    test = F.lit(True)
    for a in "xyz":
        test = test & F.col(f"c{a}").between(floor((lo[a] - low[a]) / size), floor((hi[a] - low[a]) / size))
    beyond = any(lo[a] < low[a] or hi[a] >= low[a] + size * counts[a] for a in "xyz")
    return df.filter((test | (F.col("cell") == -1)) if beyond else (test & (F.col("cell") >= 0)))


def histogram(df: DataFrame) -> DataFrame:
    return df.groupBy("cell", "type").count()


def prefix_sums(counts: DataFrame) -> DataFrame:
    """Exclusive running count by cell. Cells are sorted range by range; sums run inside a range, and only the ranges' totals, one row
    each, are gathered."""
    per = counts.groupBy("cell").agg(F.sum("count").alias("n"))
    placed = cut(per.repartitionByRange("cell").withColumn("__range", F.spark_partition_id()))
    totals = {r["__range"]: r["n"] for r in placed.groupBy("__range").agg(F.sum("n").alias("n")).collect()}
    starts, total = [], 0
    for k in sorted(totals):
        starts, total = [*starts, F.lit(k), F.lit(total)], total + totals[k]
    before = Window.partitionBy("__range").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    first = F.element_at(F.create_map(*starts), F.col("__range")).cast("long") if starts else F.lit(0).cast("long")
    return placed.withColumn("start", first + F.coalesce(F.sum("n").over(before), F.lit(0))).drop("__range")


def morton(x: Column, y: Column, z: Column, bits: int = 21) -> Column:
    """Interleaved bits, x lowest."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for i, c in enumerate((x, y, z)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1).cast("long")), 3 * b + i))
    return out


@cache
def hilbert_steps() -> tuple[int, ...]:
    """One step down the curve, by (state * 8 + octant): next state * 8 + digit.

    A state says how the axes of the current octant stand (a permutation with flips) and whether an odd number of ones has
    gone into the Gray code so far. Going down, each axis in turn flips the first one where the point lies in its upper
    half, and else changes places with it. States are found from the upright one on.
    """
    upright = ((0, False), (1, False), (2, False)), 0
    number, queue, out = {upright: 0}, [upright], []
    for axes, odd in queue:
        for octant in range(8):
            bits = [(octant >> source & 1) ^ flipped for source, flipped in axes]
            below = list(axes)
            for d, upper in enumerate(bits):
                if upper:
                    below[0] = below[0][0], not below[0][1]
                else:
                    below[0], below[d] = below[d], below[0]
            digit, last = 0, odd
            for b in bits:
                last ^= b
                digit = digit * 2 + last
            state = tuple(below), int(last)
            if state not in number:
                number[state] = len(number)
                queue.append(state)
            out.append(number[state] * 8 + digit)
    return tuple(out)


def hilbert(df: DataFrame, x: str, y: str, z: str, bits: int, name: str = "key") -> DataFrame:
    """df with the place of (x, y, z) on the Hilbert curve of 2^bits cells a side; one projection a bit plane."""
    if 3 * bits > 64:
        raise ValueError("too many bits")
    table = F.array(*map(F.lit, hilbert_steps()))
    out = df.select("*", F.lit(0).cast("long").alias("__key"), F.lit(0).alias("__state"))
    for b in range(bits - 1, -1, -1):
        bit = lambda c, at, b=b: F.shiftleft(F.shiftright(F.col(c), b).bitwiseAND(F.lit(1)).cast("int"), at)
        octant = bit(x, 0).bitwiseOR(bit(y, 1)).bitwiseOR(bit(z, 2))
        out = out.withColumn("__step", F.get(table, F.col("__state") * 8 + octant))
        out = out.withColumns({"__key": F.col("__key") * 8 + F.col("__step").bitwiseAND(F.lit(7)), "__state": F.shiftright("__step", 3)})
    return out.withColumnRenamed("__key", name).drop("__state", "__step")
