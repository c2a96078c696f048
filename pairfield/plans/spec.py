"""The declarative side: validation, id and type maps, and the domain of a particle table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


class SpecError(ValueError):
    """A declaration that no system can be built from."""


def validate(df: DataFrame) -> None:
    """Raises for repeated ids, masses that are not positive, and states that are empty, invalid or unknown."""
    if not df.filter("id is not null").groupBy("id").count().filter("count > 1").limit(1).isEmpty():
        raise SpecError("an id occurs twice")
    bad = df.agg(F.count_if(~(F.col("mass") > 0)).alias("mass"), F.count_if((F.col("state") <= 0) | (F.col("state").cast("int").bitwiseAND(F.lit(~15)) != 0)).alias("state")).first()
    if bad["mass"]:
        raise SpecError("a mass is not positive")
    if bad["state"]:
        raise SpecError("a state is empty, invalid or unknown")


def ranked(df: DataFrame, name: str, *order) -> DataFrame:
    """df with a row number from 0 in this order. Rows are sorted range by range, and only the ranges' counts are gathered, so no task sees all rows."""
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("__range"), within.alias("__at")))
    counts = {r["__range"]: r["count"] for r in placed.groupBy("__range").count().collect()}  # one row a range
    starts, total = {}, 0
    for k in sorted(counts):
        starts[k], total = total, total + counts[k]
    start = F.lit(0).cast("long") if not starts else F.element_at(F.create_map(*[F.lit(x) for k, v in starts.items() for x in (k, v)]), F.col("__range")).cast("long")
    return placed.withColumn(name, start + F.col("__at")).drop("__range", "__at")


def check_bonds(df: DataFrame, bonds: DataFrame) -> None:
    """Raises for bonds whose ends are no particles, or the same one."""
    ends = bonds.select(F.col("src").alias("id")).union(bonds.select("dst")).distinct()
    if not ends.join(df.select("id"), "id", "left_anti").limit(1).isEmpty():
        raise SpecError("a bond names an unknown id")
    if not bonds.filter("src = dst").limit(1).isEmpty():
        raise SpecError("a bond joins a particle to itself")


def assign_ids(df: DataFrame, order: str) -> DataFrame:
    """Missing ids, in input order, get the least unused ids: the k-th gap gets the k-th unused number."""
    missing = ranked(df.filter("id is null"), "__k", order)
    used = df.filter("id is not null").select("id")
    n = missing.count()
    free = ranked(df.sparkSession.range(n + used.count()).join(used, "id", "left_anti"), "__k", "id").filter(F.col("__k") < n)
    filled = missing.drop("id").join(free, "__k").drop("__k").select(*df.columns)
    return df.filter("id is not null").unionByName(filled)


def type_map(df: DataFrame) -> DataFrame:
    return df.select(F.col("type").alias("user_type")).distinct().withColumn("type", F.dense_rank().over(Window.orderBy("user_type")) - 1)


def id_map(df: DataFrame, bonds: DataFrame) -> DataFrame:
    """Dense ids: ids with bonds first, ascending in each group."""
    bonded = bonds.select(F.col("src").alias("b")).union(bonds.select("dst")).distinct()
    ids = df.select(F.col("id").alias("user_id")).join(bonded, F.col("user_id") == F.col("b"), "left")
    return ranked(ids.select("user_id", F.col("b").isNull().alias("__free")), "id", "__free", "user_id").select("user_id", "id")


def repeated_pairs(pairs: DataFrame) -> DataFrame:
    """Unordered pairs that are declared more than once."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a", "b").count().filter("count > 1")


def resolve_domain(low: tuple, high: tuple, origin: tuple | None = None, extent: tuple | None = None, factor: float = 0.5, absolute: float = 0.0) -> tuple[tuple, tuple]:
    """The domain (low, high) from particle bounds and what is declared of it."""
    if factor < 0 or absolute < 0:
        raise SpecError("negative margin")
    if extent is not None and (min(extent) < 0 or max(extent) == 0):
        raise SpecError("negative or empty extent")
    pads = [max((h - a) * factor, absolute) for a, h in zip(low, high, strict=True)]
    if origin is not None and extent is not None:
        box = tuple(origin), tuple(o + e for o, e in zip(origin, extent, strict=True))
    elif origin is not None:
        box = tuple(origin), tuple(h + p for h, p in zip(high, pads, strict=True))
    elif extent is not None:
        middle = [(a + h) / 2 for a, h in zip(low, high, strict=True)]
        box = tuple(m - e / 2 for m, e in zip(middle, extent, strict=True)), tuple(m + e / 2 for m, e in zip(middle, extent, strict=True))
    else:
        box = tuple(a - p for a, p in zip(low, pads, strict=True)), tuple(h + p for h, p in zip(high, pads, strict=True))
    if any(a < b for a, b in zip(low, box[0], strict=True)) or any(h > b for h, b in zip(high, box[1], strict=True)):
        raise SpecError("particles outside the domain")
    return box
