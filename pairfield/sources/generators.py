"""Particle generators and tables derived from the driver's data."""

from __future__ import annotations

from collections.abc import Iterator
from math import trunc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: One text for Spark and for other engines: a jittered lattice from part keys.
PARTICLES_SQL = """
SELECT p_partkey AS id, CAST(p_size % 3 AS INT) AS type,
  (p_partkey % 20) * 1.15e0 + ((p_partkey * 7919) % 1000) / 10000e0 AS x,
  (CAST(floor(p_partkey / 20e0) AS BIGINT) % 20) * 1.15e0 + ((p_partkey * 104729) % 1000) / 10000e0 AS y,
  floor(p_partkey / 400e0) * 1.15e0 + ((p_partkey * 1299709) % 1000) / 10000e0 AS z,
  ((p_partkey * 31337) % 2001 - 1000) / 1000e0 AS vx, ((p_partkey * 7433) % 2001 - 1000) / 1000e0 AS vy, ((p_partkey * 50021) % 2001 - 1000) / 1000e0 AS vz,
  1e0 + p_size / 10e0 AS mass, CASE WHEN p_partkey % 2 = 0 THEN 1e0 ELSE -1e0 END AS charge,
  CASE WHEN p_partkey % 11 = 0 THEN 8 WHEN p_partkey % 13 = 0 THEN 4 WHEN p_partkey % 17 = 0 THEN 2 ELSE 1 END AS state
FROM part"""
BONDS_SQL = "SELECT p_partkey AS src, p_partkey + 1 AS dst FROM part WHERE p_partkey % 10 < 9 AND p_partkey + 1 < (SELECT count(*) FROM part)"


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM part", "FROM {part}"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def cuboid(spark: SparkSession, origin, counts, spacing: float, mean=(0.0, 0.0, 0.0), first_id: int = 0, mass: float = 1.0, type_: int = 0) -> DataFrame:
    """A lattice, x outermost and z innermost."""
    if spacing == 0:
        raise ValueError("spacing must not be 0")
    nx, ny, nz = counts
    i = F.col("id")
    at = {"x": F.floor(i / (ny * nz)), "y": F.floor(i / nz) % ny, "z": i % nz}
    return spark.range(nx * ny * nz).select(
        (i + first_id).alias("id"), F.lit(type_).alias("type"),
        *[(F.lit(float(o)) + at[a].cast("double") * F.lit(float(spacing))).alias(a) for a, o in zip("xyz", origin, strict=True)],
        *[F.lit(float(v)).alias(f"v{a}") for a, v in zip("xyz", mean, strict=True)], F.lit(float(mass)).alias("mass"), F.lit(1).alias("state"),
    )


def ellipsoid(spark: SparkSession, center, radii, spacing: float, first_id: int = 0, mass: float = 1.0, type_: int = 0) -> DataFrame:
    """Lattice points strictly inside the ellipsoid; a radius below the spacing counts as the spacing."""
    if spacing == 0:
        raise ValueError("spacing must not be 0")
    n = [trunc(r / spacing) for r in radii]
    real = [max(float(r), float(spacing)) for r in radii]
    width = [2 * k + 1 for k in n]
    i = F.col("id")
    place = {"x": F.floor(i / (width[1] * width[2])) - n[0], "y": F.floor(i / width[2]) % width[1] - n[1], "z": i % width[2] - n[2]}
    d = {a: place[a].cast("double") * F.lit(float(spacing)) for a in "xyz"}
    grid = spark.range(width[0] * width[1] * width[2]).select("id", *[d[a].alias(f"d{a}") for a in "xyz"])
    within = sum((F.col(f"d{a}") * F.col(f"d{a}") / F.lit(r * r) for a, r in zip("xyz", real, strict=True)), F.lit(0.0)) < 1
    return grid.filter(within).select((i + first_id).alias("id"), F.lit(type_).alias("type"), *[(F.lit(float(c)) + F.col(f"d{a}")).alias(a) for a, c in zip("xyz", center, strict=True)], F.lit(float(mass)).alias("mass"), F.lit(1).alias("state"))


def thermal(df: DataFrame, velocity) -> DataFrame:
    """df with what ``velocity``, a function from the position's Columns to three Columns, adds to the velocities."""
    extra = velocity(F.col("x"), F.col("y"), F.col("z"))
    return df.withColumns({f"v{a}": (F.col(f"v{a}") if f"v{a}" in df.columns else F.lit(0.0)) + v for a, v in zip("xyz", extra, strict=True)})


def maxwell_boltzmann(df: DataFrame, average: float, dims: int, seed: int = 42) -> DataFrame:
    return df.withColumns({f"v{a}": F.lit(average) * F.randn(seed + i) for i, a in enumerate("xyz"[:dims])})


#: Fixed values of the generator of pseudo-random numbers by id: factors and a prime.
FACTORS, PRIME = (7919, 104729, 1299709, 15485863), 1000003


def normal_by_id(id_: Column, draw: int, seed: int = 0) -> Column:
    """A normal variate that depends on the id, the number of the draw and the seed alone, so a table is the same however it is cut."""
    u, v = ((F.pmod(h * h + h, F.lit(PRIME)) + F.lit(0.5)) / F.lit(float(PRIME)) for h in (F.pmod(id_ * F.lit(FACTORS[k]) + F.lit((2 * draw + k + 1) * FACTORS[k + 2] + seed), F.lit(PRIME)) for k in (0, 1)))
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2.0) * F.pi() * v)


def warmed(df: DataFrame, deviation: Column | str, seed: int = 0) -> DataFrame:
    """df with thermal velocities of a standard deviation added to its mean ones, drawn by id."""
    width = F.col(deviation) if isinstance(deviation, str) else deviation
    return df.withColumns({f"v{a}": (F.col(f"v{a}") if f"v{a}" in df.columns else F.lit(0.0)) + width * normal_by_id(F.col("id"), i, seed) for i, a in enumerate("xyz")})


class Lattice:
    """A table function: the points of a plane of a generator's lattice. A box of a x b x c points from a corner, or the points strictly
    inside an ellipsoid of radii a, b, c around a centre; ids count the lattice's places from ``first_id``, x outermost."""

    RETURNS = "id bigint, x double, y double, z double"

    def eval(self, kind: str, first_id: int, x: float, y: float, z: float, a: float, b: float, c: float, spacing: float, plane: int) -> Iterator[tuple[int, float, float, float]]:
        if kind == "cuboid":
            ny, nz = int(b), int(c)
            for j in range(ny):
                for k in range(nz):
                    yield first_id + (plane * ny + j) * nz + k, x + plane * spacing, y + j * spacing, z + k * spacing
            return
        n = [trunc(r / spacing) for r in (a, b, c)]
        radii = [max(r, spacing) for r in (a, b, c)]
        dx = (plane - n[0]) * spacing
        for j in range(2 * n[1] + 1):
            for k in range(2 * n[2] + 1):
                dy, dz = (j - n[1]) * spacing, (k - n[2]) * spacing
                if dx * dx / (radii[0] * radii[0]) + dy * dy / (radii[1] * radii[1]) + dz * dz / (radii[2] * radii[2]) < 1:
                    yield first_id + (plane * (2 * n[1] + 1) + j) * (2 * n[2] + 1) + k, x + dx, y + dy, z + dz


#: The columns of a table of generators. For a cuboid (x, y, z) is a corner and (a, b, c) are counts, for an ellipsoid the centre and radii.
GENERATOR = ("kind", "first_id", "x", "y", "z", "a", "b", "c", "spacing")


def generated(generators: DataFrame, seed: int = 0) -> DataFrame:
    """The particles of a table of generators: its rows are joined laterally with a table function, a call for each plane of a lattice, so
    a large lattice is made by many tasks. Further columns (``type``, ``mass``, ``vx``, ...) go on to the particles; where there is a
    column ``deviation``, thermal velocities of that width are added."""
    spark = ship(generators.sparkSession)
    if missing := set(GENERATOR) - set(generators.columns):
        raise ValueError(f"a table of generators has the columns {sorted(missing)}")
    planes = F.when(F.col("kind") == "cuboid", F.col("a")).otherwise(2 * F.floor(F.col("a") / F.col("spacing")) + 1).cast("int")
    right = (F.col("spacing") > 0) & F.col("kind").isin("cuboid", "ellipsoid")
    checked = generators.withColumn("spacing", F.when(right, F.col("spacing")).otherwise(F.raise_error(F.lit("a generator is a cuboid or an ellipsoid and has a spacing over 0"))))
    slabs = checked.withColumn("plane", F.explode(F.when(planes > 0, F.sequence(F.lit(0), planes - 1))))
    # a plane is a call of the function; dealt anew, as a few rows make many particles
    slabs = slabs.repartition(F.col("first_id"), F.col("plane"))
    more = [c for c in generators.columns if c not in GENERATOR]
    kinds = {"kind": "string", "first_id": "bigint", "plane": "int"}
    spark.udtf.register("pairfield_lattice", F.udtf(Lattice, returnType=Lattice.RETURNS))
    arguments = ", ".join(f"CAST(g.{c} AS {kinds.get(c, 'double')})" for c in (*GENERATOR, "plane"))
    out = spark.sql(f"SELECT {', '.join(['p.*', *[f'g.{c}' for c in more]])} FROM {{g}} g, LATERAL pairfield_lattice({arguments}) p", g=slabs)
    return warmed(out, "deviation", seed).drop("deviation") if "deviation" in more else out
