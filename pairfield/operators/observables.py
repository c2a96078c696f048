"""What a particle table measures as a whole, and the thermostat that acts on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounding_box(df: DataFrame) -> DataFrame:
    return df.agg(*[f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def domain(df: DataFrame, factor: float = 0.5, absolute: float = 0.0) -> DataFrame:
    """The default domain: the bounding box, padded per axis by the larger of factor * extent and the absolute margin."""
    box = bounding_box(df)
    pad = {a: F.greatest((F.col(f"max_{a}") - F.col(f"min_{a}")) * F.lit(factor), F.lit(absolute)) for a in "xyz"}
    return box.select(*[(F.col(f"min_{a}") - pad[a]).alias(f"min_{a}") for a in "xyz"], *[(F.col(f"max_{a}") + pad[a]).alias(f"max_{a}") for a in "xyz"])


def kinetic_energy(df: DataFrame) -> DataFrame:
    return df.agg(F.sum(F.col("mass") * (F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz")) / 2).alias("kinetic_energy"))


def momentum(df: DataFrame) -> DataFrame:
    return df.agg(*[F.sum(F.col("mass") * F.col(f"v{a}")).alias(f"p{a}") for a in "xyz"])


def potential_energy(pairs: DataFrame, energy: str) -> DataFrame:
    """Over directed pairs; each pair counts once."""
    return pairs.filter("id_a < id_b and r2 > 0").agg(F.sum(F.expr(energy)).alias("potential_energy"), F.count("*").alias("pairs"))


def average_velocity(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), *[F.avg(f"v{a}").alias(f"u{a}") for a in "xyz"])


def temperature(df: DataFrame, dims: int = 3) -> DataFrame:
    """sum m |v - mean v|^2 / (dims * n), centred before squares are summed; 0 without dimensions."""
    mean = average_velocity(df)
    off = [F.col(f"v{a}") - F.col(f"u{a}") for a in "xyz"]
    spread = F.sum(F.col("mass") * (off[0] * off[0] + off[1] * off[1] + off[2] * off[2]))
    # one row of means beside each particle
    both = df.join(F.broadcast(mean)).agg(F.max("n").alias("n"), *[F.max(f"u{a}").alias(f"u{a}") for a in "xyz"], spread.alias("e"))
    t = F.when(F.lit(dims) == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("e"), F.lit(float(dims)) * F.col("n")))
    return both.select("n", *[f"u{a}" for a in "xyz"], t.alias("temperature"))


def heat(df: DataFrame, target: float, dims: int = 3, seed: int = 42) -> DataFrame:
    """Starting velocities of a temperature: normal with variance target / mass on the first axes, for all rows."""
    if target < 0:
        raise ValueError("the temperature must not be negative")
    return df.withColumns({f"v{a}": F.sqrt(F.lit(float(target)) / F.col("mass")) * F.randn(seed + i) for i, a in enumerate("xyz"[:dims])})


def thermostat(df: DataFrame, target: float, most: float, dims: int = 3, seed: int = 42) -> DataFrame:
    """Scales velocities about their mean towards the target, by at most ``most`` in temperature; cold tables are re-ignited at random."""
    if most < 0:
        raise ValueError("the largest change must not be negative")
    now = temperature(df, dims).first()
    t = now["temperature"] or 0.0
    new = t + max(-most, min(most, target - t))
    if abs(new - t) < 1e-12:
        return df
    mean = {a: now[f"u{a}"] for a in "xyz"}
    if t < 1e-12:
        return df.withColumns({f"v{a}": F.lit(mean[a]) + F.sqrt(F.lit(new) / F.col("mass")) * F.randn(seed + i) if i < dims else F.col(f"v{a}") for i, a in enumerate("xyz")})
    s = (new / t) ** 0.5
    return df.withColumns({f"v{a}": F.lit(mean[a]) + F.lit(s) * (F.col(f"v{a}") - F.lit(mean[a])) for a in "xyz"})
