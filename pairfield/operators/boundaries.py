"""Boundaries: a chain of projections in face order X-, X+, Y-, Y+, Z-, Z+; each face looks at the rows as the one before left them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .forces import ALIVE, DEAD

FACES = tuple((a, side) for a in "xyz" for side in (-1, 1))


@dataclass(frozen=True)
class Boundary:
    kind: str  # open, absorbing, periodic, reflective, repulsive, custom
    thickness: float = -1.0
    #: Repulsive: SQL over ``d``, the distance to the face.
    wall: str = "0e0"
    halo: bool = False
    #: Custom: from the face (axis, side) and the domain's corners to new columns of the rows that touch it.
    action: Callable[[tuple[str, int], dict, dict], dict[str, Column]] | None = None


#: Wall laws as SQL over d.
def exponential(a: float, length: float, cutoff: float) -> str:
    return f"(CASE WHEN d > {cutoff!r}e0 THEN 0e0 ELSE {a!r}e0 * exp(-d / {length!r}e0) END)"


def power_law(a: float, n: float, cutoff: float) -> str:
    return f"(CASE WHEN d > {cutoff!r}e0 THEN 0e0 ELSE {a!r}e0 / power(d, {n!r}e0) END)"


def lennard_jones_93(epsilon: float, sigma: float, cutoff: float) -> str:
    s = f"({sigma!r}e0 / d)"
    cube = f"({s} * {s} * {s})"
    return f"(CASE WHEN d > {cutoff!r}e0 THEN 0e0 ELSE {4 * epsilon!r}e0 * (3e0 * {cube} - 9e0 * {cube} * {cube} * {cube}) END)"


def adhesive_lennard_jones(epsilon: float, sigma: float, cutoff: float) -> str:
    s = f"({sigma!r}e0 / d)"
    six = f"({s} * {s} * {s} * {s} * {s} * {s})"
    return f"(CASE WHEN d > {cutoff!r}e0 THEN 0e0 ELSE abs({24 * epsilon!r}e0 * (2e0 * {six} * {six} - {six}) / d) END)"


def check(boundaries: dict[tuple[str, int], Boundary]) -> None:
    """Periodic faces come in pairs."""
    for a in "xyz":
        if len({boundaries.get((a, s), Boundary("open")).kind == "periodic" for s in (-1, 1)}) > 1:
            raise ValueError(f"only one {a} face is periodic")


def crossed(a: str, side: int, low: dict[str, float], high: dict[str, float]):
    """Left through this face since the old position: the step's line meets the face's rectangle."""
    step = F.col(a) - F.col(f"o{a}")
    wall = F.lit(high[a] if side > 0 else low[a])
    beyond = F.col(a) > wall if side > 0 else F.col(a) < wall
    toward = step > 1e-12 if side > 0 else step < -1e-12
    part = F.try_divide(wall - F.col(f"o{a}"), step)
    hit = F.lit(True)
    for b in set("xyz") - {a}:
        at = F.col(f"o{b}") + part * (F.col(b) - F.col(f"o{b}"))
        hit = hit & at.between(low[b], high[b])
    return beyond & toward & hit


def apply(df: DataFrame, boundaries: dict[tuple[str, int], Boundary], low: dict[str, float], high: dict[str, float]) -> DataFrame:
    check(boundaries)
    for a, side in FACES:
        b = boundaries.get((a, side), Boundary("open"))
        if b.kind == "open":
            continue
        alive = F.col("state") == ALIVE
        if b.thickness >= 0:
            edge = F.col(a).between(high[a] - b.thickness, high[a]) if side > 0 else F.col(a).between(low[a], low[a] + b.thickness)
            touched = alive & edge
            for c in set("xyz") - {a}:
                touched = touched & F.col(c).between(low[c], high[c])
        else:
            touched = alive & crossed(a, side, low, high)
        wall = high[a] if side > 0 else low[a]
        df = df.withColumn("__touched", F.coalesce(touched, F.lit(False)))
        on = F.col("__touched")
        if b.kind == "absorbing":
            df = df.withColumn("state", F.when(on, F.lit(DEAD)).otherwise(F.col("state")))
        elif b.kind == "periodic":
            df = df.withColumn(a, F.when(on, F.col(a) - F.lit(side * (high[a] - low[a]))).otherwise(F.col(a)))
        elif b.kind == "reflective":
            df = df.withColumns({a: F.when(on, F.lit(2 * wall) - F.col(a)).otherwise(F.col(a)), f"v{a}": F.when(on, -F.col(f"v{a}")).otherwise(F.col(f"v{a}"))})
        elif b.kind == "repulsive":
            far = F.abs(F.col(a) - F.lit(wall)) * (2.0 if b.halo else 1.0)
            df = df.withColumn("d", far).withColumn(f"f{a}", F.when(on, F.col(f"f{a}") - F.lit(float(side)) * F.expr(b.wall)).otherwise(F.col(f"f{a}"))).drop("d")
        elif b.kind == "custom":
            df = df.withColumns({c: F.when(on, v).otherwise(F.col(c)) for c, v in b.action((a, side), low, high).items()})
        else:
            raise ValueError(f"unknown boundary {b.kind}")
        df = df.drop("__touched")
    return df
