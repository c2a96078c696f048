"""A declaration of a system, and what is built from it.

An Environment only collects; the order of calls does not matter, except that a face's last boundary counts. ``build``
validates, resolves the domain, compiles the interactions and gives a System whose stages are DataFrame transforms.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce as fold

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boundaries as B
from ..operators.forces import pair_forces
from ..operators.integrate import System
from ..operators.observables import bounding_box
from ..operators.pairs import Search
from ..session import shared_dir
from ..sources import ordered
from . import spec
from .geometry import Box, Domain
from .laws import Law, columns_of, law_table


@dataclass(frozen=True)
class ToType:
    type: int


@dataclass(frozen=True)
class BetweenTypes:
    a: int
    b: int


@dataclass(frozen=True)
class BetweenIds:
    a: int
    b: int


Scope = ToType | BetweenTypes | BetweenIds
PARTICLE = "id long, type int, x double, y double, z double, vx double, vy double, vz double, mass double, charge double, state int"


@dataclass
class BuildInfo:
    """Dense numbers of types and ids (user value, number), and the boxes of the build."""

    types: DataFrame
    ids: DataFrame
    particle_box: Box
    domain: Box
    #: Where the particles are kept, if in order of a curve.
    stored: str | None = None


@dataclass
class Environment:
    tables: list[DataFrame | Callable[[SparkSession], DataFrame]] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    interactions: list[tuple[Scope, Law]] = field(default_factory=list)
    boundaries: dict[tuple[str, int], B.Boundary] = field(default_factory=dict)
    fields: list[Callable] = field(default_factory=list)
    controllers: list[tuple] = field(default_factory=list)
    domain: Domain = field(default_factory=Domain)
    padding: float = 0.0
    factor: float = 0.5
    #: Names and types of further columns that every particle has.
    attributes: dict[str, str] = field(default_factory=dict)
    search: Search = Search()
    strict_states: bool = False
    order: tuple[float, str] | None = None

    def with_attributes(self, **types: str) -> Environment:
        """Columns of one's own, by name and SQL type, for laws and kernels; tables must have them, and single declarations give them."""
        taken = {c.split()[0] for c in PARTICLE.split(", ")}
        if clash := taken & set(types):
            raise spec.SpecError(f"every particle already has {sorted(clash)}")
        self.attributes |= types
        return self

    def with_neighbours(self, kind: str = "cells", **more: int) -> Environment:
        """How pairs within a reach are found: ``cells`` (``per_cutoff`` cells to the reach), ``adaptive`` (at most ``rows`` a cell) or ``direct``."""
        self.search = Search(kind, **more)
        return self

    def with_order(self, cell: float, kind: str = "hilbert") -> Environment:
        """Keeps the particles in order of a curve over the domain, in a table in the shared folder; ``region`` of ``ordered`` reads that
        table, which ``BuildInfo.stored`` names, by its row groups."""
        self.order = cell, kind
        return self

    def with_strict_states(self, on: bool = True) -> Environment:
        """Dead particles take no part in interactions, passive ones receive only."""
        self.strict_states = on
        return self

    def with_particle(self, position, velocity=(0.0, 0.0, 0.0), mass: float = 1.0, type: int = 0, id: int | None = None, charge: float = 0.0, state: int = 1, **attributes) -> Environment:
        if id is not None and any(r[0] == id for r in self.rows):
            raise spec.SpecError(f"id {id} occurs twice")
        self.rows.append((id, type, *map(float, position), *map(float, velocity), float(mass), float(charge), state, attributes))
        return self

    def with_particles(self, particles: DataFrame | Callable[[SparkSession], DataFrame] | Iterable[dict]) -> Environment:
        """A table, a generator (a function from a session to a table), or single declarations."""
        if isinstance(particles, DataFrame) or callable(particles):
            self.tables.append(particles)
        else:
            for p in particles:
                self.with_particle(**p)
        return self

    def with_interaction(self, scope: Scope, law: Law) -> Environment:
        self.interactions.append((scope, law))
        return self

    def with_boundary(self, boundary: B.Boundary, *faces: tuple[str, int]) -> Environment:
        """For some faces, or for all six if none is named."""
        self.boundaries |= dict.fromkeys(faces or B.FACES, boundary)
        return self

    def with_field(self, f: Callable[[DataFrame, float], DataFrame]) -> Environment:
        self.fields.append(f)
        return self

    def with_controller(self, trigger, action: Callable[[DataFrame], DataFrame]) -> Environment:
        self.controllers.append((trigger, action))
        return self

    def with_domain(self, origin=None, extent=None) -> Environment:
        self.domain = Domain(origin or self.domain.origin, extent or self.domain.extent)
        return self

    def with_padding(self, absolute: float | None = None, factor: float | None = None) -> Environment:
        """Margins around the particles; per axis the larger one counts."""
        self.padding = self.padding if absolute is None else absolute
        self.factor = self.factor if factor is None else factor
        return self

    def particles(self, spark: SparkSession) -> DataFrame:
        """All declared particles as one table, ids filled in."""
        names = [c.split()[0] for c in PARTICLE.split(", ")]
        own = "".join(f", {n} {t}" for n, t in self.attributes.items())
        for *_, given in self.rows:
            if odd := set(given) ^ set(self.attributes):
                raise spec.SpecError(f"attributes {sorted(odd)} are declared and not given, or given and not declared")
        parts = [spark.createDataFrame([(*r[:-1], *[r[-1][n] for n in self.attributes], i) for i, r in enumerate(self.rows)], f"{PARTICLE}{own}, __order long")] if self.rows else []
        for i, t in enumerate(self.tables):
            df = t if isinstance(t, DataFrame) else t(spark)
            if missing := set(self.attributes) - set(df.columns):
                raise spec.SpecError(f"a table lacks the attributes {sorted(missing)}")
            df = df.withColumns({n: F.col(n).cast(t) for n, t in self.attributes.items()})
            given = df.withColumns({c: F.lit({"mass": 1.0, "state": 1, "type": 0}.get(c, 0.0)) for c in names if c not in df.columns and c != "id"})
            given = given if "id" in df.columns else given.withColumn("id", F.lit(None).cast("long"))
            parts.append(given.withColumn("__order", F.monotonically_increasing_id() + F.lit((i + 1) << 53)))
        if not parts:
            raise spec.SpecError("no particles")
        df = fold(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        spec.validate(df)
        if not df.filter("id is null").limit(1).isEmpty():
            df = spec.assign_ids(df, "__order")
        return df.drop("__order")

    def _compiled(self, types: list[int]) -> tuple[dict, dict[int, Law], list[tuple[int, int, int]]]:
        by_type: dict[tuple[int, int], Law] = {}
        bonds, laws = [], {}
        for scope, law in self.interactions:
            if isinstance(scope, BetweenIds):
                if scope.a == scope.b:
                    raise spec.SpecError("a particle does not interact with itself")
                number = next((n for n, x in laws.items() if x == law), len(laws))
                laws[number] = law
                bonds.append((scope.a, scope.b, number))
                continue
            pair = (scope.type, scope.type) if isinstance(scope, ToType) else tuple(sorted((scope.a, scope.b)))
            if pair in by_type:
                raise spec.SpecError(f"types {pair} are given twice")
            by_type[pair] = law
        if len({tuple(sorted(b[:2])) for b in bonds}) < len(bonds):
            raise spec.SpecError("a pair of ids is given twice")
        law_table(by_type, types)
        return by_type, laws, bonds

    def build(self, spark: SparkSession) -> tuple[System, BuildInfo]:
        df = self.particles(spark)
        box = bounding_box(df).first()
        low, high = (tuple(box[f"{m}_{a}"] for a in "xyz") for m in ("min", "max"))
        domain = Box(*spec.resolve_domain(low, high, self.domain.origin, self.domain.extent, self.factor, self.padding))
        B.check(self.boundaries)
        types = [r["type"] for r in df.select("type").distinct().orderBy("type").collect()]  # one row a type
        by_type, laws, bonds = self._compiled(types)
        columns_of([*law_table(by_type, types).values(), *laws.values()], df.columns)
        bond_table = spark.createDataFrame(bonds, "src long, dst long, law int")
        spec.check_bonds(df, bond_table)
        periodic = {a: self.boundaries.get((a, 1), B.Boundary("open")).kind == "periodic" for a in "xyz"}
        wrap = tuple(e if periodic[a] else None for a, e in zip("xyz", domain.extent, strict=True))
        force = lambda d: pair_forces(d, by_type, types, wrap, bond_table if bonds else None, laws or None, self.strict_states, self.search)
        stored = None
        if self.order:
            stored = f"{shared_dir(spark.sparkContext)}/{uuid.uuid4().hex}"
            ordered.store(df, stored, ordered.curve_for(domain.low, domain.high, *self.order))
            df = spark.read.parquet(stored).drop(ordered.KEY)
        corners = (dict(zip("xyz", domain.low, strict=True)), dict(zip("xyz", domain.high, strict=True)))
        system = System(df, force, self.boundaries, *corners, list(self.fields), list(self.controllers))
        return system, BuildInfo(spec.type_map(df.select("type")), spec.id_map(df, bond_table), Box(low, high), domain, stored)
