"""Queries over stored tables, snapshots, frames, generators, folds, firings and partitions, each with SQL for another engine."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .operators import forces, graph, kernels
from .queries import P, _p, query, rounded
from .session import shared_dir
from .sources import files, ordered, snapshots
from .sources.generators import BONDS_SQL, FACTORS, PRIME, derived, generated
from .streaming import triggers


def _folder(spark) -> str:
    return f"{shared_dir(spark.sparkContext)}/{uuid.uuid4().hex}"


# -- tables in order of a curve -----------------------------------------------------------------------------------------
REGION = (4.0, 4.0, 0.0), (11.0, 11.0, 5.0)

for _kind in ("hilbert", "morton"):

    @query(f"region_{_kind}", f"{P} SELECT id, x, y, z FROM p WHERE state = 1 AND x BETWEEN 4 AND 11 AND y BETWEEN 4 AND 11 AND z BETWEEN 0 AND 5")
    def _region(spark, d, kind=_kind):
        path = _folder(spark)
        ordered.store(_p(spark, d), path, ordered.curve_for((0.0, 0.0, 0.0), (24.0, 24.0, 64.0), 1.0, kind))
        return ordered.region(spark, path, *REGION).filter(F.col("state") == forces.ALIVE).select("id", "x", "y", "z")


# -- snapshots and frames -----------------------------------------------------------------------------------------------
@query("snapshot_round_trip", f"{P} SELECT 7::BIGINT AS step, x::FLOAT::DOUBLE AS x, y::FLOAT::DOUBLE AS y, z::FLOAT::DOUBLE AS z, type, id, state FROM p")
def snapshot_round_trip(spark, d):
    path = _folder(spark)
    snapshots.write_snapshot(_p(spark, d), path, 7)
    return snapshots.read_snapshot(spark, path, rows=5000)


@query("xyz_frame", f"{P} SELECT id, 'T' || type || ' ' || printf('%.17g', x) || ' ' || printf('%.17g', y) || ' ' || printf('%.17g', z) AS value FROM p")
def xyz_frame(spark, d):
    return files.xyz_lines(_p(spark, d))


# -- folds of one's own -------------------------------------------------------------------------------------------------
#: (axis, sign) of the six outermost points.
_WAYS = tuple((k, sign) for k in (1, 2, 3) for sign in (-1, 1))


def _outermost(k: int, sign: int, *points) -> tuple | None:
    """Of points (id, x, y, z) that are there, the farthest along an axis, and of equal ones the least id."""
    there = [tuple(p.values()) if isinstance(p, dict) else tuple(p) for p in points if p is not None]
    return max(there, key=lambda p: (sign * p[k], -p[0]), default=None)


def _points_merge(s, t):
    return tuple(_outermost(*way, a, b) for way, a, b in zip(_WAYS, s, t, strict=True))


def _points_step(state, batch):
    points = list(zip(*[c.to_pylist() for c in batch.columns], strict=True))
    return _points_merge(state, tuple(_outermost(*way, *points) for way in _WAYS))


_POINT = "struct<id: bigint, x: double, y: double, z: double>"
EXTREMES = kernels.Reducer(("id", "x", "y", "z"), ", ".join(f"{m}_{a} {_POINT}" for a in "xyz" for m in ("least", "most")), (None,) * 6, _points_step, _points_merge)
_ENDS = " UNION ".join(f"SELECT id, x, y, z FROM (SELECT * FROM p WHERE (state & 1) <> 0 ORDER BY {a}{way}, id LIMIT 1)" for a in "xyz" for way in ("", " DESC"))


@query("reduce_extremes", f"{P}, e AS ({_ENDS}) SELECT a.id AS id_a, b.id AS id_b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 6) AS distance FROM e a JOIN e b ON a.id < b.id ORDER BY distance DESC, id_a, id_b LIMIT 1")
def reduce_extremes(spark, d):
    """The farthest two of the particles that are outermost along an axis: six points from one fold, then their few pairs."""
    ends = kernels.reduce_with(_p(spark, d), EXTREMES).select(F.explode(F.array(*[f"{m}_{a}" for a in "xyz" for m in ("least", "most")])).alias("e")).select("e.*").distinct()
    side = lambda s: ends.select(F.lit(1).alias("one"), *[F.col(c).alias(f"{c}_{s}") for c in ("id", "x", "y", "z")])
    far = F.sqrt(sum(((F.col(f"{c}_a") - F.col(f"{c}_b")) * (F.col(f"{c}_a") - F.col(f"{c}_b")) for c in "xyz"), F.lit(0.0)))
    pairs = side("a").join(side("b"), "one").filter("id_a < id_b").select("id_a", "id_b", F.round(far, 6).alias("distance"))
    return pairs.orderBy(F.desc("distance"), "id_a", "id_b").limit(1)


# -- generators ---------------------------------------------------------------------------------------------------------
#: A generator for each supplier: boxes and ellipsoids of several sizes.
GENERATORS_SQL = """SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'cuboid' ELSE 'ellipsoid' END AS kind, s_suppkey * 1000 AS first_id, s_suppkey * 1e1 AS x, 2e0 AS y, s_nationkey * 1e0 AS z,
  CAST(CASE WHEN s_suppkey % 2 = 0 THEN 2 + s_nationkey % 3 ELSE 1 + s_nationkey % 2 END AS DOUBLE) AS a, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 2 + s_suppkey % 3 ELSE 2 END AS DOUBLE) AS b,
  CAST(CASE WHEN s_suppkey % 2 = 0 THEN 4 ELSE 1.5 END AS DOUBLE) AS c, 5e-1 AS spacing, CAST(s_nationkey AS INT) AS type, 1e0 + s_nationkey / 10e0 AS mass, 2e0 AS vx, 1e-1 + s_nationkey / 50e0 AS deviation FROM supplier"""


def _normal_sql(draw: int) -> str:
    h = [f"((id * {FACTORS[k]} + {(2 * draw + k + 1) * FACTORS[k + 2]}) % {PRIME})" for k in (0, 1)]
    u, v = (f"(({x} * {x} + {x}) % {PRIME} + 0.5e0) / {PRIME}e0" for x in h)
    return f"deviation * sqrt(-2e0 * ln({u})) * cos(2e0 * pi() * {v})"


_LATTICE_SQL = f"""WITH g AS ({GENERATORS_SQL}),
c AS (SELECT g.*, unnest(range(CAST(a * b * c AS BIGINT))) AS i FROM g WHERE kind = 'cuboid'),
e AS (SELECT g.*, CAST(trunc(a / spacing) AS BIGINT) AS na, CAST(trunc(b / spacing) AS BIGINT) AS nb, CAST(trunc(c / spacing) AS BIGINT) AS nc FROM g WHERE kind = 'ellipsoid'),
s AS (SELECT *, unnest(range((2 * na + 1) * (2 * nb + 1) * (2 * nc + 1))) AS i FROM e),
o AS (SELECT *, (i // ((2 * nb + 1) * (2 * nc + 1)) - na) * spacing AS dx, (i // (2 * nc + 1) % (2 * nb + 1) - nb) * spacing AS dy, (i % (2 * nc + 1) - nc) * spacing AS dz FROM s),
p AS (SELECT first_id + i AS id, x + (i // CAST(b * c AS BIGINT)) * spacing AS x, y + (i // CAST(c AS BIGINT) % CAST(b AS BIGINT)) * spacing AS y, z + (i % CAST(c AS BIGINT)) * spacing AS z, type, mass, vx, deviation FROM c
  UNION ALL SELECT first_id + i, x + dx, y + dy, z + dz, type, mass, vx, deviation FROM o WHERE dx * dx / (a * a) + dy * dy / (b * b) + dz * dz / (c * c) < 1)
SELECT id, x, y, z, type, mass, round(vx + {_normal_sql(0)}, 6) + 0e0 AS vx, round({_normal_sql(1)}, 6) + 0e0 AS vy, round({_normal_sql(2)}, 6) + 0e0 AS vz FROM p"""


@query("generated_particles", _LATTICE_SQL)
def generated_particles(spark, d):
    generators = spark.sql(GENERATORS_SQL.replace("FROM supplier", "FROM {s}"), s=spark.read.parquet(f"{d}/supplier.parquet"))
    out = generated(generators)
    return out.select("id", "x", "y", "z", "type", "mass", *[(F.round(f"v{a}", 6) + F.lit(0.0)).alias(f"v{a}") for a in "xyz"])


# -- firings ------------------------------------------------------------------------------------------------------------
#: Moments of the events' own times, in whole seconds; an hour and a half between firings.
_FIRED = "WITH RECURSIVE e AS (SELECT event_id AS step, CAST(floor(epoch(ts)) AS DOUBLE) AS time FROM events), f(t) AS (SELECT min(time) FROM e WHERE time >= 1000e0 UNION ALL SELECT (SELECT min(time) FROM e WHERE time >= f.t + 5400e0) FROM f WHERE f.t IS NOT NULL), g AS (SELECT time, min(step) AS step FROM e GROUP BY time)"
query("trigger_periodically", f"{_FIRED} SELECT step, time FROM g WHERE time IN (SELECT t FROM f)")(
    lambda spark, d: triggers.periodically(5400.0, 1000.0).mark(_moments(spark, d)).filter("fires").select("step", "time")
)
query("trigger_combined", f"{_FIRED} SELECT e.step, NOT (g.step IS NOT NULL AND e.time IN (SELECT t FROM f WHERE t IS NOT NULL)) AND e.step % 5 = 0 AS fires FROM e LEFT JOIN g ON g.step = e.step AND g.time = e.time")(
    lambda spark, d: (~triggers.periodically(5400.0, 1000.0) & triggers.every(5)).mark(_moments(spark, d)).select("step", "fires")
)


def _moments(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("step"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("double").alias("time"))


# -- partitions ---------------------------------------------------------------------------------------------------------
#: Bonds make chains of ten from each multiple of ten on; first fit gives their links alternating parts.
query("independent_partitions", f"WITH e AS ({BONDS_SQL}) SELECT node, CAST(node % 10 % 2 AS INT) AS part FROM (SELECT src AS node FROM e UNION SELECT dst FROM e)")(
    lambda spark, d: graph.independent_partitions(graph.unique_nodes(derived(spark, d, BONDS_SQL)), derived(spark, d, BONDS_SQL))
)
