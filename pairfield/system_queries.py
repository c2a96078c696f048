"""Queries over laws by symmetry, states, kernels, geometry, walls and the builder, each with SQL for another engine."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from .functions import vec as V
from .operators import boundaries as B
from .operators import cells, forces, kernels, pairs
from .operators.integrate import System
from .plans import laws
from .plans.environment import BetweenIds, BetweenTypes, Environment, ToType
from .plans.geometry import Box, Domain
from .queries import FORCE, FORCE_OUT, LJ, LJ_SQL, MOVED, MOVED_COLUMNS, P, _p, drift_sql, force_sql, kick_sql, pair_sql, query, rounded, with_force_sql
from .sources.generators import BONDS_SQL, derived
from .streaming import triggers

NONE = laws.NoForce()


def _summed_sql(rows: str) -> str:
    return f"{P} SELECT {FORCE_OUT} FROM ({with_force_sql('p', f'SELECT id, sum(fx) AS fx, sum(fy) AS fy, sum(fz) AS fz FROM ({rows}) GROUP BY id')})"


# -- laws by symmetry and reach -----------------------------------------------------------------------------------------
CONSTANTS = {(0, 0): laws.Constant(2.0, (1.0, 2.0, 3.0)), (1, 1): NONE, (2, 2): NONE, (0, 1): laws.SymmetricConstant(1.5, (0.5, 0.0, -0.25)), (0, 2): laws.Constant(2.0, (0.0, 1.0, 0.0)), (1, 2): NONE}


def _constant_sql() -> str:
    """The first of a pair has the lower type, then the lower id."""
    sign = "CASE WHEN type_a < type_b OR (type_a = type_b AND id_a < id_b) THEN 1e0 ELSE -1e0 END"
    same, two, far = "type_a = 0 AND type_b = 0 AND r2 <= 4e0", "type_a + type_b = 1 AND r2 <= 2.25e0", "least(type_a, type_b) = 0 AND greatest(type_a, type_b) = 2 AND r2 <= 4e0"
    part = lambda a, b, c: f"CASE WHEN {same} THEN {a}e0 * {sign} WHEN {two} THEN {b}e0 WHEN {far} THEN {c}e0 * {sign} ELSE 0e0 END"
    return _summed_sql(f"SELECT id_a AS id, {part(1, 0.5, 0)} AS fx, {part(2, 0, 1)} AS fy, {part(3, -0.25, 0)} AS fz FROM ({pair_sql('p', 2.0)})")


query("constant_force", _constant_sql())(lambda spark, d: rounded(forces.pair_forces(_p(spark, d), CONSTANTS, [0, 1, 2]), *FORCE))

_PULL = laws.Custom(2.0, ("(mass_a * dx)", "(charge_b * dy)", "(0.5e0 * dz)"), "nonsymmetric", ("mass", "charge"))
query("nonsymmetric_force", _summed_sql(f"SELECT id_a AS id, mass_a * dx AS fx, charge_b * dy AS fy, 0.5e0 * dz AS fz FROM ({pair_sql('p', 2.0)}) WHERE r2 > 0"))(lambda spark, d: rounded(forces.pair_forces(_p(spark, d), _PULL), *FORCE))

#: One pair of types attracts at any distance; the others keep to their cutoffs.
FAR = {(0, 0): laws.LennardJones(2.5, 1.0, 1.0), (1, 1): NONE, (2, 2): laws.Harmonic(2.0, 3.0, 1.2), (0, 1): NONE, (0, 2): NONE, (1, 2): laws.Gravity(None, 0.5)}
_FAR_SQL = """CASE WHEN greatest(type_a, type_b) = 0 AND r2 <= 6.25e0 THEN -(48e0 / (r2 * r2 * r2) - 24e0) / (r2 * r2 * r2 * r2) WHEN least(type_a, type_b) = 2 AND r2 <= 4e0 THEN 3e0 * (sqrt(r2) - 1.2e0) / sqrt(r2)
    WHEN least(type_a, type_b) = 1 AND greatest(type_a, type_b) = 2 THEN 0.5e0 * mass_a * mass_b / (r2 * sqrt(r2)) ELSE 0e0 END"""
query("mixed_reach_force", f"{P} SELECT {FORCE_OUT} FROM ({with_force_sql('p', force_sql('p', _FAR_SQL, None))})")(lambda spark, d: rounded(forces.pair_forces(_p(spark, d), FAR, [0, 1, 2]), *FORCE))

BOND_LAWS = {0: laws.Harmonic(None, 5.0, 1.0), 1: laws.Constant(None, (-1.0, 2.0, -3.0)), 2: laws.Gravity(None, 2.0)}


def _bond_laws_sql() -> str:
    ends = "SELECT e.law, a.id AS id_a, b.id AS id_b, a.mass AS mass_a, b.mass AS mass_b, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM e JOIN p a ON e.src = a.id JOIN p b ON e.dst = b.id"
    pair = f"SELECT *, dx * dx + dy * dy + dz * dz AS r2 FROM ({ends})"
    part = lambda a, c: f"CASE law WHEN 0 THEN 5e0 * (sqrt(r2) - 1e0) / sqrt(r2) * d{a} WHEN 1 THEN {c}e0 ELSE 2e0 * mass_a * mass_b / (r2 * sqrt(r2)) * d{a} END"
    one = f"SELECT *, {part('x', -1)} AS gx, {part('y', 2)} AS gy, {part('z', -3)} AS gz FROM ({pair})"
    rows = f"SELECT id_a AS id, gx AS fx, gy AS fy, gz AS fz FROM ({one}) UNION ALL SELECT id_b, -gx, -gy, -gz FROM ({one})"
    return _summed_sql(rows).replace(P, f"{P}, e AS (SELECT src, dst, src % 3 AS law FROM ({BONDS_SQL}))", 1)


@query("bond_laws", _bond_laws_sql())
def bond_laws(spark, d):
    bonds = derived(spark, d, BONDS_SQL).withColumn("law", (F.col("src") % 3).cast("int"))
    return rounded(forces.pair_forces(_p(spark, d), NONE, bonds=bonds, bond_law=BOND_LAWS), *FORCE)


_STRICT = f"SELECT q.* FROM ({pair_sql('p', 3.0)}) q JOIN p a ON a.id = q.id_a JOIN p b ON b.id = q.id_b WHERE a.state <> 2 AND (b.state & 9) <> 0 AND r2 > 0"
query("strict_state_force", _summed_sql(f"SELECT id_a AS id, ({LJ_SQL}) * dx AS fx, ({LJ_SQL}) * dy AS fy, ({LJ_SQL}) * dz AS fz FROM ({_STRICT})"))(lambda spark, d: rounded(forces.pair_forces(_p(spark, d), LJ, strict_states=True), *FORCE))


# -- kernels and folds --------------------------------------------------------------------------------------------------
@kernels.kernel(("x", "vx", "mass"), ("vx", "x"))
def _nudge(c):
    return {"vx": c["vx"] + 1.5 / c["mass"], "x": c["x"] + 0.25 * c["vx"]}


@kernels.kernel(("vx", "vy", "vz"))
def _speed(c):
    return {"speed": F.round(F.sqrt(c["vx"] * c["vx"] + c["vy"] * c["vy"] + c["vz"] * c["vz"]), 6)}


query("particle_kernel", f"{P} SELECT id, round(CASE WHEN (state & 9) <> 0 THEN x + 0.25e0 * vx ELSE x END, 6) AS x, round(CASE WHEN (state & 9) <> 0 THEN vx + 1.5e0 / mass ELSE vx END, 6) + 0e0 AS vx FROM p")(lambda spark, d: rounded(kernels.for_each_particle(_p(spark, d), _nudge, forces.EXERTING), "id", "x", "vx"))
query("particle_view", f"{P} SELECT id, round(sqrt(vx * vx + vy * vy + vz * vz), 6) AS speed FROM p WHERE (state & 5) <> 0")(lambda spark, d: kernels.for_each_particle_view(_p(spark, d), _speed, forces.MOVABLE))
query("reduce_sum", f"{P} SELECT round(sum(mass * vx), 6) AS value FROM p WHERE (state & 1) <> 0")(lambda spark, d: rounded(kernels.reduce(_p(spark, d), "mass * vx"), "value"))
query("reduce_max", f"{P} SELECT greatest(max(z), 5e0) AS value FROM p")(lambda spark, d: kernels.reduce(_p(spark, d), "z", "max", 5.0, forces.ALL))
query("size_by_state", f"{P} SELECT count(*) AS n FROM p WHERE (state & 5) <> 0")(lambda spark, d: kernels.size(_p(spark, d), forces.MOVABLE))
query("id_range", f"{P} SELECT min(id) AS min_id, max(id) + 1 AS max_id FROM p")(lambda spark, d: kernels.id_range(_p(spark, d)))
query("at_id", f"{P} SELECT id, CASE WHEN id = 7 THEN 2.5e0 ELSE mass END AS mass FROM p")(lambda spark, d: kernels.at_id(_p(spark, d), 7, mass=2.5).select("id", "mass"))


# -- geometry and cells -------------------------------------------------------------------------------------------------
_OVERLAP = Box.from_domain(Domain.from_center_and_size((8.0, 8.0, 2.0), (9.0, 9.0, 4.0))).intersection(Box((0.0, 6.0, 1.0), (7.5, 30.0, 3.5)))
query("box_intersection", f"{P} SELECT id FROM p WHERE x BETWEEN 3.5 AND 7.5 AND y BETWEEN 6 AND 12.5 AND z BETWEEN 1 AND 3.5")(lambda spark, d: _p(spark, d).filter(_OVERLAP.contains()).select("id"))


#: A grid for each nation: its extent, reach and skin, sized by each strategy.
_GRIDS = "SELECT n_nationkey AS grid, 20e0 + n_nationkey AS ex, 30e0 - n_nationkey AS ey, CASE WHEN n_nationkey % 4 = 0 THEN 0e0 ELSE 12e0 END AS ez, 1e0 + n_regionkey AS reach, CASE WHEN n_nationkey % 2 = 0 THEN 25e-2 ELSE 0e0 END AS skin FROM nation"
_SIZES = {"cutoff": "r", "half": "r * 5e-1", "third": "r * (1e0 / 3e0)", "factor": "r * 75e-2", "absolute": "4e0"}
_BOUND = "SELECT *, least(reach, least(ex, ey, CASE WHEN ez > 0 THEN ez ELSE ex END) / 2e0) AS r FROM g"
query("grid_sizing", f"WITH g AS ({_GRIDS}), b AS ({_BOUND}) " + " UNION ALL ".join(f"SELECT grid, '{s}' AS strategy, " + ", ".join(f"CAST(greatest(2, floor(e{a} / ({w} + skin))) AS INT) AS n{a}" for a in "xyz") + " FROM b" for s, w in _SIZES.items()))(
    lambda spark, d: cells.grid_sizes(spark.sql(_GRIDS.replace("FROM nation", "FROM {n}"), n=spark.read.parquet(f"{d}/nation.parquet")), {"cutoff": "cutoff", "half": "half", "third": "third", "factor": ("factor", 0.75), "absolute": ("absolute", 4.0)}).select("grid", "strategy", "nx", "ny", "nz")
)


@query("region_by_cells", f"{P} SELECT id FROM p WHERE state = 1 AND x BETWEEN 4 AND 11 AND y BETWEEN 4 AND 11 AND z BETWEEN 0 AND 5")
def region_by_cells(spark, d):
    region = (4.0, 4.0, 0.0), (11.0, 11.0, 5.0)
    low, counts = dict.fromkeys("xyz", 0.0), {"x": 8, "y": 8, "z": 23}
    near = cells.region_by_cells(cells.cell_index(_p(spark, d), low, 3.0, counts), low, 3.0, counts, region)
    return near.filter(forces.inside(*region)).select("id")


@query("interaction_pairs", f"{P} SELECT count(*) AS n, round(sum(r2), 4) AS r2 FROM ({pair_sql('p', 2.2)}) WHERE id_a < id_b")
def interaction_pairs(spark, d):
    return pairs.interaction_pairs(_p(spark, d), 2.2).agg(F.count("*").alias("n"), F.round(F.sum("r2"), 4).alias("r2"))


query("vec_compare", f"{P} SELECT id, (x <= y AND y <= z AND z <= x) AS le, (vx < mass AND vy < mass AND vz < mass) AS lt, (vx > 0 OR vy > 0 OR vz > 0) AS some, round(1 / (x * x + y * y + z * z + 1), 9) AS inverse FROM p")(
    lambda spark, d: _p(spark, d).select(
        "id", (V.Vec.of() <= V.Vec(F.col("y"), F.col("z"), F.col("x"))).alias("le"), (V.Vec.of("v") < V.Vec(F.col("mass"), F.col("mass"), F.col("mass"))).alias("lt"),
        V.Vec.of("v").any(lambda c: c > 0).alias("some"), F.round(1 / (V.Vec.of().norm_squared() + 1), 9).alias("inverse"),
    )
)
query("scalar_signs", f"{P} SELECT id, signbit(vx) AS negative, round(vx - vy * trunc(vx / (vy + 3)), 6) + 0e0 AS rest, round(sin(x), 6) + 0e0 AS sin, round(cos(x), 6) + 0e0 AS cos, CASE WHEN vz < 0 THEN -abs(vx) ELSE abs(vx) END AS signed, round(vx * vy + vz, 6) + 0e0 AS fma, isinf(vx) AS inf, isfinite(vy) AS finite FROM p")(
    lambda spark, d: _p(spark, d).select(
        "id", V.signbit(F.col("vx")).alias("negative"), (F.round(F.col("vx") - F.col("vy") * V.truncate(F.col("vx") / (F.col("vy") + 3)), 6) + F.lit(0.0)).alias("rest"),
        *[(F.round(V.sincos(F.col("x")).getField(n), 6) + F.lit(0.0)).alias(n) for n in ("sin", "cos")], V.copysign(F.col("vx"), F.col("vz")).alias("signed"),
        (F.round(V.fma(F.col("vx"), F.col("vy"), F.col("vz")), 6) + F.lit(0.0)).alias("fma"), V.isinf(F.col("vx")).alias("inf"), V.isfinite(F.col("vy")).alias("finite"),
    )
)
query("trigger_times", "SELECT event_id AS step FROM events WHERE event_id * 0.01e0 >= 7e0 AND event_id * 0.01e0 < 9e0 OR event_id < 5")(
    lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("step"), (F.col("event_id") * F.lit(0.01)).alias("time")).filter((triggers.after_time(7.0) & triggers.between_time(0.0, 9.0) | ~triggers.after(5)).column()).select("step")
)


# -- boundaries and steps -----------------------------------------------------------------------------------------------
_DOME = {"x": -1.0, "y": -1.0, "z": -1.0}, {"x": 24.0, "y": 24.0, "z": 70.0}
_PUSH = B.power_law(2.0, 2.0, 3.0)


def _wall_step_sql(dt: float) -> str:
    """A step whose only forces are those of the lower x wall."""
    push = "CASE WHEN state = 1 AND x BETWEEN -1 AND 2 AND y BETWEEN -1 AND 24 AND z BETWEEN -1 AND 70 THEN 2e0 / power(x + 1e0, 2e0) ELSE 0e0 END"
    start = "SELECT *, 0e0 AS fx, 0e0 AS fy, 0e0 AS fz FROM p"
    moved = drift_sql(f"({kick_sql(f'({start})', dt)})", dt)
    return f"{P} SELECT {MOVED} FROM ({kick_sql(f'(SELECT *, {push} AS fx, 0e0 AS fy, 0e0 AS fz FROM ({moved}))', dt)})"


@query("wall_step", _wall_step_sql(0.05))
def wall_step(spark, d):
    system = System(_p(spark, d), partial(forces.pair_forces, law=NONE), {("x", -1): B.Boundary("repulsive", 3.0, _PUSH)}, *_DOME)
    system.update_forces()
    system.verlet(0.05)
    return rounded(system.df, *MOVED_COLUMNS)


def _turned(face, low, high):
    return {"type": F.col("type") + 10, "mass": F.col("mass") * 2}


query("custom_boundary", f"{P} SELECT id, CASE WHEN {{t}} THEN type + 10 ELSE type END AS type, CASE WHEN {{t}} THEN mass * 2 ELSE mass END AS mass FROM p".replace("{t}", "state = 1 AND z BETWEEN -1 AND 1 AND x BETWEEN -1 AND 24 AND y BETWEEN -1 AND 24"))(
    lambda spark, d: B.apply(_p(spark, d), {("z", -1): B.Boundary("custom", 2.0, action=_turned)}, *_DOME).select("id", "type", "mass")
)


@query("built_system_force", f"{P}, e(src, dst) AS (VALUES (1, 2), (3, 40)) SELECT {FORCE_OUT} FROM (" + with_force_sql("p", "SELECT id, sum(fx) AS fx, sum(fy) AS fy, sum(fz) AS fz FROM (" + " UNION ALL ".join([
    f"SELECT id_a AS id, s * dx AS fx, s * dy AS fy, s * dz AS fz FROM (SELECT *, CASE WHEN greatest(type_a, type_b) = 0 THEN {LJ_SQL} WHEN least(type_a, type_b) = 0 AND greatest(type_a, type_b) = 1 AND r2 <= 4e0 THEN 1.5e0 * mass_a * mass_b / (r2 * sqrt(r2)) ELSE 0e0 END AS s FROM ({pair_sql('p', 3.0)}) WHERE r2 > 0)",
    *[f"SELECT {m}.id, {sign}4e0 * (b.x - a.x) AS fx, {sign}4e0 * (b.y - a.y) AS fy, {sign}4e0 * (b.z - a.z) AS fz FROM e JOIN p a ON e.src = a.id JOIN p b ON e.dst = b.id" for m, sign in (("a", ""), ("b", "-"))],
]) + ") GROUP BY id") + ")")
def built_system_force(spark, d):
    env = Environment().with_particles(_p(spark, d)).with_interaction(ToType(0), LJ).with_interaction(BetweenTypes(1, 0), laws.Gravity(2.0, 1.5))
    for scope in (ToType(1), ToType(2), BetweenTypes(0, 2), BetweenTypes(1, 2)):
        env.with_interaction(scope, NONE)
    for a, b in ((1, 2), (3, 40)):
        env.with_interaction(BetweenIds(a, b), laws.Harmonic(None, 4.0, 0.0))
    system, _ = env.build(spark)
    system.update_forces()
    return rounded(system.df, *FORCE)


#: Quotients and powers that no other query has; fmod keeps the sign of what is divided.
query("scalar_hyperbolic", f"{P} SELECT id, round(sinh(vx), 6) + 0e0 AS sinh, round(cosh(vy), 6) + 0e0 AS cosh, round(tanh(vz), 6) + 0e0 AS tanh, round(asinh(x), 6) + 0e0 AS asinh, round(acosh(1e0 + x), 6) + 0e0 AS acosh, round(atanh(vx / 2e0), 6) + 0e0 AS atanh, round(vx * 7e0 - trunc(vx * 7e0 / 2e0) * 2e0, 6) + 0e0 AS fmod, round(atan2(vy, vx), 6) + 0e0 AS atan2, round(cbrt(x), 6) + 0e0 AS cbrt, round(ln(1e0 + x), 6) + 0e0 AS log1p, round(exp(vx) - 1e0, 6) + 0e0 AS expm1 FROM p")(
    lambda spark, d: _p(spark, d).select(
        "id", *[(F.round(c, 6) + F.lit(0.0)).alias(n) for n, c in {
            "sinh": F.sinh("vx"), "cosh": F.cosh("vy"), "tanh": F.tanh("vz"), "asinh": F.asinh("x"), "acosh": F.acosh(F.col("x") + 1), "atanh": F.atanh(F.col("vx") / 2), "fmod": V.fmod(F.col("vx") * 7, F.lit(2.0)),
            "atan2": F.atan2("vy", "vx"), "cbrt": F.cbrt("x"), "log1p": F.log1p("x"), "expm1": F.expm1("vx"),
        }.items()]
    )
)
query("reduce_flags", f"{P} SELECT bool_or(vx > 0.99e0) AS any, bool_and(mass > 0.5e0) AS all, NOT bool_or(charge > 2e0) AS none FROM p WHERE (state & 1) <> 0")(
    lambda spark, d: kernels.flags(_p(spark, d), {"any": ("any", "vx > 0.99"), "all": ("all", "mass > 0.5"), "none": ("none", "charge > 2")})
)
