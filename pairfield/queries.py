"""The particle engine's queries, each with SQL for another engine over the same tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vec as V
from .operators import boundaries as B
from .operators import cells, forces, graph, observables, pairs
from .operators.integrate import YOSHIDA, System
from .plans import laws, spec
from .session import cut
from .sources.generators import BONDS_SQL, PARTICLES_SQL, derived, generated
from .streaming import triggers

LJ = laws.LennardJones(3.0, 5.0, 1.0)
BOX = (23.0, 23.0, 69.0)
LOW, HIGH = dict(zip("xyz", (0.5, 0.5, 0.5), strict=True)), dict(zip("xyz", (20.0, 20.0, 4.0), strict=True))
TYPE_LAWS = {(0, 0): laws.LennardJones(2.5, 1.0, 1.0), (1, 1): laws.Harmonic(2.0, 3.0, 1.2), (2, 2): laws.NoForce(), (0, 1): laws.Gravity(2.0, 1.5), (0, 2): laws.NoForce(), (1, 2): laws.Coulomb(2.2, 0.7)}
MIXED = {(0, 0): laws.LennardJones(2.0, 1.0, 1.0), (1, 1): laws.LennardJones(2.5, 4.0, 1.1), (2, 2): laws.LennardJones(3.0, 2.0, 0.9)}

Q: dict = {}
SQL: dict[str, str] = {}
P = f"WITH p AS ({PARTICLES_SQL})"


def _p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, PARTICLES_SQL)


def r6(c: str) -> str:
    return f"round({c}, 6) + 0e0 AS {c}"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[c if c in ("id", "state", "type") else (F.round(c, 6) + F.lit(0.0)).alias(c) for c in columns])


def query(name: str, sql: str | None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# -- pair queries -------------------------------------------------------------------------------------------------------
def pair_sql(source: str = "p", cutoff: float | None = None, box=None) -> str:
    d = {a: f"b.{a} - a.{a}" for a in "xyz"}
    if box:
        d = {a: f"(b.{a} - a.{a}) - {L}e0 * round((b.{a} - a.{a}) / {L}e0)" for a, L in zip("xyz", box, strict=True)}
    cols = ", ".join(f"{s}.{c} AS {c}_{s}" for s in "ab" for c in ("id", "type", "mass", "charge"))
    inner = f"SELECT {cols}, {', '.join(f'{d[a]} AS d{a}' for a in 'xyz')} FROM {source} a JOIN {source} b ON a.id <> b.id"
    where = "" if cutoff is None else f" WHERE r2 <= {cutoff * cutoff!r}e0"
    return f"SELECT * FROM (SELECT *, dx * dx + dy * dy + dz * dz AS r2 FROM ({inner})){where}"


def force_sql(source: str, scale: str, cutoff: float | None, box=None, more: str = "") -> str:
    one = f"SELECT id_a AS id, ({scale}) * dx AS fx, ({scale}) * dy AS fy, ({scale}) * dz AS fz FROM ({pair_sql(source, cutoff, box)}) WHERE r2 > 0"
    return f"SELECT id, sum(fx) AS fx, sum(fy) AS fy, sum(fz) AS fz FROM ({one}{more}) GROUP BY id"


def with_force_sql(source: str, force: str) -> str:
    return f"SELECT q.*, coalesce(f.fx, 0e0) AS fx, coalesce(f.fy, 0e0) AS fy, coalesce(f.fz, 0e0) AS fz FROM {source} q LEFT JOIN ({force}) f ON f.id = q.id"


FORCE = ("id", "fx", "fy", "fz")
FORCE_OUT = f"id, {r6('fx')}, {r6('fy')}, {r6('fz')}"


def _force_query(name: str, law, scale: str, cutoff: float | None, box=(None, None, None)) -> None:
    """``scale``: the law written out for the other engine."""
    sql = f"{P} SELECT {FORCE_OUT} FROM ({with_force_sql('p', force_sql('p', scale, cutoff, box if box[0] else None))})"
    query(name, sql)(lambda spark, d: rounded(forces.pair_forces(_p(spark, d), law, box=box), *FORCE))


LJ_SQL = "-(240e0 / (r2 * r2 * r2) - 120e0) / (r2 * r2 * r2 * r2)"
_UNIT_LJ_SQL = "-(48e0 / (r2 * r2 * r2) - 24e0) / (r2 * r2 * r2 * r2)"
_force_query("lj_net_force", LJ, LJ_SQL, 3.0)
_force_query("gravity_force", laws.Gravity(None, 1.0), "mass_a * mass_b / (r2 * sqrt(r2))", None)
_force_query("coulomb_force", laws.Coulomb(4.0, 1.5), "1.5e0 * charge_a * charge_b / (r2 * sqrt(r2))", 4.0)
_force_query("harmonic_force", laws.Harmonic(2.0, 10.0, 1.1), "10e0 * (sqrt(r2) - 1.1e0) / sqrt(r2)", 2.0)
_force_query("soft_gravity_force", laws.SoftGravity(3.0, 1.0, 0.3), "-mass_a * mass_b / ((r2 + 0.09e0) * sqrt(r2 + 0.09e0))", 3.0)
_force_query("periodic_force", laws.LennardJones(2.5, 1.0, 1.0), _UNIT_LJ_SQL, 2.5, BOX)


def _typed(name: str, given: dict, scale: str, reach: float) -> None:
    query(name, f"{P} SELECT {FORCE_OUT} FROM ({with_force_sql('p', force_sql('p', scale, reach))})")(lambda spark, d: rounded(forces.pair_forces(_p(spark, d), given, [0, 1, 2]), *FORCE))


_LEAST, _MOST = "least(type_a, type_b)", "greatest(type_a, type_b)"
_typed("type_pair_force", TYPE_LAWS, f"""CASE WHEN {_MOST} = 0 AND r2 <= 6.25e0 THEN {_UNIT_LJ_SQL} WHEN {_LEAST} = 1 AND {_MOST} = 1 AND r2 <= 4e0 THEN 3e0 * (sqrt(r2) - 1.2e0) / sqrt(r2)
    WHEN {_LEAST} = 0 AND {_MOST} = 1 AND r2 <= 4e0 THEN 1.5e0 * mass_a * mass_b / (r2 * sqrt(r2)) WHEN {_LEAST} = 1 AND {_MOST} = 2 AND r2 <= 4.84e0 THEN 0.7e0 * charge_a * charge_b / (r2 * sqrt(r2)) ELSE 0e0 END""", 2.5)  # fmt: skip


def _mixed_sql() -> str:
    """Depth, width and reach of a pair from those of its types: geometric, arithmetic and geometric mean."""
    pick = lambda s, values: f"CASE type_{s} WHEN 0 THEN {values[0]} WHEN 1 THEN {values[1]} ELSE {values[2]} END"
    eps, sigma, reach = ([pick(s, v) for s in "ab"] for v in (("1e0", "4e0", "2e0"), ("1e0", "1.1e0", "0.9e0"), ("2e0", "2.5e0", "3e0")))
    e, s6 = f"sqrt(({eps[0]}) * ({eps[1]}))", f"power((({sigma[0]}) + ({sigma[1]})) / 2e0, 6)"
    return f"CASE WHEN r2 <= ({reach[0]}) * ({reach[1]}) THEN -(48e0 * {e} * {s6} * {s6} / (r2 * r2 * r2) - 24e0 * {e} * {s6}) / (r2 * r2 * r2 * r2) ELSE 0e0 END"


_typed("mixed_lj_force", MIXED, _mixed_sql(), 3.0)

_BOND = laws.Harmonic(None, 5.0, 1.0)
_BONDED = "SELECT a.id AS id_a, b.id AS id_b, a.mass AS mass_a, b.mass AS mass_b, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z) AS r2 FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) e JOIN p a ON a.id = e.src JOIN p b ON b.id = e.dst"
_BOND_ROWS = "SELECT id_a AS id, " + ", ".join(f"5e0 * (sqrt(r2) - 1e0) / sqrt(r2) * d{a} AS f{a}" for a in "xyz") + f" FROM ({_BONDED}) WHERE r2 > 0"


@query("bond_force", f"{P}, e AS ({BONDS_SQL}) SELECT {FORCE_OUT} FROM ({with_force_sql('p', f'SELECT id, sum(fx) AS fx, sum(fy) AS fy, sum(fz) AS fz FROM ({_BOND_ROWS}) GROUP BY id')})")
def bond_force(spark, d):
    p = _p(spark, d)
    return rounded(forces.summed(p, forces.by_scale(pairs.bonded(p, derived(spark, d, BONDS_SQL), directed=False), _BOND.scale())), *FORCE)


@query("bond_plus_type_force", f"{P}, e AS ({BONDS_SQL}) SELECT {FORCE_OUT} FROM ({with_force_sql('p', force_sql('p', LJ_SQL, 3.0, None, f' UNION ALL {_BOND_ROWS}'))})")
def bond_plus_type_force(spark, d):
    return rounded(forces.pair_forces(_p(spark, d), LJ, bonds=derived(spark, d, BONDS_SQL), bond_law=_BOND), *FORCE)


@query("pair_list_cutoff", f"{P} SELECT id_a, id_b, {r6('r2')} FROM ({pair_sql('p', 1.3)}) WHERE id_a < id_b")
def pair_list_cutoff(spark, d):
    return pairs.grid(_p(spark, d), 1.3, directed=False).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), (F.round("r2", 6) + F.lit(0.0)).alias("r2"))


@query("periodic_pairs", f"{P} SELECT id_a, id_b, {r6('r2')} FROM ({pair_sql('p', 1.3, BOX)}) WHERE id_a < id_b")
def periodic_pairs(spark, d):
    return pairs.grid(_p(spark, d), 1.3, box=BOX, directed=False).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), (F.round("r2", 6) + F.lit(0.0)).alias("r2"))


@query("neighbor_count", f"{P} SELECT p.id, coalesce(n, 0) AS n FROM p LEFT JOIN (SELECT id_a, count(*) AS n FROM ({pair_sql('p', 2.0)}) GROUP BY id_a) c ON c.id_a = p.id")
def neighbor_count(spark, d):
    p = _p(spark, d)
    n = pairs.grid(p, 2.0).groupBy("id_a").agg(F.count("*").alias("n"))
    return p.join(n, p["id"] == n["id_a"], "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


_E = "(20e0 / (r2 * r2 * r2 * r2 * r2 * r2) - 20e0 / (r2 * r2 * r2))"


@query("lj_potential_energy", f"{P} SELECT round(sum({_E}), 6) + 0e0 AS potential_energy, count(*) AS pairs FROM ({pair_sql('p', 3.0)}) WHERE id_a < id_b")
def lj_potential_energy(spark, d):
    return observables.potential_energy(pairs.grid(_p(spark, d), 3.0), LJ.energy()).withColumn("potential_energy", F.round("potential_energy", 6) + F.lit(0.0))


@query("mixed_lj_params", """WITH t AS (SELECT DISTINCT CAST(p_size AS INT) AS type FROM part), l AS (SELECT type, type / 10e0 AS e, 1e0 + type / 100e0 AS s, 2e0 + type % 3 AS c FROM t)
SELECT a.type AS type_a, b.type AS type_b, round(sqrt(a.e * b.e), 9) AS epsilon, round((a.s + b.s) / 2e0, 9) AS sigma, round(CASE WHEN a.type = b.type THEN a.c ELSE sqrt(a.c * b.c) END, 9) AS cutoff FROM l a JOIN l b ON a.type <= b.type""")
def mixed_lj_params(spark, d):
    """A law for each pair of the parts' sizes, mixed from a law for each size."""
    types = [r["type"] for r in spark.read.parquet(f"{d}/part.parquet").select(F.col("p_size").cast("int").alias("type")).distinct().orderBy("type").collect()]  # one row a type
    table = laws.law_table({(t, t): laws.LennardJones(2.0 + t % 3, t / 10, 1 + t / 100) for t in types}, types)
    return spark.createDataFrame([(a, b, round(x.epsilon, 9), round(x.sigma, 9), round(x.reach, 9)) for (a, b), x in table.items()], "type_a int, type_b int, epsilon double, sigma double, cutoff double")


# -- filters, maps, boundaries ------------------------------------------------------------------------------------------
@query("region_query", f"{P} SELECT id FROM p WHERE state = 1 AND x BETWEEN 2 AND 9.2 AND y BETWEEN 2 AND 9.2 AND z BETWEEN 0 AND 3")
def region_query(spark, d):
    return _p(spark, d).filter(forces.inside((2, 2, 0), (9.2, 9.2, 3))).select("id")


@query("state_filter", f"{P} SELECT id, state FROM p WHERE (state & {forces.MOVABLE}) <> 0")
def state_filter(spark, d):
    return _p(spark, d).filter(forces.in_state(forces.MOVABLE)).select("id", "state")


MOVED = "id, state, " + ", ".join(r6(c) for c in ("x", "y", "z", "vx", "vy", "vz"))
MOVED_COLUMNS = ("id", "state", "x", "y", "z", "vx", "vy", "vz")


def kick_sql(source: str, dt: float, cols: str = "") -> str:
    v = ", ".join(f"CASE WHEN (state & 5) <> 0 THEN v{a} + {dt / 2!r}e0 * f{a} / mass ELSE v{a} END AS v{a}" for a in "xyz")
    return f"SELECT id, type, state, mass, charge, x, y, z, {v} FROM {source}"


def drift_sql(source: str, dt: float) -> str:
    x = ", ".join(f"CASE WHEN (state & 5) <> 0 THEN {a} + {dt!r}e0 * v{a} ELSE {a} END AS {a}, {a} AS o{a}" for a in "xyz")
    return f"SELECT id, type, state, mass, charge, {x}, vx, vy, vz FROM {source}"


@query("half_kick", f"{P}, f AS (SELECT *, 1e0 AS fx, -2e0 AS fy, 5e-1 AS fz FROM p) SELECT {MOVED} FROM ({kick_sql('f', 0.0123457)})")
def half_kick(spark, d):
    df = forces.uniform_field(_p(spark, d).withColumns({f"f{a}": F.lit(0.0) for a in "xyz"}), (1, -2, 0.5))
    return rounded(forces.half_kick(df, 0.0123457), *MOVED_COLUMNS)


@query("drift", f"{P} SELECT {MOVED} FROM ({drift_sql('p', 0.7)})")
def drift(spark, d):
    return rounded(forces.drift(_p(spark, d), 0.7), *MOVED_COLUMNS)


def crossed_sql(a: str, side: int) -> str:
    wall = HIGH[a] if side > 0 else LOW[a]
    part = f"({wall!r}e0 - o{a}) / nullif({a} - o{a}, 0e0)"
    others = " AND ".join(f"o{b} + {part} * ({b} - o{b}) BETWEEN {LOW[b]!r}e0 AND {HIGH[b]!r}e0" for b in "xyz" if b != a)
    beyond = f"{a} > {wall!r}e0 AND {a} - o{a} > 1e-12" if side > 0 else f"{a} < {wall!r}e0 AND {a} - o{a} < -1e-12"
    return f"coalesce(state = 1 AND {beyond} AND {others}, FALSE)"


def walls_sql(kind: str, source: str) -> str:
    """Nested selects, one per face, each over the rows as the one before left them."""
    keep = ["id", "type", "state", "mass", "charge", "x", "y", "z", "vx", "vy", "vz", "ox", "oy", "oz"]
    for a, side in B.FACES:
        wall = HIGH[a] if side > 0 else LOW[a]
        on = crossed_sql(a, side)
        new = {"absorbing": {"state": f"CASE WHEN {on} THEN 2 ELSE state END"}, "periodic": {a: f"CASE WHEN {on} THEN {a} - {side * (HIGH[a] - LOW[a])!r}e0 ELSE {a} END"}, "reflective": {a: f"CASE WHEN {on} THEN {2 * wall!r}e0 - {a} ELSE {a} END", f"v{a}": f"CASE WHEN {on} THEN -v{a} ELSE v{a} END"}, "open": {}}[kind]
        source = f"(SELECT {', '.join(f'{new[c]} AS {c}' if c in new else c for c in keep)} FROM {source})"
    return source


for _kind, _name in (("absorbing", "absorb"), ("periodic", "periodic_wrap"), ("reflective", "reflect"), ("open", "open_boundary")):

    @query(_name, f"{P} SELECT {MOVED} FROM {walls_sql(_kind, f'({drift_sql(chr(112), 0.7)})')}")
    def _walls(spark, d, kind=_kind):
        moved = cut(forces.drift(_p(spark, d), 0.7))
        return rounded(B.apply(moved, {f: B.Boundary(kind) for f in B.FACES}, LOW, HIGH), *MOVED_COLUMNS)


@query("face_crossing", f"{P}, m AS ({drift_sql('p', 0.7)}) SELECT id, " + ", ".join(f"{crossed_sql(a, s)} AS {a}{'plus' if s > 0 else 'minus'}" for a, s in B.FACES) + " FROM m")
def face_crossing(spark, d):
    m = forces.drift(_p(spark, d), 0.7)
    alive = F.col("state") == forces.ALIVE
    return m.select("id", *[F.coalesce(alive & B.crossed(a, s, LOW, HIGH), F.lit(False)).alias(f"{a}{'plus' if s > 0 else 'minus'}") for a, s in B.FACES])


WALLS = {"repulsive_exp": B.exponential(10.0, 2.0, 3.0), "repulsive_pow": B.power_law(2.0, 2.0, 3.0), "repulsive_lj93": B.lennard_jones_93(1.0, 1.0, 3.0), "repulsive_adhesive": B.adhesive_lennard_jones(1.0, 1.0, 3.0)}
WALL_LOW, WALL_HIGH = dict.fromkeys("xyz", -1.0), {"x": 24.0, "y": 24.0, "z": 70.0}


#: The same walls for the other engine, over a distance {d}.
WALLS_SQL = {
    "repulsive_exp": "CASE WHEN {d} > 3e0 THEN 0e0 ELSE 10e0 * exp(-{d} / 2e0) END",
    "repulsive_pow": "CASE WHEN {d} > 3e0 THEN 0e0 ELSE 2e0 / power({d}, 2e0) END",
    "repulsive_lj93": "CASE WHEN {d} > 3e0 THEN 0e0 ELSE 4e0 * (3e0 / ({d} * {d} * {d}) - 9e0 / ({d} * {d} * {d} * {d} * {d} * {d} * {d} * {d} * {d})) END",
    "repulsive_adhesive": "CASE WHEN {d} > 3e0 THEN 0e0 ELSE abs(24e0 * (2e0 / power({d}, 12) - 1e0 / power({d}, 6)) / {d}) END",
}


def repulsive_sql(wall: str) -> str:
    """``wall``: a size over the distance {d}."""
    out = []
    for a in "xyz":
        terms = []
        for side in (-1, 1):
            at = WALL_HIGH[a] if side > 0 else WALL_LOW[a]
            edge = f"{a} BETWEEN {at - 3 if side > 0 else at}e0 AND {at if side > 0 else at + 3}e0"
            others = " AND ".join(f"{b} BETWEEN {WALL_LOW[b]}e0 AND {WALL_HIGH[b]}e0" for b in "xyz" if b != a)
            size = "(" + wall.replace("{d}", f"abs({a} - ({at}e0))") + ")"
            terms.append(f"CASE WHEN state = 1 AND {edge} AND {others} THEN -({side}e0) * {size} ELSE 0e0 END")
        out.append(f"round({' + '.join(terms)}, 6) + 0e0 AS f{a}")
    return f"{P} SELECT id, {', '.join(out)} FROM p"


for _name, _wall in WALLS.items():

    @query(_name, repulsive_sql(WALLS_SQL[_name]))
    def _repulsive(spark, d, wall=_wall):
        p = _p(spark, d).withColumns({f"f{a}": F.lit(0.0) for a in "xyz"})
        return rounded(B.apply(p, {f: B.Boundary("repulsive", 3.0, wall) for f in B.FACES}, WALL_LOW, WALL_HIGH), *FORCE)


@query("uniform_field", f"{P} SELECT id, 1e0 AS fx, -9.81e0 AS fy, 0e0 AS fz FROM p")
def uniform_field(spark, d):
    return rounded(forces.uniform_field(_p(spark, d).withColumns({f"f{a}": F.lit(0.0) for a in "xyz"}), (1, -9.81, 0)), *FORCE)


@query("local_field", f"{P} SELECT id, CASE WHEN x BETWEEN 5 AND 10 AND y BETWEEN 5 AND 10 AND z BETWEEN 0 AND 10 THEN 10e0 ELSE 0e0 END AS fx, 0e0 AS fy, 0e0 AS fz FROM p")
def local_field(spark, d):
    df = _p(spark, d).withColumns({f"f{a}": F.lit(0.0) for a in "xyz"})
    return rounded(forces.local_field(df, (10, 0, 0), (5, 5, 0), (10, 10, 10), 3.0, 0.0, 10.0), *FORCE)


# -- integration --------------------------------------------------------------------------------------------------------
def chain_sql(steps: list[float]) -> str:
    """Verlet steps as a chain of CTEs."""
    f = lambda s: with_force_sql(s, force_sql(s, LJ_SQL, 3.0))
    out, at = f"{P}, s0 AS ({f('p')})", "s0"
    for i, dt in enumerate(steps):
        out += f", k{i} AS ({kick_sql(at, dt)}), d{i} AS ({drift_sql(f'k{i}', dt)}), g{i} AS ({f(f'd{i}')}), n{i} AS ({kick_sql(f'g{i}', dt)})"
        at = f"n{i}"
        if i + 1 < len(steps):
            out += f", w{i} AS (SELECT n{i}.*, g{i}.fx, g{i}.fy, g{i}.fz FROM n{i} JOIN g{i} ON n{i}.id = g{i}.id)"
            at = f"w{i}"
    return f"{out} SELECT {MOVED} FROM {at}".replace("WITH p AS", "WITH p AS MATERIALIZED", 1)


def _steps(spark, d, method: str, dt: float, n: int) -> DataFrame:
    system = System(_p(spark, d), partial(forces.pair_forces, law=LJ))
    system.update_forces()
    for _ in range(n):
        getattr(system, method)(dt)
    return rounded(system.df, *MOVED_COLUMNS)


query("verlet_step", chain_sql([0.005]))(lambda spark, d: _steps(spark, d, "verlet", 0.005, 1))
query("verlet_3steps", chain_sql([0.005] * 3))(lambda spark, d: _steps(spark, d, "verlet", 0.005, 3))
query("yoshida_step", chain_sql([w * 0.005 for w in YOSHIDA]))(lambda spark, d: _steps(spark, d, "yoshida", 0.005, 1))


# -- observables --------------------------------------------------------------------------------------------------------
@query("bounding_box", f"{P} SELECT " + ", ".join(f"{m}({a}) AS {m}_{a}" for a in "xyz" for m in ("min", "max")) + " FROM p")
def bounding_box(spark, d):
    return observables.bounding_box(_p(spark, d))


@query("domain_resolve", f"{P} SELECT " + ", ".join(f"round(min({a}) - greatest((max({a}) - min({a})) * 0.5e0, 1e0), 6) AS min_{a}, round(max({a}) + greatest((max({a}) - min({a})) * 0.5e0, 1e0), 6) AS max_{a}" for a in "xyz") + " FROM p")
def domain_resolve(spark, d):
    return rounded(observables.domain(_p(spark, d), 0.5, 1.0), *[f"{m}_{a}" for a in "xyz" for m in ("min", "max")])


@query("kinetic_energy", f"{P} SELECT round(sum(mass * (vx * vx + vy * vy + vz * vz) / 2), 6) AS kinetic_energy FROM p")
def kinetic_energy(spark, d):
    return rounded(observables.kinetic_energy(_p(spark, d)), "kinetic_energy")


@query("momentum", f"{P} SELECT " + ", ".join(f"round(sum(mass * v{a}), 6) + 0e0 AS p{a}" for a in "xyz") + " FROM p")
def momentum(spark, d):
    return rounded(observables.momentum(_p(spark, d)), "px", "py", "pz")


_T = "(SELECT sum(mass * ((vx - ux) * (vx - ux) + (vy - uy) * (vy - uy) + (vz - uz) * (vz - uz))) / (3 * count(*)) AS t, any_value(ux) AS ux, any_value(uy) AS uy, any_value(uz) AS uz FROM p, (SELECT avg(vx) AS ux, avg(vy) AS uy, avg(vz) AS uz FROM p))"


@query("temperature", f"{P} SELECT round(t, 6) AS temperature FROM {_T}")
def temperature(spark, d):
    return rounded(observables.temperature(_p(spark, d)), "temperature")


@query("thermostat_scale", f"{P} SELECT id, " + ", ".join(f"round(u{a} + sqrt((t + 0.5e0) / t) * (v{a} - u{a}), 6) + 0e0 AS v{a}" for a in "xyz") + f" FROM p, {_T} t")
def thermostat_scale(spark, d):
    return rounded(observables.thermostat(_p(spark, d), 1000.0, 0.5), "id", "vx", "vy", "vz")


_CELL = ", ".join(f"CAST(floor(({a} - 0e0) / 3e0) AS BIGINT) AS c{a}" for a in "xyz")
_FLAT = f"SELECT *, CASE WHEN cx BETWEEN 0 AND 7 AND cy BETWEEN 0 AND 7 AND cz BETWEEN 0 AND 22 THEN cz * 64 + cy * 8 + cx ELSE -1 END AS cell FROM (SELECT *, {_CELL} FROM p)"


def _cells(spark, d) -> DataFrame:
    return cells.cell_index(_p(spark, d), dict.fromkeys("xyz", 0.0), 3.0, {"x": 8, "y": 8, "z": 23})


query("cell_index", f"{P} SELECT id, cx, cy, cz, cell FROM ({_FLAT})")(lambda spark, d: _cells(spark, d).select("id", "cx", "cy", "cz", "cell"))
query("cell_histogram", f"{P} SELECT cell, type, count(*) AS count FROM ({_FLAT}) GROUP BY cell, type")(lambda spark, d: cells.histogram(_cells(spark, d)))
query("cell_prefix_sum", f"{P}, n AS (SELECT cell, count(*) AS n FROM ({_FLAT}) GROUP BY cell) SELECT cell, n, CAST(coalesce(sum(n) OVER (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM n")(lambda spark, d: cells.prefix_sums(cells.histogram(_cells(spark, d))))
_MORTON = " | ".join(f"(((c{a} >> {b}) & 1) << {3 * b + i})" for b in range(10) for i, a in enumerate("xyz"))
query("morton_key", f"{P} SELECT id, {_MORTON} AS key FROM ({_FLAT})")(lambda spark, d: _cells(spark, d).select("id", cells.morton(F.col("cx"), F.col("cy"), F.col("cz"), 10).alias("key")))


def _hilbert_sql(bits: int) -> str:
    """The curve by its coordinates' bits: from the highest plane down, each axis flips the lower bits of the first or trades them with it;
    then Gray code along the axes and down the planes, and the bits are dealt axis by axis."""
    source = f"(SELECT id, cx AS x, cy AS y, cz AS z FROM ({_FLAT}))"
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for axis in "xyz":
            flip, low = f"({axis} & {q}) <> 0", q - 1
            trade = f"(xor(x, {axis}) & {low})"
            new = {"x": f"CASE WHEN {flip} THEN xor(x, {low}) ELSE xor(x, {trade}) END", axis: f"CASE WHEN {flip} THEN {axis} ELSE xor({axis}, {trade}) END"}
            if axis == "x":
                new = {"x": f"CASE WHEN {flip} THEN xor(x, {low}) ELSE x END"}
            source = f"(SELECT id, {', '.join(f'{new.get(a, a)} AS {a}' for a in 'xyz')} FROM {source})"
    source = f"(SELECT id, x, xor(x, y) AS y, xor(xor(x, y), z) AS z FROM {source})"
    odd = "0"
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        odd = f"xor({odd}, CASE WHEN (z & {q}) <> 0 THEN {q - 1} ELSE 0 END)"
    source = f"(SELECT id, xor(x, t) AS x, xor(y, t) AS y, xor(z, t) AS z FROM (SELECT *, {odd} AS t FROM {source}))"
    key = " + ".join(f"((({a} >> {b}) & 1) << {3 * b + 2 - i})" for b in range(bits) for i, a in enumerate("xyz"))
    return f"{P} SELECT id, CAST({key} AS BIGINT) AS key FROM {source}"


query("hilbert_key", _hilbert_sql(5))(lambda spark, d: cells.hilbert(_cells(spark, d), "cx", "cy", "cz", 5).select("id", "key"))

# -- declarations, generators, triggers, graphs -------------------------------------------------------------------------
query("type_map", "SELECT user_type, CAST(dense_rank() OVER (ORDER BY user_type) - 1 AS INT) AS type FROM (SELECT DISTINCT CAST(p_size AS INT) AS user_type FROM part)")(lambda spark, d: spec.type_map(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_size").cast("int").alias("type"))))
query("id_map", f"{P}, e AS (SELECT * FROM ({BONDS_SQL})), b AS (SELECT src AS n FROM e UNION SELECT dst FROM e) SELECT p.id AS user_id, row_number() OVER (ORDER BY b.n IS NULL, p.id) - 1 AS id FROM p LEFT JOIN b ON b.n = p.id")(lambda spark, d: spec.id_map(_p(spark, d), derived(spark, d, BONDS_SQL)))
query("auto_ids", "WITH r AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey * 2 END AS id FROM part), m AS (SELECT k, row_number() OVER (ORDER BY k) AS n FROM r WHERE id IS NULL), f AS (SELECT g AS id, row_number() OVER (ORDER BY g) AS n FROM range((SELECT count(*) FROM part)) t(g) WHERE g NOT IN (SELECT id FROM r WHERE id IS NOT NULL)) SELECT k, id FROM r WHERE id IS NOT NULL UNION ALL SELECT m.k, f.id FROM m JOIN f USING (n)")(lambda spark, d: spec.assign_ids(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey") * 2).alias("id")), "k"))
#: A box for each nation and an ellipsoid for each region.
_BOXES = "SELECT 'cuboid' AS kind, n_nationkey * 100 AS first_id, 1e0 + n_nationkey AS x, 2e0 AS y, 3e0 AS z, CAST(2 + n_regionkey AS DOUBLE) AS a, 3e0 AS b, 4e0 AS c, 5e-1 AS spacing FROM nation"
_BALLS = "SELECT 'ellipsoid' AS kind, r_regionkey * 1000 AS first_id, r_regionkey * 1e1 AS x, 0e0 AS y, 0e0 AS z, 3e0 AS a, 1e0 + r_regionkey AS b, 4e0 AS c, 1e0 AS spacing FROM region"


def _generated(spark, d, sql: str, table: str) -> DataFrame:
    return generated(spark.sql(sql.replace(f"FROM {table}", "FROM {t}"), t=spark.read.parquet(f"{d}/{table}.parquet")))


query("cuboid_gen", f"SELECT first_id + i AS id, x + (i // 12) * 5e-1 AS x, y + (i // 4 % 3) * 5e-1 AS y, z + (i % 4) * 5e-1 AS z FROM (SELECT *, unnest(range(CAST(a AS BIGINT) * 12)) AS i FROM ({_BOXES}))")(lambda spark, d: _generated(spark, d, _BOXES, "nation"))
query("sphere_gen", f"SELECT x + i AS x, y + j AS y, z + k AS z FROM (SELECT *, unnest(range(-4, 5)) AS k FROM (SELECT *, unnest(range(-6, 7)) AS j FROM (SELECT *, unnest(range(-3, 4)) AS i FROM ({_BALLS})))) WHERE i * i / 9e0 + j * j / (b * b) + k * k / 16e0 < 1")(lambda spark, d: _generated(spark, d, _BALLS, "region").select("x", "y", "z"))


def _clock(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("step"), (F.col("event_id") * F.lit(0.01)).alias("time"))


query("trigger_every", "SELECT event_id AS step FROM events WHERE (event_id + 1) % 3 = 0")(lambda spark, d: _clock(spark, d).filter(triggers.every(3, 1).column()).select("step"))
query("trigger_between", "SELECT event_id AS step FROM events WHERE event_id >= 3 AND event_id < 500 AND NOT event_id = 7")(lambda spark, d: _clock(spark, d).filter((triggers.between(3, 500) & ~triggers.at_step(7)).column()).select("step"))
_CHAIN = f"e AS ({BONDS_SQL})"
query("unique_nodes", f"WITH {_CHAIN} SELECT src AS node FROM e UNION SELECT dst FROM e")(lambda spark, d: graph.unique_nodes(derived(spark, d, BONDS_SQL)))
query("connected_components", f"WITH RECURSIVE {_CHAIN}, u AS (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e), r(node, seen) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.seen = u.a) SELECT node, min(seen) AS component FROM r GROUP BY node")(lambda spark, d: graph.components(derived(spark, d, BONDS_SQL)))
query("intersection_graph", "WITH m AS (SELECT DISTINCT p_size AS set_id, p_partkey AS node FROM part UNION SELECT p_size, p_partkey + 7 FROM part) SELECT DISTINCT a.set_id AS a, b.set_id AS b FROM m a JOIN m b USING (node) WHERE a.set_id <> b.set_id")(lambda spark, d: graph.intersection_graph(_sets_of_parts(spark, d)))
query("dup_pairs", "SELECT least(l_partkey % 50, l_suppkey % 50) AS a, greatest(l_partkey % 50, l_suppkey % 50) AS b, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")(lambda spark, d: spec.repeated_pairs(spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_partkey") % 50).alias("a"), (F.col("l_suppkey") % 50).alias("b"))))


def _sets_of_parts(spark, d) -> DataFrame:
    """Sets by part size; each part is also in the set of the part seven keys before it."""
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_size").alias("set_id"), F.explode(F.array("p_partkey", F.col("p_partkey") + 7)).alias("node"))
    return part.distinct()


@query("vec_ops", f"{P} SELECT id, round(x * vx + y * vy + z * vz, 9) + 0e0 AS dot, round(sqrt(x * x + y * y + z * z), 6) AS norm, greatest(x, y, z) AS largest, least(x, y, z) AS least, (vx > 0 AND vy > 0 AND vz > 0) AS all_up FROM p")
def vec_ops(spark, d):
    x, v = V.Vec.of(), V.Vec.of("v")
    return _p(spark, d).select("id", (F.round(x.dot(v), 9) + F.lit(0.0)).alias("dot"), F.round(x.norm(), 6).alias("norm"), x.largest().alias("largest"), x.least().alias("least"), v.all(lambda c: c > 0).alias("all_up"))


@query("scalar_math", f"{P} SELECT id, round(1 / sqrt(x + 1), 6) AS rsqrt, round(power(2e0, vx), 6) AS exp2, trunc(vx * 3) + 0e0 AS trunc, round(sqrt(x * x + y * y + z * z), 6) AS hypot, least(greatest(vx, -0.5e0), 0.5e0) AS clamp, round(x - 2 * round_even(x / 2, 0), 6) + 0e0 AS remainder FROM p")
def scalar_math(spark, d):
    x, vx = F.col("x"), F.col("vx")
    return _p(spark, d).select("id", F.round(V.rsqrt(x + 1), 6).alias("rsqrt"), F.round(V.exp2(vx), 6).alias("exp2"), (V.truncate(vx * 3) + F.lit(0.0)).alias("trunc"), F.round(V.hypot3(x, F.col("y"), F.col("z")), 6).alias("hypot"), V.clamp(vx, F.lit(-0.5), F.lit(0.5)).alias("clamp"), (F.round(V.remainder(x, F.lit(2.0)), 6) + F.lit(0.0)).alias("remainder"))


from . import neighbour_queries, source_queries, system_queries  # noqa: E402, F401  register their queries here
