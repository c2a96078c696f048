import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pairfield import queries
from pairfield.operators import boundaries as B
from pairfield.operators import cells, forces, graph, observables, pairs
from pairfield.operators.integrate import System, run
from pairfield.plans import laws, spec
from pairfield.sources import files
from pairfield.sources.generators import cuboid, ellipsoid
from pairfield.streaming import triggers as T

SCHEMA = "id long, type int, x double, y double, z double, vx double, vy double, vz double, mass double, charge double, state int"


def particles(spark, rows):
    return spark.createDataFrame([(i, t, *map(float, p), *map(float, v), float(m), float(q), s) for i, t, p, v, m, q, s in rows], SCHEMA)


PAIR = [(0, 0, (0, 0, 0), (0, 0, 0), 10, 1, 1), (1, 0, (2, 0, 0), (0, 0, 0), 20, -2, 1)]


@pytest.mark.parametrize("law, want", [(laws.Gravity(None, 1.0), 50), (laws.Harmonic(None, 10.0, 1.0), 10), (laws.Harmonic(None, 10.0, 3.0), -10), (laws.Coulomb(None, 1.0), -0.5), (laws.LennardJones(None, 1.0, 2.0), -12), (laws.NoForce(), 0)])
def test_laws(spark, law, want):
    out = {r["id"]: r for r in forces.pair_forces(particles(spark, PAIR), law).collect()} if not isinstance(law, laws.NoForce) else {0: {"fx": 0.0}, 1: {"fx": 0.0}}
    assert out[0]["fx"] == pytest.approx(want, abs=1e-9)
    assert out[1]["fx"] == pytest.approx(-want, abs=1e-9)


def test_mixing():
    h = laws.Harmonic(5.0, 100.0, 1.0).mix(laws.Harmonic(10.0, 50.0, 2.0))
    assert (round(h.k, 4), h.r0, h.cutoff) == (66.6667, 1.5, 10.0)
    lj = laws.LennardJones(9.0, 1.0, 2.0).mix(laws.LennardJones(16.0, 4.0, 4.0))
    assert (lj.epsilon, lj.sigma, lj.cutoff) == (2.0, 3.0, 12.0)
    with pytest.raises(laws.MixingError):
        laws.Gravity(None, 1.0).mix(laws.Gravity(None, 2.0))
    with pytest.raises(laws.MixingError):
        laws.Gravity(None, 1.0).mix(laws.Coulomb(None, 1.0))
    with pytest.raises(ValueError):
        laws.law_table({(0, 0): laws.NoForce()}, [0, 1])


def test_grid_equals_direct(spark):
    p = cuboid(spark, (0.5, 0.5, 0.5), (6, 6, 6), 1.15).withColumns({"charge": F.lit(1.0), "x": F.col("x") + (F.col("id") * 7919 % 100) / 1000})
    key = lambda df: {(r[0], r[1]) for r in df.select("id_a", "id_b").collect()}
    for box in ((None, None, None), (7.0, 7.0, None)):
        assert key(pairs.grid(p, 2.0, box=box)) == key(pairs.direct(p, 2.0, box=box))


def test_net_force_is_zero(spark):
    p = cuboid(spark, (0, 0, 0), (4, 4, 4), 2.0).withColumn("charge", F.lit(0.0))
    total = forces.pair_forces(p, laws.LennardJones(3.0, 5.0, 1.0)).agg(*[F.sum(f"f{a}") for a in "xyz"]).first()
    assert max(map(abs, total)) < 1e-11


@pytest.mark.parametrize("a", "xyz")
@pytest.mark.parametrize("side", [-1, 1])
def test_periodic_wrap(spark, a, side):
    at = {"x": 5.0, "y": 5.0, "z": 5.0} | {a: 9.6 if side > 0 else 0.4}
    p = particles(spark, [(0, 0, (at["x"], at["y"], at["z"]), tuple(side * (b == a) for b in "xyz"), 1, 0, 1)])
    out = B.apply(forces.drift(p, 1.0), {f: B.Boundary("periodic") for f in B.FACES}, dict.fromkeys("xyz", 0.0), dict.fromkeys("xyz", 10.0)).first()
    assert out[a] == pytest.approx(0.6 if side > 0 else 9.4)


def test_periodic_faces_come_in_pairs():
    with pytest.raises(ValueError):
        B.check({("x", 1): B.Boundary("periodic")})


def test_verlet_keeps_momentum_and_stationary_rows(spark):
    p = particles(spark, [(0, 0, (0, 0, 0), (0.1, 0, 0), 1, 0, 1), (1, 0, (1.2, 0, 0), (-0.1, 0, 0), 1, 0, 1), (2, 0, (9, 9, 9), (1, 1, 1), 1, 0, 8)])
    fired = []
    s = run(System(p, lambda d: forces.pair_forces(d, laws.LennardJones(2.5, 5.0, 1.0))), 0.001, 3, monitors=[(T.every(2), lambda x: fired.append(x.step))])
    assert fired == [2]
    rows = {r["id"]: r for r in s.df.collect()}
    assert rows[0]["vx"] + rows[1]["vx"] == pytest.approx(0, abs=1e-13)
    assert rows[2]["x"] == 9.0


def test_temperature(spark):
    p = particles(spark, [(i, 0, (i, 0, 0), (v, 0, 0), 1, 0, 1) for i, v in enumerate((1, -1, 1, -1))])
    assert observables.temperature(p, 2).first()["temperature"] == pytest.approx(0.5)
    with pytest.raises(ValueError):
        observables.thermostat(p, 1.0, -1.0)


def test_generators(spark):
    rows = cuboid(spark, (1, 2, 3), (2, 3, 4), 0.5).orderBy("id").collect()
    assert len(rows) == 24 and (rows[-1]["x"], rows[-1]["y"], rows[-1]["z"]) == (1.5, 3.0, 4.5)
    assert ellipsoid(spark, (0, 0, 0), (2, 2, 0), 1.0).count() == 9
    assert ellipsoid(spark, (0, 0, 0), (0.5, 0.5, 0.5), 1.0).count() == 1
    with pytest.raises(ValueError):
        cuboid(spark, (0, 0, 0), (1, 1, 1), 0)


def test_spec(spark):
    df = spark.createDataFrame([(0, 1), (1, None), (2, 10), (3, None)], "k int, id long")
    assert [r["id"] for r in spec.assign_ids(df, "k").orderBy("k").collect()] == [1, 0, 10, 2]
    ids = spark.createDataFrame([(200,), (50,), (10,), (100,)], "id long")
    bond = spark.createDataFrame([(10, 50)], "src long, dst long")
    assert dict(map(tuple, spec.id_map(ids, bond).collect())) == {10: 0, 50: 1, 100: 2, 200: 3}
    for bad in ([(1, 1.0, 1), (1, 1.0, 1)], [(1, 0.0, 1)], [(1, 1.0, 128)], [(1, 1.0, 0)]):
        with pytest.raises(spec.SpecError):
            spec.validate(spark.createDataFrame(bad, "id long, mass double, state int"))
    assert spec.resolve_domain((3, 4, 5), (3, 4, 5), extent=(4, 4, 4))[0] == (1, 2, 3)
    assert spec.resolve_domain((1, 2, 3), (3, 4, 5), factor=2)[0] == (-3, -2, -1)
    with pytest.raises(spec.SpecError):
        spec.resolve_domain((0, 0, 0), (9, 9, 9), origin=(1, 1, 1), extent=(2, 2, 2))


def test_triggers():
    fire = lambda t, n, dt=1.0: [s for s in range(n) if t(T.Moment(s * dt, s))]
    assert fire(T.every(3), 10) == [0, 3, 6, 9]
    assert fire(T.every(3, 1), 10) == [2, 5, 8]
    assert fire(T.after(4), 7) == [4, 5, 6]
    assert fire(T.between(3, 5) & ~T.at_step(4), 9) == [3]
    assert len(fire(T.periodically(0.03), 8, 0.01)) == 3


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 6), (7, 8)], "src long, dst long")
    assert len({r["component"] for r in graph.components(e).collect()}) == 3


def test_hilbert_is_a_path(spark):
    n = 8
    df = spark.range(n**3).select(*[(F.floor(F.col("id") / n**k) % n).alias(a) for k, a in enumerate("xyz")])
    rows = cells.hilbert(df, "x", "y", "z", 3).select("x", "y", "z", "key").orderBy("key").collect()
    assert [r["key"] for r in rows] == list(range(n**3))
    assert all(math.dist(a[:3], b[:3]) == 1 for a, b in zip(rows[:-1], rows[1:], strict=True))


def test_files(spark, tmp_path):
    p = particles(spark, [(0, 2, (1, 2, 3), (0, 0, 0), 1, 0, 1), (1, 5, (-4.5, 6.25, 8), (0, 0, 0), 1, 0, 1)])
    to = files.write_xyz(p, str(tmp_path / "xyz"), 4, 0.125)
    text = "".join(f.read_text() for f in sorted(Path(to).glob("part-*")))
    assert text == "2\nstep=4 time=0.125\nT2 1 2 3\nT5 -4.5 6.25 8\n"
    v = files.write_vtp(p, str(tmp_path), "f", 1, ("type", "id"), rows=1)
    files.write_pvd(str(tmp_path), "f", [(0.1, v)])
    master, pieces = Path(v).read_text(), sorted((tmp_path / "f_00001").iterdir())
    assert [f"f_00001/{x.name}" in master for x in pieces] == [True] * len(pieces) and sum('NumberOfPoints="1"' in x.read_text() for x in pieces) == len(pieces) == 2


@pytest.mark.parametrize("name", ["lj_net_force", "reflect", "morton_key"])
def test_against_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("create view part as select * from '/root/testdata/sf0.001/part.parquet'")
    want = sorted(map(tuple, con.execute(f"select * from ({queries.SQL[name]})").fetchall()))
    got = sorted(map(tuple, queries.Q[name](spark, "/root/testdata/sf0.001").collect()))
    assert [g[0] for g in got] == [w[0] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, abs=1e-6)
