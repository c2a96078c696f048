import io

import pytest
from pyspark.sql import functions as F

from pairfield import system_queries
from pairfield.functions import vec as V
from pairfield.operators import boundaries as B
from pairfield.operators import cells, forces, kernels, observables, pairs
from pairfield.operators.integrate import System, run, run_for_duration
from pairfield.plans import laws, spec
from pairfield.plans.environment import BetweenIds, BetweenTypes, Environment, ToType
from pairfield.plans.geometry import Box, Domain
from pairfield.sources import files, monitors, ordered, snapshots
from pairfield.sources.generators import cuboid, maxwell_boltzmann, thermal
from pairfield.streaming import triggers as T

NONE = laws.NoForce()


def env_of(*rows):
    env = Environment().with_interaction(ToType(0), NONE)
    for r in rows:
        env.with_particle(**r)
    return env


def force_of(system):
    system.update_forces()
    return {r["id"]: (r["fx"], r["fy"], r["fz"]) for r in system.df.collect()}


def test_symmetric_constant_counts_all_others(spark):
    env = Environment().with_interaction(ToType(0), laws.SymmetricConstant(None, (1.0, 0.0, 0.0)))
    for _ in range(33):
        env.with_particle((0, 0, 0))
    assert set(force_of(env.build(spark)[0]).values()) == {(32.0, 0.0, 0.0)}


def test_bipartite_constant(spark):
    env = Environment().with_interaction(ToType(0), NONE).with_interaction(ToType(1), NONE).with_interaction(BetweenTypes(1, 0), laws.Constant(None, (1.0, 2.0, 3.0)))
    for i in range(32):
        env.with_particle((float(i >= 20), 0, 0), type=int(i >= 20))
    got = force_of(env.build(spark)[0])
    assert {v for k, v in got.items() if k < 20} == {(12.0, 24.0, 36.0)} and {v for k, v in got.items() if k >= 20} == {(-20.0, -40.0, -60.0)}


def test_constants_mix_by_sum():
    assert laws.Constant(None, (4.0, 5.0, 6.0)).mix(laws.Constant(None, (1.0, 2.0, 3.0))).force == (5.0, 7.0, 9.0)


def test_type_chain(spark):
    env = Environment()
    for a, b, law in ((0, 1, laws.Harmonic(None, 100.0)), (1, 2, laws.Harmonic(None, 10.0)), (0, 2, NONE)):
        env.with_interaction(BetweenTypes(a, b), law)
    for t in range(3):
        env.with_interaction(ToType(t), NONE)
    for t, at in enumerate(((0, 0, 0), (1, 0, 0), (1, 1, 0))):
        env.with_particle(at, type=t)
    got = force_of(env.build(spark)[0])
    assert [got[i] for i in range(3)] == [(100, 0, 0), (-100, 10, 0), (0, -10, 0)]


def test_bond_by_ids_and_build_errors(spark):
    two = ({"position": (0, 0, 0), "id": 42}, {"position": (0, 1, 0), "id": 99})
    got = force_of(env_of(*two).with_interaction(BetweenIds(42, 99), laws.Constant(None, (-1.0, 2.0, -3.0))).build(spark)[0])
    assert got == {42: (-1, 2, -3), 99: (1, -2, 3)}
    for bad in (env_of(*two).with_interaction(BetweenIds(42, 7), laws.Harmonic()), env_of(*two).with_interaction(BetweenIds(42, 42), laws.Harmonic()), env_of(*two).with_interaction(ToType(0), NONE), env_of(*two).with_domain((5, 5, 5), (1, 1, 1)), Environment()):
        with pytest.raises(ValueError):
            bad.build(spark)
    with pytest.raises(ValueError):
        env_of(*two).with_particle((1, 1, 1), id=42)


def test_environment_maps_and_domain(spark):
    env = env_of({"position": (1, 2, 3)}, {"position": (3, 4, 5), "id": 10}).with_particles(lambda s: cuboid(s, (2, 3, 4), (1, 1, 1), 1.0, first_id=50)).with_padding(factor=2)
    _, info = env.build(spark)
    assert info.domain == Box((-3, -2, -1), (7, 8, 9)) and info.particle_box == Box((1, 2, 3), (3, 4, 5))
    assert sorted(map(tuple, info.ids.collect())) == [(0, 0), (10, 1), (50, 2)] and info.types.count() == 1


def test_geometry():
    box = Box((0, 0, 0), (2, 2, 2))
    assert box.intersection(Box((2, 0, 0), (3, 1, 1))) == Box((2, 0, 0), (2, 1, 1)) and box.intersection(Box((3, 0, 0), (4, 1, 1))) is None
    assert Domain((1, 1, 1), (-1, 2, 3)).min_corner() == (0, 1, 1) and Domain.from_min_max((0, 0, 0), (1, 2, 3)).volume() == 6 == Box.from_domain(Domain((0, 0, 0), (1, 2, 3))).volume()
    assert Domain.from_center_and_size((0, 0, 0), (2, 2, 2)).origin == (-1, -1, -1)
    with pytest.raises(spec.SpecError):
        Box.from_domain(Domain((0, 0, 0)))


def test_kernels(spark):
    p = cuboid(spark, (0, 0, 0), (2, 2, 2), 1.0).withColumn("state", F.when(F.col("id") < 3, 2).otherwise(1))
    assert kernels.size(p, forces.ALIVE).first()[0] == 5 and tuple(kernels.id_range(p).first()) == (0, 8)
    assert kernels.reduce(p, "x", "plus", 10.0, forces.ALL).first()[0] == 14 and kernels.reduce(p.limit(0), "x", "min", 3.0).first()[0] == 3
    assert kernels.view_id(kernels.at_id(p, 3, mass=9.0), 3)["mass"] == 9.0
    with pytest.raises(KeyError):
        kernels.view_id(p, 99)
    sneaky = kernels.Kernel(("x",), (), lambda c: {"x": c["x"]})
    with pytest.raises(ValueError):
        kernels.for_each_particle(p, sneaky)


def test_ranked_over_many_ranges(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    assert spec.ranked(df, "n", "k").filter("n <> k").count() == 0 and spec.ranked(df.limit(0), "n", "k").count() == 0


def test_temperature_with_a_large_mean(spark):
    p = cuboid(spark, (0, 0, 0), (4, 1, 1), 1.0, mean=(1e8, 0, 0)).withColumn("vx", F.col("vx") + F.when(F.col("id") % 2 == 0, 1).otherwise(-1))
    assert observables.temperature(p, 2).first()["temperature"] == pytest.approx(0.5)


def test_heat_reaches_the_temperature(spark):
    hot = observables.heat(cuboid(spark, (0, 0, 0), (10, 10, 10), 1.0), 40.0)
    row = observables.temperature(hot).first()
    assert row["temperature"] == pytest.approx(40, rel=0.1) and abs(row["ux"]) < 1
    spun = thermal(cuboid(spark, (0, 0, 0), (2, 1, 1), 1.0), lambda x, y, z: (x, y, F.lit(1.0)))
    assert [(r["vx"], r["vz"]) for r in spun.orderBy("id").collect()] == [(0, 1), (1, 1)]


def test_walls_push_in_a_run(spark):
    p = cuboid(spark, (0.5, 5, 5), (1, 1, 1), 1.0).withColumn("charge", F.lit(0.0))
    walls = {("x", -1): B.Boundary("repulsive", 2.0, "3e0")}
    for push, v in ((True, 0.3), (False, 0.0)):
        s = System(p, lambda d: forces.pair_forces(d, NONE), walls, dict.fromkeys("xyz", 0.0), dict.fromkeys("xyz", 10.0), walls_push=push)
        out = run(s, 0.1, 1).df.first()
        assert out["vx"] == pytest.approx(v / 2)


def test_monitors(spark, tmp_path):
    p = cuboid(spark, (0, 0, 0), (2, 1, 1), 1.0).withColumn("charge", F.lit(0.0))
    system = System(p, lambda d: forces.pair_forces(d, NONE))
    bench, said, bar = monitors.Benchmark(), io.StringIO(), io.StringIO()
    watch = [bench, monitors.ParquetOutput(T.always(), f"{tmp_path}/frames"), monitors.VTPOutput(T.at_step(2), str(tmp_path), "v", ("type", "id")), monitors.XYZOutput(T.always(), f"{tmp_path}/a.xyz"), monitors.BinaryOutput(T.at_step(1), str(tmp_path), "b"), monitors.TerminalOutput(T.at_step(1), 1, said), monitors.ProgressBar(out=bar)]
    run_for_duration(system, 0.5, 1.0, monitors=watch)
    assert bench.result.summary()["steps"] == 2 and bench.result.updates == 4
    frames = files.read_parquet(spark, f"{tmp_path}/frames")
    assert {r["step"] for r in frames.select("step").distinct().collect()} == {1, 2} and "ox" in files.read_parquet(spark, f"{tmp_path}/frames", 2).columns
    xml = "".join(f.read_text() for f in (tmp_path / "v_00002").iterdir())
    assert 'NumberOfVerts="2"' in xml and "0\n1\n" in xml.partition('Name="connectivity"')[2] and "1\n2\n" in xml.partition('Name="offsets"')[2]
    assert "v_00002.pvtp" in (tmp_path / "v.pvd").read_text() and len(list((tmp_path / "a.xyz").iterdir())) == 2 and snapshots.read_snapshot(spark, f"{tmp_path}/b_00001.bin").count() == 2
    assert said.getvalue().startswith("step 1") and "100 %" in bar.getvalue()
    run(system, 0.5, 1)
    assert system.step == 3


def test_grid_rules():
    assert cells.grid_size((20.0, 20.0, 20.0), 2.5)[0] == (8, 8, 8) and cells.grid_size((4.0, 4.0, 0.0), 100.0)[0] == (2, 2, 2)
    assert cells.cell_width(3.0, "half") == 1.5 and cells.cell_width(3.0, ("absolute", 4.0)) == 4.0
    with pytest.raises(ValueError):
        cells.cell_width(3.0, ("factor", 0.0))


def test_hilbert_starts_along_the_last_axis(spark):
    df = spark.range(8).select(*[(F.shiftright("id", k).bitwiseAND(F.lit(1))).alias(a) for k, a in enumerate("xyz")])
    rows = cells.hilbert(df, "x", "y", "z", 1).orderBy("key").select("x", "y", "z").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0), (1, 1, 0), (1, 1, 1), (1, 0, 1), (1, 0, 0)]


def test_order_and_small_things(spark):
    p = cuboid(spark, (0, 0, 0), (4, 4, 1), 1.0)
    rows = cells.reordered(p, F.floor(F.col("x") / 2)).collect()
    assert sorted(r["id"] for r in rows) == list(range(16))
    v = spark.range(1).select(V.Vec(1, 2, 3).to_string().alias("s"), V.Vec(1, 2, 2).inverse_norm_squared().alias("i"), V.Vec(1, 2, 3)[1].alias("y"), V.Vec(1, 2, 3).equals(V.Vec(1, 2, 3)).alias("e"), V.signbit(F.lit(-0.0)).alias("n")).first()
    assert tuple(v) == ("{1.0, 2.0, 3.0}", pytest.approx(1 / 9), 2.0, True, True)
    with pytest.raises(ValueError):
        T.periodically(0.0)


def test_pairs_once_and_batches(spark):
    p = cuboid(spark, (0.5, 0.5, 0.5), (5, 5, 5), 1.1)
    for box in ((None,) * 3, (6.0, 6.0, 6.0)):
        once = pairs.grid(p, 1.5, box=box, directed=False)
        keys = {tuple(sorted(r)) for r in once.select("id_a", "id_b").collect()}
        fine = pairs.grid(p, 1.5, box=box, directed=False, per_cutoff=2)
        assert {tuple(sorted(r)) for r in fine.select("id_a", "id_b").collect()} == keys and fine.count() == len(keys)
        assert len(keys) == once.count() and 2 * len(keys) == pairs.direct(p, 1.5, box=box).count()

    def count(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    assert pairs.interaction_batches(p, 1.5, count, "n long").agg(F.sum("n")).first()[0] == pairs.grid(p, 1.5, directed=False).count()


def test_a_law_without_a_cutoff_has_no_condition():
    assert "r2 <=" not in laws.scale_by_type(system_queries.FAR).split("0.5e0 * mass_a")[0].rpartition("WHEN")[2]


def test_fields_controllers_and_methods_of_ones_own(spark):
    env = env_of({"position": (0, 0, 0), "mass": 2.0}, {"position": (5, 0, 0)})
    env.with_field(lambda d, t: forces.uniform_field(d, (4.0, 0.0, 0.0)))
    env.with_controller(T.at_step(1), lambda d: d.withColumn("vy", F.lit(7.0))).with_controller(T.never(), lambda d: d.withColumn("vz", F.lit(9.0)))
    env.with_controller(T.when(lambda m: m.time > 0.75), lambda d: d.withColumn("mass", F.lit(3.0)))
    system, _ = env.build(spark)
    # forces are taken once without fields, so the first half kick of a run is empty; triggers see the clock before a step
    rows = {r["id"]: r for r in run(system, 0.5, 3).df.collect()}
    assert rows[0]["vx"] == pytest.approx(4.0 / 2 * 0.5 * 2 + 4.0 / 3 * 0.25 * 0 + 4.0 / 2 * 0.25) and rows[1]["vy"] == 7.0 and rows[1]["vz"] == 0.0 and rows[1]["mass"] == 3.0
    seen = []

    def leap(s, dt):
        seen.append(dt)
        s.df = forces.drift(s.df, dt)

    assert run(system, 0.25, 2, method=leap).step == 5 and seen == [0.25, 0.25]


def test_cold_tables_are_lit_again(spark):
    still = cuboid(spark, (0, 0, 0), (12, 12, 12), 1.0, mean=(3.0, 0.0, 0.0))
    lit = observables.temperature(observables.thermostat(still, 5.0, 2.0)).first()
    assert lit["temperature"] == pytest.approx(2.0, rel=0.1) and lit["ux"] == pytest.approx(3.0, abs=0.2)
    assert observables.temperature(observables.thermostat(still, 0.0, 2.0)).first()["temperature"] == 0.0


def test_shades_and_velocities(spark):
    p = cuboid(spark, (0, 0, 0), (3, 1, 1), 1.0).withColumn("type", F.col("id") * 2)
    assert [r["shade"] for r in files.colour_range(p).orderBy("id").collect()] == [0.0, 0.5, 1.0]
    assert {r["shade"] for r in files.colour_range(p.withColumn("type", F.lit(4))).collect()} == {0.0}
    v = maxwell_boltzmann(cuboid(spark, (0, 0, 0), (20, 20, 10), 1.0), 2.0, 2).agg(F.stddev("vx"), F.avg("vy"), F.max(F.abs("vz"))).first()
    assert v[0] == pytest.approx(2.0, rel=0.1) and abs(v[1]) < 0.2 and v[2] == 0.0


def test_context_and_kept_order(spark):
    env = Environment().with_particles(cuboid(spark, (0, 0, 0), (5, 5, 5), 1.0)).with_interaction(ToType(0), NONE).with_order(1.0)
    system, info = env.build(spark)
    assert ordered.region(spark, info.stored, (0, 0, 0), (1, 1, 4)).count() == 20 == system.context().region((0, 0, 0), (1, 1, 4)).count()
    seen = []
    run(system, 0.5, 2, monitors=[(T.at_step(2), seen.append)])
    c = seen[0]
    assert (c.step, c.time, c.size(), c.id_range(), c.at_id(3)["id"], c.reduce("mass")) == (2, 1.0, 125, (0, 125), 3, 125.0)
    with pytest.raises(AttributeError):
        c.step = 3
    assert not hasattr(c, "update_forces")
