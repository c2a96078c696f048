import random

import pytest
from pyspark.sql import functions as F

from pairfield.operators import forces, pairs, tiles
from pairfield.plans import laws
from pairfield.plans.environment import Environment, ToType
from pairfield.plans.spec import SpecError

OPEN = (None, None, None)


def cloud(spark, n, seed, dense=0.0, size=12.0):
    """Particles of three types; a part of them in a small ball, a tenth of that in one place."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = [rng.uniform(0, size) for _ in "xyz"]
        if rng.random() < dense:
            at = [4.0 + (0 if rng.random() < 0.1 else rng.uniform(0, 0.6)) for _ in "xyz"]
        rows.append((i, rng.randrange(3), *at, *[rng.uniform(-1, 1) for _ in "xyz"], rng.uniform(0.5, 2), rng.choice([-1.0, 1.0]), 1))
    return rows, spark.createDataFrame(rows, "id long, type int, x double, y double, z double, vx double, vy double, vz double, mass double, charge double, state int")


def near(rows, reach, box=OPEN):
    """{(id, id)} of pairs whose types' reach holds them, by looking at all pairs."""
    out = set()
    for k, p in enumerate(rows):
        for q in rows[:k]:
            d = [b - a for a, b in zip(p[2:5], q[2:5], strict=True)]
            d = [x if L is None else x - L * round(x / L) for x, L in zip(d, box, strict=True)]
            r = reach(p[1], q[1]) if callable(reach) else reach
            if r is not None and sum(x * x for x in d) <= r * r:
                out.add(tuple(sorted((p[0], q[0]))))
    return out


def ids(df):
    got = [tuple(sorted((r[0], r[1]))) for r in df.select("id_a", "id_b").collect()]
    assert len(got) == len(set(got))
    return set(got)


REACHES = {(0, 0): 0.5, (1, 1): 1.0, (2, 2): 4.0, (0, 1): 0.7, (0, 2): 2.0, (1, 2): 2.0}


@pytest.mark.parametrize("box", [OPEN, (12.0, 12.0, None), (12.0, 12.0, 11.9)])
def test_bins_against_all_pairs(spark, box):
    rows, df = cloud(spark, 400, 1)
    bins = pairs.bins_of(REACHES)
    for a in range(3):
        for b in range(a, 3):
            assert sum((a, b) in x and x.reach == REACHES[a, b] for x in bins) == 1
    got = pairs.binned(df, bins, box=box, directed=False)
    assert ids(got) == near(rows, lambda a, b: REACHES[min(a, b), max(a, b)], box)


def test_bins_propose_no_more_than_separate_grids(spark):
    _, df = cloud(spark, 1500, 2)
    reaches = {(0, 0): 0.5, (1, 1): 4.0, (0, 1): 1.0}
    df = df.filter("type < 2")
    proposed = pairs.binned(df, pairs.bins_of(reaches), directed=False, exact=False).count()
    apart = 0
    for (a, b), r in reaches.items():
        rows = df.filter(F.col("type").isin(a, b))
        bins = [pairs.Bin(r, (a,), None if a == b else (b,))]
        apart += pairs.binned(rows, bins, directed=False, exact=False).count()
    whole = pairs.binned(df, [pairs.Bin(4.0, (0, 1))], directed=False, exact=False).count()
    assert proposed <= apart and 2 * proposed < whole


@pytest.mark.parametrize("box", [OPEN, (12.0, 12.0, 12.0), (12.0, None, 2.0)])
def test_adaptive_cells_against_all_pairs(spark, box):
    rows, df = cloud(spark, 600, 3, dense=0.5)
    for limit, halvings in ((16, 3), (16, 1), (1000, 5)):
        assert ids(pairs.adaptive(df, 1.0, box=box, directed=False, limit=limit, halvings=halvings)) == near(rows, 1.0, box)
    assert 2 * len(near(rows, 1.0, box)) == pairs.adaptive(df, 1.0, box=box, limit=16).count()


def test_a_dense_cell_is_many_tasks(spark):
    """Half of the rows in one cell: no leaf is much over the limit, and no task has over three times the median of the candidates."""
    _, df = cloud(spark, 6000, 4, dense=0.5, size=20.0)
    cells = pairs.leaves(df, 1.0, ("id", "x", "y", "z"), OPEN, 64, 4)
    sizes = [r["n"] for r in cells.select(F.size("rows").alias("n")).collect()]
    assert max(sizes) <= 2 * 64 and sum(sizes) == 6000
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        task = F.spark_partition_id().alias("task")
        per_task = lambda df: sorted(r["count"] for r in df.select(task).groupBy("task").count().collect())
        even = per_task(pairs.adaptive(df, 1.0, ("id", "x", "y", "z"), directed=False, limit=64, exact=False))
        hot = per_task(pairs.grid(df, 1.0, ("id", "x", "y", "z"), directed=False))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert even[-1] <= 3 * even[len(even) // 2]
    assert hot[-1] > 3 * hot[len(hot) // 2]  # what a plain grid does


def test_searches_give_one_force(spark):
    _, df = cloud(spark, 300, 5, dense=0.3)
    law = laws.SoftGravity(1.5, 1.0, 0.3)
    of = lambda search: {r["id"]: (r["fx"], r["fy"], r["fz"]) for r in forces.pair_forces(df, law, box=(12.0, 12.0, None), search=search).collect()}
    want = of(pairs.Search("direct"))
    for search in (pairs.Search(), pairs.Search("cells", per_cutoff=2), pairs.Search("adaptive", rows=20)):
        assert of(search) == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
    with pytest.raises(ValueError):
        pairs.Search("tree")


def test_tiles_give_the_forces_of_pairs(spark):
    rows, df = cloud(spark, 260, 6)
    table = {(0, 0): laws.Gravity(None, 2.0), (1, 1): laws.NoForce(), (2, 2): laws.Harmonic(None, 3.0, 1.0), (0, 1): laws.Coulomb(None, 0.5), (0, 2): laws.NoForce(), (1, 2): laws.Gravity(None, 1.0)}
    for box in (OPEN, (12.0, None, 12.0)):
        want = {r[0]: [0.0] * 3 for r in rows}
        for p in rows:
            for q in rows:
                law = table[min(p[1], q[1]), max(p[1], q[1])]
                if p is q or isinstance(law, laws.NoForce):
                    continue
                d = [b - a for a, b in zip(p[2:5], q[2:5], strict=True)]
                d = [x if L is None else x - L * round(x / L) for x, L in zip(d, box, strict=True)]
                r2 = sum(x * x for x in d)
                s = {"Gravity": lambda: law.g * p[8] * q[8] / r2**1.5, "Coulomb": lambda: law.k * p[9] * q[9] / r2**1.5, "Harmonic": lambda: law.k * (r2**0.5 - law.r0) / r2**0.5}[type(law).__name__]()
                for k in range(3):
                    want[p[0]][k] += s * d[k]
        got = {r["id"]: [r["fx"], r["fy"], r["fz"]] for r in forces.pair_forces(df, table, [0, 1, 2], box).collect()}
        assert got == {k: pytest.approx(v, abs=1e-8) for k, v in want.items()}
    # one law for all types, two rows in one place, and laws that only Spark can evaluate
    assert tiles.over_arrays(laws.Gravity(None, 1.0)) and not tiles.over_arrays(laws.Custom(None, ("dx", "dy", "dz")))
    twin = df.filter("id < 2").withColumns({c: F.lit(1.0) for c in "xyz"})
    assert [tuple(r) for r in forces.pair_forces(twin, laws.Gravity(None, 1.0)).select("fx", "fy", "fz").collect()] == [(0.0, 0.0, 0.0)] * 2
    assert forces.pair_forces(df.limit(0), laws.Gravity(None, 1.0)).count() == 0


def test_fields_are_declared_and_checked(spark):
    _, df = cloud(spark, 60, 7)
    sneaky = laws.Custom(2.0, ("mass_a * dx", "0e0", "0e0"), "antisymmetric")
    for bad in (sneaky, laws.Custom(2.0, ("spin_b * dx", "0e0", "0e0"), "antisymmetric", ("spin",))):
        with pytest.raises(laws.FieldError):
            forces.pair_forces(df, bad)
    law = laws.Custom(2.0, ("spin_b * dx", "spin_a * dy", "0e0"), "nonsymmetric", ("spin",))
    spun = df.withColumn("spin", F.col("id") % 5)
    assert laws.columns_of([law, laws.Gravity()], spun.columns) == ("id", "type", "x", "y", "z", "spin", "mass")
    assert set(pairs.grid(spun, 2.0, laws.columns_of([law], spun.columns)).columns) == {f"{c}_{s}" for c in ("id", "type", "x", "y", "z", "spin") for s in "ab"} | {"dx", "dy", "dz", "r2"}
    env = Environment().with_attributes(spin="double").with_particle((0, 0, 0), spin=3.0).with_particle((1, 1, 0), spin=5.0).with_interaction(ToType(0), law)
    system, _ = env.build(spark)
    system.update_forces()
    assert {r["id"]: (r["fx"], r["fy"]) for r in system.df.collect()} == {0: (5.0, 3.0), 1: (-3.0, -5.0)}
    for bad in (Environment().with_attributes(spin="double").with_particle((0, 0, 0)), Environment().with_particle((0, 0, 0), spin=1.0), Environment().with_attributes(spin="double").with_particles(df)):
        with pytest.raises(SpecError):
            bad.with_interaction(ToType(0), law).build(spark)
    with pytest.raises(laws.FieldError):
        Environment().with_particle((0, 0, 0)).with_interaction(ToType(0), law).build(spark)
    with pytest.raises(SpecError):
        Environment().with_attributes(mass="double")


def test_drag_slows_and_keeps_momentum(spark):
    _, df = cloud(spark, 80, 8)
    out = forces.pair_forces(df, laws.Drag(3.0, 0.5))
    total = out.agg(*[F.sum(f"f{a}") for a in "xyz"], F.sum(F.col("fx") * F.col("vx") + F.col("fy") * F.col("vy") + F.col("fz") * F.col("vz"))).first()
    assert max(map(abs, total[:3])) < 1e-10 and total[3] < 0


def test_builder_sets_search_and_states(spark):
    env = lambda: Environment().with_particle((0, 0, 0)).with_particle((1, 0, 0), state=2).with_particle((0, 1, 0), state=4).with_interaction(ToType(0), laws.Harmonic(3.0, 1.0, 0.0))
    def force(e):
        system, _ = e.build(spark)
        system.update_forces()
        return {r["id"]: (r["fx"], r["fy"]) for r in system.df.collect()}

    assert force(env()) == force(env().with_neighbours("adaptive", rows=1)) == {0: (1.0, 1.0), 1: (-2.0, 1.0), 2: (1.0, -2.0)}
    assert force(env().with_strict_states()) == {0: (0.0, 0.0), 1: (0.0, 0.0), 2: (0.0, -1.0)}
