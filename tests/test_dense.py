"""Forces in dense places without making the pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairfield.operators import dense, forces, pairs, tiles
from pairfield.plans import laws
from test_near_sums import ball


def cluster(spark, n, scale=1.0):
    """Half of the rows in a small cube around a corner of cells and of the box, some of these in one place."""
    df = ball(spark, n).withColumn("mass", 1 + F.col("id") % 7 / F.lit(3.0)).withColumn("type", F.lit(0))
    return df.withColumns({a: F.when(F.col("id") % 2 == 1, (F.col(a) - s) * scale - F.lit(0.25)).otherwise(F.col(a)) for a, s in zip("xyz", (5.0, 5.0, 1.0), strict=True)})


def sums(df):
    return {r["id"]: (r["fx"], r["fy"], r["fz"]) for r in df.collect()}


def all_pairs(df, law, box):
    """By numpy, from all pairs."""
    rows = df.select("id", "x", "y", "z", "mass").orderBy("id").toPandas()
    out, at = {}, rows[["x", "y", "z"]].to_numpy()
    for i, m, place in zip(rows["id"], rows["mass"], at, strict=True):
        d = at - place
        for n, length in enumerate(box):
            if length is not None:
                d[:, n] -= length * np.floor(d[:, n] / length + 0.5)
        r2 = (d * d).sum(axis=1)
        q = r2 + law.soft**2
        s = np.where((r2 > 0) & (r2 <= law.cutoff**2), -law.g * m * rows["mass"] / (q * np.sqrt(q)), 0.0)
        out[i] = tuple(s @ d)
    return out


@pytest.mark.parametrize(("scale", "box"), [(0.6, (None, None, None)), (1.0, (13.0, None, 13.0)), (1.6, (13.0, 13.0, 13.0))])
def test_lattices_give_the_forces_of_pairs(spark, scale, box):
    """Dense cells within the reach, partly within it, and across cells and the box: through nodes, with what is beyond taken off."""
    costs = dense.Costs(node=1e-4, move=1e-4, few=1000, chunk=500, leaves=3)
    df = cluster(spark, 3000, scale)
    law = laws.SoftGravity(1.0, 1.5, 0.9)
    cells = pairs.leaves(df, 1.0, ("id", "mass"), box, 64).withColumn("leaf", F.monotonically_increasing_id()).withColumn("weight", F.lit(1.0))
    met = dense.meetings(pairs.cut(cells), 1.0, law.smooth, box, costs).select((F.col("a").isNull()).alias("nodes"), "beyond").distinct().collect()
    assert any(r["nodes"] for r in met) and (scale < 1.0 or any(r["beyond"] for r in met))
    got = sums(forces.summed(df, dense.dense_forces(df, law, ("id", "mass"), box, 64, costs=costs)))
    want = all_pairs(df, law, box)
    most = max(abs(x) for f in want.values() for x in f)
    assert got.keys() == want.keys() and max(abs(x - y) for k in want for x, y in zip(got[k], want[k], strict=True)) < 1e-12 * most


def test_a_dense_place_makes_few_pairs(spark):
    """The work in a dense place may not grow with the square of its rows: before, all its pairs became rows."""
    df, law = cluster(spark, 200_000), laws.SoftGravity(1.0, 1.0, 0.4)
    cells = pairs.cut(pairs.leaves(df, 1.0, ("id",), (None, None, None)).withColumn("leaf", F.monotonically_increasing_id()).withColumn("weight", F.lit(1.0)))
    made = dense.meetings(cells, 1.0, law.smooth, (None, None, None)).agg(F.sum("pairs")).first()[0]
    assert made < 0.3 * 100_000**2
    plan = forces.pair_forces(df, law, search=pairs.Search("adaptive"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapCoGroupsInArrow" in plan


def test_laws_that_are_not_smooth_and_rows_without_a_place(spark):
    """Other laws of r2 meet row by row; a row without a place or a mass neither gives nor gets."""
    df = cluster(spark, 600).filter("id % 20 <> 1")
    odd = df.withColumn("x", F.when(F.col("id") == 7, float("nan")).when(F.col("id") == 9, float("inf")).otherwise(F.col("x"))).withColumn("mass", F.when(F.col("id") != 11, F.col("mass")))
    for law in (laws.SoftGravity(1.0, 1.0, 0.2), laws.Gravity(1.0, 1.0), laws.Harmonic(1.0, 2.0, 0.3)):
        assert tiles.over_arrays(law)
        got = sums(forces.pair_forces(odd, law, search=pairs.Search("adaptive", rows=50)))
        want = sums(forces.pair_forces(odd.filter("id NOT IN (7, 9)"), law))
        assert got[7] == got[9] == (0.0, 0.0, 0.0)
        assert all(x == pytest.approx(y, rel=1e-9, abs=1e-9) for k in want for x, y in zip(got[k], want[k], strict=True))
