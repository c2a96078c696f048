"""What fails only on large tables, seen on small ones."""

import pytest
from pyspark.sql import functions as F

from pairfield import queries
from pairfield.operators import forces, pairs, tiles
from pairfield.plans import laws


def lattice(spark, n=400):
    return spark.range(n).select("id", (F.col("id") % 3).cast("int").alias("type"), *[((F.col("id") * k) % 50 / F.lit(5.0)).alias(a) for a, k in zip("xyz", (7, 11, 13), strict=True)], F.lit(1.0).alias("mass"), F.lit(1.0).alias("charge"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["grid", "binned", "direct", "bonded"])
def test_particles_are_not_broadcast(spark, kind):
    """A file of some MB unfolds into GBs of columns and copies: no side of such a join may go through the driver."""
    df = lattice(spark)
    bonds = spark.range(399).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    made = {
        "grid": lambda: pairs.grid(df, 1.0),
        "binned": lambda: pairs.binned(df, pairs.bins_of({(0, 0): 1.0, (1, 1): 2.0, (2, 2): 0.5, (0, 1): 1.0, (0, 2): 1.0, (1, 2): 2.0})),
        "direct": lambda: pairs.direct(df, 1.0),
        "bonded": lambda: pairs.bonded(df, bonds),
    }[kind]()
    assert "Broadcast" not in plan(made)


def test_morton_key_of_high_cells(spark, tmp_path):
    """The key has ten bits of each cell number, however high the cells are."""
    rows = [(k, "", "", "", 1 + k % 50, 1.0) for k in (0, 7, 123456, 409599, 409600, 1199999)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    cells = {r["id"]: (r["cx"], r["cy"], r["cz"]) for r in queries.Q["cell_index"](spark, str(tmp_path)).collect()}
    assert max(c[2] for c in cells.values()) > 1023
    want = {k: sum(((c >> b) & 1) << (3 * b + i) for b in range(10) for i, c in enumerate(v)) for k, v in cells.items()}
    assert {r["id"]: r["key"] for r in queries.Q["morton_key"](spark, str(tmp_path)).collect()} == want


def test_tiles_grow_with_the_table():
    """A table's rows are shuffled once a tile: tiles of one size made 586 copies of 1.2 million rows."""
    assert tiles.tiles_of(20_000) == 10 and tiles.tiles_of(0) == 8
    assert tiles.tiles_of(1_200_000) == 74
    assert all(tiles.tiles_of(n) >= tiles.tiles_of(n - 1000) for n in range(1000, 2_000_000, 1000))


@pytest.mark.parametrize("box", [(5.0, 5.0, 14.0), (None, 5.0, 7.0)])
def test_wide_laws_skip_what_is_apart(spark, box, monkeypatch):
    """A reach of which an axis has not three goes over arrays, in blocks, of which those beyond the reach are left out."""
    df = lattice(spark, 1500)
    law = laws.Coulomb(2.5, 1.0)
    monkeypatch.setattr(tiles, "ROWS", 16)
    monkeypatch.setattr(tiles, "OTHERS", 32)
    assert "MapInArrow" in plan(forces.pair_forces(df, law, box=box))
    want = forces.summed(df, forces.by_scale(pairs.direct(df, 2.5, box=box, directed=False), law.scale()))
    (one, two) = ({r["id"]: (r["fx"], r["fy"], r["fz"]) for r in x.collect()} for x in (forces.pair_forces(df, law, box=box), want))
    assert one.keys() == two.keys() and all(abs(x - y) < 1e-9 * max(1.0, abs(x)) for k in one for x, y in zip(one[k], two[k], strict=True))


@pytest.mark.parametrize("name", ["attribute_force", "bond_plus_type_force", "built_system_force", "constant_force", "drag_force", "coulomb_force", "harmonic_force", "mixed_lj_force", "nonsymmetric_force", "periodic_force", "reach_bins_force", "periodic_pairs", "soft_gravity_force", "strict_state_force", "type_pair_force"])
def test_queries_send_no_particles_through_the_driver(spark, name):
    """The planner takes a file of some MB for small: what is made of it may not be broadcast."""
    made = queries.Q[name](spark, "/root/testdata/sf0.001")
    assert "BroadcastHashJoin" not in plan(made)
