"""Counts and sums of near rows without making the pairs."""

import pytest
from pyspark.sql import functions as F

from pairfield.operators import pairs


def ball(spark, n=1500):
    """Half of the rows in a small cube, some of these in one place; the others far apart."""
    k = F.col("id")
    dense = k % 2 == 1
    off = lambda m, p: F.when(k % 20 == 1, F.lit(0.0)).otherwise((k * m % p) / F.lit(p * 1.5))
    return spark.range(n).select("id", *[F.when(dense, F.lit(s) + off(m, p)).otherwise((k * q % 100) / F.lit(8.0)).alias(a) for a, s, m, p, q in (("x", 5.0, 7919, 997, 7), ("y", 5.0, 104729, 991, 11), ("z", 1.0, 1299709, 983, 13))])


@pytest.mark.parametrize(("limit", "box"), [(16, (None, None, None)), (512, (None, 12.5, None)), (100, (5.5, 6.0, 12.5)), (16, (2.0, None, None))])
def test_near_sums_are_those_of_the_pairs(spark, limit, box, monkeypatch):
    monkeypatch.setattr(pairs, "AS_ARRAYS", 64)
    df = ball(spark)
    want = {r["id_a"]: (r["n"], r["r2"]) for r in pairs.direct(df, 0.9, ("id", "x", "y", "z"), box).groupBy("id_a").agg(F.count("*").alias("n"), F.sum("r2").alias("r2")).collect()}
    got = {r["id"]: (r["n"], r["r2"]) for r in pairs.near_sums(df, 0.9, box, limit).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-8 * max(1.0, want[k][1]) for k in want)


def test_leaves_within_the_cutoff_are_taken_as_wholes(spark):
    """In a dense place hardly any pairs of leaves may be compared row by row: before, all were."""
    df = ball(spark, 6000)
    tiles = pairs.cut(pairs.leaves(df, 0.9, ("id",), (None, None, None), 32).withColumn("leaf", F.monotonically_increasing_id()))
    size = tiles.select("leaf", F.size("rows").alias("n"))
    met = pairs.leaf_pairs(tiles, 0.9, (None, None, None)).join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
    made = {r["whole"]: r["n"] for r in met.groupBy("whole").agg(F.sum(F.col("na") * F.col("nb")).alias("n")).collect()}
    assert made[False] < 0.3 * (made[True] + made[False])
