"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and an equi-join, so no node's neighbours are gathered in one place; the edge table is
cut to the shared folder after each round. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """From (a, b), in any direction and with repeats: (node, component), component the smallest node; only nodes with edges."""
    e = edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).filter("a <> b").distinct()
    e = cut(e.select("a", "b"))
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # small star: each node and its smaller neighbours point to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        # a fixpoint is a set of stars: every node points to one root, and no root points on
        tangled = after.groupBy("a").count().filter("count > 1").limit(1).count() or after.join(after.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        e = after
        if not tangled:
            stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return stars.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
