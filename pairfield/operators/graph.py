"""Graphs of particle ids: nodes, components, intersections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def unique_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that edges lead to, by minimum labels with pointer jumping."""
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    labels = cut(unique_nodes(edges).select("node", F.col("node").alias("component")))
    while True:
        near = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("component").alias("near"))
        low = labels.join(near, labels["node"] == near["src"], "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("was"))
        low = cut(low)
        # jump: take the label of one's label
        far = low.select(F.col("node").alias("at"), F.col("component").alias("far"))
        labels = cut(low.join(far, low["component"] == far["at"]).select("node", F.least("component", "far").alias("component"), "was"))
        if labels.filter("component <> was").isEmpty():
            return labels.select("node", "component")
        labels = labels.drop("was")


def intersection_graph(members: DataFrame) -> DataFrame:
    """(a, b): sets (set_id, node) that share a node, each pair once in either direction."""
    a, b = members.select("node", F.col("set_id").alias("a")), members.select("node", F.col("set_id").alias("b"))
    return a.join(b, "node").filter("a <> b").select("a", "b").distinct()


def _first_independent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes that a walk in their order would take if it took each one without an edge to those taken before. In rounds: a node
    before all its open neighbours is taken, its neighbours are closed."""
    taken = None
    while True:
        later = edges.select(F.greatest("a", "b").alias("node")).distinct()
        now = cut(nodes.join(later, "node", "left_anti"))
        taken = now if taken is None else cut(taken.unionByName(now))
        closed = edges.join(now.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        nodes = cut(nodes.join(now, "node", "left_anti").join(closed, "node", "left_anti"))
        if nodes.isEmpty():
            return taken
        edges = cut(edges.join(nodes.select(F.col("node").alias("a")), "a", "left_semi").join(nodes.select(F.col("node").alias("b")), "b", "left_semi"))


def independent_partitions(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, part): each node in the first part that has fewer than ``most`` nodes and none with an edge to it, nodes in order.

    Part after part: a part is the first ``most`` of what an independent walk over the nodes left takes, which is what placing the
    nodes one by one gives. So there are as many rounds of joins as parts, times the longest chain of nodes that wait for one another
    within a part; ``most`` rows of a part are sorted in one place. ``edges`` (src, dst) go in any direction.
    """
    if most is not None and most < 1:
        raise ValueError("a part has a node at least")
    nodes = cut(nodes.select("node").distinct())
    both = cut(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).filter("a <> b").distinct())
    done, part = nodes.limit(0).withColumn("part", F.lit(0)), 0
    while not nodes.isEmpty():
        taken = _first_independent(nodes, both)
        taken = taken if most is None else cut(taken.orderBy("node").limit(most))
        done = cut(done.unionByName(taken.withColumn("part", F.lit(part))))
        nodes, part = cut(nodes.join(taken, "node", "left_anti")), part + 1
        open_ = lambda c, left=nodes: left.select(F.col("node").alias(c))
        both = cut(both.join(open_("a"), "a", "left_semi").join(open_("b"), "b", "left_semi"))
    return done
