import random
import struct
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pairfield.operators import graph, kernels
from pairfield.sources import ordered, snapshots
from pairfield.sources.generators import generated, normal_by_id
from pairfield.streaming import triggers as T

AT = "id long, x double, y double, z double, state int"


def points(spark, n, seed, top=32.0):
    rng = random.Random(seed)
    rows = [(i, *[rng.uniform(0, top) for _ in "xyz"], 1) for i in range(n)]
    return rows, spark.createDataFrame(rows, AT)


@pytest.mark.parametrize("kind", ["hilbert", "morton"])
def test_ranges_cover_a_box_and_little_else(spark, kind):
    curve = ordered.Curve((0.0, 0.0, 0.0), 1.0, 4, kind)
    cells = [(x, y, z) for x in range(16) for y in range(16) for z in range(16)]
    df = spark.createDataFrame([(i, x + 0.5, y + 0.5, z + 0.5, 1) for i, (x, y, z) in enumerate(cells)], AT)
    key = {cells[r["id"]]: r[ordered.KEY] for r in curve.with_key(df).collect()}
    assert sorted(key.values()) == list(range(4096))
    rng = random.Random(3)
    for _ in range(60):
        a, b = zip(*[sorted(rng.uniform(-1, 17) for _ in range(2)) for _ in "xyz"], strict=True)
        want = {key[c] for c in cells if all(lo <= v + 1 - 1e-12 and v <= hi for v, lo, hi in zip(c, a, b, strict=True))}
        exact = curve.ranges(a, b, 10_000)
        assert {k for f, t in exact for k in range(f, t + 1)} == want
        few = curve.ranges(a, b, 8)
        assert want <= {k for f, t in few for k in range(f, t + 1)} and len(few) <= max(8, 1)
        assert all(x[1] + 1 < y[0] for x, y in zip(few, few[1:], strict=False))


@pytest.mark.parametrize("kind", ["hilbert", "morton"])
def test_a_region_reads_its_row_groups_only(spark, tmp_path, kind):
    rows, df = points(spark, 60_000, 1)
    rows.append((70_000, -5.0, 2.0, 2.0, 1))
    df = df.union(spark.createDataFrame(rows[-1:], AT))
    path = str(tmp_path / kind)
    ordered.store(df, path, ordered.curve_for((0, 0, 0), (32, 32, 32), 1.0, kind), group_bytes=1 << 16, files=6)
    low, high = (3.0, 4.0, 5.0), (8.0, 8.5, 9.0)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    out = ordered.region(spark, path, low, high)
    want = {r[0] for r in rows if all(a <= v <= b for v, a, b in zip(r[1:4], low, high, strict=True))}
    assert {r["id"] for r in out.collect()} == want and want
    plan = out._jdf.queryExecution().executedPlan().toString()
    pushed = plan.partition("PushedFilters: ")[2].partition("\n")[0]
    assert f"GreaterThanOrEqual({ordered.KEY}" in pushed and f"LessThanOrEqual({ordered.KEY}" in pushed
    ranges, met, groups = ordered.curve_of(spark.read.parquet(path)).ranges(low, high), 0, 0
    for f in Path(path).glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        at = meta.schema.names.index(ordered.KEY)
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(at).statistics
            groups += 1
            met += s.has_min_max and any(a <= s.max and b >= s.min for a, b in ranges)
    assert groups >= 12 and met <= groups // 3
    # rows that the scan let through, by its own count
    out.write.format("noop").mode("overwrite").save()
    counted = ordered.region(spark, path, low, high)
    counted.collect()
    leaf = counted._jdf.queryExecution().executedPlan()
    while leaf.children().size():
        leaf = leaf.children().apply(0)
    assert leaf.metrics().apply("numOutputRows").value() < len(rows) // 3
    # a box beyond the cube finds what has no key
    assert {r["id"] for r in ordered.region(spark, path, (-6, 0, 0), (-1, 3, 3)).collect()} == {70_000}
    with pytest.raises(ValueError):
        ordered.curve_of(df.withColumn(ordered.KEY, F.lit(1)))


def test_snapshot_bytes_and_round_trip(spark, tmp_path):
    rows = [(i, i % 3, i * 0.5, -i * 0.25, 1.0, 1 + i % 2) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, type int, x double, y double, z double, state int").repartition(5)
    path = str(tmp_path / "snap")
    snapshots.write_snapshot(df, path, 7, parts=4)
    parts = sorted(Path(path).iterdir())
    assert len(parts) > 1 and not [p for p in parts if p.name.startswith("_")]
    raw = b"".join(p.read_bytes()[28:] for p in parts)
    assert raw == b"".join(struct.pack("<fffIIB", x, y, z, t, i, s) for i, t, x, y, z, s in rows)
    for p in parts:
        head = struct.unpack("<4sIQQI", p.read_bytes()[:28])
        assert head[:3] == (b"PART", 1, 7) and p.stat().st_size == 28 + 21 * head[3]
    back = snapshots.read_snapshot(spark, path, rows=100)
    assert back.rdd.getNumPartitions() >= 10
    assert sorted((r["id"], r["type"], r["x"], r["y"], r["z"], r["state"]) for r in back.collect()) == rows and {r["step"] for r in back.select("step").distinct().collect()} == {7}
    # written anew, added to, and read as a single file
    snapshots.write_snapshot(df.filter("id < 10"), path, 8)
    assert snapshots.read_snapshot(spark, path).count() == 10
    snapshots.write_snapshot(df.filter("id < 10"), path, 8, "append")
    assert snapshots.read_snapshot(spark, path).count() == 20
    assert snapshots.read_snapshot(spark, f"file://{sorted(Path(path).iterdir())[0]}").count() > 0
    snapshots.write_snapshot(df.limit(0), str(tmp_path / "none"), 1)
    assert snapshots.read_snapshot(spark, str(tmp_path / "none")).count() == 0


def test_what_is_no_snapshot(spark, tmp_path):
    (tmp_path / "bad").write_bytes(b"NOPE" + bytes(24))
    (tmp_path / "short").write_bytes(struct.pack("<4sIQQI", b"PART", 1, 0, 5, 0) + bytes(21))
    for name in ("bad", "short"):
        with pytest.raises(snapshots.SnapshotError):
            snapshots.header(str(tmp_path / name))
        with pytest.raises(Exception, match="snapshot|last row"):
            snapshots.read_snapshot(spark, str(tmp_path / name)).count()
    with pytest.raises(Exception, match="columns"):
        snapshots.register(spark)
        spark.range(3).write.format("particles").mode("append").save(str(tmp_path / "x"))
    assert not (tmp_path / "x").exists()


def test_a_failed_task_leaves_no_part(spark, tmp_path):
    df = spark.createDataFrame([(i, 0, 0.0, 0.0, 0.0, 1) for i in range(20)], "id long, type int, x double, y double, z double, state int")
    bad = df.repartition(4).withColumn("x", F.when(F.col("id") == 13, F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="broken"):
        snapshots.register(spark)
        bad.write.format("particles").option("step", 1).mode("append").save(str(tmp_path / "x"))
    assert not list((tmp_path / "x").glob("part-*")) if (tmp_path / "x").exists() else True


def test_a_fold_of_ones_own_in_levels(spark):
    def step(s, batch):
        v = batch.column(0).to_numpy()
        return s[0] + len(v), s[1] + int(v.sum()), sorted({*s[2], *v.tolist()})[-3:]

    merge = lambda s, t: (s[0] + t[0], s[1] + t[1], sorted({*s[2], *t[2]})[-3:])
    r = kernels.Reducer(("id",), "n bigint, total bigint, top array<bigint>", (0, 0, []), step, merge)
    df = spark.range(0, 5000, 1, 23).withColumn("state", F.lit(1))
    for fan in (2, 5, 64):
        rows = kernels.reduce_with(df, r, fan=fan).collect()
        assert [tuple(x) for x in rows] == [(5000, 4999 * 2500, [4997, 4998, 4999])]
    assert [tuple(x) for x in kernels.reduce_with(df.limit(0), r).collect()] == [(0, 0, [])]
    assert kernels.reduce_with(df, r, state=2).first()["n"] == 0
    with pytest.raises(ValueError):
        kernels.reduce_with(df, r, fan=1)


def test_generators_as_rows(spark):
    rows = [("cuboid", 0, 1.0, 2.0, 3.0, 2.0, 3.0, 4.0, 0.5, 7, 0.0), ("ellipsoid", 100, 0.0, 0.0, 0.0, 2.0, 2.0, 0.0, 1.0, 1, 2.0), ("ellipsoid", 200, 5.0, 5.0, 5.0, 0.5, 0.5, 0.5, 1.0, 2, 0.0), ("cuboid", 300, 0.0, 0.0, 0.0, 0.0, 3.0, 4.0, 0.5, 7, 0.0)]
    schema = "kind string, first_id long, x double, y double, z double, a double, b double, c double, spacing double, type int, deviation double"
    got = generated(spark.createDataFrame(rows, schema)).orderBy("id").collect()
    box, flat, one = ([r for r in got if r["type"] == t] for t in (7, 1, 2))
    assert len(box) == 24 and (box[-1]["x"], box[-1]["y"], box[-1]["z"]) == (1.5, 3.0, 4.5) and [r["id"] for r in box] == list(range(24)) and {r["vx"] for r in box} == {0.0}
    assert len(flat) == 9 and {r["z"] for r in flat} == {0.0} and len({r["vx"] for r in flat}) == 9
    assert [(r["x"], r["y"], r["z"]) for r in one] == [(5.0, 5.0, 5.0)]
    for bad in (("cuboid", 0, 1.0, 2.0, 3.0, 2.0, 3.0, 4.0, 0.0, 7, 0.0), ("sphere", 0, 1.0, 2.0, 3.0, 2.0, 3.0, 4.0, 1.0, 7, 0.0)):
        with pytest.raises(Exception, match="generator"):
            generated(spark.createDataFrame([bad], schema)).collect()
    v = spark.range(20_000).select(*[normal_by_id(F.col("id"), k).alias(f"v{k}") for k in range(3)]).toPandas()
    assert abs(v.mean()).max() < 0.03 and abs(v.std() - 1).max() < 0.03 and abs(np.corrcoef(v.T.to_numpy()) - np.eye(3)).max() < 0.05


@pytest.mark.parametrize("period, offset", [(5.0, 0.0), (0.75, 30.0), (1000.0, -3.0), (3.0, 1e6)])
def test_periodic_firings_are_the_loop(spark, period, offset):
    rng = random.Random(9)
    times = sorted(rng.choice([rng.randrange(0, 200) / 4, rng.randrange(100_000, 100_100) / 4]) for _ in range(300))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "step long, time double").repartition(5)
    fire, want = T.periodically(period, offset), []
    for i, t in enumerate(times):
        if fire(T.Moment(t, i)):
            want.append(i)
    assert sorted(r["step"] for r in T.periodically(period, offset).mark(df).filter("fires").collect()) == want
    both = (T.periodically(period, offset) | T.every(7)) & ~T.after(250)
    assert sorted(r["step"] for r in both.mark(df).filter("fires").collect()) == [i for i in range(250) if i in want or i % 7 == 0]
    assert T.every(3).mark(df).filter("fires").count() == 100
    with pytest.raises(TypeError):
        T.periodically(period).column()


def test_partitions_are_first_fit(spark):
    def one_by_one(nodes, edges, most):
        parts = []
        for n in sorted(nodes):
            for p in parts:
                if (most is None or len(p) < most) and not any((n, m) in edges or (m, n) in edges for m in p):
                    p.append(n)
                    break
            else:
                parts.append([n])
        return {n: k for k, p in enumerate(parts) for n in p}

    rng = random.Random(4)
    cases = [([0, 1, 2, 3], {(0, 1), (1, 2), (2, 3), (3, 0)}, 2), ([0, 1, 2, 3], {(0, 1), (0, 2), (3, 0)}, 2), (list(range(30)), {(rng.randrange(30), rng.randrange(30)) for _ in range(60)}, None), (list(range(20)), {(rng.randrange(20), rng.randrange(20)) for _ in range(30)}, 4)]
    for nodes, edges, most in cases:
        got = graph.independent_partitions(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(sorted(edges), "src long, dst long"), most)
        assert {r["node"]: r["part"] for r in got.collect()} == one_by_one(nodes, edges, most)
    # the sets of an intersection graph
    sets = spark.createDataFrame([(k, n) for k, s in enumerate([{1, 2, 3}, {3, 4}, {5, 6}, {4, 6}]) for n in s], "set_id long, node long")
    met = graph.intersection_graph(sets).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    got = graph.independent_partitions(sets.select(F.col("set_id").alias("node")), met)
    assert {r["node"]: r["part"] for r in got.collect()} == {0: 0, 1: 1, 2: 0, 3: 2}
