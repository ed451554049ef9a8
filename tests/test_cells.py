import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotstack.operators import cells, pointcloud, topology

POINTS = "cloud_id long, pt_id long, x double, y double, z double"
BOX = (("minx", "maxx"), ("miny", "maxy"))


def brute_nearest(queries, points, k, dims):
    out = set()
    for q in queries:
        near = sorted((math.dist([q[2 + d] for d in range(dims)], [p[2 + d] for d in range(dims)]), p[1]) for p in points if p[0] == q[0])
        out |= {(q[0], q[1], pt, place) for place, (_, pt) in enumerate(near[:k], 1)}
    return out


def found_nearest(spark, queries, points, k, dims):
    q, p = spark.createDataFrame(queries, POINTS).withColumnRenamed("pt_id", "query_id"), spark.createDataFrame(points, POINTS)
    return {(r.cloud_id, r.query_id, r.pt_id, r.place) for r in pointcloud.nearest(q, p, k, "xyz"[:dims], ("cloud_id",)).collect()}


def clump(rng, cloud, first, n, at, width):
    return [(cloud, first + i, *(a + rng.gauss(0, width) for a in at)) for i in range(n)]


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_nearest_of_uneven_clouds_with_equal_ids(spark, dims):
    rng = random.Random(dims)
    points = clump(rng, 1, 0, 150, (0, 0, 0), 1) + clump(rng, 1, 150, 150, (5, 5, 1), 0.001) + [(1, 900, 1e6, -1e6, 3.0)]
    points += clump(rng, 2, 0, 40, (100, 0, 0), 30) + [(2, 50 + i, 7.0, 7.0, 7.0) for i in range(60)] + [(3, 1, 0.0, 0.0, 0.0)]
    queries = points[::7] + [(1, 5000, -1e7, 0.0, 0.0), (2, 5001, 7.0, 7.0, 7.0), (9, 5002, 0.0, 0.0, 0.0)]
    k = 2 * dims - 1
    assert found_nearest(spark, queries, points, k, dims) == brute_nearest(queries, points, k, dims)


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_nearest_asks_beyond_the_walls_of_small_leaves(spark, dims):
    rng = random.Random(dims)
    points = [(1, i, float(rng.randrange(30)), float(rng.randrange(30)), float(rng.randrange(30))) for i in range(400)]
    points += [(1, 2000 + i, 7.0, 7.0, 7.0) for i in range(60)] + [(2, 3000, 1.0, 1.0, 1.0), (1, 3001, 60.0, 0.0, 0.0)]
    queries = points[::9] + [(1, 5000, -1e6, 0.0, 15.0), (1, 5001, 50.0, 15.0, 15.0), (2, 5002, 9.0, 9.0, 9.0), (9, 5003, 0.0, 0.0, 0.0)]
    q, p = spark.createDataFrame(queries, POINTS).withColumnRenamed("pt_id", "query_id"), spark.createDataFrame(points, POINTS)
    got = cells.nearest(q, p, 3, "xyz"[:dims], ("cloud_id",), ("y",), ("z",), most=16)
    assert {(r.cloud_id, r.query_id, r.pt_id, r.place) for r in got.collect()} == brute_nearest(queries, points, 3, dims)
    z = {p[1]: p[4] for p in points}
    assert all(r.z == z[r.pt_id] for r in got.collect())


def test_nearest_writes_a_query_once(spark, monkeypatch):
    rng = random.Random(3)
    points = [(1, i, rng.random(), rng.random(), 0.0) for i in range(3000)]
    rows = {}

    def counted(df, name, *more):
        out = write(df, name, *more)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    write = cells.materialize
    monkeypatch.setattr(cells, "materialize", counted)
    assert len(found_nearest(spark, points, points, 3, 2)) == 9000
    # points, queries with their leaves, and what was found: no table of places tried or of pairs
    assert sum(rows.values()) <= 3.5 * 3000


def test_nearest_leaves_out_rows_without_a_place_and_bears_empty_tables(spark):
    points = [(1, 1, 0.0, 0.0, 0.0), (1, 2, None, 0.0, 0.0), (None, 3, 0.0, 0.0, 0.0)]
    assert found_nearest(spark, points, points, 2, 2) == {(1, 1, 1, 1)}
    assert found_nearest(spark, points, [], 2, 2) == found_nearest(spark, [], points, 2, 2) == set()


def test_a_far_stray_changes_no_leaf_of_the_others(spark):
    rng = random.Random(5)
    near = [(1, i, rng.random(), rng.random(), 0.0) for i in range(2000)]

    def largest(rows):
        cut = cells.tree(spark.createDataFrame(rows, POINTS), ("cloud_id",), "xy", 32)
        return cut.cells.where("NOT cut").agg(F.max("n"), F.sum("n")).first()

    assert largest(near)[0] <= 32 and largest(near)[1] == 2000
    stray = largest([*near, (1, 9999, 1e7, 1e7, 0.0)])
    assert stray[0] <= 32 and stray[1] == 2001


def boxes(rng, n, widths):
    out = []
    for i in range(n):
        x, y, w, h = rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice(widths) * rng.random(), rng.choice(widths) * rng.random()
        out.append((i % 3, i, x, x + w, y, y + h))
    return [*out, (0, n, 1.0, 1.0, 2.0, 2.0), (0, n + 1, 1.0, 1.0, 2.0, 2.0), (0, n + 2, 1.0, 5.0, 2.0, 2.0)]


def touch(a, b):
    return a[0] == b[0] and a[2] <= b[3] and b[2] <= a[3] and a[4] <= b[5] and b[4] <= a[5]


BOXES = "g long, id long, minx double, maxx double, miny double, maxy double"


def test_box_pairs_and_joins_equal_brute_force(spark):
    rng = random.Random(7)
    rows, others = boxes(rng, 150, (0.01, 1, 30, 0)), boxes(rng, 80, (1e-6, 4, 1e5))
    a, b = spark.createDataFrame(rows, BOXES), spark.createDataFrame(others, BOXES)
    got = [(r.a.id, r.b.id) for r in cells.box_pairs(a, ("g",), "id", BOX).collect()]
    assert len(got) == len(set(got)) and set(got) == {(x[1], y[1]) for x in rows for y in rows if x[1] < y[1] and touch(x, y)}
    got = [(r.a.id, r.b.id) for r in cells.box_join(a, b, ("g",), BOX).collect()]
    assert len(got) == len(set(got)) and set(got) == {(x[1], y[1]) for x in rows for y in others if touch(x, y)}


def test_wide_boxes_and_degrees_make_rows_in_proportion(spark):
    metres = [(1, i, 10.0 * i, 10.0 * i + 9, 0.0, 9.0) for i in range(500)] + [(1, 9000, 0.0, 3e5, 0.0, 3e5)]
    for scale in (1.0, 1e-5):
        df = spark.createDataFrame([(g, i, *(v * scale for v in box)) for g, i, *box in metres], BOXES)
        levels, _ = cells._levels(BOX, df)
        assert cells._placed(df, BOX, levels, False).count() <= 8 * len(metres) + 8
        assert cells.box_pairs(df, ("g",), "id", BOX).count() == 500


def test_adjacency_of_degrees(spark):
    rows = [(i, 1, 77 + 1e-4 * (i % 20), 77 + 1e-4 * (i % 20 + 1), 28 + 1e-4 * (i // 20), 28 + 1e-4 * (i // 20 + 1), 0.0, 3.0) for i in range(200)]
    units = spark.createDataFrame(rows, "suid long, parent_suid long, minx double, maxx double, miny double, maxy double, z_min double, z_max double")
    got = {(r.suid_1, r.suid_2) for r in topology.adjacency(units).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and all(a[k] <= b[k + 1] and b[k] <= a[k + 1] for k in (2, 4, 6))}


def brute_dbscan(rows, eps, least):
    out = set()
    for cloud in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == cloud]
        x = np.array([[r[2], r[3]] for r in own])
        near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= eps * eps
        core = near.sum(axis=1) >= least
        label = np.array([r[1] for r in own], dtype=float)
        for _ in range(len(own)):
            new = np.array([label[near[i] & core].min() if core[i] else label[i] for i in range(len(own))])
            if (new == label).all():
                break
            label = new
        for i, r in enumerate(own):
            if core[i] or (near[i] & core).any():
                out.add((cloud, r[1], int(label[i] if core[i] else label[near[i] & core].min())))
    return out


def test_clusters_of_clumps_chains_and_noise_with_equal_ids(spark):
    rng = random.Random(9)
    rows = clump(rng, 1, 0, 120, (0, 0, 0), 0.2) + clump(rng, 1, 120, 60, (3, 0, 0), 0.5) + [(1, 200 + i, 10 + 0.9 * i, 10.0, 0.0) for i in range(30)]
    rows += [(2, i, rng.uniform(0, 8), rng.uniform(0, 8), 0.0) for i in range(150)] + [(2, 300, 1e5, 0.0, 0.0)]
    for eps, least in ((0.9, 3), (2.0, 12)):
        got = pointcloud.dbscan(spark.createDataFrame(rows, POINTS), eps, least).collect()
        assert {(r.cloud_id, r.pt_id, r.cluster) for r in got} == brute_dbscan(rows, eps, least) and len(got) == len({(r.cloud_id, r.pt_id) for r in got})


def test_outliers_and_heights_keep_clouds_apart(spark):
    rows = [(c, i, float(i % 5), float(i // 5), float(c)) for c in (1, 2) for i in range(25)] + [(2, 25, 500.0, 0.0, 9.0)]
    points = spark.createDataFrame(rows, POINTS).withColumn("classification", F.when(F.col("pt_id") < 20, 2).otherwise(6))
    assert {(r.cloud_id, r.pt_id) for r in pointcloud.outliers_by_distance(points, 3).collect()} == {(1, 0), (1, 4), (1, 20), (1, 24), (2, 25)}
    heights = pointcloud.height_above_ground(points).collect()
    assert len(heights) == 51 and {(r.cloud_id, r.pt_id): r.height for r in heights}[2, 25] == 7.0
    assert {r.height for r in heights if r.pt_id < 25} == {0.0}


def test_dbscan_over_borders_of_tiles_sends_no_noise_around(spark, monkeypatch):
    rng = np.random.default_rng(12)
    places = np.concatenate([rng.integers(-40, 40, (150, 2)), rng.integers(60, 68, (120, 2)), rng.integers(-4, 4, (60, 2))]) / 1.0
    rows = [(k % 2, k, float(x), float(y), 0.0) for k, (x, y) in enumerate(places)]
    kept = []
    monkeypatch.setattr(pointcloud, "discard", lambda *tables: kept.extend(tables))
    for most in (200_000, 20):
        got = pointcloud.dbscan(spark.createDataFrame(rows, POINTS), 1.5, 5, most=most).collect()
        assert {(r.cloud_id, r.pt_id, r.cluster) for r in got} == brute_dbscan(rows, 1.5, 5) and len(got) == len({r.pt_id for r in got})
    marked = next(t for t in kept if "kind" in t.columns)
    assert marked.where("kind > 0").count() == len(got) < len(rows)
