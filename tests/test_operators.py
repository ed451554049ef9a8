import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotstack.functions import geometry as G
from lotstack.functions import kernel
from lotstack.operators import constraints, delineate, features, inference, pointcloud, runs, synth, topology
from lotstack.operators.graph import components

SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]


def ring(points):
    return F.array(*(G.point(F.lit(x), F.lit(y)) for x, y in points))


def test_ring_measures(spark):
    row = spark.range(1).select(G.shoelace_area(ring(SQUARE)).alias("a"), G.perimeter(ring(SQUARE)).alias("p"), G.contains(ring(SQUARE), F.lit(1.0), F.lit(1.0)).alias("i"), G.contains(ring(SQUARE), F.lit(5.0), F.lit(1.0)).alias("o")).first()
    assert (row.a, row.p, row.i, row.o) == (12.0, 14.0, True, False)


def test_solid_text_reads_back(spark):
    row = spark.range(1).select(G.solid_wkt(ring(SQUARE), F.lit(0.0), F.lit(3.0)).alias("w"), G.solid_wkt(ring(SQUARE[:2]), F.lit(0.0), F.lit(3.0)).alias("e")).first()
    assert row.w.startswith("POLYHEDRALSURFACE Z (((0.0 0.0 0.0, 4.0 0.0 0.0") and row.e == "POLYHEDRALSURFACE Z EMPTY"
    rings = spark.createDataFrame([(row.w,), (row.e,)], "w string").select(G.read_wkt_rings(F.col("w")).alias("r")).collect()
    assert len(rings[0].r) == 6 and rings[1].r is None
    # a closed surface: every undirected edge belongs to two faces
    uses = {}
    for face in rings[0].r:
        for a, b in zip(face, face[1:]):
            key = frozenset((tuple(a), tuple(b)))
            uses[key] = uses.get(key, 0) + 1
    assert set(uses.values()) == {2}


def test_kernel_hull_and_clip():
    rng = np.random.default_rng(1)
    pts = rng.random((200, 2))
    h = kernel.hull(pts)
    for p in pts:
        assert all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= -1e-12 for a, b in zip(h, np.roll(h, -1, axis=0)))
    assert kernel.area(kernel.clip(np.array(SQUARE), np.array([(1, 1), (9, 1), (9, 9), (1, 9)]))) == pytest.approx(6.0)
    assert kernel.box_union(np.array([[0, 0, 2, 2], [1, 1, 3, 3], [10, 10, 11, 11]]))[0] == pytest.approx(7.0)


def units(spark, rows):
    return spark.createDataFrame(rows, "suid long, parent_suid long, floor_level int, z_min double, z_max double")


def test_vertical_modes(spark):
    u = units(spark, [(1, 1, 0, 0.0, 3.0), (2, 1, 1, 3.5, 6.0), (3, 1, 2, 5.5, 9.0)])
    intent = {(r.suid_1, r.suid_2): (round(r.gap, 6), r.relation) for r in topology.vertical_consecutive(u).collect()}
    assert intent == {(1, 2): (0.5, "gap"), (2, 3): (-0.5, "overlap")}
    assert all(r.relation == "overlap" for r in topology.vertical_consecutive(u, "asis").collect())
    assert topology.vertical_gaps(u.where("suid < 0")).count() == 0


def test_tetra_rules(spark):
    a, b, c = {"x": 0.0, "y": 0.0, "z": 0.0}, {"x": 1.0, "y": 0.0, "z": 0.0}, {"x": 0.0, "y": 1.0, "z": 0.0}
    up, down = {"x": 0.0, "y": 0.0, "z": 1.0}, {"x": 0.0, "y": 0.0, "z": -1.0}
    rows = [(0, "u-1", [a, b, c, up]), (1, "v-1", [a, c, b, down]), (2, "w-1", [a, b])]
    u = spark.createDataFrame(rows, "ord long, suid string, vertices array<struct<x:double,y:double,z:double>>")
    faces = topology.tetra_faces(u.withColumnRenamed("ord", "tet"))
    assert faces.count() == 8
    got = topology.shared_faces(faces).collect()
    assert [(r.suid_1, r.suid_2, r.relation) for r in got] == [("u-1", "v-1", "adjacent")]
    report = topology.validate(u.where("ord < 2"))
    assert {r.rule for r in report.collect()} >= {1} and report.columns == ["rule", "suid_1", "suid_2", "relation", "details", "severity"]


def test_faces_met_in_tiles_are_those_met_by_their_keys(spark):
    rng = np.random.default_rng(8)
    spot = lambda v: {k: (None if x is None else float(x)) for k, x in zip("xyz", v)}
    rows = []
    for k in range(300):  # small and large ones, over the borders of tiles, with faces used once to many times, of parcels in several tiles
        wide = float(rng.choice([1, 3, 40, 700]))
        corner = rng.integers(-3, 4, 3) * wide
        v = [corner + wide * np.array(c) for c in ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, int(rng.choice([-1, 1]))))]
        if rng.random() < 0.5:
            v[1], v[2] = v[2], v[1]
        rows.append((k, f"p{k % 7}-{k % 120}" if k % 11 else "1" * 17 + f"{k:08d}", [spot(x) for x in v]))
    rows += [(300, None, rows[5][2]), (301, "p1-none", [spot((0, 0, None)), *rows[6][2][1:]]), (302, "p2-five", [*rows[7][2], spot((0, 0, 99))]), (303, "p3-few", rows[8][2][:3])]
    table = spark.createDataFrame(rows, "tet long, suid string, vertices array<struct<x:double,y:double,z:double>>")
    faces = topology.tetra_faces(table)
    plain = lambda df: sorted((tuple(r) for r in df.select(*(F.col(c).cast("string") for c in df.columns)).collect()), key=str)
    for mode in ("intent", "asis"):
        met = topology.materialize(topology.met_faces(table, mode=mode), "met")
        assert plain(topology.open_faces(met)) == plain(topology.manifold_gaps(faces, mode=mode))
        assert plain(topology._of_met(met)) == plain(topology.shared_faces(faces))
        assert mode == "asis" or {r.relation for r in met.collect()} == {"gap", "adjacent", "crowded"}


def test_tetrahedra_are_dealt_once_not_their_faces(spark):
    solids = [(k, f"p-{k}", [(float(k), 0.0, 0.0), (k + 1.0, 0.0, 0.0), (float(k), 1.0, 0.0), (float(k), 0.0, 1.0)]) for k in range(1000)]
    table = spark.createDataFrame(solids, "tet long, suid string, vertices array<struct<x:double,y:double,z:double>>")
    met = topology.met_faces(table)
    placed = [f for f in met.inputFiles() if "/placed-" in f]
    assert spark.read.parquet(*placed).count() < 1100
    dealt = [x for x in met._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert len(dealt) == 1 and "bucket" in dealt[0]
    keys = [x for x in topology.validate(table.withColumnRenamed("tet", "ord"))._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert keys and not any("face" in x for x in keys)


def test_report_of_all_rules_in_both_modes(spark):
    at = lambda x, y, z: {"x": float(x), "y": float(y), "z": float(z)}
    base = [at(0, 0, 0), at(1, 0, 0), at(0, 1, 0)]
    rows = [(0, "p-1", [*base, at(0, 0, 1)]), (1, "p-2", [base[0], base[2], base[1], at(0, 0, -1)])]
    rows += [(k, f"q-{k}", [*(at(5 + v["x"], v["y"], 0) for v in base), at(5, 0, k)]) for k in (2, 3, 4)]  # one face, used by three
    rows += [(5, "r-1", [at(9, 0, 5), at(9, 1, 5), at(9, 0, 9), at(8, 0, 9)]), (6, "r-2", [at(9, 5, 0), at(9, 6, 0), at(9, 5, 20), at(8, 5, 20)])]
    rows += [(7, "7" * 17 + "00000000", [at(0, 9, 0), at(2, 9, 0), at(0, 11, 0), at(0, 9, 3)]), (8, "7" * 17 + "00010001", [at(1, 9, 0), at(5, 9, 0), at(1, 10, 0), at(1, 9, 3)])]
    u = spark.createDataFrame(rows, "ord long, suid string, vertices array<struct<x:double,y:double,z:double>>")
    for mode in ("intent", "asis"):
        report = topology.validate(u, mode).collect()
        by = lambda rule: sorted((r.suid_1, r.suid_2, r.relation, r.severity) for r in report if r.rule == rule)
        assert by(1) == [("p-1", "p-2", "adjacent", "info"), *(("q-2" if k < 2 else "q-3", "q-3" if k == 0 else "q-4", "overlap", "error") for k in range(3))]
        assert all(r.details.startswith("shared face TRIANGLE Z ((") for r in report if r.rule == 1)
        assert by(3) == [("7" * 17 + "00010001", "7" * 17 + "00000000", "overlap", "error")]
        # the faces of r-1 that lie within its parcel's height; of its own, every face touches an end
        assert {r[0] for r in by(4)} == ({"r-1"} if mode == "intent" else set())
    # a first vertex below the others' faces: long-standing output tells no end there
    low = spark.createDataFrame([(0, "s-1", [at(0, 0, -9), at(1, 0, 0), at(0, 1, 0), at(0, 0, 1)]), (1, "s-2", [at(0, 0, 2), at(1, 0, 0), at(0, 1, 0), at(1, 1, 9)])], u.schema)
    faces = topology.tetra_faces(low.withColumnRenamed("ord", "tet"))
    assert topology.manifold_gaps(faces, mode="asis").count() == 0 and topology.manifold_gaps(faces).count() == 2


def test_split_covers_the_floor(spark):
    for n in (1, 4, 9):
        cells = spark.range(1).select(F.explode(delineate.grid_cells(F.lit(n), F.lit(0.0), F.lit(0.0), F.lit(6.0), F.lit(4.0))).alias("c")).select("c.*").collect()
        assert len(cells) == n and sum((c.maxx - c.minx) * (c.maxy - c.miny) for c in cells) == pytest.approx(24.0)


def test_extrusion_counts(spark):
    b = spark.createDataFrame([(7, 3, 4, "grid", 0.0, 0.0, 10.0, 8.0)], "building_id long, levels int, n_units int, layout string, minx double, miny double, maxx double, maxy double")
    rows = delineate.extrude(b).collect()
    assert len(rows) == 1 + 1 + 3 + 12 and len({r.suid for r in rows}) == len(rows)
    parents = {r.suid for r in rows} | {None}
    assert all(r.parent in parents for r in rows)


def cloud(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    xyz = rng.random((n, 3)) * [20, 20, 5]
    return xyz, spark.createDataFrame([(k % 2, k, *map(float, p), 2 if k % 3 else 6, 1) for k, p in enumerate(xyz)], "cloud_id long, pt_id long, x double, y double, z double, classification int, return_number int")


def test_nearest_equals_brute_force(spark):
    xyz, points = cloud(spark)
    far = spark.createDataFrame([(1000, 500.0, -300.0)], "query_id long, x double, y double")
    queries = points.where("pt_id < 40").select(F.col("pt_id").alias("query_id"), "x", "y").unionByName(far)
    got = pointcloud.nearest(queries, points, 3).collect()
    found = {(r.query_id, r.place): r.pt_id for r in got}
    for q in [*range(40), 1000]:
        at = np.array([500.0, -300.0]) if q == 1000 else xyz[q, :2]
        best = np.lexsort((np.arange(len(xyz)), np.sqrt(((xyz[:, :2] - at) ** 2).sum(axis=1))))[:3]
        assert [found[q, k] for k in (1, 2, 3)] == best.tolist()


def test_dbscan_equals_brute_force(spark):
    xyz, points = cloud(spark, 300)
    got = {r.pt_id: r.cluster for r in pointcloud.dbscan(points, 1.5, 5).collect()}
    cloud_of = np.arange(300) % 2
    d = np.sqrt(((xyz[:, None, :2] - xyz[None, :, :2]) ** 2).sum(axis=2))
    near = (d <= 1.5) & (cloud_of[:, None] == cloud_of[None, :])
    core = near.sum(axis=1) >= 5
    label = np.arange(300)
    for _ in range(300):
        new = np.array([min([label[i], *label[near[i] & core]]) if core[i] else label[i] for i in range(300)])
        if (new == label).all():
            break
        label = new
    want = {}
    for i in range(300):
        reach = np.flatnonzero(near[i] & core)
        if core[i]:
            want[i] = int(label[i])
        elif len(reach):
            want[i] = int(label[reach].min())
    assert got == want


def test_hulls_of_salted_parts(spark):
    xyz, points = cloud(spark)
    for r in pointcloud.hulls(points, "cloud_id", 4).collect():
        own = xyz[r.cloud_id :: 2]
        assert r.n == len(own) and r.area == pytest.approx(kernel.area(kernel.hull(own[:, :2])))


def test_ground_filter_finds_a_block(spark):
    rows = [(0, i * 100 + j, float(i), float(j), 6.0 if 10 <= i < 14 and 10 <= j < 14 else 0.01 * i, 1, 1) for i in range(30) for j in range(30)]
    points = spark.createDataFrame(rows, "cloud_id long, pt_id long, x double, y double, z double, classification int, return_number int")
    got = {r.pt_id: r.is_ground for r in pointcloud.ground_filter(points, 1.0, 8, tile=16).collect()}
    assert len(got) == 900
    assert all(got[k] == (z < 5) for _, k, _, _, z, _, _ in rows)


def test_ground_filter_sends_points_to_their_tiles_once(spark):
    rows = [(c, i * 40 + j, float(i), float(j), 6.0 if (i - 15 * c) // 4 == 2 and j // 4 == 2 else 0.01 * i) for c in (0, 1) for i in range(40) for j in range(40)]
    rows += [(0, -1, 0.0, 0.0, None), (0, -2, None, 0.0, 1.0), (None, -3, 0.0, 0.0, 1.0), (1, -4, 500.0, 500.0, None)]
    points = spark.createDataFrame(rows, "cloud_id long, pt_id long, x double, y double, z double")
    found = pointcloud.ground_filter(points, 1.0, 8, tile=16)
    dealt = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x or "Join" in x]
    assert len(dealt) == 1 and "tx" in dealt[0]
    got = {(r.cloud_id, r.pt_id): r.is_ground for r in found.collect()}
    want = {(c, k): None if z is None else z < 5 for c, k, x, _, z in rows if c is not None and x is not None}
    assert got == want


@pytest.mark.parametrize("w", [1, 2, 3, 4, 7, 16])
def test_moving_least_takes_steps_by_the_logarithm_of_its_width(w):
    rng = np.random.default_rng(w)
    grid, taken = rng.random((40, 23)), []

    def least(a, b):
        taken.append(1)
        return np.minimum(a, b)

    near = lambda i, j: grid[max(i - w, 0) : i + w + 1, max(j - w, 0) : j + w + 1]
    want = np.array([[near(i, j).min() for j in range(23)] for i in range(40)])
    assert (pointcloud._moving(grid, w, np.minimum) == want).all()
    assert (pointcloud._moving(-grid, w, np.maximum) == -want).all()
    least.reduce = lambda parts: [taken.append(1) for _ in parts] and np.minimum.reduce(parts)
    pointcloud._moving(grid, w, least)
    assert len(taken) <= 2 * (2 + np.log2(2 * w + 1))


def test_farthest_points_start_small(spark):
    _, points = cloud(spark, 50)
    got = pointcloud.farthest_points(points, 5).orderBy("cloud_id", "place").collect()
    assert len(got) == 10 and got[0].pt_id == 0 and len({(r.cloud_id, r.pt_id) for r in got}) == 10


def test_farthest_points_of_whole_clouds_without_grouping_them(spark):
    rng = random.Random(3)
    rows = [(c, k, *(float(rng.randint(0, 9)) for _ in range(3))) for c, size in ((0, 60), (1, 3)) for k in range(size)]
    got = pointcloud.farthest_points(spark.createDataFrame(rows, "cloud_id long, pt_id long, x double, y double, z double"), 6)
    want = []
    for c in (0, 1):
        left, out = {k: p for d, k, *p in rows if d == c}, []
        while left and len(out) < 6:
            k = max(left, key=lambda k: (min((sum((a - b) ** 2 for a, b in zip(left[k], q)) for q in out), default=0), -k))
            want.append((c, len(out), k))
            out.append(left.pop(k))
    assert sorted(map(tuple, got.collect())) == want
    assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (9, 8), (8, 7), (7, 4), (20, 20)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 5: 4, 7: 4, 8: 4, 9: 4}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pages_and_filters(spark):
    u = spark.range(250).select(F.col("id").alias("suid"), F.lit("unit").alias("type"), (F.col("id") % 3).cast("int").alias("floor_level"), F.col("id").cast("double").alias("minx"), (F.col("id") + 1).cast("double").alias("maxx"), F.lit(0.0).alias("miny"), F.lit(1.0).alias("maxy"))
    assert [r.suid for r in features.page(u, 10, 20).collect()] == list(range(20, 30))
    assert features.filtered(u, "", None).count() == 250 and features.filtered(u, None, 0).count() == 84
    assert features.in_bbox(u, "10,0,12,1").count() == 4 and features.in_bbox(u, "10,zero,12").count() == 250
    assert features.page_links(u, 100, 200).first().next_offset is None
    with pytest.raises(ValueError):
        features.page(u, 0)


def test_safe_casts(spark):
    rows = spark.createDataFrame([("3.7",), ("-3.7",), (" 4 ",), ("x",), ("",), (None,), ("nan",)], "t string")
    assert [r[0] for r in rows.select(features.safe_int(F.col("t"))).collect()] == [3, -3, 4, None, None, None, None]


def test_insert_absent_and_members(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (2, "z"), (2, "z")], "k int, v string")
    assert sorted(map(tuple, constraints.insert_absent(a, b, "k").collect())) == [(1, "x"), (2, "z")]
    assert [r.is_valid for r in constraints.members(a, "v", ["X"]).collect()] == [True]


def test_softmax_sums_to_one(spark):
    row = spark.range(1).select(inference.softmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(1000.0))).alias("s"), inference.argmax(F.array(F.lit(1), F.lit(3), F.lit(3))).alias("a")).first()
    assert math.isclose(sum(row.s), 1.0) and row.a == 1


def test_patches_cover_every_cell(spark):
    cells = spark.range(40).select(F.lit("i").alias("img_id"), F.lit(0).alias("c"), F.col("id").alias("y"), F.lit(0).cast("long").alias("x"), F.lit(1.0).alias("v"))
    got = inference.patches(cells, 16, 4).groupBy("y").agg(F.collect_set("py").alias("p")).collect()
    assert len(got) == 40 and all(p % 12 == 0 and p <= r.y < p + 16 for r in got for p in r.p)


def test_model_is_a_callable(spark):
    rows = spark.range(20).select((F.col("id") % 2).alias("tile_id"), F.col("id").alias("pt_id"), *(F.col("id").cast("double").alias(c) for c in "xyzrgb"))
    got = inference.predicted(rows, lambda x: np.stack([x[:, 0], -x[:, 0]], axis=1)).collect()
    assert len(got) == 20 and all(len(r.scores) == 2 for r in got)


def test_sampling_repeats_small_clouds(spark):
    rows = spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "cloud_id long, pt_id long")
    got = inference.sampled(rows, 4).groupBy("cloud_id").count().collect()
    assert {r.cloud_id: r["count"] for r in got} == {0: 4, 1: 4}


def test_synthetic_building_is_the_same_every_time(spark):
    a = synth.building(spark, 1, 20.0, 15.0, 3, points=500)
    b = synth.building(spark, 1, 20.0, 15.0, 3, points=500).repartition(5)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert synth.dataset(spark, 3, points=100).select("cloud_id").distinct().count() == 3


def test_synthetic_buildings_hold_every_class_that_is_drawn(spark):
    told = {r.label for r in synth.building(spark, 1, 20.0, 15.0, 3, points=4000).select("label").distinct().collect()}
    assert told == {-1, 0, 1, 2, 3, 4, 5, 6, 8}
    many = synth.dataset(spark, 40, points=500)
    assert many.groupBy("cloud_id").count().where("count = 500").count() == 40 and "Union" not in many._jdf.queryExecution().executedPlan().toString()


def test_relations_of_nested_and_touching_boxes(spark):
    boxes = [(1, 0, 10, 0, 10, 0, 10), (2, 1, 3, 1, 3, 1, 3), (3, 10, 12, 10, 12, 10, 12), (4, 9, 11, 0, 5, 0, 5), (5, 0, 10, 0, 10, 0, 10), (6, 500, 501, 0, 1, 0, 1)]
    units = spark.createDataFrame([(s, 7, *map(float, b)) for s, *b in boxes], "suid long, parent_suid long, minx double, maxx double, miny double, maxy double, z_min double, z_max double")
    got = {(r.suid_1, r.suid_2): r.relation for r in topology.adjacency(units).collect()}
    assert got == {(1, 2): "contain", (1, 3): "adjacent", (1, 4): "overlap", (1, 5): "contain", (2, 5): "unknown", (3, 5): "adjacent", (4, 5): "overlap"}
    assert {(r.suid_1, r.suid_2) for r in topology.overlaps(units).collect()} == {(1, 2), (1, 4), (1, 5), (2, 5), (4, 5)}


def test_lookup_refuses_two_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    assert [r.v for r in features.lookup(rows, "k", 2).collect()] == ["c"] and features.lookup(rows, "k", 3).count() == 0
    with pytest.raises(Exception, match="more than one row"):
        features.lookup(rows, "k", 1).collect()


def test_quantiles_equal_exact_percentiles(spark):
    rng = np.random.default_rng(5)
    rows = [(k % 3, float(v)) for k, v in enumerate(np.round(rng.lognormal(0, 3, 900), 2))] + [(7, 4.0), (8, None), (9, -1.0), (9, 1.0)] + [(7, 4.0)] * 40
    df = spark.createDataFrame(rows, "g int, v double")
    for bins in (1, 16, 1024):
        got = {r.g: (r.lo, r.mid, r.hi) for r in pointcloud.quantiles(df, ("g",), "v", {"lo": 0.02, "mid": 0.5, "hi": 0.98}, bins).collect()}
        assert set(got) == {0, 1, 2, 7, 9}
        for g, found in got.items():
            assert found == pytest.approx(tuple(np.quantile([v for k, v in rows if k == g], [0.02, 0.5, 0.98])))


def test_outliers_of_a_dense_clump_and_a_stray_point(spark):
    rows = [(0, k, 0.001 * k, 0.0, 0.0) for k in range(300)] + [(0, 1000, 0.9, 0.0, 0.0), (0, 1001, 50.0, 0.0, 0.0), (1, 1002, 0.0, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "cloud_id long, pt_id long, x double, y double, z double")
    got = {r.pt_id: r.neighbours for r in pointcloud.outliers_by_radius(points, 1.0, 5).collect()}
    assert got == {1001: 0, 1002: 0}


def test_levels_need_enough_slab_points(spark):
    rows = [(c, c * 1000 + k, k % 10 / 2, k // 10 % 10 / 2, 3.0 * (k // 100), 2) for c, n in ((0, 300), (1, 60)) for k in range(n)]
    points = spark.createDataFrame(rows, "cloud_id long, pt_id long, x double, y double, z double, classification int")
    got = sorted((r.cloud_id, r.level, r.z, r.area) for r in pointcloud.levels_with_outlines(points).collect())
    assert got == [(0, 0, 0.0, 20.25), (0, 1, 3.0, 20.25), (0, 2, 6.0, 20.25)]


def test_scan_to_levels_with_a_model(spark):
    rows = [("a", 0, k, k, k % 10 / 2, k // 10 / 2, 3.0, 65535.0, 0.0, 0.0) for k in range(100)]
    scan = spark.createDataFrame(rows, "file string, cloud_id long, pt_id long, place long, x double, y double, z double, r double, g double, b double")
    seen = lambda x: np.eye(4)[np.where(x[:, 3] > 0.5, 2, 1)]
    got = inference.levels_of_scan(scan, seen, 64).collect()
    assert [(r.cloud_id, r.level, r.z, r.area) for r in got] == [(0, 0, 3.0, 20.25)]


def test_scan_goes_through_the_model_once(spark):
    rows = [("a", 0, k, k, k % 10 / 2, k // 10 / 2, 3.0, 65535.0, 0.0, 0.0) for k in range(100)]
    scan = spark.createDataFrame(rows, "file string, cloud_id long, pt_id long, place long, x double, y double, z double, r double, g double, b double")
    tiles = spark.sparkContext.accumulator(0)

    def model(x):
        tiles.add(1)
        return np.eye(4)[np.where(x[:, 3] > 0.5, 2, 1)]

    assert inference.levels_of_scan(scan, model, 64).count() == 1
    assert tiles.value == 3


def test_hull_of_columns_of_points():
    grid = np.array([(float(i), float(j)) for i in range(50) for j in range(i % 3, 60 - i % 7)])
    corners = kernel.hull(grid)
    assert [tuple(c) for c in corners] == [(0.0, 0.0), (48.0, 0.0), (49.0, 1.0), (49.0, 59.0), (0.0, 59.0)]
    assert kernel.hull(np.array([(1.0, 2.0), (1.0, 5.0), (1.0, 3.0)])).tolist() == [[1.0, 2.0], [1.0, 5.0]]


def test_building_points_stand_above_ground(spark):
    ground = [(0, k, float(k % 20), float(k // 20), 0.0, 2) for k in range(400)]
    roof = [(0, 1000 + k, float(k % 6), float(k // 6), 5.0, 6) for k in range(36)] + [(0, 2000 + k, 12.0 + k % 6, float(k // 6), 1.0, 6) for k in range(36)]
    points = spark.createDataFrame(ground + roof, "cloud_id long, pt_id long, x double, y double, z double, classification int")
    assert [(r.n, r.area) for r in pointcloud.footprints(points, eps=3.0, least=10, least_height=3.0).collect()] == [(36, 25.0)]
    assert pointcloud.footprints(points, eps=3.0, least=10).count() == 2


def test_chain_in_metres_of_a_zone(spark):
    rows = [(0, k, 75.0 + 1e-5 * (k % 20), 28.0 + 1e-5 * (k // 20), 0.1 * (k % 3), 1, 1) for k in range(400)]
    points = spark.createDataFrame(rows, "cloud_id long, pt_id long, x double, y double, z double, classification int, return_number int")
    got = pointcloud.process(points, 2.0, zone=43)
    span = got["points"].agg(F.min("x"), F.max("x")).first()
    assert 499_999 < span[0] and span[1] < 500_020
    assert got["terrain"].where("z IS NULL").count() == 0 and got["surface"].count() > 0


def test_rasters_are_turned_cropped_and_grown(spark):
    cells = spark.createDataFrame([(0, y, x, float(3 * y + x)) for y in range(2) for x in range(3)], "img_id long, y int, x int, v double")
    grid = np.arange(6).reshape(2, 3)
    got = {(r.y, r.x): r.v for r in inference.turned_raster(cells, 2, 3, 1, flip_y=True).collect()}
    want = np.rot90(np.flip(grid, 0))
    assert got == {(y, x): want[y, x] for y in range(3) for x in range(2)}
    grown = {(r.y, r.x): r.v for r in inference.reflected(cells, 4, 1).collect()}
    want = np.pad(grid, ((0, 2), (0, 1)), "reflect")
    assert grown == {(y, x): want[y, x] for y in range(4) for x in range(4)}
    assert inference.cropped(cells, 1).count() == 1 and inference.cropped(cells, 5).count() == 6
    averaged = inference.uncropped(inference.reflected(cells, 4, 1).withColumn("score", F.col("v")))
    assert {(r.y, r.x): r.score for r in averaged.collect()} == {(y, x): grid[y, x] for y in range(2) for x in range(3)}


def test_noise_is_drawn_by_id(spark):
    points = spark.range(2000).select(F.col("id").alias("pt_id"), *(F.lit(1.0).alias(k) for k in "xyz"))
    told = inference.jittered(points, 0.5, 3).agg(F.avg("x"), F.stddev_pop("y")).first()
    assert abs(told[0] - 1) < 0.05 and abs(told[1] - 0.5) < 0.05
    kept = inference.thinned(points, 0.1, 3)
    assert 1700 < kept.count() < 1900 and kept.exceptAll(inference.thinned(points, 0.1, 3)).count() == 0


def test_rings_without_area_have_no_units(spark):
    rows = [(1, 2, 2, "perimeter", "mixed", [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]], None), (2, 2, 2, "whole", "mixed", [[0.0, 0.0], [4.0, 0.0], [2.0, 0.0]], None)]
    plots = spark.createDataFrame(rows, "building_id long, levels int, n_units int, layout string, building_type string, ring array<array<double>>, holes array<array<array<double>>>")
    got = delineate.extrude_rings(plots).collect()
    assert sorted(r.type for r in got) == ["building", "floor", "floor", "parcel"] + ["unit"] * 4
    assert {r.metadata["building_id"] for r in got} == {"1"} and {r.metadata.get("unit_type") for r in got if r.type == "unit"} == {"mixed"}


def test_json_objects_merge_by_their_first_keys(spark):
    rows = [('{"a":1,"b":[1,{"c":null}]}', '{"b":"x","error":"no \\"room\\""}'), (None, '{"a":null}'), ('{"a":1.5}', None), (None, None), ("[1]", "x"), ("{}", '{"k":{"a":1}}')]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] and json.loads(r[0]) for r in df.select(features.merged_json(F.col("a"), F.col("b"))).collect()]
    assert got == [{"a": 1, "b": "x", "error": 'no "room"'}, {"a": None}, {"a": 1.5}, None, {}, {"k": {"a": 1}}]


def test_floor_polygons_merge_by_unit(spark):
    box = lambda x, y, w: [[[x, y], [x + w, y], [x + w, y + 2.0], [x, y + 2.0]]]
    rows = [(0, "A", "flat", box(0.0, 0.0, 2.0)), (0, "A", "flat", box(1.0, 0.0, 2.0)), (0, "A", "flat", box(9.0, 9.0, 0.1)), (0, "A", "shop", box(0.0, 0.0, 2.0)), (1, None, "flat", box(5.0, 0.0, 3.0))]
    units = delineate.merged_units(spark.createDataFrame(rows, "level int, unit_id string, unit_type string, rings array<array<array<double>>>"))
    assert sorted((r.level, str(r.unit_id), r.unit_type, round(r.area, 6)) for r in units.collect()) == [(0, "A", "flat", 6.0), (0, "A", "shop", 4.0), (1, "None", "flat", 6.0)]


def test_outlines_or_boxes(spark):
    rows = [(1, [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0]], 8.0), (2, [[0.0, 0.0], [4.0, 0.0]], 0.0)]
    got = {r.k: r.hull for r in pointcloud.outline_or_box(spark.createDataFrame(rows, "k int, hull array<array<double>>, area double")).collect()}
    assert got == {1: rows[0][1], 2: [[-0.5, -0.5], [4.5, -0.5], [4.5, 0.5], [-0.5, 0.5]]}


def test_degrees_come_back_from_the_plane_to_the_eighth_place_and_beyond_a_pole(spark):
    rows = [(77 + 0.013 * (i % 40), -89.9 + 0.26 * i) for i in range(1600)] + [(-1.5, -200.0), (179.0, 89.99)]
    at = spark.createDataFrame(rows, "x double, y double").select("x", "y", G.on_globe(F.col("x"), F.col("y")).alias("g")).withColumn("zone", G.utm_zone(F.col("g.lon")))
    planes = at.select("*", G.utm(F.col("g.lon"), F.col("g.lat"), F.col("zone")).alias("u"), G.web_mercator(F.col("g.lon"), F.col("g.lat")).alias("m"))
    back = planes.select("x", "y", "g.turns", G.from_utm(F.col("u.x"), F.col("u.y"), F.col("zone")).alias("u"), G.from_web_mercator(F.col("m.x"), F.col("m.y")).alias("m"))
    whole = back.select("x", "y", *(G.off_globe(F.col(f"{k}.lon"), F.col(f"{k}.lat"), F.col("turns")).alias(k) for k in "um"))
    for r in whole.collect():
        assert max(abs(r.u.lon - r.x), abs(r.m.lon - r.x), abs(r.u.lat - r.y), abs(r.m.lat - r.y)) < 1e-9, r


def test_rows_of_one_small_file_are_worked_out_by_many_tasks(spark, tmp_path):
    ring = [[0.0, 0.0], [8.0, 0.0], [8.0, 4.0], [4.0, 4.0], [4.0, 8.0], [0.0, 8.0]]
    spark.createDataFrame([(i, 4, "grid", ring) for i in range(200)], "building_id long, n_units int, layout string, ring array<array<double>>").coalesce(1).write.parquet(str(tmp_path / "floors"))
    units = delineate.split_rings(spark.read.parquet(str(tmp_path / "floors")))
    assert units.groupBy("building_id").agg(F.sum("area").alias("a"), F.count("*").alias("n")).where("a <> 48 OR n <> 3").count() == 0
    assert units.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_each_corner_of_a_solid_is_written_once(spark):
    ring = F.transform(F.col("r"), lambda p: G.point(p[0], p[1]))
    text = spark.createDataFrame([([[0.0, 0.0], [1.25, 0.0], [0.0, 2.0]],)], "r array<array<double>>").select(G.solid_wkt(ring, F.lit(-1.5), F.lit(3.0)).alias("w"))
    assert text.first().w == (
        "POLYHEDRALSURFACE Z (((0.0 0.0 -1.5, 1.25 0.0 -1.5, 0.0 2.0 -1.5, 0.0 0.0 -1.5)), ((0.0 0.0 3.0, 0.0 2.0 3.0, 1.25 0.0 3.0, 0.0 0.0 3.0)), "
        "((0.0 0.0 -1.5, 1.25 0.0 -1.5, 1.25 0.0 3.0, 0.0 0.0 3.0, 0.0 0.0 -1.5)), ((1.25 0.0 -1.5, 0.0 2.0 -1.5, 0.0 2.0 3.0, 1.25 0.0 3.0, 1.25 0.0 -1.5)), "
        "((0.0 2.0 -1.5, 0.0 0.0 -1.5, 0.0 0.0 3.0, 0.0 2.0 3.0, 0.0 2.0 -1.5)))"
    )
    assert text._jdf.queryExecution().optimizedPlan().toString().count("format_string") <= 8


def test_many_small_groups_share_batches(spark):
    rows = spark.createDataFrame([(f"t{i % 900}", i, float(i)) for i in range(9000)], "tile string, id long, v double").repartition(3)
    calls = runs.per_run(rows, ("tile",), ["id"], lambda g: (np.flatnonzero(g["v"] >= 900), {"top": np.full((g["v"] >= 900).sum(), g["v"].max()), "pair": np.column_stack([g["v"], -g["v"]])[g["v"] >= 900]}), "top double, pair array<double>")
    got = {r.id: (r.top, r.pair) for r in calls.collect()}
    assert got == {i: (float(8100 + i % 900), [float(i), -float(i)]) for i in range(900, 9000)}
    assert "FlatMapGroupsInPandas" not in calls._jdf.queryExecution().executedPlan().toString()
    tiles = spark.createDataFrame([("a", 1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)], "tile_id string, pt_id long, x double, y double, z double, r double, g double, b double")
    plan = inference.predicted(tiles, lambda x: np.eye(2)[np.zeros(len(x), int)])._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan


def test_faces_meet_by_short_keys_in_one_pass(spark, monkeypatch):
    spot = "struct<x:double,y:double,z:double>"
    solids = [(k, f"p-{k}", [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, float(k))]) for k in (1, 2)]
    faces = topology.tetra_faces(spark.createDataFrame(solids, f"tet long, suid string, vertices array<{spot}>"))
    shuffles = lambda df: [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x or "Aggregate(" in x]
    gaps = shuffles(topology.manifold_gaps(faces).drop("face_key"))
    assert gaps and not any("face_key" in x for x in gaps)
    written = []
    monkeypatch.setattr(topology, "materialize", lambda df, name: written.append((name, shuffles(df))) or df)
    assert topology.shared_faces(faces, told=False).columns == ["suid_1", "suid_2", "relation", "severity"]
    assert [name for name, _ in written] == ["used"] and not any("face_key" in x for x in written[0][1])


def test_over_used_edges_are_counted_within_units_without_shuffling_edges(spark):
    random.seed(4)
    place = lambda: tuple(float(random.randint(0, 2)) for _ in range(3))
    rows = [(random.choice([None, "a", "b", "c", "d"]), [place() for _ in range(random.choice([3, 4, 5]))]) for _ in range(60)]
    rows += [("near", [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, z)]) for z in (1.0, 1.004, 2.0)]
    df = spark.createDataFrame(rows, "suid string, vertices array<struct<x:double,y:double,z:double>>")
    true = {}
    for suid, v in rows:
        for face in itertools.combinations(v[:4], 3) if len(v) > 3 else []:
            for a, b in itertools.combinations(face, 2):
                edge = (suid, *sorted(tuple(round(c / 0.01) for c in p) for p in (a, b)))
                true[edge] = true.get(edge, 0) + 1
    found = topology.over_used_edges(df)
    assert {(r.suid, *map(tuple, r.edge_key)): r.uses for r in found.collect()} == {e: n for e, n in true.items() if n > 2}
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_outliers_by_radius_count_in_tiles_that_few_points_are_twice_in(spark):
    rng = np.random.default_rng(8)
    places = np.concatenate([rng.integers(-150, 150, (900, 3)) / 1.0 * (1, 1, 0.05), rng.integers(-6, 6, (500, 3)) / 2.0])
    rows = [(int(rng.integers(0, 2)), k, *map(float, p)) for k, p in enumerate(places)] + [(None, 5000, 0.0, 0.0, 0.0), (1, 5001, None, 0.0, 0.0), (1, 5002, 1e9, -1e9, 0.0)]
    points = spark.createDataFrame(rows, "cloud_id long, pt_id long, x double, y double, z double")
    gap = np.linalg.norm(places[:, None] - places[None], axis=2) ** 2
    cloud = np.array([r[0] for r in rows[: len(places)]])
    near = ((gap <= 9.0 + 1e-9) & (cloud[:, None] == cloud[None])).sum(axis=1) - 1
    true = {k: n for k, n in enumerate(near) if n < 4} | {5000: 0, 5001: 0, 5002: 0}
    for most in (200_000, 100):
        got = pointcloud.outliers_by_radius(points, 3.0, 4, most=most).collect()
        assert {r.pt_id: r.neighbours for r in got} == true and len(got) == len(true)
    tiled = pointcloud.in_tiles(points.where("pt_id < 900"), 3.0, ("cloud_id",))
    assert tiled.count() < 1.2 * 900 and tiled.where("home").count() == 900


def test_boxes_of_small_groups_meet_within_their_group(spark):
    random.seed(6)
    boxes = []
    for k in range(260):
        low = [random.randint(0, 12) * 1.0 for _ in range(3)]
        boxes.append((k, None if k % 50 == 7 else min(k // 10, 12), *(v for c in low for v in (c, c + random.randint(0, 4)))))
    df = spark.createDataFrame(boxes, "suid long, parent_suid long, minx double, maxx double, miny double, maxy double, z_min double, z_max double")
    meet = lambda a, b: all(a[i] <= b[i + 1] and b[i] <= a[i + 1] for i in (2, 4, 6))
    true = {(a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and a[1] is not None and a[1] == b[1] and meet(a, b)}
    got = topology.pairs_in_cells(df).select("a.suid", "b.suid").collect()
    assert set(map(tuple, got)) == true and len(got) == len(true) and sum(b[1] == 12 for b in boxes) > 64
    small = topology.pairs_in_cells(df.where("parent_suid < 12"))
    assert "Generate" not in small._jdf.queryExecution().executedPlan().toString()


def test_farthest_points_sort_no_whole_cloud(spark):
    import pyarrow as pa

    cloud, best, ids = [1, None, 1, 1, 2, None], [1.0, 0.0, 5.0, 5.0, None, 2.0], [4, 9, 8, 3, 7, 6]
    batch = pa.RecordBatch.from_pydict({"cloud_id": pa.array(cloud, pa.int64()), "best": best, "pt_id": ids})
    (few,) = pointcloud._farthest_of_batches(iter([batch]))
    assert sorted((r["cloud_id"] or 0, r["pt_id"]) for r in few.to_pylist()) == [(0, 6), (1, 3), (2, 7)]
    points = spark.createDataFrame([(1, k, float(k % 5), 0.0, 0.0) for k in range(7)] + [(2, 1, 0.0, 0.0, 0.0), (None, 1, 0.0, 0.0, 0.0), (None, 2, 3.0, 0.0, 0.0)], "cloud_id long, pt_id long, x double, y double, z double")
    got = pointcloud.farthest_points(points, 4).collect()
    assert sorted((r.cloud_id or 0, r.place, r.pt_id) for r in got) == [(0, 0, 1), (1, 0, 0), (1, 1, 4), (1, 2, 2), (1, 3, 1), (2, 0, 1)]
