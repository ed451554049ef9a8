import numpy as np
import pytest
from pyspark.sql import functions as F

from lotstack.functions import geometry as G
from lotstack.functions import kernel, overlay
from lotstack.operators import delineate, topology

SQUARE = np.array([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)])


def covered(polygons, X, Y):
    out = np.zeros(X.shape, dtype=bool)
    for polygon in polygons:
        odd = np.zeros(X.shape, dtype=bool)
        for ring in polygon:
            for (x1, y1), (x2, y2) in zip(ring, np.roll(ring, -1, axis=0)):
                if y1 != y2:
                    odd ^= ((y1 > Y) != (y2 > Y)) & (X < (x2 - x1) * (Y - y1) / (y2 - y1) + x1)
        out |= odd
    return out


def some_polygon(rng, kind):
    centre, n = rng.uniform(2, 8, 2), rng.integers(3, 9)
    if kind == "crossed":
        return [np.round(rng.uniform(0, 10, (n, 2)))]
    angle, radius = np.sort(rng.uniform(0, 2 * np.pi, n)), rng.uniform(0.5, 2, n)
    ring = centre + np.stack([np.cos(angle) * radius, np.sin(angle) * radius], axis=1)
    return [ring, centre + 0.3 * (ring - centre)] if kind == "holed" else [ring[::-1]]


@pytest.mark.parametrize("seed", range(12))
def test_overlays_cover_what_counting_a_grid_covers(seed):
    rng = np.random.default_rng(seed)
    ours = [some_polygon(rng, rng.choice(["plain", "holed", "crossed"])) for _ in range(rng.integers(1, 6))]
    others = [some_polygon(rng, rng.choice(["plain", "holed", "crossed"])) for _ in range(rng.integers(0, 4))]
    side = (np.arange(300) + 0.5) / 30
    X, Y = np.meshgrid(side, side)
    a, b = covered(ours, X, Y), covered(others, X, Y)
    for keep, true in ((overlay.UNION, a | b), (overlay.INTERSECTION, a & b), (overlay.DIFFERENCE, a & ~b)):
        parts = overlay.overlay(ours, others, keep)
        assert (covered(parts, X, Y) != true).mean() < 2e-3
        assert sum(map(overlay.area, parts)) == pytest.approx(true.mean() * 100, abs=0.3)
        assert all(overlay.signed_area(p[0]) > 0 and all(overlay.signed_area(h) < 0 for h in p[1:]) for p in parts)


def test_boxes_equal_the_union_of_boxes():
    rng = np.random.default_rng(3)
    for _ in range(20):
        boxes = np.sort(rng.integers(0, 12, (8, 2, 2)), axis=1).reshape(8, 4).astype(float)
        area, bounds = kernel.box_union(boxes)
        parts = overlay.overlay([[np.array([(a, b), (c, b), (c, d), (a, d)])] for a, b, c, d in boxes], [])
        best = max(parts, key=overlay.area)
        assert overlay.area(best) == pytest.approx(area)


def test_parts_that_touch_in_a_corner_stay_apart_and_holes_stay():
    assert len(overlay.overlay([[SQUARE], [SQUARE + 4]], [])) == 2
    ring = [[SQUARE + (4 * i, 4 * j)] for i in range(3) for j in range(3) if (i, j) != (1, 1)]
    (part,) = overlay.overlay(ring, [])
    assert [len(r) for r in part] == [4, 4] and overlay.area(part) == 128
    assert overlay.overlay([], []) == [] and overlay.overlay([[np.zeros((4, 2))]], []) == []
    assert overlay.overlay([[np.array([(0, 0), (np.nan, 1), (4, 0), (4, 4)])]], [])[0][0].shape == (3, 2)


def test_slivers_and_nearly_equal_edges():
    moved = SQUARE + (4 + 1e-13, 0)
    (part,) = overlay.overlay([[SQUARE], [moved]], [])
    assert overlay.area(part) == pytest.approx(32) and len(part[0]) == 4


@pytest.mark.parametrize("ring,simple", [
    (SQUARE, True), (np.vstack([SQUARE, SQUARE[:1]]), True), (SQUARE[::-1], True),
    ([(0, 0), (4, 4), (4, 0), (0, 4)], False),  # bow tie
    ([(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)], False),  # touches its own edge
    ([(0, 0), (4, 0), (6, 0), (4, 0), (4, 4), (0, 4)], False),  # runs back
    ([(0, 0), (2, 0), (4, 0), (4, 4), (0, 4)], True),  # a corner on a straight edge
    ([(0, 0), (4, 0), (4, 0), (4, 4)], True),  # a corner twice
    ([(0, 0), (4, 0), (8, 0)], False), ([], False), ([(0, 0), (1, float("nan")), (1, 1)], False),
    ([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0), (4, 0), (4, 4), (0, 4)], False),  # every edge twice
])
def test_rings_that_meet_themselves(ring, simple):
    assert kernel.simple(np.array(ring, dtype=float)) == simple


def test_large_rings_are_swept():
    angle = np.linspace(0, 2 * np.pi, 5000, endpoint=False)
    circle = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    assert kernel.simple(circle)
    circle[[2500, 2501]] = circle[[2501, 2500]]
    assert not kernel.simple(circle)


RINGS = "g string, rings array<array<array<double>>>"


def polygon(*rings):
    return [np.asarray(r, dtype=float).tolist() for r in rings]


def test_united_groups_equal_one_overlay_of_each(spark):
    rng = np.random.default_rng(11)
    rows = [(str(k % 3) if k % 4 else None, polygon(*some_polygon(rng, rng.choice(["plain", "holed"])))) for k in range(90)]
    rows += [("0", polygon(SQUARE + 100)), ("0", polygon(SQUARE + 100)), ("far", polygon(SQUARE * 1e6)), ("none", []), ("none", None), ("line", polygon([(0, 0), (1, 1), (2, 2)]))]
    for most in (4, 256):
        got = {}
        for r in delineate.united(spark.createDataFrame(rows, RINGS), "g", most=most).collect():
            got.setdefault(r.g, []).append(r.area)
        for g in {r[0] for r in rows}:
            parts = overlay.overlay([[np.array(x) for x in p] for k, p in rows if k == g and p], [])
            assert sorted(got.get(g, [])) == pytest.approx(sorted(map(overlay.area, parts)), abs=1e-6)


def test_united_without_rows(spark):
    assert delineate.united(spark.createDataFrame([], RINGS), "g").count() == 0
    assert delineate.merged_footprints(spark.createDataFrame([("a", None)], RINGS), "g").count() == 0


def test_units_of_a_u_and_of_a_holed_floor_add_up(spark):
    u = [[0.0, 0.0], [9.0, 0.0], [9.0, 6.0], [6.0, 6.0], [6.0, 3.0], [3.0, 3.0], [3.0, 6.0], [0.0, 6.0]]
    rows = [(k, n, layout, u, holes) for k, (n, layout, holes) in enumerate([(2, "grid", None), (4, "grid", None), (6, "corridor", None), (4, "grid", [[[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0]]])])]
    floors = spark.createDataFrame(rows, "id long, n_units int, layout string, ring array<array<double>>, holes array<array<array<double>>>")
    units = delineate.split_rings(floors, 0.0).collect()
    total = {k: sum(r.area for r in units if r.id == k) for k in range(4)}
    assert total[0] == total[1] == pytest.approx(45.0) and total[3] == pytest.approx(44.0)
    assert [len(r.parts) for r in units if r.id == 0 and r.unit_index == 2] == [2]
    assert all(len({tuple(p) for p in ring}) == len(ring) for r in units for part in r.parts for ring in part)


def test_exact_ring_tests(spark):
    l_shape = [(0.0, 0.0), (8.0, 0.0), (8.0, 4.0), (4.0, 4.0), (4.0, 8.0), (0.0, 8.0)]
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]
    point = "array<struct<x:double,y:double>>"
    meets = {(5, 5, 9, 9): False, (4, 4, 9, 9): True, (-1, -1, 9, 9): True, (1, 1, 2, 2): True, (9, 0, 10, 1): False, (8, 0, 9, 1): True, (3, 5, 5, 6): True}
    boxes = spark.createDataFrame([(list(map(float, b)), l_shape) for b in meets], f"b array<double>, ring {point}")
    got = {tuple(map(int, r.b)): r.m for r in boxes.withColumn("m", G.ring_meets_box(F.col("ring"), *(F.get("b", F.lit(k)) for k in range(4)))).collect()}
    assert got == meets
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    inner = [(square(0.0, 0.0, 4.0), True, False), (square(3.0, 3.0, 2.0), False, False), (square(5.0, 1.0, 2.0), True, True), (l_shape, True, False), (square(4.0, 4.0, 4.0), False, False)]
    inner += [(square(1.0, 1.0, 1.0), True, False), (square(2.0, 1.0, 1.0), True, True), ([(4.0, 8.0), (0.0, 8.0), (8.0, 4.0)], False, False), (square(20.0, 0.0, 1.0), False, False)]
    rows = spark.createDataFrame([(k, i, l_shape, [hole]) for k, (i, _, _) in enumerate(inner)], f"k int, i {point}, o {point}, h array<{point}>")
    got = {r.k: (r.a, r.b) for r in rows.select("k", G.ring_within(F.col("i"), F.col("o")).alias("a"), G.ring_within(F.col("i"), F.col("o"), F.col("h")).alias("b")).collect()}
    assert got == {k: (a, b) for k, (_, a, b) in enumerate(inner)}


def test_many_overlays_at_once_equal_those_one_by_one():
    rng = np.random.default_rng(11)
    kinds = ["plain", "holed", "crossed"]
    rows = [([some_polygon(rng, rng.choice(kinds)) for _ in range(rng.integers(1, 6))], [some_polygon(rng, rng.choice(kinds)) for _ in range(rng.integers(0, 3))]) for _ in range(60)]
    rows += [([[SQUARE], [SQUARE + (4, 0)]], [[SQUARE + 2]]), ([], []), ([[SQUARE[:2]]], []), ([[np.array([(0.0, 0.0), (np.nan, 1.0), (4.0, 0.0), (4.0, 4.0)])]], [])]
    polygons = [p for a, b in rows for p in (*a, *b)]
    rings = [r for p in polygons for r in p]
    ends = lambda sizes: np.concatenate([[0], np.cumsum(list(sizes))]).astype(int)
    ours = np.array([side for a, b in rows for side in [True] * len(a) + [False] * len(b)])
    for one, many in ((overlay.UNION, np.logical_or), (overlay.INTERSECTION, np.logical_and)):
        got = overlay.overlays(np.concatenate(rings), ends(map(len, rings)), ends(map(len, polygons)), ours, ends(len(a) + len(b) for a, b in rows), many)
        true = [overlay.overlay(a, b, one) for a, b in rows]
        assert [[[r.tolist() for r in p] for p in parts] for parts in got] == [[[r.tolist() for r in p] for p in parts] for parts in true]


def test_large_and_small_groups_are_united_alike(spark):
    box = lambda k, g: (g, [[[float(k), 0.0], [k + 1.0, 0.0], [k + 1.0, 2.0], [float(k), 2.0]]])
    rows = [box(k, g) for g in (1, None) for k in range(12)] + [box(k, 2) for k in (0, 0, 1, 5)] + [(3, [[[0.0, 0.0], [1.0, 0.0], [2.0, 0.0]]])]
    parts = delineate.united(spark.createDataFrame(rows, "g long, rings array<array<array<double>>>"), "g", most=6).collect()
    assert sorted(((r.g or 0), round(r.area, 9)) for r in parts) == [(0, 24.0), (1, 24.0), (2, 2.0), (2, 4.0)]


def test_rings_of_parcels_are_told_many_at_once(spark):
    """Units are judged in Arrow batches, as `ring_within` judges one by one: no row goes through nested lambdas."""
    rng = np.random.default_rng(3)
    point = "array<struct<x:double,y:double>>"
    ring = lambda n: [tuple(map(float, p)) for p in rng.integers(0, 7, (n, 2))]
    box = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    corner = [(0.0, 0.0), (8.0, 0.0), (8.0, 4.0), (4.0, 4.0), (4.0, 8.0), (0.0, 8.0)]
    rows = [(k, ring(rng.integers(3, 7)), corner if k % 2 else ring(rng.integers(3, 7)), [[ring(3)], [], None, [ring(4), box(1.0, 1.0, 1.0)]][k % 4]) for k in range(400)]
    rows += [(1000 + k, box(float(k), 0.0, 1.0), corner, [box(1.0, 0.0, 1.0)]) for k in range(9)] + [(2000, [], corner, None), (2001, corner, [], None)]
    df = spark.createDataFrame(rows, f"suid long, ring {point}, outline {point}, holes array<{point}>").withColumn("parent_suid", F.col("suid"))
    true = {r.suid for r in df.where(~G.ring_within(F.col("ring"), F.col("outline"), F.col("holes"))).collect()}
    got = topology.outside_of_parcels(df.select("suid", "parent_suid", "ring"), df.select("parent_suid", "outline", "holes"))
    assert {r.suid for r in got.collect()} == true and 0 < len(true) < len(rows)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    unknown = spark.createDataFrame([(1, 1, [(1.0, 1.0), (None, 2.0), (2.0, 2.0)]), (2, 1, [(9.0, 1.0), None, (2.0, 2.0)]), (3, 1, None)], f"suid long, parent_suid long, ring {point}")
    parcel = spark.createDataFrame([(1, corner, [None, box(5.0, 0.0, 1.0)])], f"parent_suid long, outline {point}, holes array<{point}>")
    assert [r.suid for r in topology.outside_of_parcels(unknown, parcel).collect()] == [2]


def test_sectors_of_many_rings_at_once_equal_those_one_by_one(spark):
    rng = np.random.default_rng(5)
    rings = [rng.normal(size=(rng.integers(1, 9), 2)) * 10 for _ in range(200)] + [SQUARE, SQUARE[:1], np.array([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)])]
    n = rng.integers(1, 6, len(rings))
    true = [[s.tolist() for s in kernel.sectors(r, k) if kernel.area(s) > 0] or [r.tolist()] for r, k in zip(rings, n)]
    rows = spark.createDataFrame([(i, r.tolist(), int(k)) for i, (r, k) in enumerate(zip(rings, n))], "i int, ring array<array<double>>, n int")
    cut = rows.select("i", delineate.sector_rings("ring", "n").alias("parts"))
    got = {r.i: r.parts for r in cut.collect()}
    for i, parts in enumerate(true):
        assert len(got[i]) == len(parts) and all(np.allclose(a, b, rtol=0, atol=1e-12) for a, b in zip(got[i], parts))
    # whole batches go to the kernel; before, each ring was a Python call of its own
    spun = kernel.all_sectors(kernel.Rings(np.arange(0, 4 * 50_001, 4), np.tile(SQUARE[:, 0], 50_000), np.tile(SQUARE[:, 1], 50_000)), np.full(50_000, 2))
    assert np.bincount(spun[0]).tolist() == [2] * 50_000
