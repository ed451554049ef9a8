"""From footprints to volumetric units: levels, layouts, splits and extrusion."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lotstack.functions import geometry as G
from lotstack.functions import kernel, overlay
from lotstack.functions.binding import let
from lotstack.operators import cells
from lotstack.operators.graph import components
from lotstack.plans.tables import discard, materialize, spread


# The areas and counts of the next four functions, by which types of buildings are told apart.


def units_per_floor(type: Column, area: Column) -> Column:
    """Units on a floor of so many square metres; halves go to the even number."""
    by = lambda k: F.greatest(F.lit(1.0), F.rint(area / k))
    n = F.when(type == "residential", by(100)).when(type == "commercial", by(300)).when(type == "mixed", F.greatest(F.lit(2.0), F.rint(area / 150)))
    return n.when(type == "apartments", by(75)).otherwise(by(100)).cast("int")


def units_per_mapped_floor(type: Column, area: Column) -> Column:
    """The same for buildings from maps, whose residential floors hold more units."""
    by = lambda k: F.greatest(F.lit(1.0), F.rint(area / k))
    n = F.when(type.isin("apartments", "residential"), by(85)).when(type == "commercial", by(300))
    return n.when(type == "mixed", F.greatest(F.lit(2.0), F.rint(area / 150))).otherwise(by(100)).cast("int")


def layout(type: Column, area: Column) -> Column:
    homes = type.isin("apartments", "residential")
    return (
        F.when(homes & (area > 800), "corridor")
        .when(homes & (area > 300), "perimeter")
        .when((type == "commercial") & (area > 1500), "corridor")
        .when(type == "mixed", "perimeter")
        .otherwise("grid")
    )


def estimated_levels(type: Column, area: Column) -> Column:
    """Levels of a building that states none."""

    def steps(*bounds: tuple[float, int], beyond: int) -> Column:
        out = F.when(area < bounds[0][0], bounds[0][1])
        for most, levels in bounds[1:]:
            out = out.when(area < most, levels)
        return out.otherwise(beyond)

    root = lambda k, least: F.greatest(F.lit(least), F.rint(F.sqrt(area) / k).cast("int"))
    return (
        F.when(type == "residential", steps((100, 1), (300, 2), (800, 4), (2000, 8), beyond=12))
        .when(type == "commercial", steps((200, 1), (500, 2), (1500, 4), beyond=10))
        .when(type == "industrial", F.lit(1))
        .when(type == "mixed", steps((500, 3), (1500, 6), beyond=15))
        .when(type == "hospitality", root(10, 3))
        .when(type == "institutional", root(15, 2))
        .otherwise(root(20, 1))
    )


def height_and_levels(buildings: DataFrame, storey: float = 3.0) -> DataFrame:
    """Buildings with `height` and `levels` each worked out from the other, or estimated from type and area."""
    known = F.coalesce(
        F.col("levels"), F.when(F.col("height").isNotNull(), F.greatest(F.lit(1), F.rint(F.col("height") / storey).cast("int"))), estimated_levels(F.col("building_type"), F.col("area"))
    )
    return buildings.withColumn("levels", known).withColumn("height", F.coalesce("height", F.col("levels") * storey)).withColumn(
        "min_height", F.coalesce("min_height", F.lit(0.0))
    )


def floors(buildings: DataFrame, ground: float = 0.0, storey: float = 3.0) -> DataFrame:
    """One row for each level: (…, level, z_base, height); buildings without levels have none."""
    each = F.coalesce(F.col("height"), F.col("levels") * storey) / F.col("levels")
    base = F.coalesce(F.col("min_height"), F.lit(ground))
    return (
        buildings.where(F.col("levels") > 0)
        .withColumn("level", F.explode(F.sequence(F.lit(0), F.col("levels") - 1)))
        .withColumn("floor_height", each)
        .withColumn("z_base", base + F.col("level") * F.col("floor_height"))
    )


def grid_cells(n: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """The n first cells of a near square grid, row by row: an array of (cell, minx, miny, maxx, maxy)."""
    cols = F.greatest(F.lit(1), F.rint(F.sqrt(n)).cast("int"))
    rows = F.ceil(n / cols)
    w, h = (maxx - minx) / cols, (maxy - miny) / rows

    def cell(k: Column) -> Column:
        r, c = F.floor(k / cols), k % cols
        return F.struct(k.alias("cell"), (minx + c * w).alias("minx"), (miny + r * h).alias("miny"), (minx + (c + 1) * w).alias("maxx"), (miny + (r + 1) * h).alias("maxy"))

    return F.transform(F.sequence(F.lit(0), n - 1), cell)


def corridor_cells(n: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Cells on both sides of a corridor along the longer side, at most 2 wide and 15 % of the shorter one."""
    across = (maxx - minx) > (maxy - miny)
    each = F.greatest(F.lit(1), F.floor(n / 2).cast("int"))
    length, depth = F.greatest(maxx - minx, maxy - miny), F.least(maxx - minx, maxy - miny)
    hall = F.least(F.lit(2.0), depth * 0.15)
    side = (depth - hall) / 2

    def cell(k: Column) -> Column:
        at, far = k % each, F.floor(k / each)
        a0, a1 = length / each * at, length / each * (at + 1)
        b0 = F.when(far == 0, F.lit(0.0)).otherwise(side + hall)
        b1 = b0 + side
        return F.struct(
            k.alias("cell"),
            (minx + F.when(across, a0).otherwise(b0)).alias("minx"),
            (miny + F.when(across, b0).otherwise(a0)).alias("miny"),
            (minx + F.when(across, a1).otherwise(b1)).alias("maxx"),
            (miny + F.when(across, b1).otherwise(a1)).alias("maxy"),
        )

    return F.transform(F.sequence(F.lit(0), each * 2 - 1), cell)


def split_floors(floor_rows: DataFrame, least_area: float = 1.0) -> DataFrame:
    """Units of each floor (n_units, layout, minx … maxy): one row for each cell above the least area."""
    box = [F.col(c) for c in ("minx", "miny", "maxx", "maxy")]
    whole = F.array(F.struct(F.lit(0).alias("cell"), *box))
    cells = F.when(F.col("layout") == "grid", grid_cells(F.col("n_units"), *box)).when(F.col("layout") == "corridor", corridor_cells(F.col("n_units"), *box)).otherwise(whole)
    kept = [c for c in floor_rows.columns if c not in ("minx", "miny", "maxx", "maxy")]
    return (
        floor_rows.select(*kept, F.explode(cells).alias("c"))
        .select(*kept, "c.*")
        .where((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")) > least_area)
        .withColumn("unit_index", F.col("cell") + 1)
    )


def extrude(buildings: DataFrame, ground: float = 0.0, storey: float = 3.0) -> DataFrame:
    """Volumetric units (suid, parent, type, label, floor_level, z_min, z_max, geometry) of box footprints.

    A parcel and a building for each row, a floor for each level, and the floor's units: four kinds in one union.
    """
    b = buildings.withColumn("top", F.lit(ground) + F.col("levels") * storey)
    box = lambda: [F.col(c) for c in ("minx", "miny", "maxx", "maxy")]
    solid = lambda lo, hi: G.solid_wkt(G.box_ring(*box()), lo, hi)
    name = F.col("building_id").cast("string")
    level = F.col("level").cast("string")

    def rows(df: DataFrame, kind: str, suid: Column, parent: Column, label: Column, floor: Column, lo: Column, hi: Column) -> DataFrame:
        return df.select(
            suid.alias("suid"), parent.alias("parent"), F.lit(kind).alias("type"), label.alias("label"), floor.cast("int").alias("floor_level"),
            lo.cast("double").alias("z_min"), hi.cast("double").alias("z_max"), solid(lo.cast("double"), hi.cast("double")).alias("geometry"),
        )

    parcel, building = F.concat(F.lit("parcel-"), name), F.concat(F.lit("building-"), name)
    each = b.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("levels") - 1))).withColumn("z0", F.lit(ground) + F.col("level") * storey)
    floor = F.concat(F.lit("floor-"), name, F.lit("-L"), level)
    units = split_floors(each)
    unit = F.concat(F.lit("unit-"), name, F.lit("-L"), level, F.lit("-"), F.lpad(F.col("unit_index").cast("string"), 4, "0"))
    none = F.lit(None).cast("string")
    return (
        rows(b, "parcel", parcel, none, F.concat(F.lit("Parcel "), name), F.lit(0), F.lit(ground), F.col("top"))
        .unionByName(rows(b, "building", building, parcel, F.concat(F.lit("Building "), name), F.lit(0), F.lit(ground), F.col("top")))
        .unionByName(rows(each, "floor", floor, building, F.concat(F.lit("Floor "), level), F.col("level"), F.col("z0"), F.col("z0") + storey))
        .unionByName(rows(units, "unit", unit, floor, F.concat(F.lit("Unit "), F.col("unit_index").cast("string")), F.col("level"), F.col("z0"), F.col("z0") + storey))
    )


#: A ring as an array of [x, y].
_RING = T.ArrayType(T.ArrayType(T.DoubleType()))


#: A polygon as an array of rings: its outline, then its holes.
_POLYGON = T.ArrayType(_RING)
_PARTS = T.ArrayType(_POLYGON)


@dataclass
class _Flat:
    """Lists of polygons as arrays: points, and the ends of rings in them, of polygons in rings and of rows in polygons, each with a zero ahead."""

    points: np.ndarray
    rings: np.ndarray
    polygons: np.ndarray
    rows: np.ndarray


def _ends(lengths: list[int] | np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.asarray(lengths, dtype=np.int64))])


def _flat(rows: pa.Array) -> _Flat:
    """Polygons of each row; nulls are as if they weren't there, and of a point the first two numbers count."""
    ends, at, whole = [], rows, True
    for _ in range(4):
        whole &= at.null_count == 0
        ends.append(_ends(pc.fill_null(pc.list_value_length(at), 0).to_numpy(zero_copy_only=False)))
        at = at.flatten()
    if whole and (np.diff(ends[3]) >= 2).all():
        values = at.to_numpy(zero_copy_only=False).astype(float)
        return _Flat(np.stack([values[ends[3][:-1]], values[ends[3][:-1] + 1]], axis=1), ends[2], ends[1], ends[0])
    held = [[[np.array([p[:2] for p in ring], dtype=float).reshape(-1, 2) for ring in polygon or () if ring is not None] for polygon in own or ()] for own in rows.to_pylist()]
    polygons = [polygon for own in held for polygon in own]
    rings = [ring for polygon in polygons for ring in polygon]
    return _Flat(np.concatenate([np.zeros((0, 2)), *rings]), _ends([len(r) for r in rings]), _ends([len(p) for p in polygons]), _ends([len(own) for own in held]))


def _picked(ends: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, ends) of what the lists with these ends hold, list by list in this order."""
    lengths = np.diff(ends)[order]
    after = _ends(lengths)
    return np.repeat(ends[:-1][order] - after[:-1], lengths) + np.arange(after[-1]), after


def _side_by_side(a: _Flat, b: _Flat) -> tuple[_Flat, np.ndarray]:
    """Rows with the polygons of both, and whether each polygon is of the first."""
    n = len(a.polygons) - 1
    polygons, rings = np.concatenate([a.polygons, b.polygons[1:] + a.polygons[-1]]), np.concatenate([a.rings, b.rings[1:] + a.rings[-1]])
    row = np.concatenate([np.repeat(np.arange(len(f.rows) - 1), np.diff(f.rows)) for f in (a, b)])
    order = np.argsort(row, kind="stable")
    ring_order, polygons = _picked(polygons, order)
    points, rings = _picked(rings, ring_order)
    return _Flat(np.concatenate([a.points, b.points])[points], rings, polygons, a.rows + b.rows), order < n


def _listed(rows: list[list[overlay.Polygon]]) -> pa.Array:
    """The parts of each row as nested lists."""
    parts = [part for own in rows for part in own]
    rings = [ring for part in parts for ring in part]
    points = np.concatenate([np.zeros((0, 2)), *rings])
    out = pa.array(points.reshape(-1))
    for lengths in (np.full(len(points), 2), [len(r) for r in rings], [len(p) for p in parts], [len(own) for own in rows]):
        out = pa.ListArray.from_arrays(pa.array(_ends(lengths), pa.int32()), out)
    return out.cast(to_arrow_type(_PARTS))


@F.arrow_udf(_PARTS)
def united_polygons(polygons: pa.Array) -> pa.Array:
    """The parts of the union of each row's polygons."""
    f = _flat(polygons)
    return _listed(overlay.overlays(f.points, f.rings, f.polygons, np.ones(len(f.polygons) - 1, dtype=bool), f.rows, np.logical_or))


@F.arrow_udf(_PARTS)
def shared_polygons(ours: pa.Array, others: pa.Array) -> pa.Array:
    """The parts of what each row's two lists of polygons share."""
    f, first = _side_by_side(_flat(ours), _flat(others))
    return _listed(overlay.overlays(f.points, f.rings, f.polygons, first, f.rows, np.logical_and))


@F.arrow_udf(T.BooleanType())
def simple_rings(rings: pa.Array) -> pa.Array:
    """Whether rings, of (x, y) structs or of [x, y], have area and meet themselves nowhere."""
    told = ([[p["x"], p["y"]] if isinstance(p, dict) else p[:2] for p in ring] for ring in (r or () for r in rings.to_pylist()))
    return pa.array([kernel.simple(np.array(ring, dtype=float)) for ring in told], pa.bool_())


def ring_area(ring: Column) -> Column:
    return G.shoelace_area(G.pairs_ring(ring))


def polygon_area(rings: Column) -> Column:
    """The area of an outline without its holes."""
    holes = F.aggregate(F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0))), F.lit(0.0), lambda total, h: total + ring_area(h))
    return ring_area(F.get(rings, F.lit(0))) - holes


def _boxed(polygons: DataFrame) -> DataFrame:
    """With the box of the outline: minx … maxy."""
    side = lambda f, k: f(F.transform(F.get("rings", F.lit(0)), lambda p: F.get(p, F.lit(k))))
    return polygons.withColumns({"minx": side(F.array_min, 0), "miny": side(F.array_min, 1), "maxx": side(F.array_max, 0), "maxy": side(F.array_max, 1)})


def united(polygons: DataFrame, *key: str, most: int = 256) -> DataFrame:
    """(key…, rings, area): the parts of the union of each group's polygons (rings: outline, then holes, of [x, y]), whatever their shape.

    Equal polygons of a group count once. A group of `most` polygons or fewer is united at once, which is all where groups are
    many and small; only the others are taken apart (`_united_apart`). Rings without area add nothing; a null key is a group like others.
    """
    own = polygons.select(*key, "rings").where(F.size("rings") > 0)
    crowded = materialize(own.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).drop("_n"), "crowded")
    same = lambda a, b: reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in key))
    any_crowded = bool(crowded.limit(1).count())
    small = own.join(crowded, same(own, crowded), "left_anti") if any_crowded else own
    whole = small.groupBy(*key).agg(F.collect_list("rings").alias("all")).select(*key, F.explode(united_polygons(F.array_distinct("all"))).alias("rings"))
    done = whole.withColumn("area", polygon_area(F.col("rings")))
    if any_crowded:
        many = own.join(crowded, same(own, crowded), "left_semi")
        return done.unionByName(_united_apart(many, *key, most=most))
    discard(crowded)
    return done


def _united_apart(polygons: DataFrame, *key: str, most: int) -> DataFrame:
    """`united` of large groups: polygons that lie close together are united first, at most about `most` at a time; then
    parts whose boxes touch are linked, and what hangs together is united. So no task holds a group, only what becomes one polygon.
    """
    name = [f"_k{i}" for i in range(len(key))]
    groups = materialize(polygons.select(*key).distinct().withColumn("_group", F.monotonically_increasing_id()), "groups")
    same = F.lit(True)
    for k, n in zip(key, name):
        same &= F.col(k).eqNullSafe(F.col(n))
    own = polygons.select(*(F.col(k).alias(n) for k, n in zip(key, name)), "rings").where(F.size("rings") > 0)
    own = own.join(groups, same).select("_group", "rings").distinct()
    placed = _boxed(own).where(F.col("minx").isNotNull() & F.col("miny").isNotNull())
    placed = placed.withColumns({"x": (F.col("minx") + F.col("maxx")) / 2, "y": (F.col("miny") + F.col("maxy")) / 2, "_row": F.monotonically_increasing_id()})
    placed = materialize(placed, "polygons")
    cut = cells.tree(placed, ("_group",), "xy", most)
    if cut is None:
        return groups.limit(0).select(*key, F.lit(None).cast(_POLYGON).alias("rings"), F.lit(0.0).alias("area"))
    leaf = ["_group", "_depth", *cut.names]
    near = cut.placed(placed).groupBy(*leaf).agg(F.collect_list("rings").alias("all"))
    near = near.withColumn("_leaf", F.monotonically_increasing_id()).select("_group", "_leaf", F.explode(united_polygons("all")).alias("rings"))
    parts = materialize(_boxed(near).withColumn("_row", F.monotonically_increasing_id()), "parts")
    slim = parts.select("_group", "_leaf", "_row", "minx", "miny", "maxx", "maxy")
    touching = cells.box_pairs(slim, ("_group",), "_row", (("minx", "maxx"), ("miny", "maxy"))).where("a._leaf <> b._leaf")
    linked = components(touching.select(F.col("a._row").alias("a"), F.col("b._row").alias("b"))).select(F.col("node").alias("_row"), "component")
    linked = materialize(linked.unionAll(linked.select(F.col("component").alias("_row"), "component").distinct()), "linked")
    whole = parts.select("_group", "_row", "rings").join(linked, "_row", "left")
    alone = whole.where("component IS NULL").select("_group", "rings")
    together = whole.where("component IS NOT NULL").groupBy("_group", "component").agg(F.collect_list("rings").alias("all"))
    both = alone.unionAll(together.select("_group", F.explode(united_polygons("all")).alias("rings")))
    done = materialize(both.withColumn("area", polygon_area(F.col("rings"))), "united")
    discard(placed, cut.cells, parts, linked)
    return groups.join(done, "_group").select(*key, "rings", "area")


def box_polygon(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """A box as a polygon: one ring of [x, y]."""
    return F.array(F.array(*(F.array(x.cast("double"), y.cast("double")) for x, y in ((minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy)))))


def largest_parts(polygons: DataFrame, *key: str) -> DataFrame:
    """(key…, area, minx … maxy, rings): the largest part of the union of each group's polygons; ties to the one lowest, then to the left."""
    parts = _boxed(united(polygons, *key))
    rank = F.struct("area", (-F.col("miny")).alias("down"), (-F.col("minx")).alias("left"))
    names = ("area", "minx", "miny", "maxx", "maxy", "rings")
    return parts.groupBy(*key).agg(F.max_by(F.struct(*names), rank).alias("p")).select(*key, *(f"p.{n}" for n in names))


def merged_footprints(polygons: DataFrame, *key: str) -> DataFrame:
    """(key…, area, minx … maxy, rings): the largest part of the union of each group's boxes, or of its `rings` if there are any.

    Those without area are left out and equal ones are one, so that storeys that repeat a plan don't grow a group.
    """
    if "rings" in polygons.columns:
        return largest_parts(polygons, *key)
    solid = polygons.where((F.col("maxx") > F.col("minx")) & (F.col("maxy") > F.col("miny")))
    return largest_parts(solid.select(*key, box_polygon(*(F.col(c) for c in ("minx", "miny", "maxx", "maxy"))).alias("rings")), *key)


def merged_units(polygons: DataFrame, least_area: float = 1.0) -> DataFrame:
    """(level, unit_id, unit_type, rings, area): floor polygons (…, rings) of equal level, unit_id and unit_type as one; all parts of the union above an area."""
    return united(polygons, "level", "unit_id", "unit_type").where(F.col("area") > least_area)


def top_of(rows: DataFrame, ground: float = 0.0) -> DataFrame:
    """(building_id, z_max): the highest top of each building's floors; a missing base is the ground."""
    return rows.groupBy("building_id").agg(F.max(F.coalesce("z_base", F.lit(ground)) + F.col("height")).alias("z_max"))


@F.arrow_udf(T.ArrayType(_RING))
def sector_rings(rings: pa.Array, n: pa.Array) -> pa.Array:
    """Rings (arrays of [x, y]) cut into n equal angles about their mean; the whole ring where no sector has area."""
    ends = lambda counts: pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    points = rings.flatten()
    counts = pc.fill_null(pc.list_value_length(rings), 0).to_numpy().astype(np.int64)
    axes = [pc.list_element(points, k).to_numpy(zero_copy_only=False) for k in range(2)]
    owner, parts = kernel.all_sectors(kernel.Rings(np.concatenate([[0], np.cumsum(counts)]), *axes), pc.fill_null(n, 1).to_numpy().astype(np.int64))
    pairs = pa.ListArray.from_arrays(ends(np.full(len(parts.x), 2)), pa.array(np.column_stack([parts.x, parts.y]).ravel()))
    each = pa.ListArray.from_arrays(ends(np.diff(parts.starts)), pairs)
    return pa.ListArray.from_arrays(ends(np.bincount(owner, minlength=len(rings))), each)


def clipped_rings(rings: Column | str, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """The largest part of each ring inside a box; empty where there is none."""
    own = F.col(rings) if isinstance(rings, str) else rings
    parts = shared_polygons(F.array(F.array(own)), F.array(box_polygon(minx, miny, maxx, maxy)))
    return F.coalesce(F.get(F.get(largest_first(parts), F.lit(0)), F.lit(0)), F.array().cast(_RING))


def largest_first(parts: Column) -> Column:
    return F.transform(F.reverse(F.array_sort(F.transform(parts, lambda p: F.struct(polygon_area(p).alias("area"), p.alias("rings"))))), lambda p: p["rings"])


def quick_building(buildings: DataFrame, ground: float = 0.0, storey: float = 3.0, mode: str = "intent") -> DataFrame:
    """Volumetric units of boxes (building_id, levels, building_type, …) whose floors are cut into quadrants.

    'intent' numbers the units across a floor; 'asis' takes each quadrant as a floor of its own, so that codes repeat.
    """
    quadrants = grid_cells(F.lit(4), F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"))
    kept = [c for c in buildings.columns if c not in ("minx", "miny", "maxx", "maxy")]
    parts = buildings.select(*kept, F.explode(quadrants).alias("q")).select(*kept, "q.*").withColumnRenamed("cell", "quadrant")
    area = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    units = units_per_floor(F.col("building_type"), area)
    floors_ = parts.withColumn("n_units", units).withColumn("layout", F.lit("grid")).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("levels") - 1)))
    split = split_floors(floors_.withColumn("z_min", F.lit(ground) + F.col("level") * storey))
    number = F.col("unit_index") + (F.col("quadrant") * F.col("n_units") if mode == "intent" else F.lit(0))
    return split.withColumn("z_max", F.col("z_min") + storey).withColumn("unit_index", number)


def ordered_floors(polygons: DataFrame, storey: float = 3.0) -> DataFrame:
    """Floor polygons (building_id, z_base, level, ord) with `place`: their order in the building by base, or by level where
    a base is missing; equal ones keep theirs."""
    base = F.coalesce(F.col("z_base"), F.coalesce(F.col("level"), F.lit(0)) * storey)
    return polygons.withColumn("place", F.row_number().over(Window.partitionBy("building_id").orderBy(base, "ord")) - 1)


def split_rings(floor_rows: DataFrame, least_area: float = 1.0) -> DataFrame:
    """Units of floors of any shape (ring: array of [x, y], and holes: array of rings, if the table has any; n_units, layout): (…, unit_index, ring, parts, area).

    Grid and corridor cells of the ring's box are cut by the floor without its holes; a cell of several parts is one unit, with all of
    them in `parts` (outline, then holes; the largest first) and the largest outline in `ring`. A perimeter layout takes sectors about the
    middle; any other takes the whole floor. Units whose area is not above the least are left out.
    """
    if "holes" not in floor_rows.columns:
        floor_rows = floor_rows.withColumn("holes", F.array().cast(_POLYGON))
        return split_rings(floor_rows, least_area).drop("holes")
    shape = G.pairs_ring(F.col("ring"))
    side = lambda f, k: f(F.transform(shape, lambda p: p[k]))
    box = [side(F.array_min, "x"), side(F.array_min, "y"), side(F.array_max, "x"), side(F.array_max, "y")]
    names = ("minx", "miny", "maxx", "maxy")
    kept = [c for c in floor_rows.columns if c != "ring"]
    whole = F.concat(F.array(F.col("ring").cast(_RING)), F.coalesce("holes", F.array().cast(_POLYGON)))
    boxed = spread(floor_rows).select(*kept, F.col("ring").alias("_outline"), whole.alias("_whole"), *(b.alias(f"_{n}") for b, n in zip(box, names)))
    ends = [F.col(f"_{n}") for n in names]
    in_cells = F.when(F.col("layout") == "grid", grid_cells(F.col("n_units"), *ends)).when(F.col("layout") == "corridor", corridor_cells(F.col("n_units"), *ends))
    celled = boxed.where(F.col("layout").isin("grid", "corridor")).select(*kept, "_whole", F.explode(in_cells).alias("c"))
    parts = shared_polygons(F.array("_whole"), F.array(box_polygon(*(F.col(f"c.{n}") for n in names))))
    cut = celled.select(*kept, (F.col("c.cell") + 1).alias("unit_index"), parts.alias("parts"))
    around = boxed.where(F.col("layout") == "perimeter").select(*kept, F.posexplode(sector_rings("_outline", "n_units")).alias("_p", "ring"))
    around = around.select(*kept, (F.col("_p") + 1).alias("unit_index"), F.array(F.array("ring")).alias("parts"))
    other = boxed.where(F.coalesce(~F.col("layout").isin("grid", "corridor", "perimeter"), F.lit(True)))
    other = other.select(*kept, F.lit(1).alias("unit_index"), F.array("_whole").alias("parts"))
    units = cut.unionByName(around).unionByName(other).withColumn("parts", largest_first(F.col("parts")))
    area = F.aggregate("parts", F.lit(0.0), lambda total, p: total + polygon_area(p))
    return units.withColumn("area", area).where(F.col("area") > least_area).withColumn("ring", F.get(F.get("parts", F.lit(0)), F.lit(0)))


def split_footprints(floor_rows: DataFrame, least_area: float = 1.0) -> DataFrame:
    """Units of floors whose footprint has any number of polygons (polygons: array of outline and holes): as `split_rings`.

    The polygons of a footprint of several are its units, in their order, whatever the layout; a single one is split by its layout.
    """
    kept = [c for c in floor_rows.columns if c != "polygons"]
    one = floor_rows.where(F.size("polygons") == 1).select(*kept, F.get(F.get("polygons", F.lit(0)), F.lit(0)).alias("ring"), F.slice(F.get("polygons", F.lit(0)), 2, 1 << 30).alias("holes"))
    many = floor_rows.where(F.size("polygons") > 1).select(*kept, F.posexplode("polygons").alias("_p", "_rings"))
    many = many.select(*kept, (F.col("_p") + 1).alias("unit_index"), F.array("_rings").alias("parts"), polygon_area(F.col("_rings")).alias("area"), F.get("_rings", F.lit(0)).alias("ring"))
    return split_rings(one, least_area).drop("holes").unionByName(many.where(F.col("area") > 0))


def extrude_rings(buildings: DataFrame, ground: float = 0.0, storey: float = 3.0) -> DataFrame:
    """Volumetric units (suid, parent, type, label, floor_level, z_min, z_max, geometry, metadata) of footprints of any shape.

    buildings: (building_id, levels, n_units, layout, building_type, ring, holes), holes as rings of [x, y] or null. A building's
    parcel, solid and floors have its holes, and its units are cut by them; a footprint without area has no units at all.
    """
    shape = lambda: G.pairs_ring(F.col("ring"))
    b = spread(buildings).where((F.size("ring") >= 3) & (G.shoelace_area(shape()) > 0) & (F.col("levels") > 0))
    b = b.withColumn("holes", F.coalesce("holes", F.array().cast("array<array<array<double>>>")))
    name, top = F.col("building_id").cast("string"), F.lit(ground) + F.col("levels") * storey
    each = b.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("levels") - 1))).withColumn("z0", F.lit(ground) + F.col("level") * storey)
    level = F.col("level").cast("string")
    parcel, building, floor = F.concat(F.lit("parcel-"), name), F.concat(F.lit("building-"), name), F.concat(F.lit("floor-"), name, F.lit("-L"), level)
    unit = F.concat(F.lit("unit-"), name, F.lit("-L"), level, F.lit("-"), F.lpad(F.col("unit_index").cast("string"), 4, "0"))
    own = F.create_map(F.lit("building_id"), name)

    def rows(df: DataFrame, kind: str, suid: Column, parent: Column, label: Column, at: Column, lo: Column, hi: Column) -> DataFrame:
        # a unit's solid has the faces of all rings of its parts
        more = F.slice(F.flatten("parts"), 2, 1 << 30) if kind == "unit" else F.col("holes")
        holes = F.transform(more, G.pairs_ring)
        told = F.map_concat(own, F.create_map(F.lit("unit_type"), F.col("building_type"))) if kind == "unit" else own
        solid = let(shape(), lambda ring: G.solid_wkt(ring, lo.cast("double"), hi.cast("double"), holes))
        return df.select(
            suid.alias("suid"), parent.alias("parent"), F.lit(kind).alias("type"), label.alias("label"), at.cast("int").alias("floor_level"),
            lo.cast("double").alias("z_min"), hi.cast("double").alias("z_max"), solid.alias("geometry"), told.alias("metadata"),
        )

    z0, number = F.col("z0"), F.col("unit_index").cast("string")
    return (
        rows(b, "parcel", parcel, F.lit(None).cast("string"), F.concat(F.lit("Parcel "), name), F.lit(0), F.lit(ground), top)
        .unionByName(rows(b, "building", building, parcel, F.concat(F.lit("Building "), name), F.lit(0), F.lit(ground), top))
        .unionByName(rows(each, "floor", floor, building, F.concat(F.lit("Floor "), level), F.col("level"), z0, z0 + storey))
        .unionByName(rows(split_rings(each), "unit", unit, floor, F.concat(F.lit("Unit "), number), F.col("level"), z0, z0 + storey))
    )
