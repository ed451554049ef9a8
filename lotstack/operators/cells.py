"""Grids that fit the data: boxes on several levels of cells, and cells cut by counts.

A box goes to the level whose cells are no smaller than it, and so covers two cells along each axis at most. Boxes of one
level meet in their cells, and a small box meets a large one in the cells of the large one's level. So neither a very wide box
nor coordinates in small units make many rows.

A tree of cells cuts those with more than `most` points, so that dense places have small cells and strays have large ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotstack.functions import kernel
from lotstack.plans.tables import discard, materialize

Axes = tuple[tuple[str, str], ...]
#: The width of a level's cells is this to the power of the level.
_BASE = 4.0
#: Cells of the finest level that a coordinate may be away from zero, and cuts of a tree's root at most, as powers of two.
_FAR, _DEEPEST = 50, 40
_LEAST_LEVEL = -500


def _level(axes: Axes) -> Column:
    """The lowest level whose cells are no smaller than the box; null without extent."""
    side = F.greatest(*(F.col(hi) - F.col(lo) for lo, hi in axes)) if len(axes) > 1 else F.col(axes[0][1]) - F.col(axes[0][0])
    level = F.ceil(F.log2(side) / 2).cast("int")
    return F.when(side > 0, F.when(F.pow(F.lit(_BASE), level) < side, level + 1).otherwise(level))


def _levels(axes: Axes, *tables: DataFrame) -> tuple[list[int], int]:
    """(levels that occur, the finest that coordinates allow): two numbers of bounded size for each power of four."""
    found: set[int] = set()
    reach = 0.0
    for table in tables:
        far = F.max(F.greatest(*(F.abs(F.col(c)) for axis in axes for c in axis)))
        row = table.agg(F.collect_set(_level(axes)).alias("levels"), far.alias("far")).first()
        found |= set(row["levels"])
        reach = max(reach, row["far"] or 0.0)
    finest = max(_LEAST_LEVEL, math.ceil(math.log2(reach) / 2) - _FAR // 2) if reach else _LEAST_LEVEL
    return sorted({max(level, finest) for level in found} or {finest}), finest


def _placed(table: DataFrame, axes: Axes, levels: list[int], home: bool, above: bool = False) -> DataFrame:
    """Each box once for each cell that it covers, on its own level (`home`), or on that and all higher ones (`above`: only those)."""
    own = F.greatest(F.coalesce(_level(axes), F.lit(levels[0])), F.lit(levels[0]))
    at = table.withColumn("_own", own)
    if home:
        at = at.withColumn("_level", F.col("_own"))
    else:
        higher = F.filter(F.array(*map(F.lit, levels)), lambda x: x > F.col("_own") if above else x >= F.col("_own"))
        at = at.withColumn("_level", F.explode(higher))
    size = F.pow(F.lit(_BASE), F.col("_level"))
    for k, (lo, hi) in enumerate(axes):
        at = at.withColumn(f"_c{k}", F.explode(F.sequence(F.floor(F.col(lo) / size).cast("long"), F.floor(F.col(hi) / size).cast("long"))))
    return at


def _met(a: DataFrame, b: DataFrame, same: tuple[str, ...], axes: Axes) -> DataFrame:
    """Rows of `a` and `b` whose boxes meet, each pair from the cell alone that holds the lower corner of what both share."""
    a, b = a.alias("a"), b.alias("b")
    keys = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*same, "_level", *(f"_c{k}" for k in range(len(axes))))]
    meet, first = F.lit(True), F.lit(True)
    for k, (lo, hi) in enumerate(axes):
        meet &= (F.col(f"a.{lo}") <= F.col(f"b.{hi}")) & (F.col(f"b.{lo}") <= F.col(f"a.{hi}"))
        first &= F.floor(F.greatest(f"a.{lo}", f"b.{lo}") / F.pow(F.lit(_BASE), F.col("a._level"))) == F.col(f"a._c{k}")
    return a.join(b, [*keys, meet & first])


def _struct(side: str, columns: list[str]) -> Column:
    return F.struct(*(F.col(f"{side}.{c}").alias(c) for c in columns))


def box_pairs(boxes: DataFrame, same: tuple[str, ...], name: str, axes: Axes, few: int = 64) -> DataFrame:
    """(a, b) of rows as structs, a.name < b.name, of equal columns `same`, whose boxes meet; touching counts.

    Boxes of a group of up to `few` meet all others of it, as they are. Only those of larger groups are put into cells.
    """
    columns = boxes.columns
    less = F.col(f"a.{name}") < F.col(f"b.{name}")
    small, large = _struct("a", columns), _struct("b", columns)
    crowded = boxes.groupBy(*same).agg(F.count("*").alias("_n")).where(F.col("_n") > few).drop("_n")
    none = not crowded.limit(1).count()
    own = boxes if none else boxes.join(crowded, [*same], "left_anti")
    meet = [(F.col(f"a.{lo}") <= F.col(f"b.{hi}")) & (F.col(f"b.{lo}") <= F.col(f"a.{hi}")) for lo, hi in axes]
    within = own.alias("a").join(own.alias("b"), [*(F.col(f"a.{k}") == F.col(f"b.{k}") for k in same), less, *meet]).select(small.alias("a"), large.alias("b"))
    if none:
        return within
    boxes = boxes.join(crowded, [*same], "left_semi")
    levels, _ = _levels(axes, boxes)
    met = _met(_placed(boxes, axes, levels, False), _placed(boxes, axes, levels, True), same, axes)
    met = met.where((F.col(f"a.{name}") != F.col(f"b.{name}")) & ((F.col("a._own") < F.col("b._own")) | less))
    return within.unionAll(met.select(F.when(less, small).otherwise(large).alias("a"), F.when(less, large).otherwise(small).alias("b")))


def box_join(left: DataFrame, right: DataFrame, same: tuple[str, ...], axes: Axes) -> DataFrame:
    """(a, b) of rows of two tables as structs, of equal columns `same`, whose boxes meet; touching counts."""
    levels, _ = _levels(axes, left, right)
    structs = [_struct("a", left.columns).alias("a"), _struct("b", right.columns).alias("b")]
    lower = _met(_placed(left, axes, levels, False), _placed(right, axes, levels, True), same, axes).select(*structs)
    higher = _met(_placed(left, axes, levels, True), _placed(right, axes, levels, False, above=True), same, axes).select(*structs)
    return lower.unionAll(higher)


@dataclass
class Tree:
    """Cells cut by counts: `cells` (keys…, depth, c0…, n, box of the points) holds every cell with points, `cut` those cut further."""

    keys: tuple[str, ...]
    dims: str
    origin: dict[str, float]
    width: float
    step: int
    depths: list[int]
    cells: DataFrame

    @property
    def names(self) -> list[str]:
        return [f"_c{k}" for k in range(len(self.dims))]

    def at(self, depth: Column) -> list[Column]:
        """The cell of (x, y…) at a depth."""
        size = F.lit(self.width) / F.pow(F.lit(2.0), depth)
        top = (F.pow(F.lit(2.0), depth) - 1).cast("long")
        return [F.least(F.greatest(F.floor((F.col(d) - self.origin[d]) / size).cast("long"), F.lit(0)), top).alias(n) for d, n in zip(self.dims, self.names)]

    def ancestors(self, depth: Column) -> Column:
        return F.filter(F.array(*map(F.lit, self.depths)), lambda d: d <= depth)

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows with `_depth` and the cell of the leaf that holds them, also where it has no points.

        The cells that are cut are few, one for very many points, and are sent to all tasks: no row is shuffled.
        """
        cut, deepest = self.cells.where("cut"), F.lit(0)
        for depth in self.depths[:-1]:
            here = cut.where(F.col("_depth") == depth).select(*self.keys, *self.names, F.lit(depth + self.step).alias(f"_cut{depth}"))
            rows = rows.select("*", *self.at(F.lit(depth))).join(F.broadcast(here), [*self.keys, *self.names], "left").drop(*self.names)
            deepest = F.greatest(deepest, F.coalesce(f"_cut{depth}", F.lit(0)))
        rows = rows.withColumn("_depth", deepest).drop(*(f"_cut{depth}" for depth in self.depths[:-1]))
        return rows.select("*", *self.at(F.col("_depth")))


def box_of(dims: str) -> list[Column]:
    return [f(d).alias(f"{n}{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]


def tree(points: DataFrame, keys: tuple[str, ...], dims: str, most: int, spread: str | None = None) -> Tree | None:
    """Cells of (keys…, x, y…), cut while they hold more than `most` points; boxes span `spread` (default: dims). None without points.

    The first depths come from one pass, as many as even points need; only what is still too full is counted again.
    """
    spread = spread or dims
    row = points.agg(F.count("*").alias("n"), *box_of(dims)).first()
    if not row["n"]:
        return None
    origin = {d: row[f"lo{d}"] for d in dims}
    width = max(row[f"hi{d}"] - row[f"lo{d}"] for d in dims) or 1.0
    step = 2 if len(dims) < 3 else 1
    even = 0
    while even < _DEEPEST and row["n"] > most * 2 ** (even * len(dims)):
        even += step
    out = Tree(keys, dims, origin, width, step, list(range(0, even + 1, step)), points)
    counted, left, depths = None, points, out.depths
    while True:
        # counted at the deepest; cells above are summed up from these
        deep = left.select(*keys, *spread, *out.at(F.lit(depths[-1]))).groupBy(*keys, *out.names).agg(F.count("*").alias("n"), *box_of(spread))
        deep = materialize(deep, "deep")
        here = None
        for depth in depths:
            above = [F.floor(F.col(c) / 2.0 ** (depths[-1] - depth)).cast("long").alias(c) for c in out.names]
            summed = deep.select(*keys, *above, "n", *(f"{n}{d}" for d in spread for n in ("lo", "hi"))).groupBy(*keys, *out.names)
            summed = summed.agg(F.sum("n").alias("n"), *(f(f"{n}{d}").alias(f"{n}{d}") for d in spread for n, f in (("lo", F.min), ("hi", F.max))))
            summed = summed.select(*keys, F.lit(depth).alias("_depth"), *out.names, "n", *(f"{n}{d}" for d in spread for n in ("lo", "hi")))
            here = summed if here is None else here.unionAll(summed)
        last = depths[-1]
        full = (F.col("n") > most) & (F.greatest(*(F.col(f"hi{d}") - F.col(f"lo{d}") for d in dims)) > 0 if len(dims) > 1 else F.col(f"hi{dims}") > F.col(f"lo{dims}"))
        here = materialize(here.withColumn("cut", full & (F.col("_depth") < _DEEPEST)), "cells")
        counted = here if counted is None else counted.unionAll(here)
        again = here.where(F.col("cut") & (F.col("_depth") == last))
        if not again.limit(1).count():
            break
        cell = again.select(*keys, *out.names)
        left = left.select(*keys, *spread, *out.at(F.lit(last))).join(cell, [*keys, *out.names], "left_semi").select(*keys, *spread)
        depths = [last + step]
        out.depths = [*out.depths, last + step]
    # the first pass counts cells below leaves too; those are left out: a cell stands if the one above it is cut
    up = lambda c: F.floor(F.col(c) / 2**step).cast("long").alias(c)
    cut = counted.where("cut").select(*keys, (F.col("_depth") + step).alias("_depth"), *(F.col(c).alias(f"_up{c}") for c in out.names))
    deeper = counted.where("_depth > 0").select("*", *(up(c).alias(f"_up{c}") for c in out.names))
    deeper = deeper.join(cut, [*keys, "_depth", *(f"_up{c}" for c in out.names)], "left_semi").select(*counted.columns)
    out.cells = materialize(counted.where("_depth = 0").unionAll(deeper), "tree")
    return out


def far(a: str, b: str, dims: str, greatest: bool) -> Column:
    """The least (or greatest) distance of places in two boxes."""
    total = None
    for d in dims:
        if greatest:
            gap = F.greatest(F.abs(F.col(f"{a}.hi{d}") - F.col(f"{b}.lo{d}")), F.abs(F.col(f"{b}.hi{d}") - F.col(f"{a}.lo{d}")))
        else:
            gap = F.greatest(F.col(f"{a}.lo{d}") - F.col(f"{b}.hi{d}"), F.col(f"{b}.lo{d}") - F.col(f"{a}.hi{d}"), F.lit(0.0))
        total = gap * gap if total is None else total + gap * gap
    return F.sqrt(total)


#: Points of a leaf that are searched together, and queries that one task takes of a leaf at once.
LEAF, ASKED = 8192, 65536


def _folded(found: Column, kept: Callable[[Column], Column] | None) -> Column:
    return found if kept is None else kept(found)


def nearest(queries: DataFrame, points: DataFrame, k: int, dims: str, within: tuple[str, ...], told: tuple[str, ...], carried: tuple[str, ...], most: int = LEAF) -> DataFrame:
    """(within…, query_id, pt_id, distance, place, told…, carried…): see `pointcloud.nearest`."""
    found = neighbours(queries, points, k, dims, within, told, carried, None, most)
    flat = found.select(*within, "q", F.posexplode("found").alias("place", "f"))
    return flat.select(*within, "q.query_id", "f.p.pt_id", "f.distance", (F.col("place") + 1).alias("place"), *(f"q.{c}" for c in told), *(f"f.p.{c}" for c in carried))


def neighbours(
    queries: DataFrame, points: DataFrame, k: int, dims: str, within: tuple[str, ...], told: tuple[str, ...] = (), carried: tuple[str, ...] = (),
    kept: Callable[[Column], Column] | None = None, most: int = LEAF,
) -> DataFrame:
    """(within…, q: struct of query_id and told, found): one row of each query with its k nearest points (p: struct of pt_id and
    carried, distance), sorted; or with what `kept` makes of that array, so that no more is written.

    Every query and point goes to the leaf that holds it, once. There a kernel finds the k nearest of the leaf. A query that is as near to
    the points of another leaf asks there too, within the distance that it has found; only those few are merged.
    """
    flat = dims[:2] if len(dims) < 3 else dims
    most = max(most, 4 * k)
    place = [F.col(d).cast("double").alias(d) for d in dims]
    # written once: the tree reads points three times, and they may come from a costly query
    p = materialize(points.select(F.struct("pt_id", *carried).alias("p"), *within, *place).dropna(subset=[*within, *dims]), "points")
    q = queries.select(F.struct("query_id", *told).alias("q"), *within, *place).dropna(subset=[*within, *dims])
    listed = f"array<struct<p:{p.schema['p'].dataType.simpleString()},distance:double>>"
    cut = tree(p, within, flat, most, dims)
    if cut is None:
        discard(p)
        return q.where("false").select(*within, "q", _folded(F.lit(None).cast(listed), kept).alias("found"))
    cell = [*within, "_depth", *cut.names]
    corners = [f"{n}{d}" for d in dims for n in ("lo", "hi")]
    leaves = materialize(cut.cells.where("NOT cut").select(*cell, "n", *corners).withColumn("leaf", F.monotonically_increasing_id()), "leaves")
    own = F.broadcast(leaves.select(*cell, "leaf"))
    pts = cut.placed(p).join(own, cell).select("leaf", "p", *dims)
    # of points in one place only the first k can be among the nearest: a leaf that can't be cut has but these
    crowded = leaves.where(F.col("n") > most).select("leaf")
    if crowded.limit(1).count():
        first = F.row_number().over(Window.partitionBy("leaf", *dims).orderBy("p.pt_id"))
        thin = pts.join(F.broadcast(crowded), "leaf").withColumn("_n", first).where(F.col("_n") <= k).drop("_n")
        pts = pts.join(F.broadcast(crowded), "leaf", "left_anti").unionAll(thin.select(*pts.columns))
    # a leaf without points has no row of its own; its queries keep a null, and look elsewhere
    asked = materialize(cut.placed(q).join(own, cell, "left").select("leaf", *within, "q", *dims, "_depth", *cut.names), "asked")
    held = asked.where("leaf IS NOT NULL")
    met = _searched(held, pts, k, dims, listed)
    far_off = asked.where("leaf IS NULL").withColumn("found", F.lit(None).cast(listed))
    # how near the next leaf may be: as the kth point found, or the far side of the smallest cell around with so many points
    up = [F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_depth") - F.col("_up"))).cast("long").alias(f"_u{i}") for i, c in enumerate(cut.names)]
    # a query is sure of its k points if all that is nearer lies in its leaf's own cell
    walls = []
    size = F.lit(cut.width) / F.pow(F.lit(2.0), F.col("_depth"))
    top = (F.pow(F.lit(2.0), F.col("_depth")) - 1).cast("long")
    for d, c in zip(flat, cut.names):
        low, high = F.lit(cut.origin[d]) + F.col(c) * size, F.lit(cut.origin[d]) + (F.col(c) + 1) * size
        walls += [F.when(F.col(c) > 0, F.col(d) - low), F.when(F.col(c) < top, high - F.col(d))]
    # cells of a depth are cut by rounded numbers: a wall may stand a little off
    slack = 1e-9 * (cut.width + max(abs(v) for v in cut.origin.values()))
    wall = F.least(*walls) - slack if len(walls) > 1 else walls[0] - slack
    last = F.element_at("found", -1)["distance"]
    sure = (F.size("found") == k) & (wall.isNull() | (last < wall))
    met = met.withColumn("_sure", F.coalesce(sure, F.lit(False)))
    rest = [*within, "q", *dims, "_depth", *cut.names, "leaf"]
    first_found = materialize(
        met.select(*within, F.when(F.col("_sure"), F.col("q")).alias("done"), F.when(F.col("_sure"), _folded(F.col("found"), kept)).alias("result"), F.when(~F.col("_sure"), F.struct("found", *(c for c in rest if c not in within))).alias("open")),
        "found",
    )
    settled = first_found.where("open IS NULL").select(*within, F.col("done").alias("q"), F.col("result").alias("found"))
    loose = first_found.where("open IS NOT NULL").select(*within, "open.*").select("found", *rest).unionAll(far_off.select("found", *rest))
    loose = materialize(loose.withColumn("_row", F.monotonically_increasing_id()), "open")
    enough = F.size("found") == k
    near = loose.where(enough).select("_row", *within, *dims, "leaf", last.alias("reach"))
    climbing = loose.where(~F.coalesce(enough, F.lit(False))).select("_row", *within, *dims, "leaf", "_depth", *cut.names, F.explode(cut.ancestors(F.col("_depth"))).alias("_up")).select("*", *up)
    around = cut.cells.select(*within, F.col("_depth").alias("_up"), *(F.col(c).alias(f"_u{i}") for i, c in enumerate(cut.names)), "n", *corners)
    beyond = [F.greatest(F.abs(F.col(d) - F.col(f"lo{d}")), F.abs(F.col(d) - F.col(f"hi{d}"))) for d in dims]
    climbed = climbing.join(F.broadcast(around), [*within, "_up", *(f"_u{i}" for i in range(len(flat)))]).withColumn("far", F.sqrt(sum((b * b for b in beyond[1:]), beyond[0] * beyond[0])) * (1 + 1e-9))
    climbed = climbed.groupBy("_row", *within, *dims, "leaf").agg(F.coalesce(F.max_by("far", F.when(F.col("n") >= k, F.col("_up"))), F.max("far")).alias("reach"))
    asks = near.unionAll(climbed.select(*near.columns))
    spans = [f"x_{n}{d}" for d in flat for n in ("lo", "hi")]
    wide = asks.select("*", *(e for d in flat for e in ((F.col(d) - F.col("reach")).alias(f"x_lo{d}"), (F.col(d) + F.col("reach")).alias(f"x_hi{d}"))))
    wide = materialize(wide, "reach")
    boxes = leaves.select(*within, F.col("leaf").alias("other"), *(F.col(f"{n}{d}").alias(f"x_{n}{d}") for d in flat for n in ("lo", "hi")), *corners)
    gaps = [F.greatest(F.col(f"b.lo{d}") - F.col(f"a.{d}"), F.col(f"a.{d}") - F.col(f"b.hi{d}"), F.lit(0.0)) for d in dims]
    meets = box_join(wide, boxes, within, tuple((f"x_lo{d}", f"x_hi{d}") for d in flat))
    meets = meets.where(~F.col("a.leaf").eqNullSafe(F.col("b.other")) & (F.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])) <= F.col("a.reach")))
    again = materialize(meets.select(F.col("b.other").alias("leaf"), F.col("a._row").alias("_row"), *(F.col(f"a.{d}").alias(d) for d in dims)), "again")
    more = _searched(again, pts, k, dims, listed).select("_row", "found")
    all_found = loose.where("found IS NOT NULL").select("_row", "found").unionAll(more)
    best = F.row_number().over(Window.partitionBy("_row").orderBy("f.distance", "f.p.pt_id"))
    merged = all_found.select("_row", F.explode("found").alias("f")).withColumn("_place", best).where(F.col("_place") <= k)
    merged = merged.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_place", "f"))).alias("f")).select("_row", F.transform("f", lambda f: f["f"]).alias("found"))
    merged = loose.select("_row", *within, "q").join(merged, "_row").select(*within, "q", "found")
    merged = materialize(merged.select(*within, "q", _folded(F.col("found"), kept).alias("found")), "merged")
    discard(p, asked, leaves, loose, wide, again, cut.cells)
    return settled.unionAll(merged)


def _searched(asked: DataFrame, points: DataFrame, k: int, dims: str, listed: str) -> DataFrame:
    """Rows of `asked` (leaf, x…, others) with `found`: their k nearest of the points (leaf, p, x…) of their leaf.

    Where very many ask one leaf, they ask in parts, each of which has the leaf's points.
    """
    parts = asked.groupBy("leaf").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("_parts")).where("_parts > 1")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema if f.name != "leaf")
    a = asked.join(F.broadcast(parts), "leaf", "left").withColumn("_part", F.coalesce(F.floor(F.rand(7) * F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    b = points.join(F.broadcast(parts), "leaf", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")

    def searched(of_query: pa.Table, of_point: pa.Table) -> pa.Table:
        place = lambda t: np.column_stack([t.column(d).to_numpy() for d in dims])
        told = of_point.column("p").combine_chunks()
        # by id, so that of equal distances the first place is the smallest id
        told, of_point = (x.take(order) for order in [pc.sort_indices(told.field("pt_id"))] for x in (told, of_point))
        starts, which, gaps = kernel.nearest(place(of_query), place(of_point), k)
        values = pa.StructArray.from_arrays([told.take(pa.array(which)), pa.array(gaps)], ["p", "distance"])
        return of_query.drop_columns(["_part"]).append_column("found", pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values))

    return a.groupBy("leaf", "_part").cogroup(b.groupBy("leaf", "_part")).applyInArrow(searched, f"leaf long, {kinds}, found {listed}")
