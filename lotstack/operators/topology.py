"""3-D topology rules over units, tetrahedra and boxes.

mode 'asis' keeps long-standing output, mode 'intent' follows the documented rule; they differ where a gap could never
be reported because upper and lower were taken the wrong way round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotstack.functions import geometry as G
from lotstack.functions import kernel
from lotstack.operators import cells
from lotstack.operators.runs import whole_runs
from lotstack.plans.tables import discard, materialize

TOLERANCE = 0.01
#: The corner numbers of a tetrahedron's faces.
FACES = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))


def parcel_key(suid: Column) -> Column:
    """The text before the first hyphen, else the code's parcel part."""
    return F.when(F.instr(suid, "-") > 0, F.substring_index(suid, "-", 1)).otherwise(F.concat(F.substring(suid, 1, 17), F.lit("00000000")))


_AXES = (("minx", "maxx"), ("miny", "maxy"), ("z_min", "z_max"))


def pairs_in_cells(units: DataFrame) -> DataFrame:
    """Rows (a, b) of units of one parent, as structs, a.suid < b.suid, whose boxes meet; touching counts.

    Boxes meet in cells of about their own size (`cells.box_pairs`): units of a parent meet their neighbours, not all others, in
    metres and in degrees, and a box of any width covers a bounded number of cells.
    """
    return cells.box_pairs(units, ("parent_suid",), "suid", _AXES)


def relation() -> Column:
    """How boxes a and b that meet lie: the first that holds of overlap (both share volume, and neither holds the other),
    adjacent (they share no volume: faces, edges or corners touch), contain (a holds b, or they are equal); else unknown."""
    shared = lambda lo, hi: F.least(f"a.{hi}", f"b.{hi}") > F.greatest(f"a.{lo}", f"b.{lo}")
    holds = lambda x, y, lo, hi: (F.col(f"{x}.{lo}") <= F.col(f"{y}.{lo}")) & (F.col(f"{x}.{hi}") >= F.col(f"{y}.{hi}"))
    axes = (("minx", "maxx"), ("miny", "maxy"), ("z_min", "z_max"))
    every = lambda f: f(*axes[0]) & f(*axes[1]) & f(*axes[2])
    inside = every(shared)
    a_holds, b_holds = every(lambda lo, hi: holds("a", "b", lo, hi)), every(lambda lo, hi: holds("b", "a", lo, hi))
    return F.when(inside & ~a_holds & ~b_holds, "overlap").when(~inside, "adjacent").when(a_holds, "contain").otherwise("unknown")


def adjacency(units: DataFrame) -> DataFrame:
    """(suid_1, suid_2, relation) of units of one parent whose boxes meet."""
    return pairs_in_cells(units).select(F.col("a.suid").alias("suid_1"), F.col("b.suid").alias("suid_2"), relation().alias("relation"))


def overlaps(units: DataFrame) -> DataFrame:
    """(suid_1, suid_2, volume) of units of one parent whose boxes share volume."""
    shared = lambda lo, hi: F.least(F.col(f"a.{hi}"), F.col(f"b.{hi}")) - F.greatest(F.col(f"a.{lo}"), F.col(f"b.{lo}"))
    x, y, z = shared("minx", "maxx"), shared("miny", "maxy"), shared("z_min", "z_max")
    met = pairs_in_cells(units).where((x > 0) & (y > 0) & (z > 0))
    return met.select(F.col("a.suid").alias("suid_1"), F.col("b.suid").alias("suid_2"), (x * y * z).alias("volume"))


def vertical_gaps(units: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(upper_suid, lower_suid, gap) of consecutive floors of one parent that don't meet: both signs are reported."""
    a = units.select(F.col("suid").alias("upper_suid"), "parent_suid", "floor_level", "z_min")
    b = units.select(F.col("suid").alias("lower_suid"), "parent_suid", (F.col("floor_level") + 1).alias("floor_level"), "z_max")
    gap = F.col("z_min") - F.col("z_max")
    return a.join(b, ["parent_suid", "floor_level"]).where(F.abs(gap) > tolerance).select("upper_suid", "lower_suid", gap.alias("gap"))


def vertical_consecutive(units: DataFrame, mode: str = "intent", parcel: str = "parent_suid", order: str = "suid", tolerance: float = TOLERANCE) -> DataFrame:
    """(suid_1, suid_2, gap, relation, severity) of units that follow each other by height within a parcel."""
    by = Window.partitionBy(parcel).orderBy("z_min", order)
    following = units.select("suid", "z_min", "z_max", *(F.lead(c).over(by).alias(f"next_{c}") for c in ("suid", "z_min", "z_max")))
    gap = F.col("z_min") - F.col("next_z_max") if mode == "asis" else F.col("next_z_min") - F.col("z_max")
    return (
        following.where(F.col("next_suid").isNotNull())
        .withColumn("gap", gap)
        .where(F.abs("gap") > tolerance)
        .select(
            F.col("suid").alias("suid_1"),
            F.col("next_suid").alias("suid_2"),
            "gap",
            F.when(F.col("gap") > 0, "gap").otherwise("overlap").alias("relation"),
            F.when(F.col("gap") > 0, "error").otherwise("warning").alias("severity"),
        )
    )


def boundary_violations(units: DataFrame, parcels: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(suid, parent_suid) of units that reach beyond their parcel's box. parcels: (parent_suid, px1, py1, px2, py2)."""
    outside = (
        (F.col("minx") < F.col("px1") - tolerance)
        | (F.col("miny") < F.col("py1") - tolerance)
        | (F.col("maxx") > F.col("px2") + tolerance)
        | (F.col("maxy") > F.col("py2") + tolerance)
    )
    return units.join(parcels, "parent_suid").where(outside).select("suid", "parent_suid")


def outside_of_parcels(units: DataFrame, parcels: DataFrame) -> DataFrame:
    """(suid, parent_suid) of units (suid, parent_suid, ring) that don't lie within their parcel (parent_suid, outline, holes), edge by edge.

    The boxes are compared first. A unit without a parcel is left out, and so are holes that are null. What the boxes don't tell goes to a
    kernel in Arrow batches, many rings at once; a ring with a corner that is null is told by the boxes only.
    """
    shape = "array<struct<x:double,y:double>>"
    met = units.select("suid", "parent_suid", F.col("ring").cast(shape).alias("ring")).join(
        parcels.select("parent_suid", F.col("outline").cast(shape).alias("outline"), F.coalesce(F.col("holes").cast(f"array<{shape}>"), F.array().cast(f"array<{shape}>")).alias("holes")), "parent_suid"
    )
    met = met.where(F.col("ring").isNotNull() & F.col("outline").isNotNull())
    kinds = dict(met.dtypes)
    return met.mapInArrow(_outside, f"suid {kinds['suid']}, parent_suid {kinds['parent_suid']}")


def _outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(suid, parent_suid) of the rows of `outside_of_parcels` that lie outside."""

    def read(column: pa.ListArray) -> tuple[kernel.Rings, np.ndarray]:
        """Rings, and which of them are null or have a corner that is."""
        counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
        axes = column.flatten().flatten()
        rings = kernel.Rings(np.concatenate([[0], np.cumsum(counts)]), *(v.to_numpy(zero_copy_only=False) for v in axes))
        lacking = column.is_null().to_numpy(zero_copy_only=False).copy()
        if any(v.null_count for v in axes):
            lacking[rings.owner[pc.or_(*(v.is_null() for v in axes)).to_numpy(zero_copy_only=False)]] = True
        return rings, lacking

    for batch in batches:
        own, lacks = read(batch.column("ring"))
        outline, lacks_too = read(batch.column("outline"))
        out = np.zeros(batch.num_rows, bool)
        for k in "xy":
            low, high = own.span(getattr(own, k))
            least, most = outline.span(getattr(outline, k))
            out |= (low < least) | (high > most)
        asked = np.flatnonzero(~(out | lacks | lacks_too))
        listed = batch.column("holes").take(pa.array(asked))
        holes, lack = read(listed.flatten())
        hole_of, whole = np.repeat(np.arange(len(asked)), pc.list_value_length(listed).to_numpy().astype(np.int64)), np.flatnonzero(~lack)
        out[asked] = ~kernel.rings_within(own.take(asked), outline.take(asked), holes.take(whole), hole_of[whole])
        yield batch.select(["suid", "parent_suid"]).filter(pa.array(out))


def corner(v: Column, tolerance: float) -> Column:
    """A vertex on the grid of the tolerance, in whole steps: corners that nearly meet are equal."""
    return F.struct(*(F.rint(v[k] / tolerance).cast("long").alias(k) for k in "xyz"))


def tetra_faces(tetrahedra: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(tet, suid, corners, low, high, face_key): four faces of each tetrahedron (tet, suid, vertices); equal faces have equal keys.

    `low` is the height of the solid's first vertex, `high` that of its highest.
    """
    vertex = lambda k: F.element_at("vertices", k + 1)
    faces = F.array(*(F.array(*(vertex(k) for k in f)) for f in FACES))
    return (
        tetrahedra.where(F.size("vertices") >= 4)
        .select("tet", "suid", F.explode(faces).alias("corners"), F.get("vertices", F.lit(0))["z"].alias("low"), F.array_max(F.transform("vertices", lambda v: v["z"])).alias("high"))
        .withColumn("face_key", F.sort_array(F.transform("corners", lambda v: corner(v, tolerance))))
    )


_HASHES = ("face_hash", "face_check")


def _hashes() -> list[Column]:
    """128 bits of a face's key, by two seeds: two of 10 billion different faces agree in both with a chance below 1e-18."""
    return [F.xxhash64("face_key").alias(_HASHES[0]), F.xxhash64(F.lit(1), "face_key").alias(_HASHES[1])]


def shared_faces(faces: DataFrame, told: bool = True) -> DataFrame:
    """(suid_1, suid_2, face_key, relation, severity): faces of two units that face each other, and over-shared faces.

    Two tetrahedra of different units with opposite normals are adjacent: both come out of one grouping by the key, whose least and
    greatest tetrahedron they are. Only faces with more uses are looked up again: of them, each pair of different units overlaps.
    Faces meet by 128 bits of their keys, in one pass where none is over-shared; the keys themselves are shuffled only if they are `told`.
    """
    key = ["face_key"] if told else []
    slim = faces.select("tet", "suid", *key, *_hashes(), G.normal(*(F.element_at("corners", k) for k in (1, 2, 3))).alias("normal"))
    one = F.struct("tet", "suid", "normal")
    # dealt before they are grouped: most faces are used once or twice, and grouping them in every task first would save little
    used = slim.repartition(*_HASHES).groupBy(*_HASHES).agg(F.count("*").alias("uses"), F.min(one).alias("a"), F.max(one).alias("b"), *(F.first(c).alias(c) for c in key)).where("uses > 1")
    used = materialize(used, "used")
    dot = sum((F.col(f"a.normal.{k}") * F.col(f"b.normal.{k}") for k in "yz"), F.col("a.normal.x") * F.col("b.normal.x"))
    row = lambda relation, severity: (F.col("a.suid").alias("suid_1"), F.col("b.suid").alias("suid_2"), *key, F.lit(relation).alias("relation"), F.lit(severity).alias("severity"))
    adjacent = used.where((F.col("uses") == 2) & (F.col("a.suid") != F.col("b.suid")) & (dot < -0.5)).select(*row("adjacent", "info"))
    crowded = used.where("uses > 2").select(*_HASHES)
    if not crowded.limit(1).count():
        return adjacent
    held = materialize(slim.select("tet", "suid", *_HASHES, *key).join(crowded, [*_HASHES], "left_semi"), "crowded")
    a, b = held.alias("a"), held.drop(*key).alias("b")
    pairs = a.join(b, [*(F.col(f"a.{h}") == F.col(f"b.{h}") for h in _HASHES), F.col("a.tet") < F.col("b.tet"), F.col("a.suid") != F.col("b.suid")])
    overlap = pairs.select(F.col("a.suid").alias("suid_1"), F.col("b.suid").alias("suid_2"), *key, F.lit("overlap").alias("relation"), F.lit("error").alias("severity"))
    return adjacent.unionByName(overlap)


def face_text(face_key: Column, tolerance: float = TOLERANCE) -> Column:
    """A face's text from its key: corners on the grid of the tolerance."""
    return G.triangle_wkt(F.transform(face_key, lambda v: F.struct(*((v[k] * tolerance).alias(k) for k in "xyz"))))


def manifold_gaps(faces: DataFrame, tolerance: float = TOLERANCE, mode: str = "intent") -> DataFrame:
    """(suid, face_key, relation, severity): faces used once that lie on no boundary in height: of their parcel (`intent`), or of
    their own solid, between its first and its highest vertex (`asis`)."""
    zs = F.transform("corners", lambda v: v["z"])
    tall = faces.select("suid", "face_key", *_hashes(), F.array_min(zs).alias("lo"), F.array_max(zs).alias("hi"), "low", "high")
    if mode != "asis":
        tall = tall.drop("low", "high").withColumn("parcel", parcel_key(F.col("suid")))
        bounds = tall.groupBy("parcel").agg(F.min("lo").alias("low"), F.max("hi").alias("high"))
    kept = [c for c in tall.columns if c not in _HASHES]
    once = tall.repartition(*_HASHES).groupBy(*_HASHES).agg(F.count("*").alias("uses"), *(F.first(c).alias(c) for c in kept)).where("uses = 1")
    if mode != "asis":
        once = once.join(bounds, "parcel")
    inner = (F.col("lo") > F.col("low") + tolerance) & (F.col("hi") < F.col("high") - tolerance)
    return once.where(inner).select("suid", "face_key", F.lit("gap").alias("relation"), F.lit("warning").alias("severity"))


#: Classes of faces by their width, in steps of the tolerance; a face lies in a tile so many times as wide as its class.
_WIDTHS, _TILE = 4.0 ** np.arange(1, 31), 16
#: About how many tetrahedra are dealt to a task.
PART_ROWS = 200_000
_SPOTS = [f"{k}{i}" for i in range(4) for k in "xyz"]


def _whole(steps: np.ndarray) -> np.ndarray:
    """Whole numbers; one that isn't known is the least of all."""
    return np.where(np.isnan(steps), np.iinfo(np.int64).min, np.nan_to_num(steps)).astype(np.int64)


def _mixed(key: np.ndarray) -> np.ndarray:
    """A hash of each row of whole numbers."""
    mixed = np.zeros(len(key), np.uint64)
    for column in key.T.astype(np.uint64):
        mixed = (mixed ^ column) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): rows of whole numbers in an order that has equal ones together, and where in it each run of them starts."""
    # one sort by a hash; only if two different rows have the same one do all columns decide
    mixed = _mixed(key)
    order = np.argsort(mixed)
    apart = lambda: (key[order[1:]] != key[order[:-1]]).any(axis=1)
    other = apart()
    if (other & (mixed[order[1:]] == mixed[order[:-1]])).any():
        order = np.lexsort(key.T[::-1])
        other = apart()
    return order, np.flatnonzero(np.concatenate([[True], other])) if len(key) else np.zeros(0, np.int64)


def _folded(at: np.ndarray) -> list[pa.Array]:
    """The corners (rows, 4, 3) of tetrahedra as whole numbers: the bits of the first, and those in which the others differ from it,
    which are few and zero where they share a place, so that they take little room in a shuffle."""
    bits = np.ascontiguousarray(at).view(np.int64)
    return [pa.array(bits[:, i, k] ^ bits[:, 0, k] if i else bits[:, 0, k]) for i in range(4) for k in range(3)]


def _unfolded(table: pa.Table) -> np.ndarray:
    bits = np.column_stack([table.column(c).to_numpy() for c in _SPOTS]).reshape(-1, 4, 3)
    bits[:, 1:] ^= bits[:, :1]
    return bits.view(np.float64)


def _tiled(tolerance: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Tetrahedra, once for each tile (bucket) that some of their faces lie in, with the numbers of those faces as bits (here), and their heights."""

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _SPOTS]).reshape(-1, 4, 3)
            steps = np.rint(at / tolerance)[:, np.array(FACES)]
            least, most = np.fmin.reduce(steps, axis=2), np.fmax.reduce(steps, axis=2)
            size = np.searchsorted(_WIDTHS, np.fmax.reduce(most - least, axis=2), side="right")
            place = _whole(np.floor(least / (_TILE * 4.0 ** (size + 1))[..., None]))
            bucket = _mixed(np.concatenate([size[..., None], place], axis=2).reshape(-1, 4)).view(np.int64).reshape(-1, 4)
            same = bucket[:, :, None] == bucket[:, None, :]
            here = (same << np.arange(4)).sum(axis=2)
            # the first face of each tile
            row, face = np.nonzero(same.argmax(axis=2) == np.arange(4))
            columns = [batch.column("tet"), batch.column("suid"), *_folded(at), *(pa.array(f.reduce(at[:, :, 2], axis=1)) for f in (np.fmin, np.fmax)), batch.column("top")]
            out = pa.RecordBatch.from_arrays(columns, ["tet", "suid", *_SPOTS, "low", "high", "top"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[row, face]), pa.array(here[row, face].astype(np.int32)), *out.columns], ["bucket", "here", *out.schema.names])

    return tiled


def met_faces(tetrahedra: DataFrame, tolerance: float = TOLERANCE, mode: str = "intent", told: bool = True) -> DataFrame:
    """(relation, tet, suid_1, suid_2, face_key) of faces of tetrahedra (tet, suid, vertices): `adjacent` of two units as in `shared_faces`,
    `gap` as in `manifold_gaps`, and `crowded` for each use of a face with more than two. Keys are there only if they are `told`.

    Tetrahedra are dealt, not faces: each goes once to the tiles that its faces lie in, nearly always one, and a kernel counts the faces there,
    many tiles at once. A tile is some dozen faces wide by their own size. The heights of a parcel are worked out in its tiles too; only
    parcels in several of them are told their bounds, as rows of their own.
    """
    first = F.slice("vertices", 1, 4)
    spots = [F.get(first, F.lit(i))[k].cast("double").alias(f"{k}{i}") for i in range(4) for k in "xyz"]
    rows = tetrahedra.where(F.size("vertices") >= 4).select("tet", "suid", *spots, F.array_max(F.transform("vertices", lambda v: v["z"].cast("double"))).alias("top"))
    kind = dict(rows.dtypes)
    folded = ", ".join(f"{c} long" for c in _SPOTS)
    placed = materialize(rows.mapInArrow(_tiled(tolerance), f"bucket long, here int, tet {kind['tet']}, suid {kind['suid']}, {folded}, low double, high double, top double"), "placed")
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-placed.count() // PART_ROWS))
    if mode == "asis":
        dealt = placed.drop("low", "high")
    else:
        of = placed.groupBy(parcel_key(F.col("suid")).alias("parcel")).agg(F.collect_set("bucket").alias("buckets"), F.min("low").alias("low"), F.max("high").alias("high"))
        several = of.where(F.size("buckets") > 1).select(F.explode("buckets").alias("bucket"), F.concat("parcel", F.lit("-")).alias("suid"), "low", "high", F.lit(0).alias("here"))
        # the heights of a parcel's row stand in the place of two corners; its own come from the corners of its tetrahedra
        dealt = placed.drop("low", "high", "top").unionByName(materialize(several.mapInArrow(_as_corners, f"bucket long, here int, suid {kind['suid']}, {folded}"), "parcels"), allowMissingColumns=True)

    def counted(table: pa.Table, owner: np.ndarray) -> pa.RecordBatch:
        at, here = _unfolded(table), table.column("here").to_numpy()
        if mode == "asis":
            low, high, known = at[:, 0, 2], table.column("top").to_numpy(), np.ones(len(at), bool)
        else:
            code = _parcels(table.column("suid").combine_chunks()).dictionary_encode().indices
            known = code.is_valid().to_numpy(zero_copy_only=False)
            order, starts = _runs(np.column_stack([owner, pc.fill_null(code, -1).to_numpy().astype(np.int64)]))
            low, high = np.empty(len(at)), np.empty(len(at))
            for out, f, best in ((low, np.fmin, np.fmin.reduce(at[:, :, 2], axis=1)), (high, np.fmax, np.fmax.reduce(at[:, :, 2], axis=1))):
                out[order] = np.repeat(f.reduceat(best[order], starts), np.diff(np.append(starts, len(order))))
        row, face = np.nonzero((here[:, None] >> np.arange(4)) & 1)
        corners = at[row[:, None], np.array(FACES)[face]]
        key = _whole(np.rint(corners / tolerance))
        for i, j in ((0, 1), (1, 2), (0, 1)):  # the corners in order, by x, y and z
            a, b = key[:, i], key[:, j]
            less, same = b < a, a == b
            swap = less[:, 0] | (same[:, 0] & (less[:, 1] | (same[:, 1] & less[:, 2])))
            key[:, i], key[:, j] = np.where(swap[:, None], b, a), np.where(swap[:, None], a, b)
        key = key.reshape(-1, 9)
        order, starts = _runs(np.column_stack([owner[row], key]))
        uses = np.diff(np.append(starts, len(order)))
        once = order[starts[uses == 1]]
        z, own = corners[once][:, :, 2], row[once]
        once = once[known[own] & (np.fmin.reduce(z, axis=1) > low[own] + tolerance) & (np.fmax.reduce(z, axis=1) < high[own] - tolerance)]
        a, b = (order[starts[uses == 2] + k] for k in (0, 1))
        tet, suid = table.column("tet").combine_chunks(), table.column("suid").combine_chunks()
        number = pc.fill_null(tet, np.iinfo(np.int64).min).to_numpy()
        swap = number[row[b]] < number[row[a]]
        for i in np.flatnonzero(number[row[a]] == number[row[b]]):
            swap[i] = (suid[row[b[i]]].as_py() or "") < (suid[row[a[i]]].as_py() or "")
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        across = (_normals(corners[a]) * _normals(corners[b])).T
        facing = (across[0] + across[1] + across[2] < -0.5) & pc.fill_null(pc.not_equal(suid.take(pa.array(row[a])), suid.take(pa.array(row[b]))), False).to_numpy(zero_copy_only=False)
        a, b = a[facing], b[facing]
        crowded = order[np.repeat(uses > 2, uses)]
        lead = np.concatenate([once, a, crowded])
        other = pa.concat_arrays([pa.nulls(len(once), suid.type), suid.take(pa.array(row[b])), pa.nulls(len(crowded), suid.type)])
        relation = pa.array(np.repeat(np.array(["gap", "adjacent", "crowded"]), [len(once), len(a), len(crowded)]), pa.string())
        made = {"relation": relation, "tet": tet.take(pa.array(row[lead])), "suid_1": suid.take(pa.array(row[lead])), "suid_2": other}
        if told:
            axes = key[lead].reshape(-1, 3).T
            spot = pa.StructArray.from_arrays([pa.array(v, mask=v == np.iinfo(np.int64).min) for v in axes], ["x", "y", "z"])
            made["face_key"] = pa.ListArray.from_arrays(pa.array(np.arange(len(lead) + 1, dtype=np.int32) * 3), spot)
        return pa.RecordBatch.from_pydict(made)

    schema = f"relation string, tet {kind['tet']}, suid_1 {kind['suid']}, suid_2 {kind['suid']}" + (", face_key array<struct<x:bigint,y:bigint,z:bigint>>" if told else "")
    return whole_runs(dealt, "bucket", counted, schema, parts)


def _parcels(suid: pa.StringArray) -> pa.StringArray:
    """`parcel_key` of texts."""
    hyphen = pc.find_substring(suid, "-")
    parcel = pc.binary_join_element_wise(pc.utf8_slice_codeunits(suid, 0, 17), pa.scalar("00000000", suid.type), pa.scalar("", suid.type))
    return pc.if_else(pc.greater_equal(hyphen, 0), pc.replace_substring_regex(suid, "(?s)-.*", ""), parcel)


def _as_corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of parcels (bucket, suid, low, high, here) in the form of tetrahedra that reach from low to high."""
    for batch in batches:
        at = np.full((batch.num_rows, 4, 3), np.nan)
        at[:, 0, 2], at[:, 1, 2] = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("low", "high"))
        yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("here"), batch.column("suid"), *_folded(at)], ["bucket", "here", "suid", *_SPOTS])


def _of_met(met: DataFrame) -> DataFrame:
    """`shared_faces` of `met_faces`, a table, with their keys: of crowded faces, which are few, each pair of different units overlaps."""
    adjacent = met.where("relation = 'adjacent'").select("suid_1", "suid_2", "face_key", "relation", F.lit("info").alias("severity"))
    crowded = met.where("relation = 'crowded'")
    if not crowded.limit(1).count():
        return adjacent
    held = crowded.select("tet", F.col("suid_1").alias("suid"), "face_key", *_hashes())
    a, b = held.alias("a"), held.drop("face_key").alias("b")
    pairs = a.join(b, [*(F.col(f"a.{h}") == F.col(f"b.{h}") for h in _HASHES), F.col("a.tet") < F.col("b.tet"), F.col("a.suid") != F.col("b.suid")])
    overlap = pairs.select(F.col("a.suid").alias("suid_1"), F.col("b.suid").alias("suid_2"), "face_key", F.lit("overlap").alias("relation"), F.lit("error").alias("severity"))
    return adjacent.unionByName(overlap)


def _normals(corners: np.ndarray) -> np.ndarray:
    """`geometry.normal` of triangles (n, 3, 3), step by step."""
    u, v = ((corners[:, k] - corners[:, 0]).T for k in (1, 2))
    cross = np.column_stack([u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]])
    length = np.sqrt(cross[:, 0] * cross[:, 0] + cross[:, 1] * cross[:, 1] + cross[:, 2] * cross[:, 2])[:, None]
    return np.where(length < 1e-12, np.array([0.0, 0.0, 1.0]), cross / np.where(length < 1e-12, 1.0, length))


def open_faces(met: DataFrame) -> DataFrame:
    """`manifold_gaps` of `met_faces`."""
    key = [c for c in ("face_key",) if c in met.columns]
    return met.where("relation = 'gap'").select(F.col("suid_1").alias("suid"), *key, "relation", F.lit("warning").alias("severity"))


def over_used_edges(tetrahedra: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(suid, edge_key, uses): edges that more than two faces of one unit's tetrahedra (suid, vertices) share, so that it has no clean surface.

    A unit's tetrahedra are dealt to one task, as four corners each, and their edges are counted there, many units at once: edges,
    of which there are six to a tetrahedron and each in two of its faces, are not shuffled.
    """
    at = [F.rint(F.get("vertices", F.lit(i))[k] / tolerance).cast("long").alias(f"{k}{i}") for i in range(4) for k in "xyz"]
    rows = tetrahedra.where(F.size("vertices") >= 4).select("suid", *at)
    edges = [(i, j) for i in range(4) for j in range(i + 1, 4)]

    def counted(table: pa.Table, owner: np.ndarray) -> pa.RecordBatch:
        v = np.column_stack([table.column(f"{k}{i}").to_numpy() for i in range(4) for k in "xyz"]).reshape(-1, 4, 3)
        a, b = (v[:, [e[side] for e in edges]].reshape(-1, 3) for side in (0, 1))
        # the lower corner first, by x, y and z
        less, same = a < b, a == b
        swap = ~(less[:, 0] | (same[:, 0] & (less[:, 1] | (same[:, 1] & (less[:, 2] | same[:, 2])))))
        key = np.column_stack([np.repeat(owner, 6), np.where(swap[:, None], b, a), np.where(swap[:, None], a, b)])
        order, first = _runs(key)
        key = key[order]
        uses = 2 * np.diff(np.append(first, len(key)))
        first, uses = first[uses > 2], uses[uses > 2]
        ends = pa.StructArray.from_arrays([pa.array(key[first, 1:].reshape(-1, 3)[:, k]) for k in range(3)], ["x", "y", "z"])
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * 2), ends)
        return pa.RecordBatch.from_arrays([table.column("suid").combine_chunks().take(pa.array(order[first] // 6)), listed, pa.array(uses)], ["suid", "edge_key", "uses"])

    corners = "array<struct<x:bigint,y:bigint,z:bigint>>"
    # a unit of null is one like others; a corner that is null is in no edge
    return whole_runs(rows.dropna(subset=rows.columns[1:]), "suid", counted, f"suid {dict(rows.dtypes)['suid']}, edge_key {corners}, uses long")


def validate(units: DataFrame, mode: str = "intent", tolerance: float = TOLERANCE) -> DataFrame:
    """All rules over (ord, suid, vertices): (rule, suid_1, suid_2, relation, details, severity); the details of rules about a
    face end with its text. The mode holds for rules 2 and 4; the others have but one reading."""
    counted = met_faces(units.select(F.col("ord").alias("tet"), "suid", "vertices"), tolerance, mode)
    met = materialize(counted, "met")
    discard(counted)
    zs = F.transform("vertices", lambda v: v["z"])
    tall = units.select("suid", "ord", parcel_key(F.col("suid")).alias("parcel"), F.array_min(zs).alias("z_min"), F.array_max(zs).alias("z_max"))
    row = lambda df, rule, two, details: df.select(F.lit(rule).alias("rule"), *two, "relation", details.alias("details"), "severity")
    told = lambda what: F.concat(F.lit(f"{what} "), face_text(F.col("face_key"), tolerance))
    rule1 = row(_of_met(met), 1, ("suid_1", "suid_2"), told("shared face"))
    rule2 = row(vertical_consecutive(tall, mode, "parcel", "ord", tolerance), 2, ("suid_1", "suid_2"), F.format_string("vertical gap of %.3f m", F.col("gap")))
    xs, ys = F.transform("vertices", lambda v: v["x"]), F.transform("vertices", lambda v: v["y"])
    flat = units.select(
        "suid", "ord", parcel_key(F.col("suid")).alias("parent_suid"), F.array_min(xs).alias("minx"), F.array_max(xs).alias("maxx"), F.array_min(ys).alias("miny"), F.array_max(ys).alias("maxy")
    )
    whole = F.col("suid").endswith("00000000")
    parcels = flat.where(whole).groupBy("parent_suid").agg(
        F.max_by(F.struct(F.col("minx").alias("px1"), F.col("miny").alias("py1"), F.col("maxx").alias("px2"), F.col("maxy").alias("py2")), "ord").alias("b")
    ).select("parent_suid", "b.*")
    parcels = materialize(parcels, "parcels")
    # units are dealt by their parcels only if there are any, and by themselves, so that what is shuffled goes before the rest is
    outside = boundary_violations(flat.where(~whole), parcels, tolerance)
    outside = materialize(outside, "outside") if parcels.limit(1).count() else outside.limit(0)
    rule3 = outside.select(F.lit(3).alias("rule"), F.col("suid").alias("suid_1"), F.col("parent_suid").alias("suid_2"), F.lit("overlap").alias("relation"), F.lit("outside its parcel").alias("details"), F.lit("error").alias("severity"))
    rule4 = row(open_faces(met).withColumn("suid_2", F.lit("")), 4, (F.col("suid").alias("suid_1"), "suid_2"), told("open face"))
    return rule1.unionByName(rule2).unionByName(rule3).unionByName(rule4)
