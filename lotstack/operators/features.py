"""Feature queries: filters, pages, projections, catalogues and statistics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotstack.functions import geometry as G

#: The collections on offer.
COLLECTIONS = (
    ("spatial_units", "Parcels, buildings, floors and units"),
    ("parties", "Persons, organisations and groups"),
    ("rights", "Rights, restrictions and responsibilities"),
    ("rrr", "Links between parties, rights and spatial units"),
    ("survey_sources", "Survey sources"),
)
SEVERITIES = ("error", "warning", "info")


def filtered(units: DataFrame, type: str | None = None, floor_level: int | None = None, suid: int | None = None) -> DataFrame:
    """Equality filters; an empty or missing value is no filter, floor 0 is one."""
    if suid is not None:
        units = units.where(F.col("suid") == suid)
    if type:
        units = units.where(F.col("type") == type)
    if floor_level is not None:
        units = units.where(F.col("floor_level") == floor_level)
    return units


def parse_bbox(text: str | None) -> tuple[float, float, float, float] | None:
    """minx, miny, maxx, maxy; None if malformed."""
    parts = (text or "").split(",")
    if len(parts) != 4 or not all(re.fullmatch(r"\s*[-+]?\d+(\.\d*)?([eE][-+]?\d+)?\s*", p) for p in parts):
        return None
    return tuple(map(float, parts))


def in_bbox(units: DataFrame, bbox: str | None, ring: str | None = None) -> DataFrame:
    """Units whose box meets the envelope, touching included; a malformed envelope is no filter. Pushed to the scan.

    With `ring`, a column of rings, only those whose ring itself meets the envelope, inside or border.
    """
    box = parse_bbox(bbox)
    if box is None:
        return units
    x1, y1, x2, y2 = box
    near = units.where((F.col("minx") <= x2) & (F.col("maxx") >= x1) & (F.col("miny") <= y2) & (F.col("maxy") >= y1))
    return near.where(G.ring_meets_box(F.col(ring), *map(F.lit, box))) if ring else near


def page(units: DataFrame, limit: int = 100, offset: int = 0, key: str = "suid") -> DataFrame:
    """A page in the key's order, so that pages don't overlap."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit is 1 to 1000, offset 0 or more")
    return units.orderBy(key).offset(offset).limit(limit)


def page_links(units: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """(matched, self_offset, next_offset): the next page's offset, null on the last page."""
    return units.agg(F.count("*").alias("matched")).select(
        "matched",
        F.lit(offset).cast("long").alias("self_offset"),
        F.when(F.lit(offset + limit) < F.col("matched"), F.lit(offset + limit).cast("long")).alias("next_offset"),
    )


def lookup(table: DataFrame, key: str, value) -> DataFrame:
    """The row with a key, or none; more than one is an error of the data, raised when the row is read."""
    two = table.where(F.col(key) == value).limit(2)
    counted = two.withColumn("_rows", F.count("*").over(Window.partitionBy(key)))
    refused = F.raise_error(F.lit(f"more than one row with this {key}")).cast("boolean")
    return counted.where(F.when(F.col("_rows") > 1, refused).otherwise(F.lit(True))).drop("_rows")


def children(units: DataFrame, parcels: DataFrame, parcel, most: int = 1000) -> DataFrame:
    """The first units of a parcel, by suid; an unknown parcel is no filter."""
    known = parcels.where(F.col("suid") == parcel).limit(1).count()
    return (units.where(F.col("parent_suid") == parcel) if known else units).orderBy("suid").limit(most)


def resolve_parents(units: DataFrame, known: DataFrame, code: str = "parent_code") -> DataFrame:
    """`units` with `parent_suid`, the smallest suid of the code among `known` (code, suid); null where there is none."""
    by = known.groupBy(F.col("code").alias(code)).agg(F.min("suid").alias("parent_suid"))
    return units.join(by, code, "left")


def hierarchy_of(paths: DataFrame, known: DataFrame, key: str = "suid") -> DataFrame:
    """(key, pos, found): each code of `paths` (key, path) in order that `known` (code, found) holds; misses are skipped."""
    by = known.groupBy("code").agg(F.min("found").alias("found"))
    return paths.select(key, F.posexplode("path").alias("pos", "code")).join(by, "code").select(key, "pos", "found")


def properties_json(table: DataFrame, key: str, properties: tuple[str, ...]) -> DataFrame:
    """(key, properties): properties as JSON, nulls kept, dates as ISO days."""
    kinds = dict(table.dtypes)
    own = [F.date_format(p, "yyyy-MM-dd").alias(p) if kinds[p] in ("date", "timestamp") else F.col(p) for p in properties]
    return table.select(key, F.to_json(F.struct(*own), {"ignoreNullFields": "false"}).alias("properties"))


def merged_json(first: Column, second: Column) -> Column:
    """Two JSON objects as one, as texts: keys of the second win, whatever their values; what is no object counts as empty, and two
    nulls stay null."""
    fields = "map<string,variant>"
    object_ = lambda c: F.coalesce(F.from_json(c, fields), F.create_map().cast(fields))
    kept = F.map_filter(object_(first), lambda k, _: ~F.array_contains(F.map_keys(object_(second)), k))
    return F.when(first.isNotNull() | second.isNotNull(), F.to_json(F.map_concat(kept, object_(second))))


def has_shape(rows: Column, width: int) -> Column:
    """Whether an array of arrays is a matrix with so many columns, without nulls: no rows are no matrix."""
    each = F.forall(rows, lambda r: F.coalesce((F.size(r) == width) & F.forall(r, lambda x: x.isNotNull()), F.lit(False)))
    return F.coalesce((F.size(rows) > 0) & each, F.lit(False))


def is_box(values: Column) -> Column:
    """Whether an array holds four numbers: minx, miny, maxx, maxy."""
    finite = F.forall(values, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(values) == 4) & finite, F.lit(False))


def feature_json(units: DataFrame, properties: tuple[str, ...], geometry: Column | None = None) -> DataFrame:
    """(suid, feature): GeoJSON features with the properties named."""
    box = F.struct(
        F.lit("Polygon").alias("type"),
        F.array(F.array(*(F.array(F.col(x), F.col(y)) for x, y in (("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"), ("minx", "miny"))))).alias("coordinates"),
    )
    feature = F.struct(
        F.lit("Feature").alias("type"), F.col("suid").alias("id"), (box if geometry is None else geometry).alias("geometry"), F.struct(*properties).alias("properties")
    )
    return units.select("suid", F.to_json(feature).alias("feature"))


def feature_collection(features: DataFrame) -> DataFrame:
    """One FeatureCollection text of a page of features."""
    return features.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("suid", "feature"))), lambda f: f["feature"]), ","), F.lit("]}")).alias("collection"))


def collections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(COLLECTIONS), "id string, title string")


def statistics(units: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(dimension, value, n): all units, units by type and by floor, in one pass; and the number of sources, if given."""
    if sources is not None:
        of_sources = sources.agg(F.count("*").alias("n")).select(F.lit("sources").alias("dimension"), F.lit(None).cast("string").alias("value"), "n")
        return statistics(units).unionAll(of_sources)
    return (
        units.groupingSets([[], [F.col("type")], [F.col("floor_level")]], "type", "floor_level")
        .agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
        .select(
            F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "type").otherwise("floor_level").alias("dimension"),
            F.coalesce("type", F.col("floor_level").cast("string")).alias("value"),
            "n",
        )
    )


def severity_summary(results: DataFrame) -> DataFrame:
    """(severity, n) for each severity, 0 included."""
    all_of = results.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    counted = results.groupBy("severity").agg(F.count("*").alias("n"))
    return F.broadcast(all_of).join(counted, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def preview(buildings: DataFrame, levels: str = "levels", type: str = "building_type") -> DataFrame:
    """(dimension, value, n): all buildings, buildings by type and by levels, null levels as 0."""
    by = lambda name, col: buildings.groupBy(col.cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("dimension"), "value", "n")
    total = buildings.agg(F.count("*").alias("n")).select(F.lit("total").alias("dimension"), F.lit(None).cast("string").alias("value"), "n")
    return by("type", F.col(type)).unionAll(by("levels", F.coalesce(F.col(levels), F.lit(0)))).unionAll(total)


def preview_sample(buildings: DataFrame, key: str = "building_id", n: int = 10) -> DataFrame:
    """The first buildings, by key."""
    return buildings.orderBy(key).limit(n)


def safe_int(text: Column) -> Column:
    """The whole part of a number's text; null if it isn't one."""
    number = F.trim(text).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < 9e18), F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))).cast("long")


def safe_float(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def bounds(units: DataFrame) -> DataFrame:
    """One row with the box of all units."""
    return units.agg(*(f(c).alias(c) for f, c in ((F.min, "minx"), (F.min, "miny"), (F.max, "maxx"), (F.max, "maxy"), (F.min, "z_min"), (F.max, "z_max"))))


def tileset(units: DataFrame, error: float = 500.0) -> DataFrame:
    """One 3D Tiles tileset text with the units' box as its root."""
    half = lambda a, b: (F.col(b) - F.col(a)) / 2
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2
    x, y, z = ("minx", "maxx"), ("miny", "maxy"), ("z_min", "z_max")
    zero = F.lit(0.0)
    box = F.array(mid(*x), mid(*y), mid(*z), half(*x), zero, zero, zero, half(*y), zero, zero, zero, half(*z))
    root = F.struct(F.struct(box.alias("box")).alias("boundingVolume"), F.lit(error / 10).alias("geometricError"), F.lit("ADD").alias("refine"))
    text = F.to_json(F.struct(F.struct(F.lit("1.0").alias("version")).alias("asset"), F.lit(error).alias("geometricError"), root.alias("root")))
    return bounds(units).select(text.alias("tileset"))


def selected_json(units: DataFrame, code: str = "code") -> DataFrame:
    """(suid, value): the six properties of a unit that a selection exports, as JSON, nulls kept."""
    told = F.struct(F.col(code).cast("string").alias("uln"), "label", "type", "floor_level", "z_min", "z_max")
    return units.select("suid", F.to_json(told, {"ignoreNullFields": "false"}).alias("value"))
