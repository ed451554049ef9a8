"""Map extracts: elements from JSON files, ways joined with their nodes, multipolygons, buildings and their floors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotstack.functions import geometry as G
from lotstack.operators import delineate

SCHEMA = (
    "elements array<struct<type: string, id: bigint, lon: double, lat: double, nodes: array<bigint>, "
    "members: array<struct<type: string, ref: bigint, role: string>>, tags: map<string, string>>>"
)
#: Building tags by class.
BUILDING_CLASSES = {
    "residential": ("residential", "apartments", "house", "detached", "semidetached_house", "terrace"),
    "commercial": ("commercial", "office", "retail", "shop", "supermarket", "mall"),
    "industrial": ("industrial", "warehouse", "factory"),
    "mixed": ("mixed", "mixed_use"),
    "hospitality": ("hotel", "hostel"),
    "institutional": ("hospital", "school", "university", "civic", "government", "religious"),
    "parking": ("parking", "garage"),
    "utility": ("roof", "shed"),
    "construction": ("construction",),
}
#: Roof shapes by tag.
ROOFS = {
    "flat": "flat",
    "gabled": "gabled",
    "hipped": "hipped",
    "pyramidal": "pyramid",
    "dome": "dome",
    "mansard": "mansard",
    "gambrel": "gambrel",
    "skillion": "skillion",
    "sawtooth": "sawtooth",
}
#: Wards with their boxes (west, south, east, north). Some boxes are equal and some overlap.
WARDS = {
    "A": (72.82, 18.93, 72.87, 18.96),
    "B": (72.81, 18.96, 72.86, 18.99),
    "C": (72.80, 18.99, 72.85, 19.02),
    "D": (72.82, 18.99, 72.87, 19.02),
    "E": (72.85, 18.96, 72.90, 19.00),
    "F_N": (72.85, 19.00, 72.90, 19.05),
    "F_S": (72.85, 18.96, 72.90, 19.00),
    "G_N": (72.88, 19.00, 72.93, 19.05),
    "G_S": (72.88, 19.00, 72.93, 19.05),
    "H_E": (72.90, 19.00, 72.95, 19.05),
    "H_W": (72.85, 19.00, 72.90, 19.05),
    "K_E": (72.90, 19.05, 72.95, 19.10),
    "K_W": (72.85, 19.05, 72.90, 19.10),
    "L": (72.80, 19.10, 72.85, 19.15),
    "M_E": (72.90, 19.10, 72.95, 19.15),
    "M_W": (72.85, 19.10, 72.90, 19.15),
    "N": (72.80, 19.15, 72.85, 19.20),
    "P_N": (72.90, 19.15, 72.95, 19.20),
    "P_S": (72.85, 19.15, 72.90, 19.20),
    "R_C": (72.80, 19.20, 72.85, 19.25),
    "R_N": (72.85, 19.20, 72.90, 19.25),
    "R_S": (72.80, 19.20, 72.85, 19.25),
    "S": (72.90, 19.15, 72.95, 19.20),
    "T": (72.85, 19.20, 72.90, 19.25),
}


def ward_table(spark: SparkSession) -> DataFrame:
    """(ward, minx, miny, maxx, maxy)"""
    return spark.createDataFrame([(w, *box) for w, box in WARDS.items()], "ward string, minx double, miny double, maxx double, maxy double")


def overpass_query(bbox: tuple[float, float, float, float], timeout: int = 180) -> str:
    """A query text for the buildings in (west, south, east, north), with the nodes they use."""
    west, south, east, north = bbox
    box = f"({south},{west},{north},{east})"
    return f'[out:json][timeout:{timeout}];(way["building"]{box};relation["building"]{box};);out body;>;out skel qt;'


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """(type, id, lon, lat, nodes, members, tags) of all elements of JSON extracts; broken files have none."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return raw.select(F.explode("elements").alias("e")).select("e.*")


def union_of_wards(spark: SparkSession, folder: str) -> DataFrame:
    """(ward, type, id, …): the elements of all extracts of a folder, each with its file's name; broken files have none."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").option("ignoreCorruptFiles", True).json(folder)
    ward = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1)
    return raw.select(ward.alias("ward"), F.explode("elements").alias("e")).select("ward", "e.*")


def feature_collection(built: DataFrame) -> DataFrame:
    """One GeoJSON FeatureCollection text of an extract's buildings, in the order of their ids."""
    lines = feature_lines(built, key=True)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("building_id", "value"))), lambda r: r["value"])
    return lines.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(ordered, ","), F.lit("]}")).alias("value"))


def way_rings(elements: DataFrame, least: int = 4) -> DataFrame:
    """(way_id, tags, ring): a way's nodes in order, closed; missing nodes are left out, and short rings too."""
    nodes = elements.where("type = 'node'").groupBy(F.col("id").alias("node")).agg(F.min(F.struct("lon", "lat")).alias("at")).select("node", "at.lon", "at.lat")
    ways = elements.where("type = 'way'").select(F.col("id").alias("way_id"), "tags", "nodes")
    placed = ways.select("way_id", F.posexplode("nodes").alias("pos", "node")).join(nodes, "node")
    rings = placed.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("r"))
    ring = G.closed(F.transform("r", lambda p: G.point(p["lon"], p["lat"])))
    return rings.join(ways.select("way_id", "tags"), "way_id").select("way_id", "tags", ring.alias("ring")).where(F.size("ring") >= least)


def multipolygons(elements: DataFrame, rings: DataFrame) -> DataFrame:
    """(relation_id, tags, outer, inners): the first outer ring of each relation and all its inner ones."""
    members = elements.where("type = 'relation'").select(F.col("id").alias("relation_id"), "tags", F.posexplode("members").alias("pos", "m"))
    met = members.where("m.type = 'way'").select("relation_id", "pos", F.col("m.role").alias("role"), F.col("m.ref").alias("way_id")).join(rings.select("way_id", "ring"), "way_id")
    both = met.groupBy("relation_id").agg(
        F.min_by(F.when(F.col("role") == "outer", F.col("ring")), F.when(F.col("role") == "outer", F.col("pos"))).alias("outer"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "inner", F.struct("pos", "ring")))), lambda r: r["ring"]).alias("inners"),
    )
    tags = elements.where("type = 'relation'").select(F.col("id").alias("relation_id"), "tags")
    return both.where(F.col("outer").isNotNull()).join(tags, "relation_id")


def tag(*names: str) -> Column:
    """The first of these tags that isn't empty."""
    return F.coalesce(*(F.nullif(F.element_at("tags", n), F.lit("")) for n in names))


def building_class(value: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, tags in BUILDING_CLASSES.items():
        out = out.when(value.isin(*tags), name)
    return out.otherwise("unknown")


def roof_shape(value: Column) -> Column:
    """The shape of a roof tag, whatever its case; null if unknown."""
    known = F.create_map(*(F.lit(x) for kv in ROOFS.items() for x in kv))
    return F.element_at(known, F.lower(value))


def buildings(rings: DataFrame, least_area: float = 5.0, relations: DataFrame | None = None) -> DataFrame:
    """Buildings of closed ways, and of multipolygon relations by their outer rings if given: class, levels and height
    (each worked out from the other), area in square metres, without the inner rings'. Rings that meet themselves are refused."""
    rings = rings.select("way_id", "tags", "ring", F.array().cast("array<array<struct<x:double,y:double>>>").alias("inners"))
    if relations is not None:
        rings = rings.unionByName(relations.select(F.col("relation_id").alias("way_id"), "tags", F.col("outer").alias("ring"), "inners"))
    holes = F.aggregate("inners", F.lit(0.0), lambda sum, r: sum + G.shoelace_area(r))
    number = lambda *names: F.regexp_extract(tag(*names), r"^\s*([-+]?\d+(?:\.\d+)?)", 1).try_cast("double")
    rows = rings.where(F.element_at("tags", "building").isNotNull()).select(
        F.col("way_id").alias("building_id"),
        F.coalesce(tag("name"), F.concat(F.lit("Building "), F.col("way_id").cast("string"))).alias("name"),
        building_class(tag("building")).alias("building_type"),
        number("building:levels", "levels").cast("int").alias("levels"),
        number("height", "building:height").alias("height"),
        number("min_height").alias("min_height"),
        roof_shape(tag("roof:shape")).alias("roof_shape"),
        G.square_metres(G.shoelace_area(F.col("ring")) - holes, G.vertex_mean(F.col("ring"))["y"]).alias("area"),
        "ring",
        "inners",
    )
    return delineate.height_and_levels(rows.where((F.col("area") >= least_area) & delineate.simple_rings("ring")))


def floor_rows(built: DataFrame, ground: float = 0.0) -> DataFrame:
    """One row for each floor, with its layout and number of units."""
    return delineate.floors(built, ground).select(
        "building_id", F.col("name").alias("building_name"), "level", "z_base", F.col("floor_height").alias("height"), G.polygon_wkt(F.col("ring")).alias("polygon_wkt"),
        F.format_string("U%02d", F.col("level") + 1).alias("unit_id"), F.col("building_type").alias("unit_type"),
        delineate.layout(F.col("building_type"), F.col("area")).alias("unit_layout"),
        delineate.units_per_mapped_floor(F.col("building_type"), F.col("area")).alias("units_per_floor"), "roof_shape",
    )


def feature_lines(built: DataFrame, key: bool = False) -> DataFrame:
    """GeoJSON features as text lines, for df.write.text."""
    coordinates = F.array(F.transform("ring", lambda p: F.array(p["x"], p["y"])))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"),
        F.struct("building_id", "name", "building_type", "levels", "height").alias("properties"),
    )
    return built.select(*(["building_id"] if key else []), F.to_json(feature).alias("value"))


def wards_of(rows: DataFrame, wards: DataFrame, size: float = 0.05) -> DataFrame:
    """`rows` (x, y) with each ward whose box holds them; boxes may overlap. wards: (ward, minx, miny, maxx, maxy).

    Boxes are dealt to the grid cells that they cover, so the join is on cells.
    """
    span = lambda a, b: F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))
    placed = wards.withColumn("cx", F.explode(span("minx", "maxx"))).withColumn("cy", F.explode(span("miny", "maxy")))
    own = rows.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size))
    inside = F.col("x").between(F.col("minx"), F.col("maxx")) & F.col("y").between(F.col("miny"), F.col("maxy"))
    return own.join(placed, ["cx", "cy"]).where(inside).drop("cx", "cy", "minx", "miny", "maxx", "maxy")
