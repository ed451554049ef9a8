import json
import struct

import pytest
from pyspark.sql import functions as F

from lotstack import sources
from lotstack.sources import cad, osm, points
from lotstack.streaming import jobs

OSM = {
    "elements": [
        *({"type": "node", "id": k, "lon": 72.8 + x, "lat": 19.0 + y} for k, (x, y) in enumerate([(0, 0), (0.001, 0), (0.001, 0.001), (0, 0.001)])),
        {"type": "way", "id": 10, "nodes": [0, 1, 2, 3, 0], "tags": {"building": "house", "building:levels": "4", "roof:shape": "Gabled"}},
        {"type": "way", "id": 11, "nodes": [0, 1, 99], "tags": {"building": "yes"}},
        {"type": "way", "id": 12, "nodes": [3, 2, 1, 0], "tags": {}},
        {"type": "relation", "id": 20, "members": [{"type": "way", "ref": 10, "role": "outer"}, {"type": "way", "ref": 12, "role": "inner"}], "tags": {"building": "office"}},
    ]
}


@pytest.fixture(scope="module")
def elements(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("osm")
    (folder / "a.json").write_text(json.dumps(OSM))
    (folder / "broken.json").write_text("{")
    return sources.read(spark, f"{folder}/*.json")


def test_ways_and_relations(elements):
    rings = osm.way_rings(elements)
    assert sorted(r.way_id for r in rings.collect()) == [10, 12]
    relation = osm.multipolygons(elements, rings).first()
    assert relation.relation_id == 20 and len(relation.inners) == 1


def test_buildings_and_floors(elements):
    built = osm.buildings(osm.way_rings(elements))
    b = built.first()
    assert (b.building_id, b.building_type, b.levels, b.height, b.roof_shape) == (10, "residential", 4, 12.0, "gabled") and b.area > 10_000
    floors = osm.floor_rows(built).orderBy("level").collect()
    assert [r.unit_id for r in floors] == ["U01", "U02", "U03", "U04"] and floors[1].z_base == 3.0
    feature = json.loads(osm.feature_lines(built).first().value)
    assert feature["geometry"]["type"] == "Polygon" and feature["properties"]["levels"] == 4


def test_ways_that_meet_themselves_are_no_buildings(spark):
    at = lambda *corners: [{"x": 72.8 + 0.001 * x, "y": 19.0 + 0.001 * y} for x, y in corners]
    square, bow = at((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)), at((0, 0), (2, 2), (2, 0), (0, 1), (0, 0))
    twice = at((0, 0), (2, 0), (2, 2), (1, 2), (1, 0), (0, 0))
    rows = [(k, {"building": "yes"}, ring) for k, ring in enumerate((square, bow, twice, square[::-1]))]
    built = osm.buildings(spark.createDataFrame(rows, "way_id long, tags map<string,string>, ring array<struct<x:double,y:double>>"))
    assert sorted(r.building_id for r in built.collect()) == [0, 3]


def test_relations_become_buildings(elements):
    rings = osm.way_rings(elements)
    whole = osm.multipolygons(elements, rings)
    tagged = whole.withColumn("tags", F.create_map(F.lit("building"), F.lit("office")))
    by = {r.building_id: r for r in osm.buildings(rings, 0.0, tagged).collect()}
    assert by[20].building_type == "commercial" and len(by[20].inners) == 1
    without = osm.buildings(rings, 0.0, tagged.withColumn("inners", F.slice("inners", 1, 0))).where("building_id = 20").first()
    assert by[20].area < without.area
    told = json.loads(osm.feature_collection(osm.buildings(rings, 0.0, tagged)).first().value)
    assert told["type"] == "FeatureCollection" and [f["properties"]["building_id"] for f in told["features"]] == sorted(by)


def test_wards_are_read_together(spark, elements, tmp_path):
    (tmp_path / "a-ward.json").write_text(json.dumps(OSM))
    (tmp_path / "b-ward.json").write_text("{")
    (tmp_path / "c-ward.json").write_text(json.dumps(OSM))
    by = {r.ward: r["count"] for r in osm.union_of_wards(spark, str(tmp_path)).groupBy("ward").count().collect()}
    assert by == {"a-ward": len(OSM["elements"]), "c-ward": len(OSM["elements"])}


def test_query_text():
    assert '(way["building"](18.9,72.8,19.1,72.9);' in osm.overpass_query((72.8, 18.9, 72.9, 19.1))


DXF = "0 SECTION 2 ENTITIES 0 LWPOLYLINE 8 FL_2 70 1 10 0.0 20 0.0 10 4.0 20 0.0 10 4.0 20 3.0 10 0.0 20 3.0 0 TEXT 8 FL_2 1 SHOP-A12 10 1.0 20 1.0 0 POLYLINE 8 ROOF 70 1 0 VERTEX 8 ROOF 10 0.0 20 0.0 0 VERTEX 8 ROOF 10 2.0 20 0.0 0 VERTEX 8 ROOF 10 0.0 20 2.0 0 SEQEND 0 ENDSEC 0 EOF"


def test_dxf(spark, tmp_path):
    (tmp_path / "p.dxf").write_text("\n".join(DXF.split(" ")))
    got = {r.layer: r for r in cad.floor_polygons(sources.read(spark, f"{tmp_path}/p.dxf")).collect()}
    assert (got["FL_2"].level, got["FL_2"].area, got["FL_2"].unit_type, got["FL_2"].unit_id) == (2, 12.0, "commercial", "A12")
    assert (got["ROOF"].level, got["ROOF"].area, got["ROOF"].unit_type) == (99, 2.0, "residential")


IFC = """#1=IFCBUILDINGSTOREY('g',$,'Ground',$,$,$,$,$,.ELEMENT.,0.);
#2=IFCBUILDINGSTOREY('h',$,'First, floor',$,$,$,$,$,.ELEMENT.,3.5);
#3=IFCSPACE('s',$,'Room',$,$,$,$,$,$,$);
#4=IFCSPACE('t',$,'Bare',$,$,$,$,$,$,$);
#5=IFCQUANTITYAREA('NetFloorArea',$,$,24.5);
#6=IFCQUANTITYVOLUME('NetVolume',$,$,70.);
#7=IFCELEMENTQUANTITY('q',$,'Base',$,$,(#5,#6));
#8=IFCRELDEFINESBYPROPERTIES('r',$,$,$,(#3),#7);
#9=IFCRELCONTAINEDINSPATIALSTRUCTURE('c',$,$,$,(#3,#4),#2);
"""


def test_ifc(spark, tmp_path):
    (tmp_path / "b.ifc").write_text(IFC)
    entities = sources.read(spark, f"{tmp_path}/b.ifc")
    assert [(r.name, r.elevation, r.height) for r in cad.storeys(entities).orderBy("elevation").collect()] == [("Ground", 0.0, 3.5), ("First, floor", 3.5, 3.0)]
    assert {r.name: (r.area, r.volume) for r in cad.space_quantities(entities).collect()} == {"Room": (24.5, 70.0), "Bare": (0.0, 0.0)}
    assert {r.element: r.storey for r in cad.contained(entities).collect()} == {3: 2, 4: 2}


def test_las(spark, tmp_path):
    header = bytearray(227)
    header[:4] = b"LASF"
    header[24:26] = bytes([1, 2])
    struct.pack_into("<I", header, 96, 227)
    header[104] = 2
    struct.pack_into("<HI", header, 105, 26, 2)
    struct.pack_into("<3d", header, 131, 0.01, 0.01, 0.01)
    struct.pack_into("<3d", header, 155, 100.0, 200.0, 0.0)
    record = lambda x, y, z, c: struct.pack("<3iHBBbBH3H", x, y, z, 0, 1, c, 0, 0, 0, 65535, 0, 0)
    (tmp_path / "p.las").write_bytes(bytes(header) + record(100, 200, 300, 2) + record(0, 0, 50, 6))
    got = points.byte_colours(sources.read(spark, f"{tmp_path}/p.las")).orderBy("pt_id").collect()
    assert [(r.x, r.y, r.z, r.classification, r.return_number, r.r) for r in got] == [(101.0, 202.0, 3.0, 2, 1, 255.0), (100.0, 200.0, 0.5, 6, 1, 255.0)]


def test_unknown_suffix(spark):
    for name in ("a.dwg", "b.xyz"):
        with pytest.raises(ValueError):
            sources.read(spark, name)


def test_layers(spark):
    rows = spark.createDataFrame([("BASEMENT",), ("GF",), ("ROOF",), ("LEVEL-3",), ("WALLS",)], "n string")
    got = [r[0] for r in rows.select(cad.layer_level(F.col("n"))).collect()]
    assert [None if g is None else (g.level, g.z_base) for g in got] == [(-1, -3.0), (0, 0.0), (99, 0.0), (3, 9.0), None]


def test_jobs_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"job_id": k, "path": f"f{k}"}))
    stream = jobs.submitted_files(spark, f"{tmp_path}/in", "job_id long, path string")
    jobs.run_jobs(stream, lambda rows: rows.withColumn("done", F.lit(True)), f"{tmp_path}/log", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    log = spark.read.parquet(f"{tmp_path}/log")
    assert {r.job_id: r.status for r in jobs.latest_states(log).collect()} == {0: "completed", 1: "completed", 2: "completed"}
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3

    def fails(rows):
        raise RuntimeError("no space")

    jobs.run_jobs(stream, fails, f"{tmp_path}/log2", f"{tmp_path}/out2", f"{tmp_path}/cp2").awaitTermination()
    assert {(r.status, r.error) for r in jobs.latest_states(spark.read.parquet(f"{tmp_path}/log2")).collect()} == {("failed", "no space")}
