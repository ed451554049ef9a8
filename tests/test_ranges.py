import struct
import zlib

import numpy as np
import pytest

from lotstack import sources
from lotstack.sources import cad, points, rasters


def las(records, offset=227):
    header = bytearray(offset)
    header[:4] = b"LASF"
    header[24:26] = bytes([1, 2])
    struct.pack_into("<I", header, 96, offset)
    header[104] = 2
    struct.pack_into("<HI", header, 105, 26, len(records))
    struct.pack_into("<3d", header, 131, 0.01, 0.01, 0.01)
    struct.pack_into("<3d", header, 155, 100.0, 200.0, 0.0)
    return bytes(header) + b"".join(struct.pack("<3iHBBbBH3H", x, y, z, 0, 1, c, 0, 0, 0, 65535, 0, 0) for x, y, z, c in records)


def test_a_las_file_is_dealt_to_many_tasks_and_ids_are_unique_over_files(spark, tmp_path):
    for name, n in (("b.las", 250), ("a.las", 100), ("_no.las", 5)):
        (tmp_path / name).write_bytes(las([(k, 2 * k, 50, 2 + k % 5) for k in range(n)]))
    got = points.read_las(spark, f"{tmp_path}/?.las", records=70)
    assert got.rdd.getNumPartitions() == 2 + 4
    rows = got.collect()
    assert len(rows) == 350 == len({r.pt_id for r in rows})
    of_b = sorted((r.pt_id, r.x, r.classification) for r in rows if r.file.endswith("b.las"))
    assert of_b == [((1 << 40) + k, 100 + k / 100, 2 + k % 5) for k in range(250)]
    assert points.read_las(spark, str(tmp_path)).count() == sources.read(spark, f"{tmp_path}/?.las").count() == 350
    assert points.read_las(spark, f"{tmp_path}/a.las", ["z", "pt_id"]).columns == ["pt_id", "z"]


def test_files_that_are_no_las_are_refused(spark, tmp_path):
    (tmp_path / "x.las").write_bytes(b"nothing")
    with pytest.raises(Exception, match="no LAS file"):
        points.read_las(spark, f"{tmp_path}/x.las").count()


def tiff(values, rows=3, order="<", deflate=False, predictor=1, tile=None, planar=1):
    """A TIFF of (height, width, bands) in strips of some rows, or in tiles."""
    height, width, bands = values.shape
    kind = values.dtype.newbyteorder(order)
    planes = [values] if planar == 1 else [values[:, :, b : b + 1] for b in range(bands)]
    blocks = []
    for plane in planes:
        h, w = tile or (rows, width)
        for top in range(0, height, h):
            for left in range(0, width, w):
                block = plane[top : top + h, left : left + w]
                if tile:
                    block = np.pad(block, [(0, h - block.shape[0]), (0, w - block.shape[1]), (0, 0)])
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=block[:, :1] * 0)
                raw = block.astype(kind).tobytes()
                blocks.append(zlib.compress(raw) if deflate else raw)
    offsets = [8 + sum(map(len, blocks[:k])) for k in range(len(blocks))]
    places = [(324 if tile else 273, offsets), (325 if tile else 279, [len(b) for b in blocks])]
    shape = [(322, [tile[1]]), (323, [tile[0]])] if tile else [(278, [rows])]
    code = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    tags = sorted([(256, [width]), (257, [height]), (258, [kind.itemsize * 8] * bands), (259, [8 if deflate else 1]), (277, [bands]), (284, [planar]), (317, [predictor]), (339, [code] * bands), *places, *shape])
    body = b"".join(blocks)
    at = 8 + len(body)
    extra_at, extra, entries = at + 2 + 12 * len(tags) + 4, b"", b""
    for tag, numbers in tags:
        data = struct.pack(f"{order}{len(numbers)}I", *numbers)
        if len(data) > 4:
            entries += struct.pack(f"{order}HHII", tag, 4, len(numbers), extra_at + len(extra))
            extra += data
        else:
            entries += struct.pack(f"{order}HHI", tag, 4, len(numbers)) + data
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at) + body + struct.pack(order + "H", len(tags)) + entries + b"\0\0\0\0" + extra


@pytest.mark.parametrize("kind,how", [
    ("u1", {}), ("u2", {"order": ">", "deflate": True}), ("f4", {"deflate": True, "tile": (4, 16)}), ("i2", {"predictor": 2, "deflate": True}),
    ("f8", {"planar": 2, "rows": 5}), ("u1", {"tile": (16, 4), "planar": 2, "order": ">"}), ("u1", {"predictor": 2, "order": ">"}),
])
def test_rasters_round_trip(spark, tmp_path, kind, how):
    values = np.random.default_rng(1).integers(0, 100, (11, 7, 3)).astype(kind)
    (tmp_path / "a.tif").write_bytes(tiff(values, **how))
    got = {(r.c, r.y, r.x): r.v for r in sources.read(spark, f"{tmp_path}/a.tif").collect()}
    assert got == {(c, y, x): float(values[y, x, c]) for y in range(11) for x in range(7) for c in range(3)}


def test_rasters_of_other_layouts_are_refused(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(b"II*\0\0")
    with pytest.raises(Exception, match="no TIFF"):
        rasters.read_geotiff(spark, f"{tmp_path}/a.tif").count()


IFC = """ISO-10303-21; HEADER; FILE_NAME('a;b','x'); ENDSEC; DATA;
#1=IFCBUILDINGSTOREY('g',$,'Gro''und; floor',$,$,#20,$,$,.ELEMENT.,$);
#2=IFCBUILDINGSTOREY('h',$,'\\X2\\00C4\\X0\\rst, up',$,$,#21,$,$,.ELEMENT.,3.5); /* a
comment; */ #10=IFCCARTESIANPOINT((1.,2.,0.5));
#11=IFCCARTESIANPOINT(
  (0.,0.,3.));
#12=IFCAXIS2PLACEMENT3D(#10,$,$);#13=IFCAXIS2PLACEMENT3D(#11,$,$);
#20=IFCLOCALPLACEMENT($,#12); #21=IFCLOCALPLACEMENT(#20,#13); #22=IFCLOCALPLACEMENT(#21,#13);
#30=IFCWALL('w1',#9,'Wall (outer), ''A''',$,$,#22,#99,'t',.SOLID.);
#31=IFCDOOR('d1',#9,'Door',$,$,#21,$,$,2.1,0.9);
#32=IFCSLAB('s1',$,$,$,$,$,$,$,$); #33=IFCWALLSTANDARDCASE('x',$,$,$,$,$,$,$);
#34=IFCWINDOW('n1',$,'Window',$,$,#22,$,$,bad,1.0);
#40=IFCRELCONTAINEDINSPATIALSTRUCTURE('c',$,$,$,(#30,
#31),#2); #41=IFCPROPERTYSET('p',$,'Set',$,((1,(2,3)),'x(,)y',$));
#42=(IFCA() IFCB()); #43=IFCX(; #9999999999999999999999=IFCY();
ENDSEC; END-ISO-10303-21;
"""


def test_ifc_statements_elements_and_placements(spark, tmp_path):
    (tmp_path / "b.ifc").write_text(IFC)
    entities = sources.read(spark, f"{tmp_path}/b.ifc")
    parts = {r.id: r.parts for r in entities.collect()}
    assert parts[41] == ["p", None, "Set", None, "((1,(2,3)),'x(,)y',$)"] and parts[30][2] == "Wall (outer), 'A'" and 42 not in parts
    assert [(r.name, r.elevation, r.height) for r in cad.storeys(entities).orderBy("elevation").collect()] == [("Gro'und; floor", 0.5, 3.0), ("Ärst, up", 3.5, 3.0)]
    got = {r.element: (r.type, r.name, r.storey, r.z, r.overall_height) for r in cad.elements(entities).collect()}
    assert got == {30: ("IFCWALL", "Wall (outer), 'A'", 2, 6.5, None), 31: ("IFCDOOR", "Door", 2, 3.5, 2.1), 32: ("IFCSLAB", None, None, None, None), 34: ("IFCWINDOW", "Window", None, 6.5, None)}


HATCH = (
    "0 SECTION 2 ENTITIES 0 HATCH 8 FL_1 10 0.0 20 0.0 70 1 91 3 92 3 72 0 73 1 93 4 10 0.0 20 0.0 10 4.0 20 0.0 10 4.0 20 3.0 10 0.0 20 3.0 97 0 "
    "92 1 93 3 72 1 10 9.0 20 0.0 11 12.0 21 0.0 72 1 10 12.0 20 0.0 11 9.0 21 2.0 72 1 10 9.0 20 2.0 11 9.0 21 0.0 97 0 "
    "92 16 93 1 72 1 10 1.0 20 1.0 11 2.0 21 1.0 97 0 75 1 98 1 10 5.0 20 5.0 0 TEXT 8 FL_1 1 A7 10 1.0 20 1.0 "
    "0 LWPOLYLINE 8 BAD 70 x 10 y 20 1.0 10 1.0 20 z 0 LWPOLYLINE 8 GF 70 1 10 0 20 0 10 bad 20 9 10 2 20 0 10 0 20 2 0 ENDSEC 0 EOF"
)


def test_hatches_and_values_that_are_no_numbers(spark, tmp_path):
    (tmp_path / "h.dxf").write_text("\n".join(HATCH.split(" ")))
    got = sorted((r.layer, r.level, r.area, r.unit_id) for r in cad.floor_polygons(sources.read(spark, f"{tmp_path}/h.dxf")).collect())
    assert got == [("FL_1", 1, 3.0, "U"), ("FL_1", 1, 12.0, "A7"), ("GF", 0, 2.0, "U")]
