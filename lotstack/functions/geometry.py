"""Geometry as column expressions: rings are arrays of structs (x, y) or (x, y, z)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotstack.functions.binding import let

#: Metres in a degree of latitude.
DEGREE = 111_000.0


def point(x: Column, y: Column, z: Column | None = None) -> Column:
    fields = [x.cast("double").alias("x"), y.cast("double").alias("y")]
    return F.struct(*fields, *([] if z is None else [z.cast("double").alias("z")]))


def box_ring(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """The closed ring of a box, anticlockwise from its lower left corner."""
    return F.array(point(minx, miny), point(maxx, miny), point(maxx, maxy), point(minx, maxy), point(minx, miny))


def edges(ring: Column) -> Column:
    """(a, b) of each edge; the ring is closed if it isn't."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, following, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def closed(ring: Column) -> Column:
    return F.when((F.size(ring) > 0) & (F.element_at(ring, 1) != F.element_at(ring, -1)), F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def shoelace_area(ring: Column) -> Column:
    cross = F.transform(edges(ring), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.abs(_sum(cross)) / 2


def perimeter(ring: Column) -> Column:
    return _sum(F.transform(edges(ring), lambda e: F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])))


def vertex_mean(ring: Column) -> Column:
    """The mean of all vertices, a repeated closing one included."""
    n = F.size(ring)
    return point(_sum(F.transform(ring, lambda p: p["x"])) / n, _sum(F.transform(ring, lambda p: p["y"])) / n)


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting over half-open edges."""
    crossed = F.filter(
        edges(ring),
        lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y))
        & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]),
    )
    return F.size(crossed) % 2 == 1


def _turn(a: Column, b: Column, x: Column, y: Column) -> Column:
    """Above 0 if (x, y) lies to the left of the line from a to b, 0 on it."""
    return (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])


def on_ring(ring: Column, x: Column, y: Column) -> Column:
    """Whether a place lies on an edge."""
    between = lambda e, k, v: v.between(F.least(e["a"][k], e["b"][k]), F.greatest(e["a"][k], e["b"][k]))
    return F.exists(edges(ring), lambda e: between(e, "x", x) & between(e, "y", y) & (_turn(e["a"], e["b"], x, y) == 0))


def ring_meets_box(ring: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Whether the inside or the border of a ring meets a box; touching counts."""

    def meets(e: Column) -> Column:
        a, b = e["a"], e["b"]
        near = (F.least(a["x"], b["x"]) <= maxx) & (F.greatest(a["x"], b["x"]) >= minx) & (F.least(a["y"], b["y"]) <= maxy) & (F.greatest(a["y"], b["y"]) >= miny)
        sides = [_turn(a, b, x, y) for x in (minx, maxx) for y in (miny, maxy)]
        return near & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)

    return F.exists(edges(ring), meets) | contains(ring, minx, miny)


def _crossed(e: Column, f: Column) -> Column:
    """Whether two edges cross in one place within both."""
    turns = lambda a, b: _turn(a["a"], a["b"], b["a"]["x"], b["a"]["y"]) * _turn(a["a"], a["b"], b["b"]["x"], b["b"]["y"])
    return (turns(e, f) < 0) & (turns(f, e) < 0)


def _middles(ring: Column) -> Column:
    return F.transform(edges(ring), lambda e: point((e["a"]["x"] + e["b"]["x"]) / 2, (e["a"]["y"] + e["b"]["y"]) / 2))


def ring_within(inner: Column, outer: Column, holes: Column | None = None) -> Column:
    """Whether a ring lies inside another, and outside its holes; borders may touch.

    No edges cross, all corners and the middles of edges of the inner ring lie in the outer one or on it, and no corner of the
    outer one lies strictly inside the inner one.
    """
    strictly = lambda ring, p: contains(ring, p["x"], p["y"]) & ~on_ring(ring, p["x"], p["y"])
    inside = lambda ring, p: contains(ring, p["x"], p["y"]) | on_ring(ring, p["x"], p["y"])
    apart = lambda ring: ~F.exists(edges(inner), lambda e: F.exists(edges(ring), lambda f: _crossed(e, f))) & ~F.exists(ring, lambda p: strictly(inner, p))
    out = F.forall(F.concat(inner, _middles(inner)), lambda p: inside(outer, p)) & apart(outer)
    if holes is not None:
        free = lambda h: ~F.exists(F.concat(inner, _middles(inner)), lambda p: strictly(h, p)) & apart(h)
        # a hole that is the inner ring itself has no corner strictly inside it, but its middle
        filled = lambda h: strictly(inner, vertex_mean(h))
        out &= F.forall(F.coalesce(holes, F.array().cast("array<array<struct<x:double,y:double>>>")), lambda h: free(h) & ~filled(h))
    return out


def square_metres(area: Column, latitude: Column) -> Column:
    """Square degrees as square metres at a latitude."""
    return area * DEGREE * DEGREE * F.cos(F.radians(latitude))


def _number(v: Column) -> Column:
    """A coordinate as text, without an exponent and with at least one decimal place."""
    return F.regexp_replace(F.format_string("%.9f", v), r"(\.\d+?)0+$", "$1")


def polygon_wkt(ring: Column) -> Column:
    inside = F.array_join(F.transform(closed(ring), lambda p: F.concat_ws(" ", _number(p["x"]), _number(p["y"]))), ", ")
    return F.concat(F.lit("POLYGON (("), inside, F.lit("))"))


def triangle_wkt(face: Column) -> Column:
    told = F.transform(face, lambda p: F.concat_ws(" ", _number(p["x"]), _number(p["y"]), _number(p["z"])))
    # the first corner's text closes the ring
    inside = let(told, lambda t: F.array_join(F.concat(t, F.slice(t, 1, 1)), ", "))
    return F.concat(F.lit("TRIANGLE Z (("), inside, F.lit("))"))


def solid_faces(ring: Column, z_min: Column, z_max: Column) -> Column:
    """The faces of a prism as closed rings: bottom, reversed top, and one wall for each edge."""
    ring = closed(ring)
    lift = lambda r, z: F.transform(r, lambda p: point(p["x"], p["y"], z))
    open_edges = F.slice(edges(ring), 1, F.greatest(F.size(ring) - 1, F.lit(0)))
    wall = lambda e: F.array(
        point(e["a"]["x"], e["a"]["y"], z_min),
        point(e["b"]["x"], e["b"]["y"], z_min),
        point(e["b"]["x"], e["b"]["y"], z_max),
        point(e["a"]["x"], e["a"]["y"], z_max),
        point(e["a"]["x"], e["a"]["y"], z_min),
    )
    return F.concat(F.array(lift(ring, z_min), F.reverse(lift(ring, z_max))), F.transform(open_edges, wall))


def _prism_text(ring: Column, low: Column, high: Column) -> Column:
    """The faces of a prism as in `solid_faces`, as texts: each corner and height is written as text once, however many faces have it."""
    at = lambda p, z: F.concat(p, z)
    face = lambda *corners: F.concat(F.lit("(("), *[x for c in corners for x in (c, F.lit(", "))][:-1], F.lit("))"))
    flat = lambda r, z: F.concat(F.lit("(("), F.array_join(F.transform(r, lambda p: at(p, z)), ", "), F.lit("))"))
    wall = lambda a, b: face(at(a, low), at(b, low), at(b, high), at(a, high), at(a, low))

    def faces(r: Column) -> Column:
        walls = F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), wall)
        return F.concat(F.array(flat(r, low), flat(F.reverse(r), high)), walls)

    texts = lambda r: F.transform(r, lambda p: F.concat_ws(" ", _number(p["x"]), _number(p["y"])))
    return let(texts(ring), faces)


def solid_wkt(ring: Column, z_min: Column, z_max: Column, holes: Column | None = None) -> Column:
    """POLYHEDRALSURFACE Z of a prism; EMPTY for fewer than four vertices. Each hole adds a bottom, a top and walls of its own."""

    def whole(rings: Column) -> Column:
        def told(z: Column) -> Column:
            faces = F.flatten(F.transform(rings, lambda r: _prism_text(r, z["low"], z["high"])))
            return F.concat(F.lit("POLYHEDRALSURFACE Z ("), F.array_join(faces, ", "), F.lit(")"))

        heights = F.struct(*(F.coalesce(F.concat(F.lit(" "), _number(z.cast("double"))), F.lit("")).alias(n) for z, n in ((z_min, "low"), (z_max, "high"))))
        return F.when(F.size(F.get(rings, F.lit(0))) >= 4, let(heights, told)).otherwise("POLYHEDRALSURFACE Z EMPTY")

    outline = F.array(let(ring, closed))
    if holes is not None:
        outline = F.concat(outline, F.coalesce(F.filter(F.transform(holes, closed), lambda h: F.size(h) >= 4), F.filter(outline, lambda r: F.lit(False))))
    return let(outline, whole)


def read_wkt_rings(wkt: Column) -> Column:
    """The rings of a surface's text with at least three points, as arrays of arrays of numbers; null if EMPTY."""

    def read(text: Column) -> Column:
        rings = F.regexp_extract_all(text, F.lit(r"\(\(([^)(]+)\)\)"), 1)
        numbers = F.transform(rings, lambda r: F.transform(F.split(F.trim(r), r"\s*,\s*"), lambda p: F.split(F.trim(p), r"\s+").cast("array<double>")))
        return F.when(~text.contains("EMPTY"), F.filter(numbers, lambda r: F.size(F.filter(r, lambda p: F.size(p) >= 3)) >= 3))

    return let(wkt, read)


def wkt_centroid(wkt: Column) -> Column:
    """The mean of all vertices of a text; z is 0 where absent; (0, 0, 0) without vertices."""
    # fixed value: what counts as a vertex in a text
    pattern = r"([\d\.-]+)\s+([\d\.-]+)(?:\s+([\d\.-]+))?"
    part = lambda k: F.transform(F.regexp_extract_all(wkt, F.lit(pattern), k), lambda v: F.coalesce(F.expr("1D") * F.nullif(v, F.lit("")).cast("double"), F.lit(0.0)))
    mean = lambda k: F.when(F.size(part(k)) > 0, _sum(part(k)) / F.size(part(k))).otherwise(0.0)
    return F.struct(mean(1).alias("x"), mean(2).alias("y"), mean(3).alias("z"))


def tetra_volume(a: Column, b: Column, c: Column, d: Column) -> Column:
    u, v, w = ([p[k] - a[k] for k in "xyz"] for p in (b, c, d))
    return F.abs(u[0] * (v[1] * w[2] - v[2] * w[1]) - u[1] * (v[0] * w[2] - v[2] * w[0]) + u[2] * (v[0] * w[1] - v[1] * w[0])) / 6


def normal(a: Column, b: Column, c: Column) -> Column:
    """The unit normal of a triangle; (0, 0, 1) if it has no area."""
    u, v = ([p[k] - a[k] for k in "xyz"] for p in (b, c))
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    length = F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2])
    flat = length < 1e-12
    return F.struct(*(F.when(flat, float(k == "z")).otherwise(v / length).alias(k) for k, v in zip("xyz", cross)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(sum(((a[k] - b[k]) * (a[k] - b[k]) for k in "yz"), (a["x"] - b["x"]) * (a["x"] - b["x"])))


def on_globe(lon: Column, lat: Column) -> Column:
    """(lon, lat, turns) of the place that degrees beyond a pole come to: a latitude of 100 is one of 80 on the other side. Places
    within both poles stay as they are, with 0 turns."""
    turns = F.floor((lat + 90) / 180).cast("long")
    turns = F.when(lat.between(-90, 90), F.lit(0).cast("long")).otherwise(turns)
    odd = F.pmod(turns, F.lit(2)) == 1
    folded = F.when(odd, turns * 180 - lat).otherwise(lat - turns * 180)
    across = F.when(lon > 0, lon - 180).otherwise(lon + 180)
    return F.struct(F.when(odd, across).otherwise(lon).alias("lon"), F.when(turns == 0, lat).otherwise(folded).alias("lat"), turns.alias("turns"))


def off_globe(lon: Column, lat: Column, turns: Column) -> Column:
    """The degrees (lon, lat) that `on_globe` turned into these; longitudes as they were between -180 and 180."""
    odd = F.pmod(turns, F.lit(2)) == 1
    across = F.when(lon > 0, lon - 180).otherwise(lon + 180)
    return F.struct(F.when(odd, across).otherwise(lon).alias("lon"), F.when(turns == 0, lat).when(odd, turns * 180 - lat).otherwise(turns * 180 + lat).alias("lat"))


def web_mercator(lon: Column, lat: Column) -> Column:
    """EPSG:4326 degrees as EPSG:3857 metres."""
    radius = 6378137.0
    return F.struct((F.radians(lon) * radius).alias("x"), (F.log(F.tan(F.radians(lat) / 2 + F.lit(3.141592653589793 / 4))) * radius).alias("y"))


def from_web_mercator(x: Column, y: Column) -> Column:
    """EPSG:3857 metres as EPSG:4326 degrees."""
    radius = 6378137.0
    return F.struct(F.degrees(x / radius).alias("lon"), F.degrees(2 * F.atan(F.exp(y / radius)) - F.lit(3.141592653589793 / 2)).alias("lat"))


#: The ellipsoid's axis and flattening, the scale on a zone's middle, and the shifts of x and of southern y.
_AXIS, _FLATTENING, _SCALE, _EAST, _SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
_N = _FLATTENING / (2 - _FLATTENING)
_RADIUS = _AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Krueger's series to the third power of the third flattening: to the plane, from it, and to the latitude.
_TO = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_FROM = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def utm_zone(lon: Column) -> Column:
    """The zone of a longitude, 1 to 60; 180 degrees are in the last."""
    return F.least(F.floor((lon + 180) / 6) + 1, F.lit(60)).cast("int")


def utm(lon: Column, lat: Column, zone: Column | int, south: bool = False) -> Column:
    """EPSG:4326 degrees as metres (x, y) of a UTM zone (EPSG:326zz, in the south 327zz)."""
    zone = F.lit(zone) if isinstance(zone, int) else zone
    k = 2 * _N**0.5 / (1 + _N)
    off, sine = F.radians(lon - (zone * 6 - 183)), F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sine) - k * F.atanh(k * sine))
    up, across = F.atan2(t, F.cos(off)), F.atanh(F.sin(off) / F.sqrt(1 + t * t))
    x = across + sum((a * F.cos(2 * j * up) * F.sinh(2 * j * across) for j, a in enumerate(_TO, 1)), F.lit(0.0))
    y = up + sum((a * F.sin(2 * j * up) * F.cosh(2 * j * across) for j, a in enumerate(_TO, 1)), F.lit(0.0))
    return F.struct((x * (_SCALE * _RADIUS) + _EAST).alias("x"), (y * (_SCALE * _RADIUS) + (_SOUTH if south else 0.0)).alias("y"))


def from_utm(x: Column, y: Column, zone: Column | int, south: bool = False) -> Column:
    """Metres of a UTM zone as EPSG:4326 degrees (lon, lat)."""
    zone = F.lit(zone) if isinstance(zone, int) else zone
    up, across = (y - (_SOUTH if south else 0.0)) / (_SCALE * _RADIUS), (x - _EAST) / (_SCALE * _RADIUS)
    k = 2 * _N**0.5 / (1 + _N)
    # the series' first values are off by the powers that they leave out: one step each undoes what `utm` does to the last digits
    u = up - sum((b * F.sin(2 * j * up) * F.cosh(2 * j * across) for j, b in enumerate(_FROM, 1)), F.lit(0.0))
    v = across - sum((b * F.cos(2 * j * up) * F.sinh(2 * j * across) for j, b in enumerate(_FROM, 1)), F.lit(0.0))
    step = lambda p: F.struct(
        (up - sum((a * F.sin(2 * j * p["u"]) * F.cosh(2 * j * p["v"]) for j, a in enumerate(_TO, 1)), F.lit(0.0))).alias("u"),
        (across - sum((a * F.cos(2 * j * p["u"]) * F.sinh(2 * j * p["v"]) for j, a in enumerate(_TO, 1)), F.lit(0.0))).alias("v"),
    )

    def degrees(p: Column) -> Column:
        east, north = F.sinh(p["v"]), F.cos(p["u"])
        t = F.sin(p["u"]) / F.sqrt(east * east + north * north)
        c = F.atan(t)
        first = c + sum((d * F.sin(2 * j * c) for j, d in enumerate(_LATITUDE, 1)), F.lit(0.0))
        flat = F.signum(t) * F.asinh(F.abs(t))
        better = lambda lat: F.atan(F.sinh(flat + k * F.atanh(k * F.sin(lat))))
        return F.struct((F.degrees(F.atan2(east, north)) + (zone * 6 - 183)).alias("lon"), F.degrees(better(better(first))).alias("lat"))

    return let(F.struct(u.alias("u"), v.alias("v")), lambda p: let(step(p), lambda q: let(step(q), degrees)))


def pairs_ring(ring: Column) -> Column:
    """An array of [x, y] as a ring of points."""
    return F.transform(ring, lambda p: point(F.get(p, F.lit(0)), F.get(p, F.lit(1))))
