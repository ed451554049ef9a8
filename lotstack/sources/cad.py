"""Floor plans: text DXF group codes and IFC (STEP) entities, as rows that joins put together."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotstack.functions import geometry as G
from lotstack.plans.tables import materialize

_DXF = "file string, ord int, kind string, layer string, text string, closed boolean, points array<struct<x: double, y: double>>"


def _number(text: str, kind: type):
    """A group's value as a number; None if it is none."""
    try:
        return kind(text)
    except ValueError:
        return None


class _Hatch:
    """The outer boundary paths of a HATCH, from the groups that follow its number of paths."""

    def __init__(self) -> None:
        self.paths: list[list[dict]] = []
        self.reading = self.outer = False

    def group(self, code: str, value: str) -> None:
        if code == "91":
            self.reading = True
        elif code in ("75", "97"):  # the style ends the boundaries; 97 counts what a path was made from
            self.reading, self.outer = self.reading and code == "97", False
        elif code == "92" and self.reading:
            self.outer = bool((_number(value, int) or 0) & 1)
            if self.outer:
                self.paths.append([])
        elif self.outer and code == "10":
            self.paths[-1].append({"x": _number(value, float), "y": None})
        elif self.outer and code == "20" and self.paths[-1] and self.paths[-1][-1]["y"] is None:
            self.paths[-1][-1]["y"] = _number(value, float)


def _entities(name: str, text: str) -> Iterator[tuple]:
    """Closed outlines, texts and the outer boundaries of hatches of a DXF's ENTITIES section. Values that are no numbers are left out."""
    lines = text.splitlines()
    pairs = [(lines[i].strip(), lines[i + 1].strip()) for i in range(0, len(lines) - 1, 2)]
    section, ord_, current = "", 0, None

    def whole(points: list[dict]) -> list[dict]:
        return [p for p in points if p["x"] is not None and p["y"] is not None]

    def done(e: dict) -> tuple:
        return name, e["ord"], e["kind"], e["layer"], e["text"], e["closed"], whole(e["points"])

    outline = None  # the POLYLINE that the VERTEX entities belong to
    for k, (code, value) in enumerate(pairs):
        if code == "0":
            if current and current["kind"] == "VERTEX" and outline:
                outline["points"] += current["points"]
            elif current and current["kind"] == "POLYLINE":
                outline = current
            elif current and current["kind"] in ("LWPOLYLINE", "TEXT", "MTEXT"):
                yield done(current)
            elif current and current["kind"] == "HATCH":
                for path in current["hatch"].paths:
                    yield done(current | {"closed": True, "points": path})
            if outline and value in ("SEQEND", "ENDSEC"):
                yield done(outline)
                outline = None
            current = {"ord": ord_, "kind": value, "layer": "0", "text": None, "closed": False, "points": [], "hatch": _Hatch()} if section == "ENTITIES" else None
            ord_ += 1
        elif code == "2" and k and pairs[k - 1] == ("0", "SECTION"):
            section = value
        elif current is not None:
            if code == "8":
                current["layer"] = value
            elif current["kind"] == "HATCH":
                current["hatch"].group(code, value)
            elif code == "1":
                current["text"] = value
            elif code == "70":
                current["closed"] = bool((_number(value, int) or 0) & 1)
            elif code == "10":
                current["points"].append({"x": _number(value, float), "y": 0.0})
            elif code == "20" and current["points"]:
                current["points"][-1]["y"] = _number(value, float)


def read_dxf(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, kind, layer, text, closed, points) of outlines and texts of text DXF files; one task reads a file."""

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                yield pd.DataFrame(list(_entities(name, content.decode("utf-8", "replace"))), columns=["file", "ord", "kind", "layer", "text", "closed", "points"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parsed, _DXF)


def layer_level(layer: Column) -> Column:
    """(level, z_base) that a layer's name tells: basement, ground, roof, or a numbered floor; null if none."""
    name = F.upper(layer)
    number = F.nullif(F.regexp_extract(name, r"(?:FL|FLOOR|LEVEL|L)[_\-]?(\d+)", 1), F.lit("")).cast("int")
    level = (
        F.when(name.contains("BASEMENT") | name.contains("B-"), -1)
        .when(name.contains("GROUND") | name.contains("GF") | name.contains("FL_00"), 0)
        .when(name.contains("ROOF"), 99)
        .otherwise(number)
    )
    return F.when(level.isNotNull(), F.struct(level.alias("level"), F.when(level == 99, 0.0).otherwise(level * 3.0).alias("z_base")))


#: Words that tell a unit's type, in the order in which they are looked for.
UNIT_WORDS = (
    ("commercial", ("SHOP", "RETAIL", "COMMERCIAL", "OFFICE")),
    ("parking", ("PARKING", "GARAGE", "CAR")),
    ("utility", ("UTILITY", "MECH", "ELEC", "HVAC")),
    ("common", ("COMMON", "LOBBY", "CORRIDOR", "STAIR", "ELEV")),
)


def unit_type(text: Column) -> Column:
    name, out = F.upper(text), F.when(F.lit(False), F.lit(""))
    for kind, words in UNIT_WORDS:
        out = out.when(F.greatest(*(name.contains(w) for w in words)), kind)
    return out.otherwise("residential")


def unit_id(text: Column) -> Column:
    """The first code like A1, A-1 or 12B in a text in capitals, else its first 20 characters."""
    name = F.upper(F.regexp_replace(text, r"^\s+|\s+$", ""))
    return F.coalesce(F.nullif(F.regexp_extract(name, r"([A-Z]\d+|[A-Z]-\d+|\d+[A-Z]?)", 1), F.lit("")), F.substring(name, 1, 20))


def floor_polygons(entities: DataFrame, storey: float = 3.0) -> DataFrame:
    """Closed outlines with level, height and the first text of their layer that stands inside them."""
    outlines = entities.where(F.col("kind").isin("LWPOLYLINE", "POLYLINE", "HATCH") & F.col("closed") & (F.size("points") >= 3)).select("file", "ord", "layer", "points", F.xxhash64("points").alias("_shape"))
    texts = entities.where(F.col("kind").isin("TEXT", "MTEXT") & (F.size("points") > 0)).select(
        "file", "layer", F.col("ord").alias("text_ord"), "text", F.get("points", F.lit(0)).alias("at")
    )
    met = outlines.join(texts, ["file", "layer"]).where(G.contains(F.col("points"), F.col("at.x"), F.col("at.y")))
    first = met.groupBy("file", "ord", "_shape").agg(F.min(F.struct("text_ord", "text"))["text"].alias("text"))
    level = layer_level(F.col("layer"))
    return outlines.join(first, ["file", "ord", "_shape"], "left").select(
        "file", "ord", "layer", F.coalesce(level["level"], F.lit(0)).alias("level"), F.coalesce(level["z_base"], F.lit(0.0)).alias("z_base"), F.lit(storey).alias("height"),
        G.shoelace_area(F.col("points")).alias("area"), unit_id(F.coalesce("text", F.lit("U"))).alias("unit_id"), unit_type(F.coalesce("text", F.lit(""))).alias("unit_type"), "points",
    )


#: A statement of an IFC file, and the pieces of its arguments.
_STATEMENT = re.compile(r"\s*#(\d+)\s*=\s*([A-Z0-9]+)\s*\((.*)\)\s*", re.DOTALL)
_PIECES = re.compile(r"'(?:[^']|'')*'|[(),]|[^(),']+")
_WIDE = re.compile(r"\\X2\\((?:[0-9A-F]{4})+)\\X0\\")


def _top_arguments(text: str) -> list[str]:
    """Arguments outside all brackets and quotes, as they stand."""
    out, depth = [""], 0
    for piece in _PIECES.findall(text):
        if piece == "," and not depth:
            out.append("")
            continue
        depth += (piece == "(") - (piece == ")")
        out[-1] += piece
    return [a.strip() for a in out]


def _plain(argument: str) -> str | None:
    """An argument without quotes, its characters decoded; None for $."""
    if argument == "$":
        return None
    if argument[:1] == "'" and argument[-1:] == "'" and len(argument) > 1:
        told = argument[1:-1].replace("''", "'")
        return _WIDE.sub(lambda m: bytes.fromhex(m[1]).decode("utf-16-be", "replace"), told)
    return argument


def _statements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Statements of texts that were cut at semicolons; a semicolon inside quotes or comments is put back."""
    held, of, out = "", None, []
    schema = pa.schema([("file", pa.string()), ("id", pa.int64()), ("entity", pa.string()), ("args", pa.string()), ("parts", pa.list_(pa.string()))])
    for batch in batches:
        for file, value in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist()):
            held = f"{held};{value}" if held and file == of else value
            of = file
            if "/*" in held:
                held = re.sub(r"/\*.*?\*/", " ", held, flags=re.DOTALL)
            if held.count("'") % 2 or "/*" in held:
                continue
            text, held = held, ""
            if (m := _STATEMENT.fullmatch(text)) and int(m[1]) < 2**63:
                out.append({"file": file, "id": int(m[1]), "entity": m[2], "args": m[3], "parts": [_plain(a) for a in _top_arguments(m[3])]})
        yield pa.RecordBatch.from_pylist(out, schema)
        out = []


def read_ifc(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, entity, args, parts) of the entities of IFC files; parts are the arguments, decoded, null for $.

    Statements end at semicolons, wherever lines end, and a file is split among tasks. What is no statement is left out.
    """
    texts = spark.read.option("lineSep", ";").text(path).select(F.input_file_name().alias("file"), "value")
    return texts.mapInArrow(_statements, "file string, id long, entity string, args string, parts array<string>")


def _argument(k: int) -> Column:
    """The kth argument, without quotes; null for $."""
    return F.get("parts", F.lit(k))


def _references(column: Column) -> Column:
    return F.transform(F.regexp_extract_all(column, F.lit(r"#(\d+)"), 1), lambda x: x.cast("long"))


def placements(entities: DataFrame, rounds: int = 64) -> DataFrame:
    """(file, placement, x, y, z, total_z) of local placements: their own location, and the height with all placements above them.

    Chains are followed by joins that double their reach each round. Heights add up along chains that are not tilted.
    """
    numbers = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"([-+0-9.eE]+)"), 1), lambda v: v.try_cast("double"))
    at = lambda c, k: F.coalesce(F.get(c, F.lit(k)), F.lit(0.0))
    spots = entities.where("entity = 'IFCCARTESIANPOINT'").select("file", F.col("id").alias("spot"), numbers(_argument(0)).alias("p"))
    axes = entities.where("entity IN ('IFCAXIS2PLACEMENT3D', 'IFCAXIS2PLACEMENT2D')").select("file", F.col("id").alias("axis"), F.get(_references(_argument(0)), F.lit(0)).alias("spot"))
    local = entities.where("entity = 'IFCLOCALPLACEMENT'").select("file", F.col("id").alias("placement"), F.get(_references(_argument(0)), F.lit(0)).alias("above"), F.get(_references(_argument(1)), F.lit(0)).alias("axis"))
    placed = local.join(axes, ["file", "axis"], "left").join(spots, ["file", "spot"], "left")
    own = materialize(placed.select("file", "placement", "above", *(at("p", k).alias(n) for k, n in enumerate("xyz"))), "placements")
    chain = own.select("file", "placement", "above", F.col("z").alias("total_z"))
    for _ in range(rounds):
        if not chain.where("above IS NOT NULL").limit(1).count():
            break
        up = chain.select("file", F.col("placement").alias("above"), F.col("above").alias("next"), F.col("total_z").alias("more"))
        longer = chain.join(up, ["file", "above"], "left").select("file", "placement", F.when(F.col("next") != F.col("placement"), F.col("next")).alias("above"), (F.col("total_z") + F.coalesce("more", F.lit(0.0))).alias("total_z"))
        chain = materialize(longer, "chain")
    return own.drop("above").join(chain.select("file", "placement", "total_z"), ["file", "placement"])


def storeys(entities: DataFrame) -> DataFrame:
    """(file, storey, name, elevation, height): a storey's height reaches the next one's elevation, the last is 3. A storey that
    tells no elevation has its placement's."""
    rows = entities.where("entity = 'IFCBUILDINGSTOREY'").select(
        "file", F.col("id").alias("storey"), _argument(2).alias("name"), _argument(9).try_cast("double").alias("told"), F.get(_references(_argument(5)), F.lit(0)).alias("placement")
    )
    rows = rows.join(placements(entities).select("file", "placement", "z"), ["file", "placement"], "left")
    rows = rows.select("file", "storey", "name", F.coalesce("told", "z", F.lit(0.0)).alias("elevation"))
    following = F.lead("elevation").over(Window.partitionBy("file").orderBy("elevation", "storey"))
    return rows.withColumn("height", F.coalesce(following - F.col("elevation"), F.lit(3.0)))


#: The kinds of building elements that are taken.
ELEMENTS = ("IFCWALL", "IFCSLAB", "IFCDOOR", "IFCWINDOW")


def elements(entities: DataFrame) -> DataFrame:
    """(file, element, global_id, type, name, storey, z, overall_height): walls, slabs, doors and windows, the storey that contains
    them, the height of their placement, and that of doors and windows themselves."""
    tall = F.when(F.col("entity").isin("IFCDOOR", "IFCWINDOW"), _argument(8).try_cast("double"))
    rows = entities.where(F.col("entity").isin(*ELEMENTS)).select(
        "file", F.col("id").alias("element"), _argument(0).alias("global_id"), F.col("entity").alias("type"), _argument(2).alias("name"),
        F.get(_references(_argument(5)), F.lit(0)).alias("placement"), tall.alias("overall_height"),
    )
    rows = rows.join(placements(entities).select("file", "placement", F.col("total_z").alias("z")), ["file", "placement"], "left")
    return rows.join(contained(entities), ["file", "element"], "left").select("file", "element", "global_id", "type", "name", "storey", "z", "overall_height")


def contained(entities: DataFrame) -> DataFrame:
    """(file, element, storey): where each element is contained; the first relation counts."""
    rows = entities.where("entity = 'IFCRELCONTAINEDINSPATIALSTRUCTURE'").select(
        "file", F.col("id").alias("relation"), F.explode(_references(_argument(4))).alias("element"), F.get(_references(_argument(5)), F.lit(0)).alias("storey")
    )
    return rows.groupBy("file", "element").agg(F.min(F.struct("relation", "storey"))["storey"].alias("storey"))


def space_quantities(entities: DataFrame) -> DataFrame:
    """(file, space, name, area, volume): net floor area and volume of spaces through their quantity sets, else 0."""
    spaces = entities.where("entity = 'IFCSPACE'").select("file", F.col("id").alias("space"), _argument(2).alias("name"))
    defined = entities.where("entity = 'IFCRELDEFINESBYPROPERTIES'").select("file", F.explode(_references(_argument(4))).alias("space"), F.get(_references(_argument(5)), F.lit(0)).alias("set"))
    sets = entities.where("entity = 'IFCELEMENTQUANTITY'").select("file", F.col("id").alias("set"), F.explode(_references(_argument(5))).alias("quantity"))
    values = entities.where("entity IN ('IFCQUANTITYAREA', 'IFCQUANTITYVOLUME')").select("file", F.col("id").alias("quantity"), _argument(0).alias("what"), _argument(3).try_cast("double").alias("v"))
    found = defined.join(sets, ["file", "set"]).join(values, ["file", "quantity"])
    of = lambda what: F.max(F.when(F.col("what") == what, F.col("v")))
    summed = found.groupBy("file", "space").agg(of("NetFloorArea").alias("a"), of("NetVolume").alias("b"))
    return spaces.join(summed, ["file", "space"], "left").select("file", "space", "name", F.coalesce("a", F.lit(0.0)).alias("area"), F.coalesce("b", F.lit(0.0)).alias("volume"))
