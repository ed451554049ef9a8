"""Seeded synthetic buildings as labelled points: every value is an expression of the row number and the seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labels by name.
LABELS = {"ignore": -1, "ground": 0, "wall": 1, "floor_slab": 2, "roof": 3, "window": 4, "door": 5, "column": 6, "stair": 7, "interior_wall": 8}


def roof_height(shape: str, storey: Column | float) -> Column:
    storey = F.lit(storey) if isinstance(storey, float) else storey
    if shape in ("gabled", "hipped"):
        return F.greatest(F.lit(2.0), storey * 0.8)
    return F.greatest(F.lit(2.5), storey) if shape == "pyramid" else F.lit(0.0)


def roof_z(shape: str, u: Column, v: Column, storey: Column | float) -> Column:
    """Height above the eaves at (u, v) of [0, 1]: the ridge is in the middle, and falls off evenly."""
    across, along = 1 - F.abs(2 * v - 1), 1 - F.abs(2 * u - 1)
    share = {"gabled": across, "hipped": F.least(across, along * 2), "pyramid": F.least(across, along)}.get(shape, F.lit(0.0))
    return roof_height(shape, storey) * share


def _points(rows: DataFrame, noise: float) -> DataFrame:
    """(cloud_id, pt_id, x, y, z, r, g, b, label) of rows (cloud_id, pt_id, width, depth, floors, storey, ground, roof, units, seed)."""
    draw = lambda k: F.pmod(F.xxhash64("pt_id", F.col("seed") * 31 + k), F.lit(1 << 40)) / float(1 << 40)
    rows = rows.withColumns({"part": draw(1), "u": draw(2), "v": draw(3), "w": draw(4)})
    width, depth, storey, ground, u, v, w = (F.col(c) for c in ("width", "depth", "storey", "ground", "u", "v", "w"))
    shares = (("floor_slab", 0.28), ("wall", 0.58), ("column", 0.61), ("interior_wall", 0.68), ("roof", 0.86))
    kind = F.when(F.lit(False), "")
    for name, until in shares:
        kind = kind.when(F.col("part") < until, name)
    rows = rows.withColumn("kind", kind.otherwise("ground")).withColumn("level", F.floor(w * F.col("floors")))
    side = F.floor(u * 4)
    along = u * 4 - side
    wall_x = F.when(side == 0, along * width).when(side == 1, width).when(side == 2, (1 - along) * width).otherwise(0.0)
    wall_y = F.when(side == 0, 0.0).when(side == 1, along * depth).when(side == 2, depth).otherwise((1 - along) * depth)
    # columns stand in the corners; inner walls divide a floor evenly, along and across
    corner_x, corner_y = F.when(F.floor(u * 2) == 0, 0.0).otherwise(width), F.when(F.floor(v * 2) == 0, 0.0).otherwise(depth)
    parts = F.greatest(F.lit(2), F.floor(F.sqrt("units"))).cast("long")
    across, line = draw(14) < 0.5, 1 + F.floor(draw(15) * (parts - 1))
    inner_x = F.when(across, u * width).otherwise(line * width / parts)
    inner_y = F.when(across, line * depth / parts).otherwise(v * depth)
    pick = lambda wall, post, inner, outdoors, indoors: (
        F.when(F.col("kind") == "wall", wall).when(F.col("kind") == "column", post).when(F.col("kind") == "interior_wall", inner).when(F.col("kind") == "ground", outdoors).otherwise(indoors)
    )
    x = pick(wall_x, corner_x, inner_x, u * 2 * width - width / 2, u * width)
    y = pick(wall_y, corner_y, inner_y, v * 2 * depth - depth / 2, v * depth)
    over_roof = F.lit(0.0)
    for shape in ("gabled", "hipped", "pyramid"):
        over_roof = F.when(F.col("roof") == shape, roof_z(shape, u, v, storey)).otherwise(over_roof)
    upright = ground + w * F.col("floors") * storey
    level_z = F.when(F.col("kind") == "floor_slab", ground + F.col("level") * storey).otherwise(ground + F.col("floors") * storey + over_roof)
    z = pick(upright, upright, upright, ground, level_z)
    opening = F.when(draw(5) < 0.15, "window").when((draw(5) < 0.2) & (F.col("level") == 0), "door").otherwise("wall")
    named = F.when(F.col("kind") == "wall", opening).otherwise(F.col("kind"))
    label = F.element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv)), named)
    odd = draw(6) < 0.01
    jitter = lambda k: (draw(k) - 0.5) * 2 * noise
    return rows.select(
        "cloud_id", "pt_id",
        (x + jitter(7)).alias("x"), (y + jitter(8)).alias("y"), (z + jitter(9) + F.when(odd, draw(10) * 10 - 5).otherwise(0.0)).alias("z"),
        *((F.floor(draw(11 + k) * 256)).cast("double").alias(c) for k, c in enumerate("rgb")),
        F.when(odd, -1).otherwise(label).cast("int").alias("label"),
    )


def building(spark: SparkSession, cloud_id: int, width: float, depth: float, floors: int, storey: float = 3.0, ground: float = 0.0, roof: str = "flat", points: int = 20_000, seed: int = 0, noise: float = 0.02, units: int = 4) -> DataFrame:
    """(cloud_id, pt_id, x, y, z, r, g, b, label): slabs, walls with windows and doors, columns, inner walls, a roof, and the
    ground around. One point in a hundred is an outlier, labelled -1.
    """
    told = {"width": float(width), "depth": float(depth), "floors": floors, "storey": float(storey), "ground": float(ground), "roof": roof, "units": units}
    rows = spark.range(points).select(F.lit(cloud_id).cast("long").alias("cloud_id"), F.col("id").alias("pt_id"), F.lit(seed).cast("long").alias("seed"))
    return _points(rows.withColumns({k: F.lit(x) for k, x in told.items()}), noise)


def dataset(spark: SparkSession, n: int, seed: int = 0, points: int = 2_000) -> DataFrame:
    """n buildings whose sizes, floors and roofs follow from their numbers: one plan over all points, of any n."""
    k = F.col("cloud_id")
    rows = spark.range(n * points).select(F.floor(F.col("id") / points).alias("cloud_id"), (F.col("id") % points).alias("pt_id"))
    shape = F.element_at(F.array(*map(F.lit, ("flat", "gabled", "hipped", "pyramid"))), (k % 4 + 1).cast("int"))
    told = {"width": 10.0 + (k * 7 + seed) % 21, "depth": 8.0 + (k * 5 + seed) % 13, "floors": 1 + (k + seed) % 8, "storey": F.lit(3.0), "ground": F.lit(0.0)}
    return _points(rows.withColumns(told | {"roof": shape, "units": 2 + k % 8, "seed": k + seed}), 0.02)
