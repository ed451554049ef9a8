"""Model inference over point clouds and rasters: tiles, votes, class scores, metrics. The model is a callable."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotstack.functions.binding import let
from lotstack.operators.pointcloud import levels_with_outlines, quantiles
from lotstack.operators.runs import per_run
from lotstack.plans.tables import materialize
from lotstack.sources.points import byte_colours


#: Classes of the floor model with their training weights.
CLASSES = (
    ("ground", 0.5),
    ("wall_exterior", 1.0),
    ("floor_slab", 2.0),
    ("roof", 1.5),
    ("window", 5.0),
    ("door", 10.0),
    ("column", 8.0),
    ("stair", 15.0),
    ("interior_wall", 3.0),
    ("ceiling", 4.0),
    ("beam", 6.0),
    ("railing", 8.0),
    ("pipe", 10.0),
    ("cable_tray", 10.0),
    ("duct", 10.0),
    ("equipment", 12.0),
    ("furniture", 15.0),
    ("vegetation", 2.0),
    ("vehicle", 10.0),
    ("clutter", 5.0),
)


def class_table(spark: SparkSession) -> DataFrame:
    """(class, name, weight)"""
    return spark.createDataFrame([(k, *row) for k, row in enumerate(CLASSES)], "class int, name string, weight double")


def softmax(scores: Column) -> Column:
    powers = let(F.array_max(scores), lambda top: F.transform(scores, lambda v: F.exp(v.cast("double") - top)))
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda a, b: a + b)
    return let(powers, lambda p: let(total(p), lambda t: F.transform(p, lambda v: v / t)))


def argmax(scores: Column) -> Column:
    """The first place, from 0, of the greatest score."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def tile_windows(clouds: DataFrame, tile: int = 8192) -> DataFrame:
    """(cloud_id, start, stop) of half-overlapping windows over n points; those shorter than a quarter tile are left out."""
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(tile // 2))
    windows = clouds.select("cloud_id", "n", F.explode(starts).alias("start")).withColumn("stop", F.least(F.col("start") + tile, F.col("n")))
    return windows.where((F.col("stop") - F.col("start")) * 4 >= tile).select("cloud_id", "start", "stop")


def _point(rows: DataFrame) -> list[str]:
    """What names a point: its id, within its cloud if there is one."""
    return [c for c in ("cloud_id", "pt_id") if c in rows.columns]


def votes(tile_scores: DataFrame) -> DataFrame:
    """(cloud_id if there, pt_id, class, score): class scores averaged over the tiles that saw a point."""
    own = _point(tile_scores)
    long = tile_scores.select(*own, F.posexplode("scores").alias("class", "p"))
    return long.groupBy(*own, "class").agg(F.avg("p").alias("score"))


def voted_class(points: DataFrame, averaged: DataFrame) -> DataFrame:
    """(cloud_id if the votes have it, pt_id, class): the best class, ties to the smaller; -1 without a vote."""
    own = _point(averaged)
    best = averaged.groupBy(*own).agg(F.max(F.struct("score", (-F.col("class")).alias("less")))["less"].alias("less"))
    return points.select(*own).join(best, own, "left").select(*own, F.coalesce(-F.col("less"), F.lit(-1)).cast("int").alias("class"))


def predicted(tiles: DataFrame, model: Callable[[np.ndarray], np.ndarray], columns: tuple[str, ...] = ("x", "y", "z", "r", "g", "b")) -> DataFrame:
    """(cloud_id if there, pt_id, scores) of tiles (tile_id, pt_id, …): centred coordinates and colours of 0 to 1 go through the model.

    The model maps (n, 6) to (n, classes). Load heavy models inside the callable, once for each worker.
    """

    def scored(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        x = np.column_stack([rows[c] for c in columns]).astype(float)
        x[:, :3] -= x[:, :3].mean(axis=0)
        if x[:, 3:].max(initial=0) > 1:
            x[:, 3:] /= 255
        return np.arange(len(x)), {"scores": np.asarray(model(x), dtype=float)}

    own = _point(tiles)
    return per_run(tiles.select(*dict.fromkeys(("tile_id", *own, *columns))), ("tile_id",), own, scored, "scores array<double>")


def onnx_model(path: str, name: str = "input") -> Callable[[np.ndarray], np.ndarray]:
    """A callable that opens an ONNX file on first use in each worker."""
    opened: list = []

    def run(x: np.ndarray) -> np.ndarray:
        if not opened:
            import onnxruntime

            opened.append(onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"]))
        return opened[0].run(None, {name: x.astype(np.float32)})[0]

    return run


def normalised_bands(cells: DataFrame) -> DataFrame:
    """Raster cells (img_id, c, y, x, v) with v clipped to its band's 2nd and 98th percentiles and scaled to 0 to 1."""
    bounds = quantiles(cells, ("img_id", "c"), "v", {"lo": 0.02, "hi": 0.98})
    scaled = (F.least(F.greatest(F.col("v"), F.col("lo")), F.col("hi")) - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-8)
    return cells.join(bounds, ["img_id", "c"]).select("img_id", "c", "y", "x", scaled.alias("v"))


def patches(cells: DataFrame, size: int = 256, overlap: int = 32) -> DataFrame:
    """Cells once for each patch that covers them: (img_id, py, px, c, y, x, v); patches start every size - overlap."""
    step = size - overlap

    def starts(v: Column) -> Column:
        return F.explode(F.transform(F.sequence(F.greatest(F.ceil((v - size + 1) / step), F.lit(0)), F.floor(v / step)), lambda k: k * step))

    return cells.withColumn("py", starts(F.col("y"))).withColumn("px", starts(F.col("x")))


def averaged_cells(patch_scores: DataFrame) -> DataFrame:
    return patch_scores.groupBy("img_id", "y", "x").agg(F.avg("score").alias("score"))


def iou(labelled: DataFrame, classes: int) -> DataFrame:
    """(class, inter, uni, iou) of pred and label; unlabelled rows (-1) count in the union of what they were taken for."""
    long = labelled.select(F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("class"), "pred", "label")
    p, t = F.col("pred") == F.col("class"), F.col("label") == F.col("class")
    summed = long.groupBy("class").agg(F.sum((p & t).cast("long")).alias("inter"), F.sum((p | t).cast("long")).alias("uni"))
    return summed.where("uni > 0").withColumn("iou", F.col("inter") / F.col("uni"))


def accuracy(labelled: DataFrame, of_class: int = 2) -> DataFrame:
    """(accuracy, class_accuracy) over labelled rows, and over those of one class."""
    right = (F.col("pred") == F.col("label")).cast("double")
    return labelled.where("label >= 0").agg(F.avg(right).alias("accuracy"), F.avg(F.when(F.col("label") == of_class, right)).alias("class_accuracy"))


def label_histogram(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.count("*").alias("n"))


def split_rows(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """`rows` with split train, val or test (80, 10, 10 of 100), by a hash of the key: the same on every run."""
    at = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(100))
    return rows.withColumn("split", F.when(at < 80, "train").when(at < 90, "val").otherwise("test"))


def sampled(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n points of each cloud in the order of a hash; clouds with fewer repeat theirs."""
    by = Window.partitionBy("cloud_id")
    ranked = points.withColumn("r", F.row_number().over(by.orderBy(F.xxhash64("pt_id", F.lit(seed)), "pt_id")) - 1).withColumn("m", F.count("*").over(by))
    again = F.sequence(F.col("r"), F.greatest(F.lit(n - 1), F.col("r")), F.col("m"))
    return ranked.where(F.col("r") < n).withColumn("place", F.explode(again)).where(F.col("place") < n).drop("r", "m")


def augmented(points: DataFrame, angle: float, scale: float, flip: bool = False) -> DataFrame:
    """Points turned about the vertical axis, scaled, and mirrored if wanted."""
    x, y = F.col("x") * (-1.0 if flip else 1.0), F.col("y")
    c, s = F.cos(F.lit(angle)), F.sin(F.lit(angle))
    return points.withColumns({"x": (x * c - y * s) * scale, "y": (x * s + y * c) * scale, "z": F.col("z") * scale})


def tile_rows(points: DataFrame, tile: int = 8192) -> DataFrame:
    """`points` (cloud_id, place, …) once for each half-overlapping window, with tile_id, at and padded.

    A window of fewer points than a tile repeats its first ones until it is full; those shorter than a quarter tile are left out.
    """
    half = tile // 2
    sizes = points.groupBy("cloud_id").agg(F.count("*").alias("_n"))
    first = F.greatest(F.floor((F.col("place") - tile) / half) + 1, F.lit(0))
    start = F.explode(F.transform(F.sequence(first, F.floor(F.col("place") / half)), lambda k: k * half))
    own = points.join(sizes, "cloud_id").withColumn("_start", start).withColumn("_m", F.least(F.lit(tile), F.col("_n") - F.col("_start")))
    again = F.sequence(F.col("place") - F.col("_start"), F.lit(tile - 1).cast("long"), F.col("_m"))
    return (
        own.where(F.col("_m") * 4 >= tile)
        .withColumn("at", F.explode(again)).withColumn("padded", F.col("at") >= F.col("_m"))
        .withColumn("tile_id", F.concat_ws("-", "cloud_id", "_start")).drop("_n", "_m", "_start")
    )


def voted_arrays(tile_scores: DataFrame) -> DataFrame:
    """(cloud_id if there, pt_id, class): the best average of `votes`, ties to the smaller class, from one grouping by point."""
    own = _point(tile_scores)
    summed = lambda s, v: F.when(F.size(s) == 0, v).otherwise(F.zip_with(s, v, lambda a, b: a + b))
    total = F.aggregate(F.collect_list("scores"), F.array().cast("array<double>"), summed, lambda s: s)
    seen = tile_scores.groupBy(*own).agg(total.alias("total"), F.count("scores").alias("n"))
    return seen.select(*own, argmax(F.transform("total", lambda v: v / F.col("n"))).alias("class"))


def segmented(points: DataFrame, model: Callable[[np.ndarray], np.ndarray], tile: int = 8192) -> DataFrame:
    """(cloud_id, pt_id, class) of clouds (cloud_id, pt_id, place, x, y, z, r, g, b): tiles through the model, and the best average."""
    return _with_class(points, points, model, tile, "class").select(*_point(points), "class")


def _with_class(points: DataFrame, seen: DataFrame, model: Callable[[np.ndarray], np.ndarray], tile: int, name: str) -> DataFrame:
    """`points` with the model's class of each, which it tells from the same points as it is to see them; -1 without a vote."""
    voted = voted_arrays(predicted(tile_rows(seen, tile), model)).withColumnRenamed("class", name)
    return points.join(voted, _point(voted), "left").withColumn(name, F.coalesce(name, F.lit(-1)).cast("int"))


def levels_of_scan(scan: DataFrame, model: Callable[[np.ndarray], np.ndarray], tile: int = 8192, **delineation) -> DataFrame:
    """(cloud_id, level, z, cluster, area) of scanned points (file, cloud_id, pt_id, place, …): colours as bytes, classes by the
    model, and the levels of its floor slabs."""
    # read by several steps: as bytes, in tiles, and with the classes
    scan = materialize(scan, "scan")
    classified = _with_class(scan.drop("classification"), byte_colours(scan), model, tile, "classification")
    return levels_with_outlines(classified, **delineation)


def model_status(spark: SparkSession, models: dict[str, str]) -> DataFrame:
    """(model, path, there): whether the file of each model is in the store that Spark sees."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(conf).exists(where)

    return spark.createDataFrame([(name, path, there(path)) for name, path in models.items()], "model string, path string, there boolean")


def reflected(cells: DataFrame, size: int = 256, overlap: int = 32) -> DataFrame:
    """Raster cells with their mirror images to the right and below, so that whole patches cover the raster (height, width
    are its own size). Edges are not doubled; an image smaller than its margin is mirrored again."""
    step = size - overlap
    sizes = cells.groupBy("img_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    whole = lambda n: F.when(F.col(n) <= size, F.lit(size)).otherwise(F.ceil((F.col(n) - size) / step) * step + size).cast("int")

    def images(v: str, n: str) -> Column:
        period = F.greatest(2 * (F.col(n) - 1), F.lit(1))
        there = F.sequence(F.col(v), whole(n) - 1, period)
        back = F.when((F.col(v) > 0) & (F.col(v) < F.col(n) - 1) & (period - F.col(v) < whole(n)), F.sequence(period - F.col(v), whole(n) - 1, period))
        return F.explode(F.concat(there, F.coalesce(back, F.array().cast("array<int>"))))

    both = cells.withColumns({"y": F.col("y").cast("int"), "x": F.col("x").cast("int")}).join(sizes.select("img_id", F.col("height").cast("int"), F.col("width").cast("int")), "img_id")
    return both.withColumn("y", images("y", "height")).withColumn("x", images("x", "width"))


def uncropped(scores: DataFrame) -> DataFrame:
    """Averaged patch scores (img_id, height, width, y, x, score) of the raster itself: what `reflected` added is cut off."""
    return averaged_cells(scores.where((F.col("y") < F.col("height")) & (F.col("x") < F.col("width"))))


def prepared(points: DataFrame) -> DataFrame:
    """Points centred on their cloud's mean, with colours of 0 to 1: those of clouds that go beyond 1 are divided by 255."""
    of = points.groupBy("cloud_id").agg(*(F.avg(k).alias(f"_{k}") for k in "xyz"), F.max(F.greatest("r", "g", "b")).alias("_top"))
    colour = lambda k: F.when(F.col("_top") > 1, F.col(k) / 255).otherwise(F.col(k))
    moved = {k: F.col(k) - F.col(f"_{k}") for k in "xyz"} | {k: colour(k) for k in "rgb"}
    return points.join(of, "cloud_id").withColumns(moved).drop("_x", "_y", "_z", "_top")


def _uniform(seed: int, *columns: str) -> Column:
    """A number of (0, 1) by a hash: the same on every run."""
    return (F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def jittered(points: DataFrame, deviation: float = 0.01, seed: int = 0) -> DataFrame:
    """Coordinates with normal noise (Box and Muller), drawn from the point's id."""
    noise = lambda k: F.sqrt(-2 * F.log(_uniform(seed * 6 + k, "pt_id"))) * F.cos(2 * 3.141592653589793 * _uniform(seed * 6 + k + 3, "pt_id")) * deviation
    return points.withColumns({name: F.col(name) + noise(k) for k, name in enumerate("xyz")})


def thinned(points: DataFrame, share: float = 0.1, seed: int = 0) -> DataFrame:
    """Points without a share of them, drawn by id (an augmentation; `sampled` fills clouds up again)."""
    return points.where(_uniform(seed, "pt_id") > share)


def turned_raster(cells: DataFrame, height: int, width: int, quarters: int = 0, flip_y: bool = False, flip_x: bool = False) -> DataFrame:
    """Raster cells mirrored, then turned by quarters against the clock."""
    y = height - 1 - F.col("y") if flip_y else F.col("y")
    x = width - 1 - F.col("x") if flip_x else F.col("x")
    for _ in range(quarters % 4):
        y, x, height, width = width - 1 - x, y, width, height
    return cells.withColumns({"y": y, "x": x})


def cropped(cells: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """A square of each raster, whose corner a hash of its id draws; rasters no larger than it stay whole."""
    sizes = cells.groupBy("img_id").agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    larger = (F.col("_h") > size) & (F.col("_w") > size)
    corner = lambda n, k: F.when(larger, F.floor(_uniform(seed * 2 + k, "img_id") * (F.col(n) - size + 1))).otherwise(0)
    placed = cells.join(sizes, "img_id").withColumn("y", F.col("y") - corner("_h", 0)).withColumn("x", F.col("x") - corner("_w", 1))
    return placed.where(~larger | (F.col("y").between(0, size - 1) & F.col("x").between(0, size - 1))).drop("_h", "_w")
