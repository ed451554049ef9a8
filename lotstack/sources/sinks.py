"""Sinks: whole results published at once, GeoJSON and JSON files, tables of points, grids and footprints."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotstack.functions import geometry as G


def publish(df: DataFrame, path: str, *by: str) -> None:
    """Write a result as Parquet so that readers never see a part of it: beside the place first, then renamed.

    A failed job leaves what was there. The result before is moved aside by one rename and replaced by a second: a reader between
    the two finds none, and must ask again. It is removed once the new one is in place.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    path = path.rstrip("/")
    mark = uuid.uuid4().hex
    staged, before = f"{path}.staged-{mark}", f"{path}.before-{mark}"
    files = at(path).getFileSystem(conf)
    try:
        df.write.partitionBy(*by).parquet(staged) if by else df.write.parquet(staged)
        there = files.exists(at(path))
        if there and not files.rename(at(path), at(before)):
            raise OSError(f"{path} cannot be moved")
        if not files.rename(at(staged), at(path)):
            if there:
                files.rename(at(before), at(path))
            raise OSError(f"{path} cannot be put in place")
        files.delete(at(before), True)
    finally:
        files.delete(at(staged), True)


def write_geojson(lines: DataFrame, path: str, value: str = "value") -> None:
    """Features as text lines, written as FeatureCollections: each part file is one, whatever its length."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = lambda texts: pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["value"])
        yield line(['{"type":"FeatureCollection","features":['])
        first = True
        for b in batches:
            texts = b.column(0).to_pylist()
            yield line([t if first and k == 0 else f",{t}" for k, t in enumerate(texts)])
            first = first and not texts
        yield line(["]}"])

    lines.select(F.col(value)).where(F.col(value).isNotNull()).mapInArrow(wrapped, "value string").write.text(path)


def write_footprints(outlines: DataFrame, path: str, layer: str = "buildings") -> None:
    """Outlines (hull: array of [x, y]) as rows of a layer with WKT polygons; those of fewer than three corners have none."""
    ring = G.pairs_ring(F.col("hull"))
    told = outlines.withColumn("geometry", F.when(F.size("hull") >= 3, G.polygon_wkt(ring))).withColumn("layer", F.lit(layer))
    publish(told.drop("hull"), path, "layer")


def write_grid(cells: DataFrame, path: str, tile: int = 1024) -> None:
    """Grid cells (cx, cy, …) by square tiles, so that a window reads only its own."""
    tiled = cells.withColumn("tx", F.floor(F.col("cx") / tile)).withColumn("ty", F.floor(F.col("cy") / tile))
    publish(tiled.repartition("tx", "ty").sortWithinPartitions("tx", "ty", "cy", "cx"), path, "tx", "ty")


def read_grid(spark: SparkSession, path: str, x1: int, y1: int, x2: int, y2: int, tile: int = 1024) -> DataFrame:
    """The cells of a window of a grid, ends included: other tiles are not read."""
    tiles = F.col("tx").between(x1 // tile, x2 // tile) & F.col("ty").between(y1 // tile, y2 // tile)
    return spark.read.parquet(path).where(tiles & F.col("cx").between(x1, x2) & F.col("cy").between(y1, y2)).drop("tx", "ty")


def write_points(points: DataFrame, path: str) -> None:
    """Points as a table whose files hold neighbours: sorted by cell, so that boxes prune row groups."""
    publish(points.repartitionByRange("x", "y").sortWithinPartitions("x", "y"), path)


def write_floors(rows: DataFrame, path: str) -> None:
    """Floor polygons as JSON lines, nulls kept."""
    rows.write.option("ignoreNullFields", False).json(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """(file, pt_id, values, label) of NPZ archives with `points` (n, columns) and `labels` (n); a file is read by one task."""

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as held:
                    points, labels = held["points"].astype(float), held["labels"].astype(int)
                for a in range(0, len(points), 50_000):
                    part = points[a : a + 50_000]
                    yield pd.DataFrame({"file": name, "pt_id": np.arange(a, a + len(part)), "values": list(part), "label": labels[a : a + 50_000]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parsed, "file string, pt_id long, values array<double>, label int")
