"""Readers and writers for tables, map extracts, CAD/BIM files and point clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lotstack.sources import cad, osm, points, rasters


def read(spark: SparkSession, path: str) -> DataFrame:
    """The reader for a path's suffix; an unknown one is an error, and so is the binary DWG."""
    suffix = path.rstrip("/*").rpartition(".")[2].lower()
    readers = {"dxf": cad.read_dxf, "ifc": cad.read_ifc, "json": osm.read_elements, "las": points.read_las, "tif": rasters.read_geotiff, "tiff": rasters.read_geotiff}
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix not in readers:
        raise ValueError(f"no reader for .{suffix}")
    return readers[suffix](spark, path)
