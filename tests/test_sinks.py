import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotstack.operators import inference
from lotstack.sources import sinks


def test_publish_replaces_all_or_nothing(spark, tmp_path):
    path = f"{tmp_path}/out"
    sinks.publish(spark.range(3), path)
    sinks.publish(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(Exception, match="no more"):
        sinks.publish(spark.range(2).select(F.raise_error(F.lit("no more")).cast("long").alias("id")), path)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_each_geojson_file_is_a_collection(spark, tmp_path):
    lines = spark.range(0, 50, 1, 3).select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("id"))).alias("value"))
    sinks.write_geojson(lines.unionAll(lines.where("false")), f"{tmp_path}/g")
    held = [json.loads(p.read_text()) for p in (tmp_path / "g").glob("part-*") if p.stat().st_size]
    assert all(h["type"] == "FeatureCollection" for h in held)
    assert sorted(f["id"] for h in held for f in h["features"]) == list(range(50))


def test_footprints_grids_points_and_floors(spark, tmp_path):
    outlines = spark.createDataFrame([(1, [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]), (2, [[0.0, 0.0]])], "cluster long, hull array<array<double>>")
    sinks.write_footprints(outlines, f"{tmp_path}/f")
    got = {r.cluster: (r.layer, r.geometry) for r in spark.read.parquet(f"{tmp_path}/f").collect()}
    assert got == {1: ("buildings", "POLYGON ((0.0 0.0, 1.0 0.0, 1.0 1.0, 0.0 0.0))"), 2: ("buildings", None)}
    cells = spark.range(100).select(F.floor(F.col("id") / 10).alias("cx"), (F.col("id") % 10).alias("cy"), F.col("id").cast("double").alias("z"))
    sinks.write_grid(cells, f"{tmp_path}/grid", 4)
    window = sinks.read_grid(spark, f"{tmp_path}/grid", 3, 3, 5, 6, 4)
    assert sorted((r.cx, r.cy) for r in window.collect()) == [(x, y) for x in range(3, 6) for y in range(3, 7)]
    sinks.write_points(cells.select(F.col("cx").alias("x"), F.col("cy").alias("y"), "z"), f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 100
    sinks.write_floors(spark.range(2).select("id", F.lit(None).cast("string").alias("unit_id")), f"{tmp_path}/j")
    assert all("unit_id" in line for p in (tmp_path / "j").glob("part-*") for line in p.read_text().splitlines())


def test_samples_of_npz(spark, tmp_path):
    np.savez(tmp_path / "a.npz", points=np.ones((3, 6), np.float32), labels=np.arange(3, dtype=np.int32))
    rows = sinks.read_samples(spark, f"{tmp_path}/a.npz").collect()
    assert [(r.pt_id, r.label, len(r["values"])) for r in rows] == [(0, 0, 6), (1, 1, 6), (2, 2, 6)]


def test_model_status(spark, tmp_path):
    (tmp_path / "m.onnx").write_bytes(b"x")
    got = inference.model_status(spark, {"floors": f"{tmp_path}/m.onnx", "roofs": f"{tmp_path}/none.onnx"})
    assert {r.model: r.there for r in got.collect()} == {"floors": True, "roofs": False}
