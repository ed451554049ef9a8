import hashlib
import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lotstack.functions import ids


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_known_hash(spark):
    assert one(spark, ids.coordinate_hash(F.lit(77.209), F.lit(28.614), F.lit(ids.PARCEL_Z)))[0] == "280168"


def test_hash_equals_packed_doubles(spark):
    points = [(k, 77.0 + k * 0.013, 28.0 - k * 0.017, -5.0 + k) for k in range(200)]
    got = spark.createDataFrame(points, "k int, x double, y double, z double").select("k", ids.coordinate_hash(F.col("x"), F.col("y"), F.col("z")).alias("h"))
    found = {r.k: r.h for r in got.collect()}
    for k, *xyz in points:
        packed = struct.pack("<ddd", *(round(v, 3) + 0.0 for v in xyz))
        assert found[k] == f"{int(hashlib.md5(packed).hexdigest(), 16) % 10**6:06d}"


def test_compose_then_parse(spark):
    parts = {name: F.lit(str(k + 1)) for k, name in enumerate(ids.WIDTHS)}
    row = one(spark, ids.parse(ids.compose(**parts)).alias("p")).p
    assert row.is_valid and all(int(row[name]) == k + 1 and len(row[name]) == w for k, (name, w) in enumerate(ids.WIDTHS.items()))


def test_parse_refuses_other_lengths(spark):
    assert not one(spark, ids.parse(F.lit("12")).alias("p")).p.is_valid
    assert not one(spark, ids.parse(F.lit(None).cast("string")).alias("p")).p.is_valid
    with pytest.raises(PySparkException):
        spark.range(1).select(ids.parse_strict(F.concat(F.lit("1"), F.col("id").cast("string")))).collect()


@pytest.mark.parametrize(("value", "digits", "wanted"), [("5", 3, "005"), ("12345", 3, "345"), ("-5", 4, "-005"), ("", 2, "00"), ("+7", 3, "+07")])
def test_pad(spark, value, digits, wanted):
    assert one(spark, ids.pad(F.lit(value), digits))[0] == wanted == value.zfill(digits)[-digits:]


@pytest.mark.parametrize(("floor", "text"), [(0, "1000"), (1, "1010"), (-1, "0990"), (99, "1990"), (900, None), (-101, None)])
def test_vertical(spark, floor, text):
    assert one(spark, ids.encode_vertical(F.lit(floor)))[0] == text


def test_floor_from_z_ties_to_even(spark):
    got = [one(spark, ids.floor_from_z(F.lit(a), F.lit(a + 3.0), F.lit(0.0)))[0] for a in (0.0, 3.0, 6.0)]
    assert got == [0, 2, 2]


def test_sql_functions(spark):
    ids.register(spark)
    row = spark.sql("SELECT generate_parcel_id('1', '2', '3', '4', '5', '6', '7') AS c, compute_floor_level(3.0, 6.0, 0.0) AS f").first()
    assert row.c == "01" + "002" + "03" + "0004" + "000005" + "0006" + "0007" and row.f == 2
    assert spark.sql(f"SELECT parse_parcel_id('{row.c}').village AS v").first().v == "0004"


def test_codes_of_an_administrative_area(spark):
    area = {"state": F.lit("27"), "village": F.lit("4321")}
    x, y, n = F.lit(77.2), F.lit(28.6), F.lit(3)
    for level in ("parcel", "building", "floor", "unit"):
        default, told = one(spark, *(ids.code_for(F.lit(level), x, y, n, n, n, a) for a in (None, area)))
        assert told[:2] == "27" and default[:2] == "01" and told[11:] == default[11:] and one(spark, ids.parse(F.lit(told)).alias("p")).p.village == "4321"
