"""Point clouds: uncompressed LAS files by fixed records, and tables. Compressed LAZ has no reader here."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotstack.sources import ranges

_COLUMNS = {"file": "string", "pt_id": "long", "x": "double", "y": "double", "z": "double", "classification": "int", "return_number": "int", "r": "double", "g": "double", "b": "double"}
#: Fixed values of the format: where colour starts in a record, by point format.
_COLOUR_AT = {2: 20, 3: 28, 7: 30, 8: 30}
#: Bytes of a header that hold all that is read of it; records of a task and of a batch; ids of a file.
_HEADER, _RECORDS, _AT_ONCE, _IDS = 375, 2_000_000, 100_000, 1 << 40


@dataclass
class _Layout:
    kind: int
    offset: int
    length: int
    count: int
    scale: np.ndarray
    shift: np.ndarray


def _layout(raw: bytes, name: str) -> _Layout:
    if raw[:4] != b"LASF":
        raise ValueError(f"{name} is no LAS file")
    if raw[104] & 0x80:
        raise ValueError(f"{name} is compressed")
    offset = struct.unpack_from("<I", raw, 96)[0]
    length, count = struct.unpack_from("<HI", raw, 105)
    if raw[25] >= 4 and len(raw) > 255:
        count = struct.unpack_from("<Q", raw, 247)[0] or count
    return _Layout(raw[104], offset, length, count, np.array(struct.unpack_from("<3d", raw, 131)), np.array(struct.unpack_from("<3d", raw, 155)))


def _points(raw: bytes, at: _Layout, first: int, file: str, number: int, columns: list[str]) -> pd.DataFrame:
    """The wanted columns of whole records; ids count on from file to file."""
    rows = np.frombuffer(raw, dtype=np.uint8, count=len(raw) // at.length * at.length).reshape(-1, at.length)
    n, old, out = len(rows), at.kind < 6, {}
    if {"x", "y", "z"} & set(columns):
        xyz = np.ascontiguousarray(rows[:, :12]).view("<i4") * at.scale + at.shift
        out = {"x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]}
    if {"r", "g", "b"} & set(columns):
        colour = _COLOUR_AT.get(at.kind)
        rgb = np.ascontiguousarray(rows[:, colour : colour + 6]).view("<u2").astype(float) if colour else np.zeros((n, 3))
        out |= {"r": rgb[:, 0], "g": rgb[:, 1], "b": rgb[:, 2]}
    out |= {"file": [file] * n, "pt_id": number * _IDS + first + np.arange(n)}
    out["classification"] = (rows[:, 15] & 31 if old else rows[:, 16]).astype(np.int32)
    out["return_number"] = (rows[:, 14] & (7 if old else 15)).astype(np.int32)
    return pd.DataFrame({c: out[c] for c in columns})


class LasSource(ranges.Ranged):
    """LAS files, so many records a task as the option says."""

    columns = _COLUMNS

    @classmethod
    def name(cls) -> str:
        return "las"

    @staticmethod
    def cut(file: pa.NativeFile, name: str, options: dict[str, str]) -> list[tuple]:
        count, records = _layout(file.read_at(_HEADER, 0), name).count, int(options["records"])
        return [(a, min(count, a + records)) for a in range(0, count, records)]

    @staticmethod
    def read(file: pa.NativeFile, part: tuple, name: str, number: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
        at = _layout(file.read_at(_HEADER, 0), name)
        for first in range(*part, _AT_ONCE):
            raw = file.read_at((min(part[1], first + _AT_ONCE) - first) * at.length, at.offset + first * at.length)
            yield pa.RecordBatch.from_pandas(_points(raw, at, first, name, number, columns), preserve_index=False)


def read_las(spark: SparkSession, path: str, columns: list[str] | None = None, records: int = _RECORDS) -> DataFrame:
    """(file, pt_id, x, y, z, classification, return_number, r, g, b) of LAS files, or the wanted of them; without colour it is 0.

    Ids are unique over all files of the path: those of each file begin at a multiple of 2**40, in the order of names. A file is
    read by a task for so many `records`; in a store that Arrow doesn't reach by one, and its ids then begin at a hash of its name.
    """
    wanted = [c for c in _COLUMNS if columns is None or c in columns]
    if ranges.reachable(path):
        spark.dataSource.register(LasSource)
        return spark.read.format("las").option("path", path).option("columns", ",".join(wanted)).option("records", records).load()

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content, number in zip(frame["path"], frame["content"], frame["number"]):
                at = _layout(bytes(content[:_HEADER]), name)
                for first in range(0, at.count, _AT_ONCE):
                    begin = at.offset + first * at.length
                    yield _points(bytes(content[begin : begin + min(_AT_ONCE, at.count - first) * at.length]), at, first, name, number, wanted)

    whole = spark.read.format("binaryFile").load(path).select("path", "content", F.pmod(F.xxhash64("path"), F.lit(1 << 22)).alias("number"))
    return whole.mapInPandas(parsed, ", ".join(f"{c} {_COLUMNS[c]}" for c in wanted))


def byte_colours(points: DataFrame) -> DataFrame:
    """Colours of 16 bits as 0 to 255, file by file; others stay."""
    wide = points.groupBy("file").agg((F.max(F.greatest("r", "g", "b")) > 255).alias("wide"))
    scaled = {c: F.when(F.col("wide"), F.col(c) / 65535 * 255).otherwise(F.col(c)) for c in "rgb"}
    return points.join(wide, "file").withColumns(scaled).drop("wide")


def long_raster(arrays: DataFrame) -> DataFrame:
    """(img_id, c, y, x, v) of arrays (img_id, bands: array of bands of rows of values)."""
    return arrays.select("img_id", F.posexplode("bands").alias("c", "b")).select("img_id", "c", F.posexplode("b").alias("y", "r")).select("img_id", "c", "y", F.posexplode("r").alias("x", "v"))
