"""GeoTIFF rasters as rows: strips and tiles, plain or deflated, a task for each. BigTIFF and other compressions are refused."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lotstack.sources import ranges

#: Fixed values of the format: bytes and struct codes of field types, and the numbers of tags and compressions.
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _OFFSETS, _SAMPLES, _ROWS, _COUNTS, _PLANAR, _PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
_TILE_WIDTH, _TILE_HEIGHT, _TILE_OFFSETS, _TILE_COUNTS, _FORMAT, _SCALE, _TIEPOINT = 322, 323, 324, 325, 339, 33550, 33922
_PLAIN, _DEFLATED = 1, (8, 32946)
_KINDS = {1: "u", 2: "i", 3: "f"}


def _tags(file: pa.NativeFile, name: str) -> tuple[str, dict[int, tuple]]:
    """(byte order, values by tag) of the first image of a file."""
    head = file.read_at(8, 0)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8 or struct.unpack_from(order + "H", head, 2)[0] != 42:
        raise ValueError(f"{name} is no TIFF file of 32 bits")
    at = struct.unpack_from(order + "I", head, 4)[0]
    count = struct.unpack(order + "H", file.read_at(2, at))[0]
    raw, out = file.read_at(12 * count, at + 2), {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", raw, 12 * k)
        if kind in _TYPES:
            code = f"{order}{n}{_TYPES[kind]}"
            size = struct.calcsize(code)
            data = raw[12 * k + 8 : 12 * k + 8 + size] if size <= 4 else file.read_at(size, struct.unpack_from(order + "I", raw, 12 * k + 8)[0])
            out[tag] = struct.unpack(code, data)
    return order, out


class TiffSource(ranges.Ranged):
    columns = {"img_id": "string", "c": "int", "y": "int", "x": "int", "v": "double"}

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    @staticmethod
    def cut(file: pa.NativeFile, name: str, options: dict[str, str]) -> list[tuple]:
        """(first band, top, left, height, width, offset, bytes) of each strip or tile; height and width as stored."""
        _, tags = _tags(file, name)
        if tags.get(_COMPRESSION, (1,))[0] not in (_PLAIN, *_DEFLATED):
            raise ValueError(f"{name} has compression {tags[_COMPRESSION][0]}")
        width, height, samples = tags[_WIDTH][0], tags[_HEIGHT][0], tags.get(_SAMPLES, (1,))[0]
        planes = samples if tags.get(_PLANAR, (1,))[0] == 2 else 1
        if _TILE_OFFSETS in tags:
            w, h, offsets, sizes = tags[_TILE_WIDTH][0], tags[_TILE_HEIGHT][0], tags[_TILE_OFFSETS], tags[_TILE_COUNTS]
        else:
            w, h, offsets, sizes = width, min(height, tags.get(_ROWS, (height,))[0]), tags[_OFFSETS], tags[_COUNTS]
        across, down = -(-width // w), -(-height // h)
        out = []
        for k, (offset, size) in enumerate(zip(offsets, sizes)):
            plane, place = divmod(k, across * down)
            top, left = place // across * h, place % across * w
            stored = h if _TILE_OFFSETS in tags else min(h, height - top)
            if plane < planes:
                out.append((plane, top, left, stored, w, offset, size))
        return out

    @staticmethod
    def read(file: pa.NativeFile, part: tuple, name: str, number: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
        order, tags = _tags(file, name)
        plane, top, left, h, w, offset, size = part
        width, height, samples = tags[_WIDTH][0], tags[_HEIGHT][0], tags.get(_SAMPLES, (1,))[0]
        bands = 1 if tags.get(_PLANAR, (1,))[0] == 2 else samples
        bits = tags.get(_BITS, (1,))[0]
        if bits % 8:
            raise ValueError(f"{name} has {bits} bits a value")
        kind = np.dtype(f"{order}{_KINDS[tags.get(_FORMAT, (1,))[0]]}{bits // 8}")
        raw = file.read_at(size, offset)
        raw = raw if tags.get(_COMPRESSION, (1,))[0] == _PLAIN else zlib.decompress(raw)
        values = np.frombuffer(raw, dtype=kind, count=h * w * bands).reshape(h, w, bands)
        predictor = tags.get(_PREDICTOR, (1,))[0]
        if predictor == 2:
            values = np.cumsum(values, axis=1, dtype=kind.newbyteorder("="))
        elif predictor != 1:
            raise ValueError(f"{name} has predictor {predictor}")
        values = values[: height - top, : width - left]
        y, x, c = np.indices(values.shape)
        flat = {"c": c.ravel() + plane, "y": y.ravel() + top, "x": x.ravel() + left}
        every = {k: pa.array(v.astype(np.int32)) for k, v in flat.items()} | {"v": pa.array(values.astype(np.float64).ravel()), "img_id": pa.array([name] * values.size)}
        whole = pa.RecordBatch.from_arrays([every[k] for k in columns], columns)
        for at in range(0, values.size, 1 << 17):
            yield whole.slice(at, 1 << 17)


def read_geotiff(spark: SparkSession, path: str) -> DataFrame:
    """(img_id, c, y, x, v) of GeoTIFF files: the path of the file, band, row, column and value, a task for each strip or tile."""
    if not ranges.reachable(path):
        raise ValueError(f"no reader for rasters of {path}")
    spark.dataSource.register(TiffSource)
    return spark.read.format("geotiff").option("path", path).load()


def georeferences(path: str) -> list[tuple[str, float, float, float, float]]:
    """(img_id, x, y, width, height) of each file: the place of its upper left corner and the size of a cell, if it tells them."""
    out = []
    for name in ranges.files(path):
        with ranges.opened(name) as file:
            tags = _tags(file, name)[1]
        if _SCALE in tags and _TIEPOINT in tags:
            scale, tie = tags[_SCALE], tags[_TIEPOINT]
            out.append((name, tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], scale[1]))
    return out
