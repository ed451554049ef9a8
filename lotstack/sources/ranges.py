"""Files of fixed layout, read range by range: a Python data source deals one file to many tasks.

Tasks open files through Arrow's file systems (local paths and what its URIs reach); a path of another store is read whole,
file by file, through Spark's own reader.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Schemes whose files Arrow opens by itself.
SCHEMES = ("", "file", "hdfs", "s3", "gs")


def reachable(path: str) -> bool:
    return (re.match(r"([a-z][a-z0-9+.-]*)://?", path) or [None, ""])[1] in SCHEMES


def opened(path: str) -> pa.NativeFile:
    fs, inner = pyarrow.fs.FileSystem.from_uri(path) if re.match("[a-z][a-z0-9+.-]*:/", path) else (pyarrow.fs.LocalFileSystem(), path)
    return fs.open_input_file(inner)


def files(path: str) -> list[str]:
    """The files of a path, in the order of their names: a file, a folder's files, or those of a pattern of its last part."""
    scheme = re.match("[a-z][a-z0-9+.-]*:/", path)
    fs, inner = pyarrow.fs.FileSystem.from_uri(path) if scheme else (pyarrow.fs.LocalFileSystem(), path)
    back = (lambda p: f"{path[: path.index(inner)]}{p}") if scheme else (lambda p: p)
    info = fs.get_file_info(inner)
    if info.type == pyarrow.fs.FileType.File:
        return [path]
    folder, pattern = (inner, r"[^_.].*") if info.type == pyarrow.fs.FileType.Directory else (posixpath.dirname(inner), "")
    if not pattern:
        pattern = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in posixpath.basename(inner))
    found = fs.get_file_info(pyarrow.fs.FileSelector(folder))
    named = sorted(f.path for f in found if f.type == pyarrow.fs.FileType.File and re.fullmatch(pattern, posixpath.basename(f.path)))
    if not named:
        raise FileNotFoundError(path)
    return [back(p) for p in named]


@dataclass
class Range(InputPartition):
    """What one task reads: `number` is the file's place among all."""

    file: str
    number: int
    part: tuple


class Ranged(DataSource):
    """A format of its own says how a file is cut (`cut`) and a part is read (`read`): both get the open file."""

    columns: dict[str, str]

    @staticmethod
    def cut(file: pa.NativeFile, name: str, options: dict[str, str]) -> list[tuple]:
        raise NotImplementedError

    @staticmethod
    def read(file: pa.NativeFile, part: tuple, name: str, number: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def wanted(self) -> list[str]:
        told = self.options.get("columns")
        return told.split(",") if told else list(self.columns)

    def schema(self) -> str:
        return ", ".join(f"{c} {self.columns[c]}" for c in self.wanted())

    def reader(self, schema) -> DataSourceReader:
        return RangedReader(type(self), dict(self.options), self.wanted())


class RangedReader(DataSourceReader):
    def __init__(self, kind: type[Ranged], options: dict[str, str], columns: list[str]):
        self.kind, self.options, self.columns = kind, options, columns

    def partitions(self) -> list[Range]:
        out = []
        for number, name in enumerate(files(self.options["path"])):
            with opened(name) as file:
                out += [Range(name, number, part) for part in self.kind.cut(file, name, self.options)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with opened(partition.file) as file:
            yield from self.kind.read(file, partition.part, partition.file, partition.number, self.columns)
