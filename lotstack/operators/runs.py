"""Numpy over many small groups of rows: groups come as runs of sorted rows, many to a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

Added = tuple[np.ndarray, dict[str, np.ndarray]]


def per_run(rows: DataFrame, keys: tuple[str, ...], passed: list[str], function: Callable[[dict[str, np.ndarray]], Added], added: str) -> DataFrame:
    """(passed…, added…): `function` of the columns of each group of equal keys tells the rows that stay, and their new columns.

    A new column of two axes is one of arrays. Rows are sorted in their partition, so a task holds a batch and the group that
    goes on beyond it, and a group costs no call of its own between Spark and Python.
    """
    numbers = [c for c in rows.columns if c not in keys or dict(rows.dtypes)[c] != "string"]

    def done(table: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
        columns = {c: table.column(c).to_numpy() for c in numbers}
        stay, made = [], []
        for start, stop in zip(bounds, bounds[1:]):
            kept, new = function({c: v[start:stop] for c, v in columns.items()})
            stay.append(kept + start)
            made.append(new)
        out = {c: table.column(c).combine_chunks().take(pa.array(np.concatenate(stay))) for c in passed}
        for c in made[0]:
            v = np.concatenate([new[c] for new in made])
            out[c] = pa.array(v) if v.ndim == 1 else pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))
        return pa.RecordBatch.from_pydict(out)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            if table.num_rows:
                change = np.zeros(table.num_rows - 1, dtype=bool)
                for key in keys:
                    column = table.column(key).combine_chunks()
                    change |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
                bounds = np.concatenate([[0], np.flatnonzero(change) + 1])
                if len(bounds) > 1:
                    yield done(table, bounds)
                rest = table.slice(bounds[-1])
        if rest is not None and rest.num_rows:
            yield done(rest, np.array([0, rest.num_rows]))

    kinds = dict(rows.dtypes)
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(mapped, ", ".join([*(f"{c} {kinds[c]}" for c in passed), added]))


def whole_runs(rows: DataFrame, key: str | tuple[str, ...], function: Callable[[pa.Table, np.ndarray], pa.RecordBatch], schema: str, parts: int | None = None) -> DataFrame:
    """`function` of whole groups of equal `key` (one column or several), many at once, with the number of each row's group: (table, numbers) to a batch.

    Groups are sorted in their partition, of which there are `parts` if that is given; a task holds a batch and the group that goes on beyond it.
    """

    keys = (key,) if isinstance(key, str) else key

    def numbered(table: pa.Table) -> np.ndarray:
        other = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
        for name in keys:
            column = table.column(name).combine_chunks()
            apart = pc.not_equal(column.slice(1), column.slice(0, max(len(column) - 1, 0)))
            # nulls come first, and are one group
            other |= pc.fill_null(apart, pa.scalar(False)).to_numpy(zero_copy_only=False)
            other |= np.diff(column.is_null().to_numpy(zero_copy_only=False).astype(int)).astype(bool)
        return np.concatenate([[0], np.cumsum(other)])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = [batch.column(name)[batch.num_rows - 1].as_py() for name in keys]
            waiting.append(pa.Table.from_batches([batch]))
            if last is None or ends != last[0]:
                table = pa.concat_tables(waiting)
                number = numbered(table)
                cut = int(np.searchsorted(number, number[-1]))
                if cut:
                    yield function(table.slice(0, cut), number[:cut])
                waiting, last = [table.slice(cut)], (ends,)
        if waiting:
            table = pa.concat_tables(waiting)
            yield function(table, numbered(table))

    return rows.repartition(*([parts] if parts else []), *keys).sortWithinPartitions(*keys).mapInArrow(mapped, schema)
