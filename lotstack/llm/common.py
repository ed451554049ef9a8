"""What several corpus operators share: tables in the shared folder, word hashing over Arrow text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lotstack.plans.tables import discard, materialize, shared_dir

__all__ = ["BASE", "BASE_INVERSE", "discard", "documents", "free_name", "hash_words", "materialize", "mix", "ordered_int64", "power", "shared_dir", "text_chunks"]


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("*",)))


def free_name(name: str, df: DataFrame) -> str:
    """`name`, with underscores after it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# --- word hashing -----------------------------------------------------------------------------

_RNG = np.random.default_rng(20240229)
#: One random odd multiplier for each byte value, and the base of the polynomial.
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE_LOWER = _BYTE[_LOWER]
_kept_powers: dict[int, np.ndarray] = {}


def power(base: int, n: int) -> np.ndarray:
    have = _kept_powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 19)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _kept_powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values that looks random."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ordered_int64(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as signed ones in the same order."""
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of texts, A-Z lower-cased.

    `data` holds the UTF-8 bytes of all texts and `offsets` their bounds. Returns the words' hashes in
    order and the bounds of each text's words. A word never spans two texts.
    """
    n = len(data)
    texts = len(offsets) - 1
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(texts + 1, np.int64)
    space = _SPACE[data]
    begins = np.empty(n, dtype=bool)
    begins[0] = True
    begins[1:] = space[:-1]
    inner = offsets[offsets < n]
    begins[inner] = True
    begins &= ~space
    starts = np.flatnonzero(begins)
    ends_here = np.empty(n, dtype=bool)
    ends_here[-1] = True
    ends_here[:-1] = space[1:]
    ends_here[inner[inner > 0] - 1] = True
    ends_here &= ~space
    ends = np.flatnonzero(ends_here) + 1
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_LOWER[data] * power(BASE, n), out=total[1:])
    hashes = (total[ends] - total[starts]) * power(BASE_INVERSE, n)[starts]
    hashes = mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return hashes, np.searchsorted(starts, offsets)


def text_chunks(
    batches: Iterator[pa.RecordBatch], text: str = "text", chunk_bytes: int = 1 << 19
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into runs of rows with about `chunk_bytes` of text: (rows, bytes, bounds). Null is empty.

    A text longer than that is a chunk of its own: texts are always whole.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if column.null_count:
            column = column.fill_null("")
        wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
        offsets = np.frombuffer(column.buffers()[1], dtype=wide, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
        raw = column.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        at, n = 0, len(column)
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + chunk_bytes, side="right")) - 1)
            to = min(to, n)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
        del column, data, raw
        pa.default_memory_pool().release_unused()
