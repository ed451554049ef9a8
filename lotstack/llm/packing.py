"""Best-fit packing with large-item matching.

Texts become token ids (the tokenizer's, then one end id); longer ones are cut into pieces of the capacity, the
first piece taking the remainder. How many pieces there are of each size decides the packing: pieces of one size
are interchangeable. So the plan is made over the counts by size (at most `capacity` rows, at any input size):

* pieces above a third of the capacity go at most two to a sequence: the largest is matched with the largest that
  still fits beside it, again and again;
* smaller pieces, largest first, go to the tightest gap that takes them, and to new sequences once none does.

A plan says which places of which sequences the pieces of a size take, as ranges of ranks. Ranks within a size come
from salted windows: rank in the salt plus the counts of earlier salts, so a size that many pieces share is spread.

Defined results: a null or empty text is one piece that holds the end id alone; repeated rows are packed each;
rows with equal or null ids are ranked in any order, which changes their places alone. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from lotstack.llm.common import BASE, BASE_INVERSE, materialize, power, text_chunks

END_ID = 0
CAPACITY = 2048
#: Pieces of one size and salt, about, and the fewest salts.
IN_SALT, LEAST_SALTS = 50_000, 256
#: Bytes of a run of texts that are encoded together, about.
RUN_BYTES = 1 << 21

# The classes of the byte-level tokenizer's own splitting pattern, for U+0000 to U+017F and U+2010 to U+2027.
_LETTERS = [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xB5, 0xB5), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x17F)]
_DIGITS = [(0x30, 0x39), (0xB2, 0xB3), (0xB9, 0xB9), (0xBC, 0xBE)]
_BLANKS = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0)]
_SIGNS = (0x2010, 0x2027)
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

_LETTER, _DIGIT, _SIGN, _BLANK, _OTHER = range(5)
_CLASS = np.full(0x2028, _OTHER, np.uint8)
_CLASS[:0x180] = _SIGN
_CLASS[_SIGNS[0] : _SIGNS[1] + 1] = _SIGN
for _kind, _ranges in ((_LETTER, _LETTERS), (_DIGIT, _DIGITS), (_BLANK, _BLANKS)):
    for _first, _last in _ranges:
        _CLASS[_first : _last + 1] = _kind
_WEIGHT = np.random.default_rng(7).integers(1, 2**63, len(_CLASS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def split_starts(chars: np.ndarray, kind: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the strings begin that the tokenizer splits texts into, before it looks for tokens.

    chars: code points of all texts; kind: their classes; begins: where each text begins. Strings are runs of one class
    with the blank before them; of several blanks the last goes with what follows; `'s` and its like stand alone.
    """
    n = len(chars)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[begins] = True
    last[:-1] = first[1:]
    last[-1] = True
    changed = np.ones(n, bool)
    changed[1:] = kind[1:] != kind[:-1]
    run = first | changed
    blank, space = kind == _BLANK, chars == 0x20
    after_space = np.zeros(n, bool)
    after_space[1:] = space[:-1]
    after_space &= ~first
    before_other = np.zeros(n, bool)
    before_other[:-1] = ~blank[1:]
    starts = np.where(blank, run | (before_other & ~last), run & ~after_space)
    quote = np.flatnonzero((chars == 0x27) & run & ~after_space & ~last)
    if len(quote):
        ends = np.append(begins[1:], n)[np.searchsorted(begins, quote, side="right") - 1]
        for ending in _ENDINGS:
            at = quote[quote + len(ending) < ends]
            for k, letter in enumerate(ending, 1):
                at = at[chars[at + k] == ord(letter)]
            starts[at + 1] = False
            after = at + len(ending) + 1
            after = after[after < n]
            starts[after[kind[after] == _LETTER]] = True
    return np.flatnonzero(starts)


class Encoder:
    """Token ids of whole texts. Each different string that the tokenizer splits off is encoded once in a run of texts.

    Strings are told apart by 64-bit hashes and merged by the tokenizer's own ranks: that a pair's rank is that of the
    token it makes is checked. Texts with characters beyond the classes above, or with special tokens, and tokenizers
    of other kinds go to the tokenizer whole.
    """

    #: What separates strings to be encoded: no text that is split here has it, so it gets an id of its own.
    SEPARATOR, SEPARATOR_ID = "\ue000", 2**31 - 1

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        split = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        model = told["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        made = ["".join(m) for m in pairs]
        in_order = len(set(made)) == len(made) and sorted(made, key=lambda t: model["vocab"].get(t, -1)) == made
        splits = told["normalizer"] is None and split.items() <= (told["pre_tokenizer"] or {}).items()
        self.merger = None
        if in_order and splits and model["type"] == "BPE":
            plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
            byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
            ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if all(c in byte for c in t)}
            ranks[self.SEPARATOR.encode()] = self.SEPARATOR_ID
            self.merger = tiktoken.Encoding("pieces", pat_str=f"{self.SEPARATOR}|[^{self.SEPARATOR}]+", mergeable_ranks=ranks, special_tokens={})

    def _encoded(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each string begin, how many there are, and the ids."""
        ids = np.array(self.merger.encode_ordinary(self.SEPARATOR.join(strings)), np.int64)
        breaks = np.flatnonzero(ids == self.SEPARATOR_ID)
        begins = np.concatenate([[0], breaks + 1])
        return begins, np.append(breaks, len(ids)) - begins, ids.astype("<u4")

    def encode_run(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a run: UTF-8 bytes of all texts, and their bounds."""
        whole = data.tobytes().decode()
        chars = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        bounds = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        out = [np.zeros(0, "<u4")] * (len(offsets) - 1)
        if not len(chars):
            return out
        kind = _CLASS[np.minimum(chars, len(_CLASS) - 1)]
        kind[chars >= len(_CLASS)] = _OTHER
        alone = np.full(len(out), self.merger is None)
        alone[np.searchsorted(bounds, np.flatnonzero(kind == _OTHER), side="right") - 1] = True
        if any(s in whole for s in self.special):
            alone |= [any(s in whole[a:b] for s in self.special) for a, b in zip(bounds, bounds[1:])]
        for k in np.flatnonzero(alone):
            out[k] = np.array(self.tokenizer.encode(whole[bounds[k] : bounds[k + 1]], add_special_tokens=False).ids, "<u4")
        if alone.all():
            return out
        filled = bounds[:-1][np.diff(bounds) > 0]
        starts = split_starts(chars, kind, filled)
        total = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(_WEIGHT[np.minimum(chars, len(_WEIGHT) - 1)] * power(BASE, len(chars)), out=total[1:])
        ends = np.append(starts[1:], len(chars))
        text = np.searchsorted(bounds, starts, side="right") - 1
        if alone.any():
            kept = ~alone[text]
            starts, ends, text = starts[kept], ends[kept], text[kept]
        if not len(starts):
            return out
        hashes = (total[ends] - total[starts]) * power(BASE_INVERSE, len(chars))[starts] + (ends - starts).astype(np.uint64)
        codes, distinct = pd.factorize(hashes)
        one = np.empty(len(distinct), np.int64)
        one[codes[::-1]] = np.arange(len(codes))[::-1]
        begins, lengths, ids = self._encoded([whole[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist())])
        lengths = lengths[codes]
        until = lengths.cumsum()
        ids = ids[np.repeat(begins[codes] - until + lengths, lengths) + np.arange(until[-1])]
        cuts = np.concatenate([[0], until])[np.searchsorted(text, np.arange(len(out) + 1))]
        for k in np.flatnonzero(~alone):
            out[k] = ids[cuts[k] : cuts[k + 1]]
        return out

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        data = np.frombuffer(text.encode(), np.uint8)
        return self.encode_run(data, np.array([0, len(data)]))[0].tobytes()


_encoders: dict[str, Encoder] = {}


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) and, if wanted, `ids`: the pieces of all whole texts."""
    schema = T.StructType([*PIECES.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]) if keep_ids else PIECES

    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        encoder, end = _encoders[tokenizer], np.array([END_ID], dtype="<u4").tobytes()
        for rows, data, offsets in text_chunks(batches, chunk_bytes=RUN_BYTES):
            out: list[tuple] = []
            for doc_id, body in zip(rows.column(0).to_pylist(), encoder.encode_run(data, offsets)):
                ids = body.tobytes() + end
                total = len(ids) // 4
                first = total % capacity or capacity
                bounds = [0, *range(first, total + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    own = ids[4 * a : 4 * b]
                    row = (doc_id, k, a, b - a, zlib.crc32(own))
                    out.append((*row, np.frombuffer(own, dtype="<i4")) if keep_ids else row)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], schema.names)

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, end rank, first sequence, offset): the places that the pieces of each size take.

    The pieces of ranks first..end-1 of a size go to as many consecutive sequences, at the same offset.
    """
    left = dict(counts)
    sizes = sorted(left)
    groups: list[tuple[int, tuple[int, ...]]] = []  # (sequences, sizes in each)
    large = [s for s in sizes if 3 * s > capacity]
    while large:
        a = large[-1]
        partner = next((b for b in reversed(large) if a + b <= capacity and (b != a or left[b] > 1)), None)
        if partner is None:
            groups.append((left[a], (a,)))
            left[a] = 0
        else:
            n = left[a] // 2 if partner == a else min(left[a], left[partner])
            groups.append((n, (a, partner)))
            left[a] -= n
            left[partner] -= n
        large = [s for s in large if left[s]]
    gaps: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    free: list[int] = []
    done: list[tuple[int, tuple[int, ...]]] = []

    def put(n: int, own: tuple[int, ...]) -> None:
        gap = capacity - sum(own)
        if not gap:
            done.append((n, own))
            return
        if not gaps.get(gap):
            insort(free, gap)
        gaps.setdefault(gap, []).append((n, own))

    for n, own in groups:
        put(n, own)
    for s in reversed([s for s in sizes if 3 * s <= capacity]):
        while left[s]:
            k = bisect_left(free, s)
            gap = free[k] if k < len(free) else capacity
            if k < len(free):
                n, own = gaps[gap].pop()
                if not gaps[gap]:
                    free.pop(k)
            else:
                n, own = -(-left[s] // (capacity // s)), ()
            each = gap // s
            full = min(n, left[s] // each)
            rest = left[s] - full * each if full < n else 0
            if full:
                put(full, own + (s,) * each)
            if rest:
                put(1, own + (s,) * rest)
            if n - full - bool(rest):
                put(n - full - bool(rest), own)
            left[s] -= full * each + rest
    rank = dict.fromkeys(sizes, 0)
    out, sequence = [], 0
    for n, own in done + [g for gap in free for g in gaps[gap]]:
        if not own:
            continue
        offset = 0
        for s in own:
            out.append((s, rank[s], rank[s] + n, sequence, offset))
            rank[s] += n
            offset += s
        sequence += n
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` with `sequence_id` and `offset`. Each row has a number, so equal rows are spread over the salts too."""
    spark = pieces.sparkSession
    numbered = materialize(pieces.withColumn("_at", F.monotonically_increasing_id()), "pieces")
    salts = max(LEAST_SALTS, numbered.count() // IN_SALT)
    salted = numbered.withColumn("_salt", F.pmod(F.xxhash64("_at"), F.lit(salts)).cast("int"))
    by = materialize(salted.groupBy("length", "_salt").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in by.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.createDataFrame(
        plan(counts, capacity), "length long, first_rank long, end_rank long, first_sequence long, offset long"
    )
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    before = by.select("length", "_salt", F.coalesce(earlier, F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "_at")) - 1
    ranked = salted.withColumn("_local", local).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_local") + F.col("_before"))
    # the plan's rows are bounded by the capacity, not by the input
    return (
        ranked.join(F.broadcast(places), "length")
        .where((F.col("_rank") >= F.col("first_rank")) & (F.col("_rank") < F.col("end_rank")))
        .withColumn("sequence_id", F.col("first_sequence") + F.col("_rank") - F.col("first_rank"))
        .drop("_at", "_salt", "_local", "_before", "_rank", "first_rank", "end_rank", "first_sequence")
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
