"""Benchmark decontamination by spaced-seed hashing.

A spaced seed is a fixed mask over a window of tokens: the positions it ignores may differ, so a window still
matches when a word there was substituted. Hashes of all masked windows of the texts are looked up among those of
the benchmark items; each hit names a text, an item and a diagonal (how the item lies against the text), and the
overlap along that diagonal is then verified token by token.

Verification counts an item's tokens that stand at their place, inside windows of `SPAN` tokens of which at least
`LEAST_IN_WINDOW` agree, over all hit diagonals (an insertion moves the rest of a passage to another diagonal). A
text is contaminated by an item when that covers at least `LEAST_COVERED` of the item's tokens, or when one diagonal
has at least `LONG_OVERLAP` such tokens, whatever share of the item they are. Items shorter than a window have to
stand with at most one word substituted, found by masks that ignore one place each; punctuation at the edges of words
doesn't count there. Items of fewer than `LEAST_TOKENS` tokens are no evidence.

Hashes are joined inside the tasks: the benchmark's index is broadcast in blocks of at most `BLOCK_TOKENS` tokens (one
item at least), counted as they are read, and a larger benchmark takes one pass over the texts for each block. Equal
stretches of a text that lie along diagonals of one item are verified once, so repeated passages cost little.

Defined results: null and empty texts or items match nothing; null item ids are kept as null, ids of other types as they are; equal items each
match; repeated rows are each searched; an empty table on either side gives an empty result. Rows are kept whole
by `decontaminated`, whatever their columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lotstack.llm.common import BASE, BASE_INVERSE, hash_words, mix, power, text_chunks

#: Fixed masks: 1 is looked at, 0 ignored. Each has weight 8 and span 12.
MASKS = ("111010010111", "110110100111", "111001011011", "101101110101")
SPAN = 12
LEAST_IN_WINDOW, LEAST_COVERED, LEAST_TOKENS = 8, 0.5, 5
#: Agreeing tokens of one diagonal that contaminate by themselves.
LONG_OVERLAP = 13
#: Tokens of benchmark items that are broadcast at once.
BLOCK_TOKENS = 2_000_000

_STEP = [pow(0x9E3779B97F4A7C15, k + 1, 2**64) | 1 for k in range(SPAN)]


_SPACE, _PUNCTUATION = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PUNCTUATION[list(rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~""")] = True


def without_edges(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts with blanks for the punctuation at the edges of words: ASCII, dashes, quotes and dots of other scripts."""
    n = len(data)
    if not n:
        return data
    marked = _PUNCTUATION[data]
    wide = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80) & (data[2:] >= 0x90) & (data[2:] <= 0xA7))
    angled = np.flatnonzero((data[:-1] == 0xC2) & ((data[1:] == 0xAB) | (data[1:] == 0xBB)))
    for at, size in ((wide, 3), (angled, 2)):
        for k in range(size):
            marked[at + k] = True
    bound = np.zeros(n + 1, bool)
    bound[offsets] = True
    bound[[0, n]] = True
    beside = np.concatenate([[False], marked, [False]])
    starts = np.flatnonzero(marked & (~beside[:-2] | bound[:-1]))
    ends = np.flatnonzero(marked & (~beside[2:] | bound[1:])) + 1
    edge = bound[starts] | _SPACE[data[starts - 1]] | bound[ends] | _SPACE[data[np.minimum(ends, n - 1)]]
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, starts[edge], 1)
    np.add.at(inside, ends[edge], -1)
    return np.where(inside.cumsum()[:-1] > 0, np.uint8(0x20), data)


def masked_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """A hash of each window of SPAN words, of the positions that the mask looks at."""
    n = len(words) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            total += words[k : k + n] * np.uint64(_STEP[k])
    return mix(total)


class Index:
    """The masked windows of a block of items, and the whole of those shorter than a window, with a place ignored too."""

    def __init__(self, items: list[tuple[int | None, str]]):
        data = "\n".join(t for _, t in items).encode()
        ends = np.cumsum([len(t.encode()) + 1 for _, t in items]) if items else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.minimum(ends, len(data))]).astype(np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)
        words, bounds = hash_words(raw, offsets)
        self.ids = [i for i, _ in items]
        self.words = [words[bounds[k] : bounds[k + 1]] for k in range(len(items))]
        self.seeds = []
        for mask in MASKS:
            parts = [masked_hashes(w, mask) for w in self.words]
            self.seeds.append((mask, *self._table([(h, k) for k, h in enumerate(parts)])))
        self.short: list[tuple[int, np.ndarray, np.ndarray]] = []
        for n in range(LEAST_TOKENS, SPAN):
            whole = [(self._whole(w, n), k) for k, w in enumerate(self.words) if len(w) == n]
            if whole:
                hashes, items_at, _ = self._table(whole)
                self.short.append((n, hashes, items_at))
        bare, bare_bounds = hash_words(without_edges(raw, offsets), offsets)
        self.bare = [bare[bare_bounds[k] : bare_bounds[k + 1]] for k in range(len(items))]
        self.near: list[tuple[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]] = []
        for n in range(LEAST_TOKENS, SPAN):
            of_n = [k for k, w in enumerate(self.bare) if len(w) == n and len(self.words[k]) < SPAN]
            if of_n:
                tables = [self._table([(next(self._ignoring(self.bare[k], n, (j,))), k) for k in of_n])[:2] for j in range(n)]
                self.near.append((n, [(h, item, np.array([self.bare[k][j] for k in item])) for j, (h, item) in enumerate(tables)]))

    @staticmethod
    def _ignoring(words: np.ndarray, n: int, places) -> Iterator[np.ndarray]:
        """For each of `places`: a hash of each window of n words, of all its words but that one."""
        count = max(len(words) - n + 1, 0)
        total = np.zeros(count, np.uint64)
        for k in range(n if count else 0):
            total += words[k : k + count] * np.uint64(_STEP[k])
        for j in places:
            yield mix(total - words[j : j + count] * np.uint64(_STEP[j])) if count else total

    @staticmethod
    def _whole(words: np.ndarray, n: int) -> np.ndarray:
        count = len(words) - n + 1
        total = np.zeros(max(count, 0), np.uint64)
        for k in range(n if count > 0 else 0):
            total += words[k : k + count] * np.uint64(_STEP[k])
        return mix(total)

    @staticmethod
    def _table(parts: list[tuple[np.ndarray, int]]):
        hashes = np.concatenate([h for h, _ in parts]) if parts else np.zeros(0, np.uint64)
        item = np.concatenate([np.full(len(h), k) for h, k in parts]) if parts else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(h)) for h, _ in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        return hashes[order], item[order], place[order]

    def search(self, data: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], float]:
        """{(text, item): share of the item's tokens that are covered} of the items that contaminate a run of texts."""
        words, bounds = hash_words(data, offsets)
        ends = bounds[1:]
        text_of = lambda at: np.searchsorted(ends, at, side="right")
        whole = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power(BASE, len(words)))])
        lengths = np.array([len(w) for w in self.words], np.int64)
        diagonals: dict[int, tuple[int, int, int]] = {}
        for mask, hashes, item, place in self.seeds:
            for at, entry in _matches(masked_hashes(words, mask), hashes):
                text = text_of(at)
                inside = at + SPAN <= ends[text]
                at, entry, text = at[inside], entry[inside], text[inside]
                start = at - place[entry]
                # what lies along the diagonal: equal stretches of a text are verified once for an item
                first, last = np.maximum(start, bounds[text]), np.minimum(start + lengths[item[entry]], ends[text])
                stretch = (whole[last] - whole[first]) * power(BASE_INVERSE, len(words))[first] + (first - start).astype(np.uint64)
                keys = mix(mix(stretch + mix(text.astype(np.uint64))) + item[entry].astype(np.uint64))
                keys, one = np.unique(keys, return_index=True)
                for key, k in zip(keys.tolist(), one.tolist()):
                    if key not in diagonals:
                        diagonals[key] = int(text[k]), int(item[entry[k]]), int(start[k])
        covered: dict[tuple[int, int], np.ndarray] = {}
        long: set[tuple[int, int]] = set()
        for text, item, start in diagonals.values():
            found = self._agreeing(words, int(bounds[text]), int(ends[text]), self.words[item], start)
            if found.sum() >= LONG_OVERLAP:
                long.add((text, item))
            have = covered.get((text, item))
            covered[text, item] = found if have is None else have | found
        out = {key: share for key, c in covered.items() if (share := float(c.mean())) >= LEAST_COVERED or key in long}
        if self.near:
            self._search_near(without_edges(data, offsets), offsets, out)
        for n, hashes, item in self.short:
            for at, entry in _matches(self._whole(words, n), hashes):
                text = text_of(at)
                inside = at + n <= ends[text]
                pairs = np.unique(text[inside] * len(self.ids) + item[entry[inside]])
                out.update((divmod(pair, len(self.ids)), 1.0) for pair in pairs.tolist())
        return out

    def _search_near(self, data: np.ndarray, offsets: np.ndarray, out: dict[tuple[int, int], float]) -> None:
        """Add the short items that stand with at most one word substituted."""
        words, bounds = hash_words(data, offsets)
        ends = bounds[1:]
        for n, tables in self.near:
            for j, (found, (hashes, item, ignored)) in enumerate(zip(self._ignoring(words, n, range(n)), tables)):
                for at, entry in _matches(found, hashes):
                    text = np.searchsorted(ends, at, side="right")
                    inside = at + n <= ends[text]
                    at, entry, text = at[inside], entry[inside], text[inside]
                    same = (words[at + j] == ignored[entry]).astype(np.int64)
                    pairs = np.unique((text * len(self.ids) + item[entry]) * 2 + same)
                    for pair, equal in zip((pairs // 2).tolist(), (pairs % 2).tolist()):
                        key = divmod(pair, len(self.ids))
                        out[key] = max(1.0 if equal else (n - 1) / n, out.get(key, 0.0))

    @staticmethod
    def _agreeing(words: np.ndarray, first: int, last: int, item: np.ndarray, start: int) -> np.ndarray:
        """Which of the item's tokens stand at their place, in windows that agree well."""
        a, b = max(0, first - start), min(len(item), last - start)
        equal = np.zeros(len(item), dtype=np.int64)
        equal[a:b] = item[a:b] == words[start + a : start + b]
        sums = np.concatenate([[0], equal.cumsum()])
        good = np.flatnonzero(sums[SPAN:] - sums[:-SPAN] >= LEAST_IN_WINDOW)
        edge = np.zeros(len(item) + 1, dtype=np.int64)
        np.add.at(edge, good, 1)
        np.add.at(edge, good + SPAN, -1)
        return (edge.cumsum()[:-1] > 0) & (equal > 0)


def _matches(hashes: np.ndarray, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in `hashes`, entries of the sorted `table`) that are equal; equal entries come in turn."""
    if not len(table) or not len(hashes):
        return
    low = np.uint64(0xFFFF)
    maybe = np.zeros(1 << 16, dtype=bool)
    maybe[(table & low).astype(np.int64)] = True
    at = np.flatnonzero(maybe[(hashes & low).astype(np.int64)])
    entry = np.searchsorted(table, hashes[at])
    while len(at):
        ok = entry < len(table)
        ok[ok] = table[entry[ok]] == hashes[at[ok]]
        at, entry = at[ok], entry[ok]
        if len(at):
            yield at, entry
        entry = entry + 1


def _indexes(benchmark: DataFrame) -> Iterator[Broadcast]:
    """The benchmark's index, broadcast in blocks: items are read one partition after another, one block is held at once."""
    context = benchmark.sparkSession.sparkContext
    block: list[tuple] = []
    held, sent = 0, False
    for r in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        size = len(r["text"].split())
        if block and held + size > BLOCK_TOKENS:
            yield context.broadcast(Index(block))
            block, held, sent = [], 0, True
        block.append((r["item_id"], r["text"]))
        held += size
    if block or not sent:
        yield context.broadcast(Index(block))


def overlaps(docs: DataFrame, benchmark: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(the docs' `columns`, item_id, covered): each text and each item that contaminates it."""
    keys = [f for f in docs.schema.fields if f.name in columns]
    schema = T.StructType([*keys, T.StructField("item_id", benchmark.schema["item_id"].dataType), T.StructField("covered", T.DoubleType())])
    kind = to_arrow_type(schema["item_id"].dataType)
    out = None
    for index in _indexes(benchmark):

        def found(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for rows, data, offsets in text_chunks(batches):
                met = sorted((t, k, c) for (t, k), c in index.value.search(data, offsets).items())
                if met:
                    own = rows.take(pa.array([t for t, _, _ in met])).columns[:-1]
                    ids = pa.array([index.value.ids[k] for _, k, _ in met], kind)
                    yield pa.RecordBatch.from_arrays([*own, ids, pa.array([c for _, _, c in met])], schema.names)

        part = docs.select(*(f.name for f in keys), "text").mapInArrow(found, schema)
        out = part if out is None else out.unionAll(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that no item contaminates."""
    for index in _indexes(benchmark):

        def kept(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for rows, data, offsets in text_chunks(batches):
                bad = {t for t, _ in index.value.search(data, offsets)}
                yield rows if not bad else rows.filter(pa.array([t not in bad for t in range(rows.num_rows)]))

        docs = docs.mapInArrow(kept, docs.schema)
    return docs


def op7_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages, with the items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
