"""Language-model scoring with a Katz backoff n-gram model.

    P(w | h) = d(c(h,w)) * c(h,w) / c(h)     if c(h,w) >= MIN_COUNT
             = alpha(h) * P(w | h')          otherwise; h' is h without its first word
    P(w)     = d(c(w)) * c(w) / N            for words of the training texts; the rest is one unknown word's

d are Good-Turing discounts, of each order its own. All n-grams are kept, those seen once too, and alpha(h) makes the
probabilities after each h sum to exactly 1. Where nothing would be left for the backoff (no count of h is
discounted), c(h) counts one more. One start stands before a text, so histories are shorter in its first words.

Counts and backoff weights are tables of the shared folder. Words that are frequent enough to be among the `HOT` most
frequent have numbers; their counts and weights, a table of bounded size, are broadcast. Other words are looked up by
joins. So no table that grows with the input has to fit in a task, and frequent words meet in no task.

The longest n-grams are in no table. Each text sends its own, packed, to the bucket of their history. There they are counted,
and each text gets back the sum of what its seen n-grams score: all of a training text's have been seen, so it needs no
shorter ones but at its start. Held-out texts also need shorter n-grams and weights: those of their histories only are
worked out, so shorter n-grams are looked up for these alone: bigrams and those who ask for them go, packed, to the
bucket of the bigram. Orders between have tables.

Tokens of a text: its words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, then one end token.

Defined results: null and empty texts have the end token alone; rows with null ids are training rows; repeated rows
count and are scored each; without training texts every count is 0 and only the unknown word has probability. An
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotstack.llm.common import discard, documents, hash_words, materialize, mix, text_chunks

#: Rows of the broadcast table of words.
HOT = 1 << 20
#: Least count of an n-gram that is kept; counts up to DISCOUNTED are discounted.
MIN_COUNT, DISCOUNTED = 1, 5
#: Words of the query's longest n-grams.
ORDER = 3
#: Tokens of a bucket of n-grams, and entries that a task gathers before it sends them, about.
IN_BUCKET, GATHERED = 1_000_000, 1_000_000

_END = np.uint64(0x7E0F_E0D0_0000_0001)
_TOP = np.uint64(1 << 63)
_BOS = 1 << 20  # the number of what stands before the first word, beyond all words' numbers
_WIDTH = 21


@dataclass
class Model:
    """What is broadcast: frequent words by hash, their numbers, most frequent first, and by number counts, log weights and scales."""

    hashes: np.ndarray
    numbers: np.ndarray
    counts: np.ndarray
    tokens: int
    vocabulary: int
    texts: int
    word_discount: np.ndarray
    pair_discount: np.ndarray = field(default_factory=lambda: np.ones(DISCOUNTED + 1))
    log_alpha: np.ndarray | None = None
    scale: np.ndarray | None = None
    #: What discounting leaves of the words' probability.
    left: float = 0.0

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Numbers of frequent words; the hashes of others, as negative numbers."""
        different, back = np.unique(words, return_inverse=True)
        at = np.searchsorted(self.hashes, different)
        at[at == len(self.hashes)] = 0
        known = self.hashes[at] == different if len(self.hashes) else np.zeros(len(different), bool)
        return np.where(known, self.numbers[at] if len(self.hashes) else at, (different | _TOP).view(np.int64))[back]

    @cached_property
    def by_code(self) -> np.ndarray:
        """Counts by number; the last is that of text starts."""
        table = np.append(self.counts, np.zeros(_BOS + 1 - len(self.counts), np.int64))
        table[_BOS] = self.texts
        return table

    def count(self, codes: np.ndarray) -> np.ndarray:
        """Counts of frequent words and of text starts; -1 for other codes."""
        return np.where(codes >= 0, self.by_code[np.maximum(codes, 0)], -1)

    def unknown(self) -> float:
        """The unknown word's probability: what discounting leaves, or that of one more word if it leaves nothing."""
        return self.left or 1 / (self.tokens + 1)

    def word_probability(self, counts: np.ndarray) -> np.ndarray:
        """P(w) from c(w); the unknown word's for 0."""
        d = self.word_discount[np.minimum(counts, DISCOUNTED + 1)]
        whole = self.tokens if self.left else self.tokens + 1
        return np.where(counts > 0, d * counts / max(whole, 1), self.unknown())

    def bigram(self, c: np.ndarray, ch: np.ndarray, cw: np.ndarray, a: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """p, and what a bigram adds to the score of backing off."""
        p = self.pair_discount[np.minimum(c, DISCOUNTED + 1)] * c / ch * scale
        return p, np.log10(p) - a - np.log10(self.word_probability(cw))

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.vocabulary + 1)))


def discounts(of_count: dict[int, int], first: int) -> np.ndarray:
    """Good-Turing discounts by count, 1 beyond DISCOUNTED: (r + 1) n(r+1) / (r n(r)), where that is sound."""
    out = np.ones(DISCOUNTED + 2)
    for r in range(first, DISCOUNTED + 1):
        n, more = of_count.get(r, 0), of_count.get(r + 1, 0)
        if n and 0 < (r + 1) * more < r * n:
            out[r] = (r + 1) * more / (r * n)
    return out


def _small_counts(table: DataFrame) -> dict[int, int]:
    got = table.where(F.col("c") <= DISCOUNTED + 1).groupBy("c").agg(F.count("*").alias("n")).collect()
    return {r["c"]: r["n"] for r in got}


def _least_count(table: DataFrame, most: int) -> int:
    """The smallest count such that at most `most` rows have that count or more: from the counts of counts."""
    by = table.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c"))
    held = 0
    least = None
    for r in by.toLocalIterator():
        held += r["n"]
        if held > most:
            return (least or r["c"] + 1)
        least = r["c"]
    return 1


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end token after each text, and the bounds of the texts."""
    words, bounds = hash_words(data, offsets)
    words &= ~_TOP
    return np.insert(words, bounds[1:], _END), bounds + np.arange(len(bounds))


def _pairs(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The code before each token."""
    before = np.empty_like(codes)
    before[1:] = codes[:-1]
    before[bounds[:-1]] = _BOS
    return before


def pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One key for each bigram: numbers side by side, or a negative hash if either word has none."""
    rare = mix(h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w.view(np.uint64)) | _TOP
    return np.where((h >= 0) & (w >= 0), (h << _WIDTH) | np.maximum(w, 0), rare.view(np.int64))


def _ngram_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Keys of n-grams from those of their first and of their last n - 1 words."""
    return mix(h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w.view(np.uint64)).view(np.int64)


def _history_keys(h: np.ndarray) -> np.ndarray:
    """Keys of n-grams as histories: a look-up tells them from the n-grams themselves."""
    return mix(h.view(np.uint64) ^ np.uint64(0xD1B54A32D192ED03)).view(np.int64)


def _longer(keys: np.ndarray, bounds: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order from 3: keys of the first and of the last n - 1 words by token, and where the text has so many."""
    place = np.arange(len(keys)) - np.repeat(bounds[:-1], np.diff(bounds))
    for n in range(3, order + 1):
        before = np.roll(keys, 1)
        yield before, keys, place >= n - 2
        keys = _ngram_keys(before, keys)


def _packed(*columns: np.ndarray) -> bytes:
    """Whole numbers as bytes, compressed byte place by byte place; the first column, sorted, as differences."""
    columns = (np.diff(columns[0], prepend=np.int64(0)), *columns[1:])
    return pa.compress(np.concatenate([c.view(np.uint8).reshape(-1, 8).T.ravel() for c in columns]), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(packed, 8 * n * columns, codec="zstd", asbytes=True), np.uint8).reshape(columns, 8, n)
    out = [np.ascontiguousarray(c.T).reshape(-1).view(np.int64) for c in raw]
    return [np.cumsum(out[0]), *out[1:]]


def _by_bucket(buckets: int, keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The buckets of the keys that have rows, with their numbers of rows and their packed columns; keys are spread evenly."""
    bucket = (mix(keys.view(np.uint64)) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int32)
    placed = np.argsort(bucket, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
    filled = np.flatnonzero(np.diff(ends))
    return filled.astype(np.int32), np.diff(ends)[filled], [_packed(*(c[placed[ends[k] : ends[k + 1]]] for c in columns)) for k in filled]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of (keys, counts), with the sums of their counts."""
    keys = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    parts.clear()
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts[order], starts) if len(keys) else counts


def _summed_pairs(h: np.ndarray, w: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((w, h))
    h, w, counts = h[order], w[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])])) if len(h) else np.zeros(0, np.int64)
    return h[starts], w[starts], np.add.reduceat(counts, starts) if len(h) else counts


def count_words(training: DataFrame) -> DataFrame:
    """(w, c): how often each token stands in the training texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> pa.RecordBatch:
            words, c = _summed(parts)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(c)], ["w", "c"])

        for _, data, offsets in text_chunks(batches):
            parts.append(np.unique(_tokens(data, offsets)[0], return_counts=True))
            if sum(len(p[0]) for p in parts) > GATHERED:
                yield merged()
        if parts:
            yield merged()

    return training.select("text").mapInArrow(counted, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def count_pairs(training: DataFrame, model, buckets: int) -> DataFrame:
    """(h, w, c) of the bigrams seen at least MIN_COUNT times.

    Tasks add up their own bigrams and send them packed by bucket; keys are spread evenly over the buckets, and a
    frequent bigram is one entry of each task.
    """
    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        rare: list[tuple[np.ndarray, np.ndarray]] = []

        def sent() -> Iterator[pa.RecordBatch]:
            keys, c = _summed(parts)
            h, w = (np.concatenate(x) for x in zip(*rare))
            rare.clear()
            h, w, n = _summed_pairs(h, w, np.ones(len(h), np.int64))
            for plain, *columns in ((True, keys, keys, c), (False, pair_keys(h, w), h, w, n)):
                bucket, rows, packed = _by_bucket(buckets, *columns)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (bucket, np.full(len(bucket), plain), rows)), pa.array(packed, pa.binary())], ["bucket", "plain", "n", "part"])

        for _, data, offsets in text_chunks(batches):
            words, bounds = _tokens(data, offsets)
            codes = model.value.codes(words)
            before = _pairs(codes, bounds)
            keys = pair_keys(before, codes)
            plain = keys >= 0
            parts.append(np.unique(keys[plain], return_counts=True))
            rare.append((before[~plain], codes[~plain]))
            if sum(len(p[0]) for p in parts) + sum(len(p[0]) for p in rare) > GATHERED:
                yield from sent()
        if parts:
            yield from sent()

    def added(table: pa.Table) -> pa.Table:
        parts = list(zip(*(table[x].to_pylist() for x in ("plain", "n", "part"))))
        none = np.zeros(0, np.int64)
        keys, c = _summed([(none, none), *(_unpacked(p, n, 2) for plain, n, p in parts if plain)])
        h, w, rare = _summed_pairs(*map(np.concatenate, zip((none, none, none), *(_unpacked(p, n, 3) for plain, n, p in parts if not plain))))
        all_h = np.concatenate([keys >> _WIDTH, h])
        all_w = np.concatenate([keys & ((1 << _WIDTH) - 1), w])
        all_c = np.concatenate([c, rare]).astype(np.int64)
        kept = all_c >= MIN_COUNT
        return pa.table({"h": all_h[kept], "w": all_w[kept], "c": all_c[kept]})

    return training.select("text").mapInArrow(gathered, "bucket int, plain boolean, n long, part binary").groupBy("bucket").applyInArrow(added, "h long, w long, c long")


def _rare_counts(pairs: DataFrame, model, words: DataFrame) -> DataFrame:
    """Those of `pairs` with a word that has no number, with ch and cw, the counts of both words."""

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, w = (np.asarray(b.column(k)) for k in (0, 1))
            counts = [pa.array(model.value.count(x)) for x in (h, w)]
            yield pa.RecordBatch.from_arrays([*b.columns, *counts], ["h", "w", "c", "ch", "cw"])

    return (
        pairs.where("h < 0 OR w < 0").mapInArrow(looked_up, "h long, w long, c long, ch long, cw long")
        .join(words.select(F.col("code").alias("h"), F.col("c").alias("rh")), "h", "left")
        .join(words.select(F.col("code").alias("w"), F.col("c").alias("rw")), "w", "left")
        .select("h", "w", "c", F.coalesce("rh", "ch").alias("ch"), F.coalesce("rw", "cw").alias("cw"))
    )


def _counted(pairs: DataFrame, rare: DataFrame) -> DataFrame:
    """All bigrams with ch and cw, which are null where both words have numbers, and the weights of `rare`, if it has any."""
    more = [c for c in rare.columns if c not in pairs.columns]
    return pairs.where("h >= 0 AND w >= 0").select("*", *(F.lit(None).cast(rare.schema[c].dataType).alias(c) for c in more)).unionByName(rare)


def _counts_of(m: Model, b: pa.RecordBatch) -> list[np.ndarray]:
    """h, w, c, ch, cw of rows of _counted."""
    h, w, c = (np.asarray(b.column(k)) for k in range(3))
    looked_up = (np.asarray(b.column(k).fill_null(-1)) for k in (3, 4))
    return [h, w, c, *(np.where(known >= 0, known, m.count(x)) for known, x in zip(looked_up, (h, w)))]


def _probabilities(counted: DataFrame, model) -> DataFrame:
    """(h, p, low, ch) by history and batch: sums of p = d * c / c(h) and of low = P(w)."""

    def worked_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            if not b.num_rows:
                continue
            h, _, c, ch, cw = _counts_of(m, b)
            of, first, back = np.unique(h, return_index=True, return_inverse=True)
            p = m.pair_discount[np.minimum(c, DISCOUNTED + 1)] * c / ch
            sums = [np.bincount(back, x, len(of)) for x in (p, m.word_probability(cw))]
            yield pa.RecordBatch.from_arrays([*map(pa.array, (of, *sums, ch[first]))], ["h", "p", "low", "ch"])

    return counted.mapInArrow(worked_out, "h long, p double, low double, ch long")


def _gains_of(m: Model, b: pa.RecordBatch) -> list[np.ndarray]:
    """key, p and gain of rows of _counted with weights."""
    h, w, c, ch, cw = _counts_of(m, b)
    own = np.maximum(h, 0)
    a, scale = (np.asarray(b.column(k).fill_null(np.nan)) for k in (5, 6))
    a, scale = np.where(h >= 0, m.log_alpha[own], a), np.where(h >= 0, m.scale[own], scale)
    return [pair_keys(h, w), *m.bigram(c, ch, cw, a, scale)]


def _gains(counted: DataFrame, model) -> DataFrame:
    """(key, p, gain) of bigrams."""

    def worked_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*map(pa.array, _gains_of(model.value, b))], ["key", "p", "gain"])

    return counted.mapInArrow(worked_out, "key long, p double, gain double")


def _by_key(rows: DataFrame, kind: int, buckets: int, columns_of) -> DataFrame:
    """(bucket, kind, n, part): packed by the bucket of their key, what columns_of makes of batches: keys, whole numbers or doubles."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            columns = [np.concatenate(x).view(np.int64) for x in zip(*parts)]
            parts.clear()
            order = np.argsort(columns[0])
            columns = [c[order] for c in columns]
            bucket, n, part = _by_bucket(buckets, columns[0], *columns)
            return pa.RecordBatch.from_arrays([*map(pa.array, (bucket, np.full(len(n), kind, np.int32), n)), pa.array(part, pa.binary())], ["bucket", "kind", "n", "part"])

        parts: list[list[np.ndarray]] = []
        for b in batches:
            parts.append(columns_of(b))
            if sum(len(x[0]) for x in parts) > GATHERED:
                yield packed(parts)
        if parts:
            yield packed(parts)

    return rows.mapInArrow(sent, "bucket int, kind int, n long, part binary")


def look_up(asked: DataFrame, pairs: DataFrame, rare: DataFrame, model, buckets: int) -> DataFrame:
    """(of_history, id, s): what `asked` (key, id, what) gets, summed in each bucket, from the bigrams that there are.

    pairs: bigrams with their counts, of which those of words with numbers count; rare: rows of _counted of the others.
    """

    def answered(table: pa.Table) -> pa.Table:
        m = model.value
        parts = list(zip(*(table[x].to_pylist() for x in ("kind", "n", "part"))))
        read = lambda kind: [np.concatenate(x) for x in zip(*[[np.zeros(0, np.int64)] * (3 - (kind == 1)), *(_unpacked(p, n, 3 - (kind == 1)) for k, n, p in parts if k == kind)])]
        key, id_, what = read(0)
        got = []
        for kind in (1, 2):
            have, *values = read(kind)
            order = np.argsort(have)
            have = have[order]
            at = np.minimum(np.searchsorted(have, key), max(len(have) - 1, 0))
            hit = np.flatnonzero(have[at] == key) if len(have) else at[:0]
            values = [v[order[at[hit]]] for v in values]
            if kind == 1:
                h, w = key[hit] >> _WIDTH, key[hit] & ((1 << _WIDTH) - 1)
                p, gain = m.bigram(values[0], m.count(h), m.count(w), m.log_alpha[h], m.scale[h])
            else:
                p, gain = (v.view(np.float64) for v in values)
            asks = what[hit]
            got.append((asks, id_[hit], np.where(asks == _GAIN, gain, np.where(asks == _P, p, np.where(asks == _LOG_P, 1, -1) * np.log10(p)))))
        asks, id_, s = (np.concatenate(x) for x in zip(*got))
        of_history = asks == _P
        rows, back = np.unique(np.stack([of_history.astype(np.int64), id_]), axis=1, return_inverse=True) if len(s) else (np.zeros((2, 0), np.int64), s.astype(int))
        return pa.table({"of_history": rows[0] > 0, "id": rows[1], "s": np.bincount(back.ravel(), s, rows.shape[1]).astype(float)})

    column = lambda b, k: np.asarray(b.column(k))
    parts_of = (
        (asked, lambda b: [column(b, k) for k in range(3)]),
        (pairs.where("h >= 0 AND w >= 0"), lambda b: [pair_keys(column(b, 0), column(b, 1)), column(b, 2)]),
        (rare, lambda b: _gains_of(model.value, b)),
    )
    everything = reduce(DataFrame.unionByName, [_by_key(rows, kind, buckets, columns_of) for kind, (rows, columns_of) in enumerate(parts_of)])
    return everything.groupBy("bucket").applyInArrow(answered, "of_history boolean, id long, s double")


def backoff_weights(sums: DataFrame) -> DataFrame:
    """(h, a, scale): log weights, and what p has to be multiplied with where nothing was left for the backoff."""
    sums = sums.groupBy("h").agg(F.sum("p").alias("p"), F.sum("low").alias("low"), F.max("ch").alias("ch"))
    full = F.col("p") > 1 - 1e-9
    scale = F.when(full, F.col("ch") / (F.col("ch") + 1) / F.col("p")).otherwise(F.lit(1.0))
    return sums.select("h", F.log10((1 - F.col("p") * scale) / (1 - F.col("low"))).alias("a"), scale.alias("scale"))


def count_longer(training: DataFrame, model, order: int) -> DataFrame:
    """(h, w, c) of the n-grams of `order` words: keys of their first and of their last words, and counts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> pa.RecordBatch:
            h, w = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            return pa.RecordBatch.from_arrays([*map(pa.array, _summed_pairs(h, w, np.ones(len(h), np.int64)))], ["h", "w", "c"])

        for _, data, offsets in text_chunks(batches):
            words, bounds = _tokens(data, offsets)
            codes = model.value.codes(words)
            *_, (h, w, there) = _longer(pair_keys(_pairs(codes, bounds), codes), bounds, order)
            parts.append((h[there], w[there]))
            if sum(len(p[0]) for p in parts) > GATHERED:
                yield merged()
        if parts:
            yield merged()

    return training.select("text").mapInArrow(counted, "h long, w long, c long").groupBy("h", "w").agg(F.sum("c").alias("c"))


def longer_ngrams(counts: DataFrame, shorter: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """(key, p, seen, gain) of the n-grams and (key, a) of their histories, from counts and the shorter ones' (key, p).

    seen: what an n-gram adds to the score of its shorter one; gain: what it adds to the score of backing off; a: log alpha.
    """
    d = discounts(_small_counts(counts), MIN_COUNT)
    held = F.element_at(F.array(*map(F.lit, d.tolist())), (F.least("c", F.lit(DISCOUNTED + 1)) + 1).cast("int")) * F.col("c")
    both = counts.join(shorter.select(F.col("key").alias("w"), F.col("p").alias("low")), "w").select("h", "w", "c", "low")
    both = materialize(both, f"{order}-grams-with-shorter")
    discard(counts)
    ngrams = both.withColumn("held", held)
    sums = ngrams.groupBy("h").agg(F.sum("held").alias("p"), F.sum("low").alias("low"), F.sum("c").alias("ch")).withColumn("p", F.col("p") / F.col("ch"))
    scale = F.when(F.col("p") > 1 - 1e-9, F.col("ch") / (F.col("ch") + 1) / F.col("p")).otherwise(F.lit(1.0))
    alpha = (1 - F.col("p") * scale) / (1 - F.col("low"))
    weights = materialize(sums.select("h", F.log10(alpha).alias("a"), (scale / F.col("ch")).alias("scale")), f"backoff-{order}")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = _ngram_keys(np.asarray(b.column(0)), np.asarray(b.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(keys), *b.columns[2:]], ["key", "p", "seen", "gain"])

    def histories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_history_keys(np.asarray(b.column(0)))), b.column(1)], ["key", "a"])

    p = F.col("held") * F.col("scale")
    seen = F.log10(p) - F.log10("low")
    found = ngrams.join(weights, "h").select("h", "w", p.alias("p"), seen.alias("seen"), (seen - F.col("a")).alias("gain"))
    ngrams = materialize(found.mapInArrow(keyed, "key long, p double, seen double, gain double"), f"{order}-grams")
    discard(both)
    return ngrams, weights.select("h", "a").mapInArrow(histories, "key long, a double")


_DOCUMENT = "row_id long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>, pairs array<long>, longer array<long>, firsts array<long>"
#: What a bucket tells: counts of counts, texts' sums over seen n-grams, what they change where histories are full after all,
#: held-out texts' n-grams seen, histories of those not seen, and these histories' weights and n-grams.
_COUNTS, _SUMS, _OPEN, _HITS, _MISSES, _HISTORIES, _FOLLOWING, _TEXT = range(8)
#: Columns of what is told; a text has its row_id, doc_id, n_tokens, score and n_known in id, h, w, s and n.
_TOLD = "kind int, id long, h long, w long, s double, n long, held_out boolean, base double, rare array<long>, pairs array<long>, longer array<long>, firsts array<long>"
_AS_TOLD = {"row_id": "id", "doc_id": "h", "n_tokens": "w", "score": "s", "n_known": "n"}
#: Bits of each of the counts in n: how many n-grams were seen once, twice, ... DISCOUNTED times.
_BITS = 12
#: What is asked of bigrams.
_GAIN, _LOG_P, _MINUS_LOG_P, _P = range(4)


def _seen(r: int):
    return F.shiftright("n", _BITS * (r - 1)).bitwiseAND(F.lit((1 << _BITS) - 1))


def _met(table: pa.Table, sure: np.ndarray, unsure: np.ndarray) -> pa.Table:
    """What a bucket's n-grams tell. sure: by count, whether it is discounted; unsure: whether it may be."""
    parts = [(_unpacked(p, n, 3), base) for p, n, base in zip(table["part"].to_pylist(), table["n"].to_pylist(), table["base"].to_pylist())]
    w, h, row = (np.concatenate([x[k] for x, _ in parts]) for k in range(3))
    row = (row >> 1) + np.repeat([base for _, base in parts], [len(x[0]) for x, _ in parts]), (row & 1).astype(bool)
    parts.clear()
    order = np.lexsort((w, h))
    h, w, row, held = h[order], w[order], row[0][order], row[1][order]
    new_h = np.concatenate([[True], h[1:] != h[:-1]])
    new = new_h | np.concatenate([[True], w[1:] != w[:-1]])
    gram, at = np.cumsum(new) - 1, np.flatnonzero(new)
    history = (np.cumsum(new_h) - 1)[at]
    c = np.bincount(gram, ~held).astype(np.int64)
    ch = np.bincount(history, c).astype(np.int64)
    few = np.minimum(c, DISCOUNTED + 1)
    undiscounted = (ch > 0) & (np.bincount(history, sure[few]) == 0)
    mask = sum(((np.bincount(history, few == r, len(ch)) > 0) * undiscounted) << r for r in np.flatnonzero(unsure)) + np.zeros(len(ch), np.int64)
    full = undiscounted & (mask == 0)
    value = np.log10(np.maximum(c, 1)) - np.log10(np.maximum(ch + full, 1))[history]

    def told(kind: int, rows: int, **columns: np.ndarray) -> pa.Table:
        return pa.table({"kind": pa.array(np.full(rows, kind, np.int32)), **{k: pa.array(v) for k, v in columns.items()}})

    def counted(kind: int, counts: list[np.ndarray], **columns: np.ndarray) -> Iterator[pa.Table]:
        """Rows with counts in n; what doesn't fit goes on in further rows, which add nothing else than counts."""
        while True:
            part = [np.minimum(x, (1 << _BITS) - 1) for x in counts]
            yield told(kind, len(counts[0]), **columns, n=sum(x << _BITS * k for k, x in enumerate(part)))
            counts = [x - y for x, y in zip(counts, part)]
            more = np.flatnonzero(sum(counts))
            if not len(more):
                return
            counts = [x[more] for x in counts]
            key = "id" if kind == _SUMS else "h"
            columns = {k: v[more] * (k == key) for k, v in columns.items()}

    seen = c[gram] > 0
    rows, of = np.unique(row[seen], return_inverse=True)
    by_row = [np.bincount(of, few[gram[seen]] == r, len(rows)).astype(np.int64) for r in range(1, DISCOUNTED + 1)]
    may = seen & (mask[history[gram]] > 0)
    open_, of_open = np.unique(np.stack([row[may], mask[history[gram[may]]]]), axis=1, return_inverse=True)
    change = -np.log10(1 + 1 / np.maximum(ch, 1))[history[gram[may]]]
    hit, missed = held & seen, held & ~seen & (ch[history[gram]] > 0)
    asked = np.zeros(len(ch), bool)
    asked[history[gram[missed]]] = True
    following, first = asked[history] & (c > 0), at[new_h[at]]
    by_history = [np.bincount(history, few == r, len(ch)).astype(np.int64)[asked] for r in range(1, DISCOUNTED + 1)]
    of_counts = np.bincount(np.minimum(c, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1:-1]
    return pa.concat_tables(
        [
            told(_COUNTS, len(of_counts), id=np.arange(1, len(of_counts) + 1), w=of_counts),
            *counted(_SUMS, by_row, id=rows, s=np.bincount(of, value[gram[seen]], len(rows)).astype(float)),
            told(_OPEN, open_.shape[1], id=open_[0], w=open_[1], s=np.bincount(of_open.ravel(), change, open_.shape[1]).astype(float)),
            told(_HITS, hit.sum(), id=row[hit], w=w[hit]),
            told(_MISSES, missed.sum(), id=row[missed], h=h[missed]),
            # s, w and id: c(h), whether it counts one more, and the counts that tell if it does, where that is open
            *counted(_HISTORIES, by_history, h=h[first][asked], s=ch[asked].astype(float), w=full[asked].astype(np.int64), id=mask[asked]),
            told(_FOLLOWING, following.sum(), h=h[at][following], w=w[at][following]),
        ],
        promote_options="default",
    )


def meet_by_history(docs: DataFrame, model, order: int, buckets: int, sure: np.ndarray, unsure: np.ndarray) -> DataFrame:
    """Texts scored as far as the broadcast tables go, and what the buckets of their n-grams of `order` words tell."""
    score = _scorer(model, order)
    sent_schema = f"{_DOCUMENT}, bucket int, n long, base_id long, part binary"

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def gathered_parts() -> pa.RecordBatch:
            h, w, row = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            base = int(row.min()) >> 1 if len(row) else 0
            row -= base << 1
            by_w = np.argsort(w)
            bucket, n, packed = _by_bucket(buckets, h[by_w], w[by_w], h[by_w], row[by_w])
            texts = [pa.nulls(len(n), f.type) for f in texts_schema]
            return pa.RecordBatch.from_arrays([*texts, *map(pa.array, (bucket, n, np.full(len(n), base))), pa.array(packed, pa.binary())], names)

        texts_schema, names = None, None
        for text, entries in score(batches):
            texts_schema, names = text.schema, [*text.schema.names, "bucket", "n", "base_id", "part"]
            bucket = pa.array((-1 - np.asarray(text.column(0)) % buckets).astype(np.int32))
            n = len(text)
            yield pa.RecordBatch.from_arrays([*text.columns, bucket, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names)
            parts.append(entries)
            if sum(len(p[0]) for p in parts) > GATHERED:
                yield gathered_parts()
        if parts:
            yield gathered_parts()

    def gathered(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() >= 0:
            out = _met(table.select(["n", "base_id", "part"]).rename_columns(["n", "base", "part"]), sure, unsure)
        else:
            out = table.drop_columns(["bucket", "n", "base_id", "part"]).append_column("kind", pa.array(np.full(len(table), _TEXT, np.int32)))
            out = out.rename_columns([_AS_TOLD.get(c, c) for c in out.column_names])
        return pa.concat_tables([out, empty], promote_options="default").select(empty.column_names)

    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    empty = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _TOLD.split(", ")]).empty_table()
    return docs.mapInArrow(sent, sent_schema).groupBy("bucket").applyInArrow(gathered, _TOLD)


def katz_scores(docs: DataFrame, held_out, most: int = HOT, order: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    held_out: a Column; most: rows of the broadcast table, at most HOT; order: words of the longest n-grams, at least 2.
    """
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    docs = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    training = docs.where(~F.col("held_out"))

    words = materialize(count_words(training), "word-counts")
    n = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count("*").alias("vocabulary")).first()
    end = int(_END.astype(np.int64))
    texts = words.where(F.col("w") == end).agg(F.coalesce(F.max("c"), F.lit(0)).alias("c")).first()["c"]
    small = _small_counts(words)
    least = _least_count(words, most)
    hot = words.where(F.col("c") >= least).toArrow()
    hashes, counts = np.asarray(hot["w"]).astype(np.uint64), np.asarray(hot["c"]).astype(np.int64)
    by_count = np.argsort(-counts, kind="stable")
    by_hash = np.argsort(hashes)
    numbers = np.argsort(by_count)[by_hash]
    word_discount = discounts(small, 1)
    kept = n["tokens"] - sum(small.get(r, 0) * r * (1 - word_discount[r]) for r in range(1, DISCOUNTED + 1))
    base = {"hashes": hashes[by_hash], "numbers": numbers, "counts": counts[by_count], "tokens": n["tokens"], "vocabulary": n["vocabulary"]}
    base |= {"texts": texts, "word_discount": word_discount, "left": 1 - kept / max(n["tokens"], 1) if kept < n["tokens"] else 0.0}
    rare_words = words.where(F.col("c") < least).select(F.col("w").bitwiseOR(F.lit(-(2**63))).alias("code"), "c")

    buckets = max(8, -(-n["tokens"] // IN_BUCKET))
    model = send(Model(**base))
    pairs = materialize(count_pairs(training, model, buckets), "bigram-counts")
    base["pair_discount"] = discounts(_small_counts(pairs), MIN_COUNT)
    model = send(Model(**base))
    rare_pairs = materialize(_rare_counts(pairs, model, rare_words), "rare-bigrams")
    weights = materialize(backoff_weights(_probabilities(_counted(pairs, rare_pairs), model)), "backoff")

    # weights of words with numbers, and of text starts: at most HOT + 1 rows
    numbered = weights.where("h >= 0").toArrow()
    base["log_alpha"], base["scale"] = np.zeros(_BOS + 1), np.ones(_BOS + 1)
    for k, name in (("a", "log_alpha"), ("scale", "scale")):
        base[name][np.asarray(numbered["h"])] = np.asarray(numbered[k])
    model = send(Model(**base))
    rare_weights = weights.where("h < 0")
    bigrams = _counted(pairs, rare_pairs.join(rare_weights, "h", "left").select("h", "w", "c", "ch", "cw", "a", "scale"))

    tables = []
    for k in range(3, order):
        counted = materialize(count_longer(training, model, k), f"{k}-gram-counts")
        shorter, histories = longer_ngrams(counted, tables[-1][0] if tables else _gains(bigrams, model), k)
        tables.append((shorter, histories))

    numbered_docs = docs.withColumn("row_id", F.monotonically_increasing_id())
    if order == 2:
        alone = _scorer(model, order)
        scored = materialize(numbered_docs.mapInArrow(lambda batches: (text for text, _ in alone(batches)), _DOCUMENT), "scores")
    else:
        each = np.arange(DISCOUNTED + 2)
        sure, unsure = (each > 0) & (each <= 2), (each > 2) & (each <= DISCOUNTED)
        while True:
            met = materialize(meet_by_history(numbered_docs, model, order, buckets, sure, unsure), f"{order}-grams-met")
            of_counts = met.where(F.col("kind") == _COUNTS).groupBy("id").agg(F.sum("w").alias("c")).collect()
            d = discounts({r["id"]: r["c"] for r in of_counts}, MIN_COUNT)
            if not (sure & (d == 1)).any():
                break
            # so few n-grams that small counts are not discounted: again, now that it is known which are
            discard(met)
            sure, unsure = d < 1, each < 0
        scored = met.where(F.col("kind") == _TEXT).withColumnsRenamed({v: k for k, v in _AS_TOLD.items()})
        told = lambda kind: met.where(F.col("kind") == kind)

    # shorter n-grams are looked up once for all that ask for them; what a text asks for adds to its score
    ask = lambda level, table, what, id_="id", key="key": (level, table.select(F.col(key).alias("key"), F.col(id_).alias("id"), F.lit(what).cast("long").alias("what")))
    asks = [ask(2, scored.select("row_id", F.explode("pairs").alias("key")), _GAIN, "row_id")]
    if order > 2:
        firsts = scored.select("row_id", F.posexplode("firsts").alias("at", "key"))
        asks += [ask(k, firsts.where(F.col("at") == k - 2), _LOG_P, "row_id") for k in range(2, order)]
        asks += [ask(order - 1, told(_HITS), _MINUS_LOG_P, "id", "w"), ask(order - 1, told(_FOLLOWING), _P, "h", "w")]
    asked = lambda level: reduce(DataFrame.unionByName, [table for at, table in asks if at == level])
    rare = bigrams.where("h < 0 OR w < 0")
    answers = [look_up(asked(2), pairs, rare, model, buckets)]
    for k, (table, _) in enumerate(tables, 3):
        s = F.when(F.col("what") == _P, F.col("p")).otherwise(F.when(F.col("what") == _LOG_P, 1.0).otherwise(-1.0) * F.log10("p"))
        answers.append(asked(k).join(table, "key").select((F.col("what") == _P).alias("of_history"), "id", s.alias("s")))
    answers = [reduce(DataFrame.unionByName, answers).groupBy("of_history", "id").agg(F.sum("s").alias("s"))]
    answers = materialize(reduce(DataFrame.unionByName, answers), "answers")
    discard(pairs, rare_pairs)
    adds = lambda table, k=0, b=0.0: table.select("row_id", F.lit(k).cast("long").alias("k"), F.lit(b).alias("b"), "s")
    late = adds(answers.where("NOT of_history").withColumnRenamed("id", "row_id"))

    others_by_word = (
        scored.select("row_id", "held_out", F.explode("rare").alias("code"))
        .groupBy("row_id", "held_out", "code").agg(F.count("*").alias("n"))
        .join(rare_words, "code", "left")
        .join(rare_weights.select(F.col("h").alias("code"), "a"), "code", "left")
    )

    def by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            n, c, a, scores = (np.asarray(b.column(k)) for k in range(1, 5))
            parts = [n * (c > 0), n * m.base(c), scores * n * (np.log10(m.word_probability(c)) + a)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(parts[0].astype(np.int64)), *map(pa.array, parts[1:])], ["row_id", "k", "b", "s"])

    scores = (F.col("held_out") | F.lit(order == 2)).cast("long").alias("scores")
    by_words = others_by_word.select("row_id", "n", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("a", F.lit(0.0)).alias("a"), scores)
    late = late.unionByName(by_words.mapInArrow(by_word, "row_id long, k long, b double, s double"))
    for k, (ngrams, histories) in enumerate(tables, 3):
        both = ngrams.select("key", F.col("gain").alias("s")).unionByName(histories.select("key", F.col("a").alias("s")))
        late = late.unionByName(adds(scored.select("row_id", F.explode("longer").alias("key")).join(both, "key")))
    if order > 2:
        log_d = sum((_seen(r) * float(np.log10(d[r])) for r in range(1, DISCOUNTED + 1)), F.lit(0.0))
        late = late.unionByName(adds(told(_SUMS).select(F.col("id").alias("row_id"), (F.col("s") + log_d).alias("s"))))
        discounts_none = lambda mask: mask.bitwiseAND(F.lit(sum(1 << r for r in range(1, DISCOUNTED + 1) if d[r] < 1))) == 0
        late = late.unionByName(adds(told(_OPEN).where(discounts_none(F.col("w"))).select(F.col("id").alias("row_id"), "s")))
        full = F.col("w") + ((F.col("id") > 0) & discounts_none(F.col("id"))).cast("long")
        away = sum((_seen(r) * float(r * (1 - d[r])) for r in range(1, DISCOUNTED + 1)), F.lit(0.0))
        over = told(_HISTORIES).groupBy("h").agg(F.sum(away + full).alias("over"), F.sum(F.col("s") + full).alias("c"))
        low = answers.where("of_history").select(F.col("id").alias("h"), F.col("s").alias("low"))
        alpha = over.join(low, "h").select("h", F.log10(F.col("over") / F.col("c") / (1 - F.col("low"))).alias("s"))
        late = late.unionByName(adds(told(_MISSES).select(F.col("id").alias("row_id"), "h").join(alpha, "h")))
    late = late.groupBy("row_id").agg(*(F.sum(x).alias(x) for x in "kbs"))
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return scored.join(late, "row_id", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        plus("n_known", "k").alias("n_known"),
        F.lit(n["tokens"]).cast("long").alias("train_tokens"),
        plus("base", "b").alias("base_score"),
        plus("score", "s").alias("score"),
    )


def _scorer(model, order: int = 2):
    """Scores from the broadcast tables; what those don't hold is left as words, bigrams and longer n-grams to look up.

    Held-out texts are scored by bigrams, to which longer n-grams add. Training texts are scored by their longest n-grams,
    and by shorter ones in their first words: `firsts`. With each batch come its n-grams of `order` words: keys of their first
    and of their last words, and twice the row, one more for a held-out one.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        m = model.value
        by_count = m.by_code
        log_low, base = np.log10(m.word_probability(by_count)), m.base(by_count)
        for rows, data, offsets in text_chunks(batches):
            words, bounds = _tokens(data, offsets)
            codes = m.codes(words)
            before = _pairs(codes, bounds)
            texts = len(bounds) - 1
            of = np.repeat(np.arange(texts), np.diff(bounds))
            place = np.arange(len(codes)) - bounds[of]
            total = lambda x: np.bincount(of, x, texts)  # noqa: E731, B023
            has, has_before = codes >= 0, before >= 0
            at, at_before = np.where(has, codes, 0), np.where(has_before, before, 0)
            held = np.asarray(rows.column(2))[of]
            by_pairs = held | (order == 2)
            score = np.where(has, log_low[at], 0) + np.where(has_before, m.log_alpha[at_before], 0)
            keys = pair_keys(before, codes)

            def lists(values: np.ndarray, chosen: np.ndarray) -> pa.Array:
                """Lists by text of values that are chosen; a token may have several."""
                n = chosen if chosen.ndim == 1 else chosen.sum(axis=1)
                ends = np.concatenate([[0], np.cumsum(np.bincount(of, n, texts))])  # noqa: B023
                return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values[chosen]))

            found, there, firsts, first = [], [], [keys], [place == 0]
            entries = (keys[:0],) * 3
            for k, (h, w, so_long) in enumerate(_longer(keys, bounds, order), 3):
                if k == order:
                    entries = h[so_long], w[so_long], np.asarray(rows.column(3))[of[so_long]] * 2 + held[so_long]
                    break
                found += [_ngram_keys(h, w), _history_keys(h)]
                there += [so_long & held] * 2
                firsts, first = [*firsts, found[-2]], [*first, place == k - 2]
            longer = np.array(found, np.int64).reshape(-1, len(keys)).T
            chosen = np.array(there, bool).reshape(-1, len(keys)).T

            columns = [rows.column(3), rows.column(0), rows.column(2)]
            columns += [pa.array(np.diff(bounds)), pa.array(total(has).astype(np.int64))]
            columns += [pa.array(total(np.where(has, base[at], 0))), pa.array(total(np.where(by_pairs, score, 0)))]
            columns += [lists(codes, ~has), lists(keys, by_pairs), lists(longer, chosen)]
            columns += [lists(np.array(firsts).T, np.array(first).T & ~by_pairs[:, None])]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _DOCUMENT.split(", ")]), entries

    return scored


def op6_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram scores of all documents; every tenth, by checksum of the id, is held out."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    return katz_scores(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, order=ORDER)
