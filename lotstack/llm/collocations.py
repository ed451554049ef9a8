"""Phrase collocation mining with hashed pruning (PCY, and DHP's counting of the next length).

Texts are cut into pieces, pieces into words, and a phrase is a run of words within one piece. Pass 1 counts words; pass k
counts phrases of k words, and only those that may be frequent: both of their parts of k - 1 words are frequent (Apriori),
and so is the bucket that the pass before counted them in, together with all others that fall there. Each pass also counts
the buckets of the next length, for phrases whose two parts have survived. What is frequent reaches the tasks as bitmaps
of `bucket_bits` bits, at most 8 MiB each whatever the input; a bit that is set by chance costs a count, never a result.

Words are 64-bit hashes in between, and two words of one hash are noticed where words are counted: the job then starts anew
with another seed, so that results never rest on a hash. Counts are combined within tasks before they are shuffled.

Defined results: a null text is empty, a null lang is `und`; texts without words add nothing; repeated rows and ids count
each; an empty table gives an empty result; extra columns are ignored. Scores are exact while 1000 * a * n has 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotstack.llm.common import BASE, BASE_INVERSE, discard, documents, materialize, mix, power, text_chunks

LONGEST, AT_LEAST, TOP = 5, 100, 2000
#: Bits of a bucket number, at least and at most; bytes of text for each bucket.
LEAST_BITS, MOST_BITS, BYTES_PER_BUCKET = 12, 26, 128
#: Buckets of one row of counters.
SLICE = 1 << 16
#: Rows that a task holds back to combine them.
HELD = 1 << 20
_SALTS = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CUBES = _LOWER.astype(np.int64) ** 3
_CUTS = np.zeros(256, dtype=bool)
_CUTS[list(b".,;:!?\n\x0b\x0c\r")] = True
_SPACE = _CUTS.copy()
_SPACE[[9, 32]] = True
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


def words_of(data: np.ndarray, offsets: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, piece) of each word of texts whose bytes stand in `data` between `offsets`; A-Z lower-cased."""
    n = len(data)
    space = _SPACE[data]
    edges = np.zeros(n + 1, dtype=bool)
    edges[offsets] = True
    solid = ~space
    before = np.concatenate([[True], space[:-1]]) | edges[:-1]
    after = np.concatenate([space[1:], [True]]) | edges[1:]
    starts, ends = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    breaks = np.cumsum(_CUTS[data] | edges[:-1], dtype=np.int64)
    bytes_ = np.random.default_rng(20240229 + seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(bytes_[_LOWER[data]] * power(BASE, n), out=total[1:])
    hashes = (total[ends] - total[starts]) * power(BASE_INVERSE, n)[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    return mix(hashes), starts, ends, breaks[starts]


def gram_hashes(words: np.ndarray, salt: np.uint64) -> np.ndarray:
    """Hashes of phrases, one in each row of `words`."""
    g = mix(words[:, 0] ^ salt)
    for j in range(1, words.shape[1]):
        g = mix(g * _MULTIPLIER + words[:, j])
    return g


def _salt(lang: str) -> np.uint64:
    raw = np.frombuffer(lang.encode(), dtype=np.uint8)
    return mix(np.array([int.from_bytes(raw.tobytes(), "little") % (2**64 - 59)], dtype=np.uint64))[0]


class Counted:
    """How often rows of word hashes occur, combined now and then; gives (words, counts) when it holds many different ones."""

    def __init__(self, width: int):
        self.width, self.grams, self.words, self.counts, self.held = width, [], [], [], 0

    def add(self, grams: np.ndarray, words: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.grams.append(grams)
        self.words.append(words)
        self.counts.append(counts)
        self.held += len(grams)
        if self.held > HELD:
            yield from self.flush(HELD // 2)

    def flush(self, keep: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not self.held:
            return
        grams, words, counts = np.concatenate(self.grams), np.concatenate(self.words), np.concatenate(self.counts)
        grams, words, counts = combined(grams, words, counts)
        if len(grams) > keep:
            yield words, counts
            self.grams, self.words, self.counts, self.held = [], [], [], 0
        else:
            self.grams, self.words, self.counts, self.held = [grams], [words], [counts], len(grams)


def combined(grams: np.ndarray, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal rows of `words` once, with the sum of their counts. Rows of equal hashes that differ stay apart."""
    order = np.argsort(grams, kind="stable")
    grams, words, counts = grams[order], words[order], counts[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (words[1:] != words[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    return grams[at], words[at], np.add.reduceat(counts, at) if len(at) else counts


class Buckets:
    """Counters of buckets, none beyond `most`."""

    def __init__(self, bits: int, most: int):
        self.bits, self.most = bits, most
        self.counts = np.zeros(1 << bits, dtype=np.min_scalar_type(most))

    def add(self, grams: np.ndarray) -> None:
        at, n = np.unique(grams >> np.uint64(64 - self.bits), return_counts=True)
        self.counts[at] = np.minimum(self.counts[at].astype(np.int64) + n, self.most)

    def slices(self) -> Iterator[tuple[int, bytes]]:
        for at in range(0, len(self.counts), SLICE):
            part = self.counts[at : at + SLICE]
            if part.any():
                yield at // SLICE, part.tobytes()


def _bit(bitmap: np.ndarray, bits: int, grams: np.ndarray) -> np.ndarray:
    at = grams >> np.uint64(64 - bits)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


_ROWS = "lang string, words array<long>, count long, word string, slice int, counters binary"
_SCHEMA = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.int64())), ("count", pa.int64()), ("word", pa.string()), ("slice", pa.int32()), ("counters", pa.binary())])


def _batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in _SCHEMA], schema=_SCHEMA)


def _gram_batches(lang: str, words: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(words), 1 << 16):
        part, n = words[at : at + (1 << 16)], len(words[at : at + (1 << 16)])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * words.shape[1]), pa.array(np.ascontiguousarray(part).reshape(-1).view(np.int64)))
        yield _batch(n, lang=pa.array([lang] * n, pa.string()), words=lists, count=pa.array(counts[at : at + n].astype(np.int64)))


def _slice_batches(buckets: Buckets) -> Iterator[pa.RecordBatch]:
    for number, counters in buckets.slices():
        yield _batch(1, slice=pa.array([number], pa.int32()), counters=pa.array([counters], pa.binary()))


def _spelt(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The lower-cased words at these places."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    at = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(_LOWER[data[at]].tobytes()))


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, bytes, bounds) of runs of texts."""
    for batch in batches:
        langs = batch.column("lang").fill_null("und").dictionary_encode()
        codes = np.asarray(langs.indices)
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            rows = batch if len(langs.dictionary) == 1 else batch.filter(pa.array(codes == code))
            for _, data, offsets in text_chunks([rows], chunk_bytes=1 << 20):
                yield lang, data, offsets


def _first_pass(bits: int, at_least: int, seed: int):
    def spelt(lang: str, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        n = len(hashes)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(hashes.view(np.int64)))
        return _batch(n, lang=pa.array([lang] * n, pa.string()), words=lists, count=pa.array(np.zeros(n, dtype=np.int64)), word=_spelt(data, starts, ends))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, counted, told = Buckets(bits, at_least), {}, {}
        for lang, data, offsets in _by_lang(batches):
            hashes, starts, ends, pieces = words_of(data, offsets, seed)
            if not len(hashes):
                continue
            found, first, inverse, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            sums = np.cumsum(_CUBES[data])
            sums = sums[ends - 1] - sums[starts] + _CUBES[data[starts]]
            if len(odd := np.flatnonzero(sums != sums[first[inverse]])):  # another word of the same hash: told, so that it is noticed
                yield spelt(lang, hashes[odd], data, starts[odd], ends[odd])
            # a task spells a word once, or again when it has forgotten it
            known = told.get(lang, np.zeros(0, dtype=np.uint64))
            new = ~np.isin(found, known)
            yield spelt(lang, found[new], data, starts[first[new]], ends[first[new]])
            told[lang] = np.concatenate([known, found[new]]) if len(known) < HELD else found
            for words, n in counted.setdefault(lang, Counted(1)).add(found, found[:, None], counts):
                yield from _gram_batches(lang, words, n)
            pairs = np.flatnonzero(pieces[:-1] == pieces[1:])
            buckets.add(gram_hashes(np.stack([hashes[pairs], hashes[pairs + 1]], axis=1), _salt(lang)))
        for lang, mine in counted.items():
            for words, n in mine.flush():
                yield from _gram_batches(lang, words, n)
        yield from _slice_batches(buckets)

    return count


def _next_pass(k: int, longest: int, bits: int, at_least: int, seed: int, frequent: list[Broadcast], bucketed: Broadcast):
    """Counts phrases of k words; `frequent` has the bitmaps of the frequent phrases of 1 to k - 1 words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(bits, at_least) if k < longest else None
        counted: dict[str, Counted] = {}
        for lang, data, offsets in _by_lang(batches):
            hashes, _, _, pieces = words_of(data, offsets, seed)
            salt = _salt(lang)
            # places where a frequent phrase of j words begins, and its hash; then where two of them overlap
            at, grams = np.arange(len(hashes)), mix(hashes ^ salt)
            for j in range(1, k):
                good = _bit(frequent[j - 1].value, bits, grams)
                at, grams = at[good], grams[good]
                met = np.flatnonzero((at[1:] == at[:-1] + 1) & (pieces[at[1:] + j - 1] == pieces[at[:-1]]))
                at = at[met]
                grams = mix(grams[met] * _MULTIPLIER + hashes[at + j])
            good = _bit(bucketed.value, bits, grams)
            at, grams = at[good], grams[good]
            if buckets is not None:
                met = np.flatnonzero((at[1:] == at[:-1] + 1) & (pieces[at[1:] + k - 1] == pieces[at[:-1]]))
                buckets.add(mix(grams[met] * _MULTIPLIER + hashes[at[met] + k]))
            if len(at):
                words = hashes[at[:, None] + np.arange(k)]
                mine = counted.setdefault(lang, Counted(k))
                for found in mine.add(*combined(grams, words, np.ones(len(at), dtype=np.int64))):
                    yield from _gram_batches(lang, *found)
        for lang, mine in counted.items():
            for found in mine.flush():
                yield from _gram_batches(lang, *found)
        if buckets is not None:
            yield from _slice_batches(buckets)

    return count


def _bitmap(slices: DataFrame, bits: int, at_least: int) -> Broadcast:
    """The buckets with `at_least` in all, as bits. A partition adds up its slices as they come; 2 ** bits / 8 bytes reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, total = np.min_scalar_type(at_least), {}
        for batch in batches:
            for number, counters in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                here = np.frombuffer(counters, dtype=kind).astype(np.int64)
                total[number] = np.minimum(total[number] + here, at_least) if number in total else here
        out = [(n, np.packbits(t >= at_least, bitorder="little").tobytes()) for n, t in total.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], ["slice", "bits"])

    found = np.zeros(max(1, (1 << bits) // 8), dtype=np.uint8)
    for row in slices.select("slice", "counters").repartition("slice").mapInArrow(add, "slice int, bits binary").collect():
        part = np.frombuffer(row["bits"], dtype=np.uint8)
        found[row["slice"] * (SLICE // 8) :][: len(part)] = part
    return slices.sparkSession.sparkContext.broadcast(found)


def _frequent_bitmap(table: DataFrame, bits: int) -> Broadcast:
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = Buckets(bits, 1)
        for batch in batches:
            langs, lists = batch.column("lang").dictionary_encode(), batch.column("words")
            words = np.asarray(lists.flatten()).view(np.uint64).reshape(batch.num_rows, -1)
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                marked.add(gram_hashes(words[np.asarray(langs.indices) == code], _salt(lang)))
        for rows in _slice_batches(marked):
            yield rows.select(["slice", "counters"])

    return _bitmap(table.select("lang", "words").mapInArrow(mark, "slice int, counters binary"), bits, 1)


def frequent_phrases(docs: DataFrame, at_least: int = AT_LEAST, longest: int = LONGEST, bucket_bits: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, words, totals): (lang, words, f) of all phrases with f >= at_least; (lang, words, word) of the frequent words; (lang, n)."""
    texts = docs.select("lang", "text")
    if bucket_bits is None:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bucket_bits = min(MOST_BITS, max(LEAST_BITS, (size // BYTES_PER_BUCKET).bit_length()))
    seed = 0
    while True:
        raw = materialize(texts.mapInArrow(_first_pass(bucket_bits, at_least, seed), _ROWS), "words")
        counts = raw.where("words IS NOT NULL").groupBy("lang", "words")
        counts = materialize(counts.agg(F.sum("count").cast("long").alias("f"), F.min("word").alias("word"), F.max("word").alias("other")), "word_counts")
        if not counts.where("word <> other").limit(1).count():
            break
        discard(raw, counts)
        seed += 1
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    spelt = counts.where(F.col("f") >= at_least).select("lang", "words", "f", "word")
    phrases, tables, bitmaps = spelt.select("lang", "words", "f"), [], []
    table = phrases
    for k in range(2, longest + 1):
        bitmaps.append(_frequent_bitmap(table, bucket_bits))
        bucketed = _bitmap(raw.where("slice IS NOT NULL"), bucket_bits, at_least)
        discard(raw)
        raw = materialize(texts.mapInArrow(_next_pass(k, longest, bucket_bits, at_least, seed, list(bitmaps), bucketed), _ROWS), f"phrases{k}")
        found = raw.where("words IS NOT NULL").groupBy("lang", "words").agg(F.sum("count").alias("f")).where(F.col("f") >= at_least)
        table = materialize(found, f"frequent{k}")
        tables.append(table)
    discard(raw)
    for table in tables:
        phrases = phrases.unionAll(table)
    return phrases, spelt.select("lang", "words", "word"), totals


def collocations(docs: DataFrame, at_least: int = AT_LEAST, longest: int = LONGEST, top: int = TOP, bucket_bits: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's first `top` phrases of 2 to `longest` words by their lowest-scoring cut."""
    phrases, spelt, totals = frequent_phrases(docs, at_least, longest, bucket_bits)
    size = F.size("words")
    longer = phrases.where(size > 2)
    inner = longer.select("lang", F.col("f").alias("g"), "words", F.explode(F.sequence(F.lit(2), size - 1)).alias("k"))
    inner = inner.select("lang", "g", F.explode(F.transform(F.sequence(F.lit(1), size - F.col("k") + 1), lambda i: F.slice("words", i, F.col("k")))).alias("words"))
    held = inner.groupBy("lang", "words").agg(F.max("g").alias("g"))
    kept = phrases.where(size > 1).join(held, ["lang", "words"], "left").where(F.col("g").isNull() | (100 * F.col("g") < 100 * F.col("f"))).drop("g")

    cuts = kept.select("lang", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("words", F.lit(1), F.col("k"))).withColumn("right", F.slice("words", F.col("k") + 1, size))
    part = lambda side, count: phrases.select("lang", F.col("words").alias(side), F.col("f").alias(count))
    scored = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    score = F.expr("cast(cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(19,0)) as decimal(38,0)) div cast(cast(l as decimal(19,0)) * cast(r as decimal(19,0)) as decimal(38,0))")
    scored = scored.withColumn("score", score.cast("long"))
    best = scored.groupBy("lang", "words").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "words", "b.*")
    # the words of a phrase, put together again
    letters = best.select("lang", "words", F.posexplode("words").alias("at", "one")).withColumn("one", F.array("one"))
    letters = letters.join(spelt.withColumnRenamed("words", "one"), ["lang", "one"])
    told = letters.groupBy("lang", "words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    named = best.join(told, ["lang", "words"])
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a lang's phrases are ranked in parts first, so that no task gets more than a bounded number of them
    salted = named.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_pcy_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of each language, over all documents."""
    return collocations(documents(spark, sf_dir, "lang", "text"))


COLLOCATIONS_SQL = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS ph FROM w, range(1, {LONGEST + 1}) t(k) WHERE len(ws) >= k
), f AS (
  SELECT lang, ph, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {AT_LEAST}
), n AS (
  SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang
), inner_phrases AS (
  SELECT lang, f AS g, unnest(flatten(list_transform(range(2, len(ph)), lambda k: list_transform(range(1, len(ph) - k + 2), lambda i: ph[i:i + k - 1])))) AS ph FROM f WHERE len(ph) > 2
), kept AS (
  SELECT lang, ph, f FROM f WHERE len(ph) > 1 AND NOT EXISTS (SELECT 1 FROM inner_phrases i WHERE i.lang = f.lang AND i.ph = f.ph AND 100 * i.g >= 100 * f.f)
), cuts AS (
  SELECT c.lang, c.ph, c.f AS a, k, x.f AS l, y.f AS r, n.n, ((1000::HUGEINT * c.f * n.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(ph))) AS k FROM kept) c JOIN n ON n.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.ph = c.ph[:k] JOIN f y ON y.lang = c.lang AND y.ph = c.ph[k + 1:]
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ph, ' ')) AS rank, array_to_string(ph, ' ') AS phrase, a, l, r, n, score
FROM best QUALIFY rank <= {TOP}
"""
