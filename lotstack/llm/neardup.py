"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set holds its distinct five-word shingles. Documents with equal sets form a class, and one of them, the
smallest id, stands for it. A sketch keeps the `K` smallest hashes of a set. Inverted lists of retained values bring
together the sketches that overlap; the sketch of the union estimates the similarity and drops pairs far below the
threshold; exact Jaccard on full sets, from whole texts, confirms each link.

Only a sketch's rarest values are listed: two sketches that have to share `o` of their values share one of the
rarest `size - o + 1`, in any common order. Common passages so bring no pairs together, as long as the rest of the
texts differ. In a list of many copies not all pairs are compared: all are compared with the list's most central
member first (the one whose values are the most common), and afterwards only those that the confirmed links leave in
different components. So no link between components is lost, and links inside a component change nothing.

Defined results: null and empty texts, or texts without words, have no shingles and are linked with nothing; texts of
one to four words have one shingle, the whole sequence; rows with null ids take no part in links and stand for
themselves; repeated rows fall into one class. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotstack.llm.common import discard, hash_words, materialize, mix, ordered_int64, text_chunks
from lotstack.operators.graph import components

#: Values that a sketch keeps, and words in a shingle.
K, WORDS = 64, 5
#: Values of the wide sketches that tell apart the members of mixed lists.
WIDE = 512
#: The similarity that the corpus pipeline links at.
PIPELINE_PERCENT = 80
#: Estimates may fall this far below the threshold: more than six deviations of an estimate from K values.
MARGIN = 0.3

_STEPS = [np.uint64(pow(0xC2B2AE3D27D4EB4F, k + 1, 2**64) | 1) for k in range(WORDS)]


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one text's words."""
    if not len(words):
        return words
    size = min(WORDS, len(words))
    total = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        total += words[k : k + len(total)] * _STEPS[k]
    return np.unique(mix(total + np.uint64(size)))


def sketches(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, n, set_key, sketch): set size, a 128-bit key of the set (null without shingles), its k least hashes."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches):
            words, bounds = hash_words(data, offsets)
            sizes, keys, least = [], [], []
            for a, b in zip(bounds, bounds[1:]):
                own = shingles(words[a:b])
                sizes.append(len(own))
                keys.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                least.append(ordered_int64(own[:k]))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in least])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(least)))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists], ["doc_id", "n", "set_key", "sketch"]
            )

    return docs.select("doc_id", "text").mapInArrow(sketched, "doc_id long, n long, set_key binary, sketch array<long>")


def least_shared(k: int, percent: int) -> int:
    """Values that two sketches of k at the threshold share at least: six deviations below the mean."""
    p = percent / 100
    return int(k * p - 6 * (k * p * (1 - p)) ** 0.5)


def _needed(n: Column, percent: int) -> Column:
    """Values that a sketch of a set of n has to share with that of any set at the threshold.

    If both sets are sketched whole, that is the share of the larger; else the bound for samples, in proportion.
    """
    whole = F.ceil(n * percent / 100)
    return F.when(n * 100 <= K * percent, whole).otherwise(F.floor(F.least(n, F.lit(K)) * least_shared(K, percent) / K))


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _lists(reps: DataFrame, percent: int) -> DataFrame:
    """(value, rep, n, central): the inverted lists of each sketch's rarest values that other sketches hold too."""
    values = reps.select("rep", "n", F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    common = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("rep")
    rank = F.row_number().over(own.orderBy("df", "value"))
    singles = F.col("size") - F.count("*").over(own)
    return (
        values.join(common, "value")
        .withColumn("central", F.sum("df").over(own))
        .withColumn("place", rank + singles)
        .where(F.col("place") <= F.col("size") - _needed(F.col("n"), percent) + 1)
        .select("value", "rep", "n", "central")
    )


def _wide_pairs(rest: DataFrame, docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) across components that wide sketches leave possible, and the table they are read from.

    rest: (rep, n, component).

    Of two sets the smaller needs fewer listed values than the larger; where two sketches first meet, what is left of
    either bounds what they can share. For sets that are sketched whole both bounds are exact. Each row carries the values
    that its sketch lists before it (at most WIDE), so that a pair comes out where it first meets and nowhere else.
    """
    wide = sketches(docs.join(rest.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), WIDE)
    wide = wide.dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("rep"), F.explode("sketch").alias("value"))
    common = wide.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("rep")
    n, size = F.col("n"), F.least("n", F.lit(WIDE))
    loose = F.floor(size * least_shared(WIDE, percent) / WIDE)
    whole = n * 100 <= WIDE * percent
    rank = F.row_number().over(own.orderBy("df", "value"))
    listed = (
        wide.join(common, "value")
        .join(rest, "rep")
        .withColumn("size", size)
        .withColumn("whole", whole)
        .withColumn("place", rank + F.col("size") - F.count("*").over(own))
        .where(F.col("place") <= size - F.when(whole, F.ceil(n * percent / 100)).otherwise(loose) + 1)
        .withColumn("short", F.col("place") <= size - F.when(whole, F.ceil(n * 2 * percent / (100 + percent))).otherwise(loose) + 1)
        .withColumn("before", F.collect_list("value").over(own.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)))
        .select("value", "rep", "n", "component", "size", "whole", "place", "short", "before")
    )
    listed = materialize(listed, "wide-lists")
    x = listed.where("short").alias("x")
    y = listed.alias("y")
    ordered = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.rep") < F.col("y.rep")))
    left = 1 + F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
    needed = F.ceil((F.col("x.n") + F.col("y.n")) * percent / (100 + percent))
    possible = ~(F.col("x.whole") & F.col("y.whole")) | (left >= needed)
    on = (F.col("x.value") == F.col("y.value")) & (F.col("x.component") != F.col("y.component")) & ordered & _sizes_fit("x.n", "y.n", percent) & possible
    # two sketches share many values: they meet at the first of them alone
    on = on & ~F.arrays_overlap("x.before", "y.before")
    return x.join(y, on).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct(), listed


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose union sketch estimates a similarity that can be at the threshold."""
    with_a = pairs.join(reps.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a")
    both = with_a.join(reps.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    shared = F.size(F.array_intersect(F.array_intersect(union, F.col("sa")), F.col("sb")))
    return both.where(shared >= F.size(union) * (percent / 100 - MARGIN)).select("a", "b")


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |A and B| >= percent * |A or B| on full sets."""
    texts = docs.select("doc_id", "text")
    met = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(
        texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a"
    )

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, set_a = None, None
        for batch in batches:
            for rows, data, offsets in text_chunks([batch], "text_b"):
                words, bounds = hash_words(data, offsets)
                keep = []
                for i, a in enumerate(rows.column(0).to_pylist()):
                    if a != last:
                        _, da, oa = next(text_chunks([rows.slice(i, 1)], "text_a"))
                        last, set_a = a, shingles(hash_words(da, oa)[0])
                    set_b = shingles(words[bounds[i] : bounds[i + 1]])
                    both = len(np.intersect1d(set_a, set_b, assume_unique=True))
                    keep.append(100 * both >= percent * (len(set_a) + len(set_b) - both))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.select("a", "b", "text_a", "text_b").mapInArrow(checked, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row; linked if 100 * |A and B| >= percent * |A or B|."""
    docs = docs.select("doc_id", "text")
    sketched = materialize(sketches(docs), "sketches")
    usable = sketched.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    reps = materialize(
        usable.join(classes, "set_key").where("doc_id = rep").dropDuplicates(["rep"]).select("rep", "n", "sketch"), "representatives"
    )
    lists = materialize(_lists(reps, percent), "lists")

    heads = lists.groupBy("value").agg(F.max_by(F.struct("rep", "n"), F.struct("central", -F.col("rep"))).alias("head"))
    stars = (
        lists.join(heads, "value")
        .select(F.col("head.rep").alias("a"), F.col("head.n").alias("na"), F.col("rep").alias("b"), "n")
        .where((F.col("a") != F.col("b")) & _sizes_fit("na", "n", percent))
        .select("a", "b")
        .distinct()
    )
    links = materialize(_confirmed(_likely(stars, reps, percent), docs, percent), "links")
    found = components(links)

    placed = lists.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep")
    )
    mixed = placed.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("value")
    rest = materialize(placed.join(mixed, "value").select("rep", "n", "component").distinct(), "rest")
    pairs, wide_lists = _wide_pairs(rest, docs, percent)
    more = materialize(_confirmed(_likely(pairs, reps, percent), docs, percent), "more-links")
    discard(lists, rest, wide_lists, reps)
    if more.limit(1).count():
        discard(found)
        found = components(links.unionAll(more))
    discard(links, more)
    grouped = usable.select("doc_id", "set_key").distinct().join(classes, "set_key").select("doc_id", "rep").groupBy("doc_id").agg(F.min("rep").alias("rep"))
    answer = (
        grouped.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select(F.col("doc_id").alias("_id"), F.coalesce("component", "rep").alias("_component"))
    )
    return (
        sketched.select("doc_id", "n")
        .join(answer, F.col("doc_id") == F.col("_id"), "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.coalesce("_component", "doc_id").alias("component_id"),
            F.coalesce(F.coalesce("_component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
        )
    )


def op5_bottomk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


NEARDUP_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), x AS (SELECT doc_id, len(s) AS n, unnest(s) AS v FROM s), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.v = b.v AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (
  SELECT doc_id AS d, doc_id AS c FROM s UNION SELECT e.b, r.c FROM r JOIN e ON r.d = e.a
), m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM s JOIN m ON d = doc_id
"""
