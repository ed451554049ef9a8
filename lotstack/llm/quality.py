"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts in Arrow batches; the trees are grown with numpy on a bounded sample of labelled
rows (`MAX_TRAINING_ROWS`, the smallest by a hash of the id) and flattened into arrays, which each task walks for
all rows of a batch at once. Labels, language, source and id are never inputs of a score.

Defined results: null and empty texts get the score of all-zero statistics; rows without a label are scored alike;
null labels are no labels; a document with several labels takes part once with each; repeated rows are repeated.
Without any usable label, or with one class only, every score is the smoothed share of label 1. An empty table
gives an empty result; extra columns pass through `score`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The bounded sample of labelled rows that the trees are grown on.
MAX_TRAINING_ROWS = 20_000
TREES, DEPTH, BINS, RATE, SMOOTH, LEAST_ROWS = 80, 4, 64, 0.15, 1.0, 10
THRESHOLD = 0.3

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "share_upper", "share_digit", "share_punctuation", "share_other_ascii",
    "share_beyond_ascii", "share_space", "share_newline", "words_per_line", "distinct_words", "distinct_lines",
    "repeated_line_bytes", "top_word", "top_pair", "long_words", "short_words", "share_letters", "entropy",
    "sentence_ends", "share_marks", "share_pipes", "share_links", "stop_start", "longest_line",
)

_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[48:58] = 3
_CLASS[128:] = 4
_CLASS[[9, 11, 12, 13, 32]] = 5
_CLASS[10] = 6
for _c in b".,;:'\"-()?":
    _CLASS[_c] = 7
for _c in b"!#$%&*+=<>@^_`~{}[]\\/":
    _CLASS[_c] = 8
_CLASS[ord("|")] = 9


def statistics(text: bytes) -> np.ndarray:
    """The statistics of one text, in the order of STATISTICS."""
    out = np.zeros(len(STATISTICS))
    n = len(text)
    if not n:
        return out
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    by = np.bincount(_CLASS, weights=counts, minlength=10)
    words = text.lower().split()
    m = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    distinct_lines = set(lines)
    p = counts[counts > 0] / n
    out[0] = np.log1p(n)
    out[1] = np.log1p(m)
    out[3], out[4], out[5], out[6] = by[1] / n, by[3] / n, by[7] / n, by[0] / n
    out[7], out[8], out[9] = by[4] / n, by[5] / n, by[6] / n
    out[18] = (by[1] + by[2] + by[4]) / n
    out[19] = -(p * np.log2(p)).sum()
    out[20] = (counts[46] + counts[33] + counts[63]) / max(m, 1)
    out[21], out[22] = by[8] / n, by[9] / n
    if m:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=m)
        tally: dict[bytes, int] = {}
        for w in words:
            tally[w] = tally.get(w, 0) + 1
        out[2] = lengths.mean()
        out[11] = len(tally) / m
        out[14] = max(tally.values()) / m
        out[16], out[17] = (lengths > 14).mean(), (lengths <= 3).mean()
        out[23] = (text.count(b"http") + text.count(b"www.") + text.count(b"@")) / m
        pairs: dict[tuple[bytes, bytes], int] = {}
        for pair in zip(words, words[1:]):
            pairs[pair] = pairs.get(pair, 0) + 1
        out[15] = max(pairs.values(), default=0) / m
        out[24] = text[:1].islower()
    if lines:
        out[10] = m / len(lines)
        out[12] = len(distinct_lines) / len(lines)
        out[13] = 1 - sum(map(len, distinct_lines)) / sum(map(len, lines))
        out[25] = np.log1p(max(map(len, lines)))
    return out


@dataclass(frozen=True)
class Trees:
    """A forest flattened into arrays: complete trees of one depth, level by level."""

    base: float
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # (trees, inner nodes): right if the value is greater
    leaf: np.ndarray  # (trees, leaves)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for all rows of x, each level of each tree as one numpy step."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            while len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def grow_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosted trees with logistic loss; splits are sought over histograms of at most BINS bins a statistic."""
    inner, leaves = 2**depth - 1, 2**depth
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    empty = Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not 0 < y.sum() < len(y):
        return empty
    features = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(features)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(features)], axis=1)
    at = binned + np.arange(features) * BINS
    raw = np.full(len(y), base)
    all_features, all_cuts, all_leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        slope, bend = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (features * BINS) + at).ravel()
            shape = (width, features, BINS)
            sums = [
                np.bincount(cell, weights=None if w is None else np.repeat(w, features), minlength=width * features * BINS).reshape(shape)
                for w in (slope, bend, None)
            ]
            left = [s.cumsum(axis=2) for s in sums]
            total = [s[:, :, -1:] for s in left]
            gain = (
                left[0] ** 2 / (left[1] + SMOOTH)
                + (total[0] - left[0]) ** 2 / (total[1] - left[1] + SMOOTH)
                - total[0] ** 2 / (total[1] + SMOOTH)
            )
            gain[(left[2] < LEAST_ROWS) | (total[2] - left[2] < LEAST_ROWS)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            split_bin = np.full(width, BINS)
            for k in range(width):
                f, b = divmod(int(best[k]), BINS)
                feature[first + k] = f
                if gain[k, f, b] > 1e-9 and b < len(cuts[f]):
                    cut[first + k], split_bin[k] = cuts[f][b], b
            here = node - first
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > split_bin[here])
        leaf_of = node - inner
        leaf = RATE * np.bincount(leaf_of, slope, leaves) / (np.bincount(leaf_of, bend, leaves) + SMOOTH)
        raw += leaf[leaf_of]
        all_features.append(feature)
        all_cuts.append(cut)
        all_leaves.append(leaf)
    return Trees(base, np.array(all_features), np.array(all_cuts), np.array(all_leaves))


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> Trees:
    """Trees from labelled documents that are not held out: at most `most` of them, the smallest by hash of the id."""
    marked = labels.where(F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    rows = (
        docs.select("doc_id", "text")
        .where(F.coalesce(~held_out(), F.lit(False)))
        .join(marked, "doc_id")
        .withColumn("_order", F.xxhash64("doc_id"))
    )
    # the sample is settled on ids alone, before texts are moved
    chosen = rows.select("_order").orderBy("_order").limit(most).agg(F.max("_order")).first()[0]
    if chosen is None:
        return grow_trees(np.zeros((0, len(STATISTICS))), np.zeros(0))
    sample = rows.where(F.col("_order") <= chosen).select("text", "quality")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), type=pa.list_(pa.float64())), batch.column(1)], ["x", "quality"])

    # the bound holds for rows that share an id, too: statistics are a few numbers for each row
    got = sample.mapInArrow(measured, "x array<double>, quality int").limit(most).toArrow()
    x = np.array(got["x"].combine_chunks().flatten()).reshape(-1, len(STATISTICS))
    y = (np.array(got["quality"]) == 1).astype(float)
    order = np.lexsort([*x.T, y])  # the rows' order of arrival must not matter
    return grow_trees(x[order], y[order])


def _matrix(texts: pa.Array) -> np.ndarray:
    rows = [statistics(t.as_py().encode() if t.is_valid else b"") for t in texts]
    return np.array(rows).reshape(len(rows), len(STATISTICS))


def score(docs: DataFrame, trees: Trees, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` with a column `name`, from whole texts; a column of that name is replaced."""
    fields = [f for f in docs.schema.fields if f.name.lower() != name.lower()]
    schema = T.StructType([*fields, T.StructField(name, T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = trees.scores(_matrix(batch.column(batch.schema.get_field_index(text))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], [*batch.schema.names, name])

    return docs.select(*(f"`{f.name}`" for f in fields)).mapInArrow(scored, schema)


def op9_quality_gbdt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, fit(docs, labels)).drop("text")
    return scored.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
