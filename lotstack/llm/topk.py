"""Exact top-k search by inner product with the threshold algorithm of Fagin, Lotem and Naor.

Components are turned into integers. Candidates are dealt into blocks of bounded size; each block keeps, for every
dimension, its candidates sorted by that component. A query walks the lists of all dimensions together, from the
end that its own component favours, scores each candidate at first sight by random access, and stops once its kth
score is above the bound: the score of a candidate with the values that the walks have reached. Candidates that
tie with the kth score can still have a smaller id, so a bound that equals it doesn't stop the walk. The best of
all blocks are then merged.

Queries meet candidates block by block: each query is sent to each block of candidates, a stated query set against all
rows. Both are dealt together and sorted so that a task reads a block of candidates and then its queries, one block at a
time: nothing is broadcast, and the candidates are sent once.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do null ids; rows with
equal ids are candidates each, and queries each with ranks of their own, which alone don't meet themselves; shorter
vectors count as filled up with zeros; where sums could pass 2**53, Python's whole numbers are used, and a score beyond
64 bits is refused with an error; ties go to the smaller id; a query with fewer candidates gets them all. An empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotstack.llm.common import materialize

#: Rows of a block, at most about. Candidates come in small blocks up to so many of them, then blocks grow up to the large size:
#: queries are sent once to each block, so until then what is sent grows with the tables and not with their square.
CANDIDATES_IN_BLOCK = 4096
FEW_BLOCKS, CANDIDATES_IN_LARGE_BLOCK = 64, 32768
#: Whole numbers below this are exact as floats, and so are sums of them.
EXACT = 2**53


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(row_id, vec_id, q): whole components floor(scale * x), as doubles, of the vectors that take part.

    Rows are told apart by row_id. Doubles from 2**53 on are whole already.
    """
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    scaled = F.transform("embedding", lambda x: x.cast("double") * scale)
    whole = F.transform(scaled, lambda y: F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y))
    return vectors.where(F.col("vec_id").isNotNull() & good).select(F.monotonically_increasing_id().alias("row_id"), "vec_id", whole.alias("q"))


def _matrix(values: pa.ListArray, dims: int) -> np.ndarray:
    lengths = np.diff(np.asarray(values.offsets))
    flat = np.asarray(values.flatten(), dtype=np.float64)
    if (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims))
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths])] = flat
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties to the smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)
    return np.lexsort((ids, -scores))[:k]


def threshold_topk(query: np.ndarray, own: int, ids: np.ndarray, rows: np.ndarray, order: np.ndarray, ranked: np.ndarray, k: int, row_ids=None):
    """(ids, scores) of the query's best k rows of a block, best first; `own` is the query's own row, by row_ids or ids.

    `order[d]` lists the rows by falling component d and `ranked[d]` their components. Arrays of Python's whole numbers
    are walked like floats.
    """
    n = len(ids)
    row_ids = ids if row_ids is None else row_ids
    used = np.flatnonzero(query)
    weights = query[used]
    down = (weights > 0).astype(bool)
    seen = np.zeros(n, dtype=bool)
    found_ids, found_scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=rows.dtype)
    depth, step = 0, max(k, 16)
    while depth < n:
        to = n if not len(used) else min(n, depth + step)
        before = seen.copy()
        if len(used):
            seen[order[used[down], depth:to]] = True
            seen[order[used[~down], n - to : n - depth]] = True
        else:
            seen[:] = True
        new = np.flatnonzero(seen & ~before)
        new = new[row_ids[new] != own]
        found_ids = np.concatenate([found_ids, ids[new]])
        found_scores = np.concatenate([found_scores, rows[new] @ query])
        best = _best(found_scores, found_ids, k)
        found_ids, found_scores = found_ids[best], found_scores[best]
        depth, step = to, step * 2
        if len(best) == k and depth < n:
            reached = np.where(down, ranked[used, depth - 1], ranked[used, n - depth])
            if found_scores[-1] > weights @ reached:
                break
    return found_ids, found_scores


def top_k(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k greatest inner products with the other rows."""
    rows = materialize(rows, "vectors")
    totals = rows.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("dims")).first()
    blocks = max(1, -(-totals["n"] // CANDIDATES_IN_LARGE_BLOCK), min(FEW_BLOCKS, -(-totals["n"] // CANDIDATES_IN_BLOCK)))
    dims = totals["dims"] or 0
    candidates = rows.withColumns({"block": F.pmod(F.xxhash64("row_id", F.lit(1)), F.lit(blocks)).cast("int"), "asks": F.lit(False)})
    queries = rows.where(is_query).withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "asks": F.lit(True)})
    met = candidates.unionByName(queries).repartition(blocks, "block").sortWithinPartitions("block", "asks")
    names = ["query_row", "query_id", "vec_id", "score"]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, last, kept, exact, largest = [], None, None, None, 0.0
        for batch in batches:
            block, asks = batch.column("block").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            change = np.flatnonzero((block[1:] != block[:-1]) | (asks[1:] != asks[:-1])) + 1
            for start, stop in zip([0, *change], [*change, batch.num_rows]):
                if start == stop:
                    continue
                part = batch.slice(start, stop - start)
                if not asks[start]:
                    if block[start] != last:
                        waiting, last, kept = [], block[start], None
                    waiting.append(part)
                    continue
                if block[start] != last:  # no candidate was dealt to this block
                    continue
                if kept is None:
                    whole_block = pa.Table.from_batches(waiting).combine_chunks()
                    own_rows, ids = (whole_block.column(c).to_numpy() for c in ("row_id", "vec_id"))
                    matrix = _matrix(whole_block.column("q").combine_chunks(), dims)
                    order = np.ascontiguousarray(np.argsort(-matrix, axis=0, kind="stable").T)
                    kept = ids, matrix, order, np.take_along_axis(matrix.T, order, axis=1)
                    waiting, exact, largest = [], None, float(np.abs(matrix).max(initial=0))
                out = []
                for own_row, own_id, q in zip(part.column("row_id").to_numpy(), part.column("vec_id").to_numpy(), _matrix(part.column("q"), dims)):
                    walked = kept
                    if largest * float(np.abs(q).sum()) >= EXACT:  # sums may be inexact as floats: Python's whole numbers
                        whole = np.frompyfunc(int, 1, 1)
                        exact = exact or (kept[0], whole(kept[1]), kept[2], whole(kept[3]))
                        walked, q = exact, whole(q)
                    found = threshold_topk(q, own_row, *walked, k, own_rows)
                    out += [(own_row, own_id, x, int(score)) for x, score in zip(*found)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*out)], names)

    near = met.mapInArrow(best, "query_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector, among all vectors."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(quantised(vectors), F.col("vec_id") % 50 == 0, 5)


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))), true)
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
