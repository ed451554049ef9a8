"""Embedding near-duplicates by hierarchical navigable small-world graphs, one for each shard of the vectors.

Vectors are dealt into shards of bounded size by a hash; equal vectors are one vertex with a number of copies. Each shard
builds its graph: vertices come in batches that double in size, look for their neighbours in the graph so far and in their
own batch, and keep those that no nearer one already covers. Vertices live on layers of falling size, and a search walks down from
the top. Searches run for a whole batch of queries at a time, in numpy.

Every pair of shards is met once, the vectors of one as queries in the graph of the other. A search keeps a beam of the best
vertices, and goes on from every vertex above the threshold, beyond the beam, so that a large group of copies is found whole.
What it finds is verified by the cosine in double precision. Before a shard is used, an audit holds its graph against
brute force: for a bounded number of its vectors all links inside the shard must be found, and each of them must be found again by a vector
turned away from it by the threshold's angle. The beam is doubled until `RECALL` of both are found; a beam as wide as the
shard sees all of it.

Links are never written one by one: a pair of shards gives, for each vector, how many it has found and one link to the
smallest of its component there; components of these links are those of all links.

Defined results: vectors that are null or zero, or hold null or non-finite components, link with nothing; shorter vectors
count as filled up with zeros; rows with equal ids are vectors each; rows with a null id take part, and a component without
any other id has none. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotstack.llm.common import discard, materialize
from lotstack.operators.graph import components

COSINE = 0.95
#: Vectors of a shard, at most about; neighbours of a vertex on the lowest layer and above it.
SHARD_ROWS, WIDTH, UPPER = 16384, 32, 16
#: Beam while building; first beam of searches; queries of a batch; vectors audited in a shard; links that the audit must find.
BUILD_BEAM, FIRST_BEAM, BATCH, AUDITED, RECALL = 64, 32, 256, 512, 0.995
#: What single precision may lose before links are verified.
_SLACK = 1e-4


class Graph:
    """The layers of one shard: `links[l][v]` are the neighbours of vertex v on layer l, filled up with -1."""

    def __init__(self, unit: np.ndarray, links: list[np.ndarray], entry: int):
        self.unit, self.links, self.entry = unit, links, entry

    @cached_property
    def back(self) -> tuple[np.ndarray, np.ndarray]:
        """(bounds, vertices): those that have each vertex as a neighbour on the lowest layer."""
        source, target = np.nonzero(self.links[0] >= 0)[0], self.links[0][self.links[0] >= 0]
        return np.concatenate([[0], np.cumsum(np.bincount(target, minlength=len(self.unit)))]), source[np.argsort(target, kind="stable")]

    @staticmethod
    def build(unit: np.ndarray, seed: int = 11) -> Graph:
        n = len(unit)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(rng.random(n)) / np.log(UPPER)).astype(int), 6)
        level[0] = max(level.max(initial=0), 0)
        links = [np.full((n, WIDTH if at == 0 else UPPER), -1, dtype=np.int32) for at in range(level[0] + 1)]
        graph, done = Graph(unit, links, 0), 1
        while done < n:
            new = np.arange(done, min(n, done + min(done, BATCH)))
            graph._insert(new, level)
            done += len(new)
        return graph

    def _insert(self, new: np.ndarray, level: np.ndarray) -> None:
        queries = self.unit[new]
        entries = np.full((len(new), 1), self.entry)
        among = queries @ queries.T
        np.fill_diagonal(among, -np.inf)
        for at in range(len(self.links) - 1, -1, -1):
            mine = np.flatnonzero(level[new] >= at)
            found = self.beam(queries[mine], entries[mine], at, BUILD_BEAM)[0]
            if at:
                entries = self.beam(queries, entries, at, 4)[0]
            if not len(mine):
                continue
            same = np.where((level[new] >= at)[None, :], among[mine], -np.inf)
            nearest = np.argsort(-same, axis=1)[:, :WIDTH]
            mates = np.where(np.take_along_axis(same, nearest, axis=1) > -np.inf, new[nearest], -1)
            chosen = self._choose(new[mine], np.concatenate([found, mates], axis=1), self.links[at].shape[1] // 2)
            self.links[at][new[mine], : chosen.shape[1]] = chosen
            # and back: each neighbour chooses among those it has and those that have chosen it
            source = np.repeat(new[mine], chosen.shape[1])[chosen.reshape(-1) >= 0]
            target = chosen.reshape(-1)[chosen.reshape(-1) >= 0]
            order = np.argsort(target, kind="stable")
            source, target = source[order], target[order]
            named, first, count = np.unique(target, return_index=True, return_counts=True)
            place = np.arange(len(target)) - np.repeat(first, count)
            for begin in range(0, len(named), 1024):
                some = named[begin : begin + 1024]
                width = int(count[begin : begin + 1024].max())
                callers = np.full((len(some), width), -1, dtype=np.int64)
                rows = np.repeat(np.arange(len(some)), count[begin : begin + 1024])
                here = slice(first[begin], first[begin] + len(rows))
                callers[rows, place[here]] = source[here]
                callers = callers[:, : 4 * WIDTH]
                kept = self._choose(some, np.concatenate([self.links[at][some], callers], axis=1), self.links[at].shape[1])
                self.links[at][some] = -1
                self.links[at][some, : kept.shape[1]] = kept

    def _choose(self, of: np.ndarray, among: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, nearest first, those nearer to `of` than to any chosen before; filled up with the nearest others."""
        among = np.sort(among, axis=1)
        again = np.zeros(among.shape, dtype=bool)
        again[:, 1:] = among[:, 1:] == among[:, :-1]
        bad = again | (among < 0) | (among == of[:, None])
        near = np.where(bad, -np.inf, (self.unit[among] @ self.unit[of][:, :, None])[:, :, 0])
        order = np.argsort(-near, axis=1)[:, : 2 * BUILD_BEAM]
        among, near = np.take_along_axis(among, order, axis=1), np.take_along_axis(near, order, axis=1)
        points = self.unit[among]
        between = points @ points.transpose(0, 2, 1)
        good = near > -np.inf
        taken = np.zeros(among.shape, dtype=bool)
        total = np.zeros(len(of), dtype=int)
        for j in range(among.shape[1]):
            covered = (taken[:, :j] & (between[:, j, :j] > near[:, j : j + 1])).any(axis=1)
            taken[:, j] = good[:, j] & ~covered & (total < most)
            total += taken[:, j]
        rank = np.argsort(np.where(taken, 0, np.where(good, 1, 2)), axis=1, kind="stable")[:, :most]
        return np.where(np.take_along_axis(good, rank, axis=1), np.take_along_axis(among, rank, axis=1), -1)

    def beam(self, queries: np.ndarray, entries: np.ndarray, layer: int, width: int, above: float = np.inf, at_once: int = 4):
        """(best, hits): each query's best `width` vertices of a layer, nearest first, and (query, vertex) of all seen with a cosine >= `above`."""
        n, links = len(self.unit), self.links[layer]
        stamp = np.full((len(queries), n), -1, dtype=np.int32)
        best = np.full((len(queries), width), -1, dtype=np.int64)
        near = np.full((len(queries), width), -np.inf, dtype=np.float32)
        spent = np.zeros((len(queries), width), dtype=bool)
        hits: list[np.ndarray] = []

        def fresh(rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Those not seen before, each once, and their cosines."""
            new = (nodes >= 0) & (stamp[rows, nodes] < 0)
            rows, nodes = rows[new], nodes[new]
            number = np.arange(len(rows), dtype=np.int32)
            stamp[rows, nodes] = number
            once = stamp[rows, nodes] == number
            rows, nodes = rows[once], nodes[once]
            cosines = np.einsum("kd,kd->k", queries[rows], self.unit[nodes])
            if len(good := np.flatnonzero(cosines >= above)):
                hits.append(np.stack([rows[good], nodes[good]]))
            return rows, nodes, cosines

        active, wanted = np.arange(len(queries)), entries
        while len(active):
            rows, nodes, cosines = fresh(np.repeat(active, wanted.shape[1]), wanted.reshape(-1))
            # the new ones of a query side by side, then into its beam
            count = np.bincount(rows, minlength=len(queries))
            place = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
            more = int(count.max(initial=0))
            new, gain = np.full((len(queries), more), -1, dtype=np.int64), np.full((len(queries), more), -np.inf, dtype=np.float32)
            new[rows, place], gain[rows, place] = nodes, cosines
            all_near = np.concatenate([near[active], gain[active]], axis=1)
            order = np.argsort(-all_near, axis=1, kind="stable")[:, :width]
            near[active] = np.take_along_axis(all_near, order, axis=1)
            best[active] = np.take_along_axis(np.concatenate([best[active], new[active]], axis=1), order, axis=1)
            spent[active] = np.take_along_axis(np.concatenate([spent[active], np.zeros((len(active), more), dtype=bool)], axis=1), order, axis=1)
            open_ = ~spent[active] & (best[active] >= 0)
            active = active[open_.any(axis=1)]
            open_ = ~spent[active] & (best[active] >= 0)
            picked = np.argsort(~open_, axis=1, kind="stable")[:, :at_once]
            usable = np.take_along_axis(open_, picked, axis=1)
            vertices = np.where(usable, np.take_along_axis(best[active], picked, axis=1), 0)
            spent[active[:, None], picked] = True
            wanted = np.where(usable[:, :, None], links[vertices], -1).reshape(len(active), vertices.shape[1] * links.shape[1])
        # on from every hit, beyond the beam, along links either way
        at = 0
        while at < len(hits):
            rows, nodes = np.concatenate(hits[at:], axis=1)
            at = len(hits)
            bounds, callers = self.back
            for begin in range(0, len(rows), 1 << 15):
                row, node = rows[begin : begin + (1 << 15)], nodes[begin : begin + (1 << 15)]
                fresh(np.repeat(row, links.shape[1]), links[node].reshape(-1))
                count = bounds[node + 1] - bounds[node]
                place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                fresh(np.repeat(row, count), callers[np.repeat(bounds[node], count) + place])
        return best, (np.concatenate(hits, axis=1) if hits else np.zeros((2, 0), dtype=np.int64))

    def near(self, queries: np.ndarray, width: int, above: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, vertex) with a cosine of about `above` or more, batch by batch."""
        for begin in range(0, len(queries), BATCH):
            some = queries[begin : begin + BATCH]
            entries = np.full((len(some), 1), self.entry)
            for layer in range(len(self.links) - 1, 0, -1):
                entries = self.beam(some, entries, layer, 4)[0]
            _, hits = self.beam(some, entries, 0, width, above)
            yield begin + hits[0], hits[1]

    def audited_beam(self, above: float, seed: int = 5) -> tuple[int, float, float]:
        """(beam, links found, turned vectors found): the narrowest beam of 32, 64, … that passes the audit."""
        rng, n = np.random.default_rng(seed), len(self.unit)
        some = rng.permutation(n)[:AUDITED]
        own = self.unit[some]
        aside = rng.standard_normal(own.shape)
        aside -= np.einsum("kd,kd->k", aside, own)[:, None] * own
        norm = np.linalg.norm(aside, axis=1, keepdims=True)
        turned = (above * own + np.sqrt(1 - above**2) * aside / np.where(norm > 0, norm, 1)).astype(np.float32)
        true = own @ self.unit.T >= above
        width = FIRST_BEAM
        while True:
            seen = np.zeros(true.shape, dtype=bool)
            for rows, nodes in self.near(own, width, above - _SLACK):
                seen[rows, nodes] = True
            again = np.zeros(len(some), dtype=bool)
            for rows, nodes in self.near(turned, width, above - 100 * _SLACK):
                again[rows[nodes == some[rows]]] = True
            links, met = float((seen & true).sum() / max(1, true.sum())), float(again.mean()) if len(some) else 1.0
            if min(links, met) >= RECALL or width >= n:
                return width, links, met
            width *= 2


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; rows are scaled first, so that nothing overflows."""
    a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (a.astype(np.float64), b.astype(np.float64)))
    return np.einsum("kd,kd->k", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))


def _unite(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Let `low`, each vertex's smallest known one of its component, know of links (a, b)."""
    while True:
        x, y = low[a], low[b]
        apart = x != y
        if not apart.any():
            return
        np.minimum.at(low, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (low[low] != low).any():
            low[:] = low[low]


_SHARD = "shard int, dims int, vertices binary, copies binary, vectors binary, layers binary, beam int, found double, turned double"
_ARROW = {"int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}


def build_shards(vertices: DataFrame, shards: int, dims: int, threshold: float = COSINE) -> DataFrame:
    """A row for each shard of (vertex, copies, v): its vectors, its graph, and the beam and the recalls of its audit."""
    schema = pa.schema([(name, _ARROW[kind]) for name, kind in (f.strip().split(" ") for f in _SHARD.split(","))])

    def build(table: pa.Table) -> pa.Table:
        rows = table.sort_by("vertex")
        ids, copies = (np.asarray(rows.column(c).combine_chunks(), dtype=np.int64) for c in ("vertex", "copies"))
        lists = rows.column("v").combine_chunks()
        lengths = np.diff(np.asarray(lists.offsets))
        flat = np.asarray(lists.flatten())
        vectors = np.zeros((len(ids), dims), dtype=flat.dtype)
        vectors[np.repeat(np.arange(len(ids)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        graph = Graph.build(_unit(vectors.astype(np.float64)))
        layers = np.concatenate([x.reshape(-1) for x in graph.links])
        row = [rows.column("shard")[0].as_py(), dims, ids.tobytes(), copies.tobytes(), vectors.tobytes(), layers.tobytes(), *graph.audited_beam(threshold)]
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

    dealt = vertices.select(F.pmod(F.xxhash64("vertex"), F.lit(shards)).cast("int").alias("shard"), "vertex", "copies", "v")
    return dealt.groupBy("shard").applyInArrow(build, _SHARD)


class _Shard:
    def __init__(self, row: dict, kind: str):
        self.ids, self.copies = np.frombuffer(row["vertices"], dtype=np.int64), np.frombuffer(row["copies"], dtype=np.int64)
        self.vectors = np.frombuffer(row["vectors"], dtype=kind).reshape(-1, row["dims"])
        self.unit = _unit(self.vectors.astype(np.float64))
        n, flat = len(self.ids), np.frombuffer(row["layers"] or b"", dtype=np.int32)
        lowest, others = flat[: n * WIDTH].reshape(-1, WIDTH), flat[n * WIDTH :].reshape(-1, max(1, n), UPPER)
        self.graph, self.beam = Graph(self.unit, [lowest, *others], 0), row["beam"]


def _found(asking: _Shard, asked: _Shard, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(asking, asked) places with a cosine >= threshold in double precision, a batch of those that ask at a time."""
    for a, b in asked.graph.near(asking.unit, asked.beam, threshold - _SLACK):
        good = [_cosines(asking.vectors[a[i : i + 65536]], asked.vectors[b[i : i + 65536]]) >= threshold for i in range(0, len(a), 65536)]
        good = np.concatenate(good) if good else np.zeros(0, dtype=bool)
        yield a[good], b[good]


def _met_inside(shard: _Shard, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(met, low) of a shard that asks itself: what either of two vertices finds links both."""
    n = len(shard.ids)
    low, met = np.arange(n), np.zeros(n, dtype=np.int64)
    bits = np.zeros((n, -(-n // BATCH) * BATCH // 8), dtype=np.uint8)
    for number, (a, b) in enumerate(_found(shard, shard, threshold)):
        a, b = a[a != b], b[a != b]
        block = np.zeros((BATCH, bits.shape[1] * 8), dtype=bool)
        block[a - number * BATCH, b] = True
        bits[number * BATCH : (number + 1) * BATCH] = np.packbits(block, axis=1)[: n - number * BATCH]
        _unite(low, a, b)
    for begin in range(0, n, BATCH):
        found = np.unpackbits(bits[begin : begin + BATCH], axis=1)[:, :n]
        found_by = np.unpackbits(bits[:, begin // 8 : (begin + BATCH) // 8], axis=1)[:, : len(found)].T
        either = (found | found_by).astype(bool)
        for row in np.flatnonzero(either.any(axis=1)):
            met[begin + row] = shard.copies[either[row]].sum()
    return met, low


def near_links(shards: DataFrame, count: int, kind: str, threshold: float = COSINE) -> DataFrame:
    """(vertex, other, met): for vertices and pairs of shards, how many vectors there are linked, and a vertex of the same component."""
    # shards stand in a ring: each asks itself and the half of the others that follow it, so every pair meets once
    meets = lambda asker, i: f"2 * {i} <> {count} OR {asker} < {count // 2}"
    steps = f"sequence(0, {count // 2})"
    asked = F.expr(f"transform(filter({steps}, i -> i > 0 AND ({meets('shard', 'i')})), i -> cast((shard + i) % {count} AS int))")
    asker = F.expr(f"transform(filter({steps}, i -> {meets(f'pmod(shard - i, {count})', 'i')}), i -> cast(pmod(shard - i, {count}) AS int))")
    columns = ["asker", "asked", "dims", "vertices", "copies", "vectors", "layers", "beam"]
    asks = shards.withColumn("layers", F.lit(None).cast("binary")).select("*", F.col("shard").alias("asker"), F.explode(asked).alias("asked"))
    answers = shards.select("*", F.col("shard").alias("asked"), F.explode(asker).alias("asker"))

    def meet(table: pa.Table) -> pa.Table:
        rows = {r["layers"] is not None: r for r in table.to_pylist()}
        here = rows.get(True) and _Shard(rows[True], kind)
        if here and rows[True]["asker"] == rows[True]["asked"]:
            met, low = _met_inside(here, threshold)
            ids = here.ids
        elif len(rows) == 2:
            asking = _Shard(rows[False], kind)
            n = len(asking.ids)
            ids = np.concatenate([asking.ids, here.ids])
            low, met = np.arange(len(ids)), np.zeros(len(ids), dtype=np.int64)
            for a, b in _found(asking, here, threshold):
                np.add.at(met, a, here.copies[b])
                np.add.at(met, n + b, asking.copies[a])
                _unite(low, a, n + b)
        else:  # an empty shard
            ids = low = met = np.zeros(0, dtype=np.int64)
        some = np.flatnonzero(met)
        return pa.table({"vertex": ids[some], "other": ids[low[some]], "met": met[some]})

    met = asks.select(*columns).unionByName(answers.select(*columns))
    return met.groupBy("asker", "asked").applyInArrow(meet, "vertex long, other long, met long")


def near_duplicates(vectors: DataFrame, threshold: float = COSINE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vectors (vec_id, embedding)."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    good = F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", F.when(good, v).alias("v"))
    kinds = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    vertices = materialize(kinds.withColumn("vertex", F.monotonically_increasing_id()), "vertices")
    totals = vertices.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).first()
    shards = max(1, -(-totals["n"] // shard_rows))
    kind = {"float": "f4", "double": "f8"}[vectors.schema["embedding"].dataType.elementType.simpleString()]
    built = materialize(build_shards(vertices, shards, totals["dims"] or 0, threshold), "graphs")
    met = materialize(near_links(built, shards, kind, threshold), "met")
    links = met.where("vertex <> other").select(F.col("vertex").alias("a"), F.col("other").alias("b"))
    found = components(links)
    counts = met.groupBy("vertex").agg(F.sum("met").alias("met"))
    named = vertices.join(counts, "vertex", "left").join(found.withColumnRenamed("node", "vertex"), "vertex", "left")
    named = named.select("v", "least", (F.coalesce("met", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vertex").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = named.join(smallest, "component").select("v", "n_links", "component_id")
    id_ = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = rows.join(known, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), id_.alias("component_id"))
    discard(built)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op11_hnsw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with a cosine of 0.95 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


HNSW_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))), false) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), c AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id
"""
