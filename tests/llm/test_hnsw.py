import collections

import numpy as np

from lotstack.llm import hnsw

VECTORS = "vec_id long, embedding array<float>, vertex int"


def brute(rows):
    """(n_links, component) of each row, by all cosines in double precision."""
    good = [r for r in rows if r[1] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    width = max((len(r[1]) for r in good), default=0)
    x = np.array([np.float32(list(r[1]) + [0] * (width - len(r[1]))).astype(float) for r in good]).reshape(len(good), width)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    of = list(range(len(good)))
    for i, j in zip(*np.nonzero(linked)):
        a, b = of[i], of[j]
        if a != b:
            of = [min(a, b) if o in (a, b) else o for o in of]
    least = collections.defaultdict(list)
    for r, o in zip(good, of):
        least[o].append(r[0])
    out = [(r[0], 0, r[0]) for r in rows if not any(r is g for g in good)]
    return sorted((*out, *((r[0], int(n) - 1, min((i for i in least[o] if i is not None), default=None)) for r, o, n in zip(good, of, linked.sum(axis=1)))), key=str)


def clusters(seed, n, dims=16):
    """Random directions, and groups of near copies of a few of them; distances about the threshold."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n, dims))
    noisy = [centres[rng.integers(0, 5)] + rng.standard_normal(dims) * rng.choice([0.05, 0.15, 0.25]) for _ in range(n)]
    return [(i, [float(np.float32(y)) for y in x], 1) for i, x in enumerate([*centres, *noisy])]


def found(spark, rows, **parameters):
    out = hnsw.near_duplicates(spark.createDataFrame(rows, VECTORS), **parameters).collect()
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in out)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=str)


def test_links_equal_brute_force_in_one_shard_and_in_many(spark):
    rows = clusters(1, 300)
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, shard_rows=130) == brute(rows)  # odd number of shards
    assert found(spark, rows, shard_rows=160) == brute(rows)  # even
    assert sum(n for _, n, _ in brute(rows)) > 5000


def test_odd_vectors_have_defined_results(spark):
    one = [1.0, 2.0, 0.0]
    rows = [(1, one, 1), (1, one, 2), (2, [2.0, 4.0], 3), (3, None, 4), (4, [0.0, 0.0, 0.0], 5), (5, [float("nan"), 1.0, 1.0], 6), (6, [None, 1.0, 1.0], 7)]
    rows += [(7, [], 8), (None, one, 9), (None, [0.0, 0.0, 5.0], 10), (8, [3e38, 3e38, 3e38], 11), (9, [1e-38, 1e-38, 1e-38], 12), (None, None, 13)]
    assert found(spark, rows) == brute(rows)
    assert (9, 1, 8) in found(spark, rows)


def test_tables_may_be_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(5, None, 0)]) == [(5, 0, 5)]


def test_many_equal_vectors_are_one_vertex(spark):
    rows = [(i, [1.0, 0.5], 0) for i in range(3000)] + [(9000, [-1.0, 0.5], 0)]
    assert found(spark, rows) == sorted([(i, 2999, 0) for i in range(3000)] + [(9000, 0, 9000)], key=str)


def test_searches_reach_a_group_wider_than_the_beam():
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(32)
    x = np.concatenate([rng.standard_normal((1500, 32)), centre + 0.1 * rng.standard_normal((900, 32))])
    unit = hnsw._unit(x)
    graph = hnsw.Graph.build(unit)
    seen = np.zeros((len(x), len(x)), dtype=bool)
    for rows, nodes in graph.near(unit, 32, 0.95):
        seen[rows, nodes] = True
    true = unit @ unit.T >= 0.95
    assert true.sum() > 500_000 and (seen & true).sum() >= 0.999 * true.sum()


def test_the_beam_widens_until_the_audit_passes():
    unit = hnsw._unit(np.random.default_rng(4).standard_normal((600, 24)))
    graph = hnsw.Graph.build(unit)
    assert graph.audited_beam(0.95)[0] == hnsw.FIRST_BEAM
    graph.links[0][:] = -1
    graph.links[0][:-1, 0] = np.arange(1, 600)  # a chain: only a beam as wide as the shard walks all of it
    for layer in graph.links[1:]:
        layer[:] = -1
    graph = hnsw.Graph(unit, graph.links, 0)
    beam, links, turned = graph.audited_beam(0.95)
    assert beam > hnsw.FIRST_BEAM and links == turned == 1.0
