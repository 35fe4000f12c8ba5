import math
from functools import reduce
from operator import add

import numpy as np
import pytest

from larder.llm import neighbours as nb
from larder.llm import small_world as sw

SCHEMA = "vec_id long, embedding array<double>, score string, query long, dim int"


def brute(rows, k, step):
    """The exact answer, added up in one order; rows that repeat each other count once."""
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    out = []
    for q, v in rows:
        if q % step == 0:
            score = lambda x: reduce(add, (a * b for a, b in zip(v, x, strict=True)), 0.0)  # noqa: B023, E731  (sum() would correct its rounding)
            near = sorted((-score(x), i) for i, x in rows if i != q and len(x) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return sorted(out)


def asked(spark, rows, k=5, step=3, **more):
    vectors = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in nb.nearest(nb.build_index(vectors, k, **more), vectors.filter(f"vec_id % {step} = 0"), k, query_block=7).collect())


def made(n, dim, seed=1):
    return np.random.default_rng(seed).normal(size=(n, dim))


@pytest.mark.parametrize("shard_vectors", [nb.SHARD_VECTORS, 50])
def test_small_shards_are_exact(spark, shard_vectors):
    """A search that keeps as many nodes as a shard has finds all; lengths and dimensions differ."""
    r = np.random.default_rng(2)
    rows = [(i, list(map(float, v * r.choice([1e-3, 1, 50])))) for i, v in enumerate(made(150, 6))] + [(1000 + i, list(map(float, v))) for i, v in enumerate(made(20, 3))]
    assert asked(spark, rows, shard_vectors=shard_vectors) == brute(rows, 5, 3)


def test_copies_ties_and_odd_rows(spark):
    same, rows = [1.0, 2.0], [(i, [1.0, 2.0]) for i in range(400)]
    rows += rows[:100] + [(-3, [2.0, 1.0]), (3003, [2.0, -1.0]), (3006, [0.0, 3.0]), (None, same), (501, None), (504, []), (507, [0.0, -0.0]), (510, [math.nan, 1.0]), (513, [math.inf, 1.0]), (516, [None, 1.0]), (519, [1e200, 1e200]), (522, [1e-200, 0.0])]
    assert asked(spark, rows) == brute(rows, 5, 3)


def test_an_id_with_several_vectors_is_answered_for_each(spark):
    rows = [(3, [1.0, 0.0]), (3, [0.0, 1.0]), (1, [5.0, 1.0]), (2, [1.0, 5.0])]
    assert asked(spark, rows, k=1) == [(3, 1, 1, 5.0), (3, 1, 2, 5.0)]


def test_few_rows_and_none(spark):
    assert asked(spark, []) == [] and asked(spark, [(3, [1.0])]) == []
    assert asked(spark, [(3, [1.0]), (6, [-2.0])]) == [(3, 1, 6, -2.0), (6, 1, 3, -2.0)]


def test_recall_of_a_graph():
    """Clusters, tight groups of near copies and lengths that differ."""
    r = np.random.default_rng(3)
    centres = made(20, 24, 4)
    v = centres[r.integers(0, 20, 3000)] + 0.4 * made(3000, 24, 5)
    v[:800] = centres[0] + 1e-4 * made(800, 24, 6)
    v = (v / np.linalg.norm(v, axis=1, keepdims=True) * r.uniform(0.75, 1.3, (3000, 1))).astype(np.float32)
    draws = sw.spread(np.arange(3000))
    order = sw.Graph.order(draws, np.arange(3000))
    v = v[order]
    graph = sw.Graph.build(sw.on_sphere(v), draws[order])
    assert len(graph.layers) > 1 and all(len(a) > len(b) for a, b in zip(graph.layers, graph.layers[1:], strict=False))
    queries = np.arange(0, 3000, 20)
    found = graph.search(v[queries], nb.BEAM)[:, :20]
    exact = v[queries].astype(float) @ v.T.astype(float)
    least = np.sort(exact, axis=1)[:, -20]
    assert np.mean(np.take_along_axis(exact, found, 1) >= least[:, None] - 1e-6) >= 0.95


def test_built_again_alike():
    v = made(500, 8).astype(np.float32)
    draws = np.sort(sw.spread(np.arange(500)))
    a, b = (sw.Graph.build(sw.on_sphere(v), draws) for _ in range(2))
    assert all((x == y).all() for x, y in zip(a.layers, b.layers, strict=True))
