"""Neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringspan.llm import ann as A


def brute(ids, v, queries, k):
    out = {}
    for q in queries:
        s = [(-float(A.exact(v[q : q + 1], v[j : j + 1])[0]), ids[j]) for j in range(len(ids)) if j != q]
        out[ids[q]] = [i for _, i in sorted(s)[:k]]
    return out


def rows(spark, ids, v):
    return spark.createDataFrame([(int(i), [float(x) for x in r], 1) for i, r in zip(ids, v, strict=True)], "vec_id long, embedding array<float>, id int")


def recall(spark, ids, v, **kw):
    got = {}
    for r in A.search(rows(spark, ids, v), F.col("id") % 50 == 0, **kw).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    want = brute(ids, v, range(0, len(ids), 50), 5)
    for q, found in got.items():
        assert len(found) == 5 and all(s == float(A.exact(v[q : q + 1], v[j : j + 1])[0]) for j, s in found.items())
    return np.mean([len(set(got[q]) & set(w)) / 5 for q, w in want.items()])


def test_a_table_of_one_window_is_searched_whole(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((30, 8)).astype(np.float32).astype(float)
    assert recall(spark, range(30), v) == 1


@pytest.mark.parametrize("n", [600, 4000])
def test_recall_without_structure(spark, n):
    v = np.random.default_rng(n).standard_normal((n, 64)).astype(np.float32).astype(float)
    assert recall(spark, range(n), v) >= 0.9


def test_windows_beyond_the_sample_are_dealt_in_parts(spark):
    """Two windows of many parts: a query that reaches both finds all there is."""
    v = np.random.default_rng(4).standard_normal((500, 8)).astype(np.float32).astype(float)
    assert recall(spark, range(500), v, curves=2, window_rows=16, sample_rows=16, reach=2) == 1


def test_recall_of_a_fixed_reach_on_clusters(spark):
    rng = np.random.default_rng(2)
    v = (rng.standard_normal((600, 32))[rng.integers(0, 600, 6000)] + 0.1 * rng.standard_normal((6000, 32))).astype(np.float32).astype(float)
    assert recall(spark, range(6000), v, reach=1) >= 0.9


def test_double_vectors_keep_their_precision(spark):
    v = np.random.default_rng(3).standard_normal((25, 6))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = A.search(df, F.col("id") == 0).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, float(A.exact(v[:1], v[i : i + 1])[0])) for i in brute(range(25), v, [0], 5)[0]]


def test_copies_ties_and_bad_rows(spark):
    same = [1.0, 2.0, 3.0]
    data = [(i, same) for i in range(20)] + [(100, [3.0, -1.0, 0.5]), (100, [3.0, -1.0, 0.5]), (150, None), (200, [0.0, 0.0, 0.0]), (250, [1.0, None, 2.0]), (300, [1.0, float("nan"), 2.0]), (350, []), (400, [1.0]), (None, same), (450, [float("inf"), 1.0, 1.0])]
    df = spark.createDataFrame([(i, v) for i, v in data], "vec_id long, embedding array<float>")
    got = {}
    for r in A.search(df, F.col("id") % 10 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {0: [1, 2, 3, 4, 5], 10: [0, 1, 2, 3, 4], 100: [0, 1, 2, 3, 4]}


def test_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in A.search(df, F.col("id") == 0).collect()] == [(0, 1)]
    assert A.search(df.limit(0), F.col("id") == 0).count() == 0


def test_hilbert_neighbours_are_neighbours():
    n = 8
    grid = np.array([(x, y) for x in range(n) for y in range(n)])
    k = A.hilbert_keys(grid, 3)
    assert sorted(k.tolist()) == list(range(n * n))
    path = grid[np.argsort(k)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
