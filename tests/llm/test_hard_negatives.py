"""Hard negatives against the scores of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringspan.llm import hard_negatives as H

SCHEMA = "vec_id long, v array<long>, label int, id int, score string, far string, a int, c1 int, key int"


def brute(rows, k=5, m=5, low=80, high=100, every=10):
    rows = sorted({(i, lab, tuple(v)) for i, v, lab in rows if i is not None and lab is not None and v is not None and None not in v})
    dims = [len(v) for _, _, v in rows]
    dim = min(set(dims), key=lambda d: (-dims.count(d), d)) if dims else 0
    rows = [r for r in rows if len(r[2]) == dim]
    out = []
    for a in (r for r in rows if r[0] % every == 0):
        dot = lambda r: sum(x * y for x, y in zip(a[2], r[2], strict=True))  # noqa: B023, E731
        for p in sorted((r for r in rows if r[1] == a[1] and r[0] != a[0]), key=lambda r: (-dot(r), r[0]))[:k]:
            neg = sorted((r for r in rows if r[1] != a[1] and low * dot(p) <= 100 * dot(r) <= high * dot(p)), key=lambda r: (-dot(r), r[0]))[:m]
            out += [(a[0], p[0], n + 1, x[0], dot(p), dot(x)) for n, x in enumerate(neg)]
    return sorted(out)


def found(spark, rows, every=10, **how):
    df = spark.createDataFrame([(*r, 1, "s", "f", 2, 3, 4) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in H.mine(df, F.col("id") % every == 0, vec_col="v", **how).collect())


def clustered(seed, n=600, dim=12, scale=256):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((8, dim))
    return [(i, [int(x) for x in np.floor(scale * (centre[i % 8] + 0.4 * rng.standard_normal(dim)))], int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("how", [{}, {"block_anchors": 7}, {"pivots": 1}, {"positives": 2, "negatives": 3}])
def test_all_pairs(spark, how):
    rows = clustered(3)
    assert found(spark, rows, **how) == brute(rows, how.get("positives", 5), how.get("negatives", 5))


def test_copies_and_ties(spark):
    """A third of the rows are one vector, under several labels."""
    rows = clustered(4, 300) + [(1000 + i, [300] * 12, i % 3) for i in range(150)]
    assert found(spark, rows) == brute(rows)


def test_nulls_other_dimensions_and_repeats(spark):
    rows = clustered(5, 120)
    rows += [rows[10], rows[11], (None, rows[0][1], 1), (500, None, 1), (510, [None] * 12, 1), (520, [1, 2], 1), (530, [], 1), (540, rows[0][1], None), (550, [2**40] * 12, 1), (560, [0] * 12, 1), (570, [-x for x in rows[0][1]], 2)]
    assert found(spark, rows) == brute([r for r in rows if r[0] != 550])


def test_large_components_are_scored_exactly(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [int(x) for x in rng.integers(-(2**26), 2**26, 6)], int(rng.integers(0, 3))) for i in range(200)]
    assert found(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert found(spark, []) == []
    one = [(0, [1, 2], 1)]
    assert found(spark, one) == []
    few = [(0, [10, 10], 1), (1, [10, 9], 1), (2, [10, 8], 2), (3, [0, 1], 2)]
    assert found(spark, few) == brute(few) == [(0, 1, 1, 2, 190, 180)]


def test_brackets_hold_and_prune():
    rows = np.array([v for _, v, _ in clustered(7)], dtype=np.int64)
    p = H.Pivots(rows[:200], int((rows**2).sum(axis=1).max()), 8)
    b = H.Block(p, np.arange(20), np.zeros(20, dtype=np.int64), rows[:20], 5)
    least, most = b.bracket(slice(0, 20), p.of_rows(rows))
    score = rows[:20] @ rows.T
    assert (least <= score).all() and (score <= most).all()
    assert (most < np.partition(score, -6, axis=1)[:, -6][:, None]).mean() > 0.3  # of clustered rows a third needs no score
