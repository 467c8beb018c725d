"""Pairs of a key: all of them in the end, in bounded memory."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from ringspan.llm import blocks as B
from ringspan.llm._shared import cut


def entries(n, root):
    """Rows of one key with equal prints: (key, check, last, size, node[, root])."""
    t = [np.zeros(n), np.zeros(n), np.zeros(n), np.full(n, 50), np.arange(n)]
    return np.stack([*t, np.arange(n)] if root else t).astype(np.int64)


def test_pairs_leave_as_they_are_found():
    b = B.Blocks(2, 12, 10, 2.4)
    peaks = []
    for n in (2500, 5000):
        tracemalloc.start()
        r = B._Run(entries(n, True), 6, b, 0.8)
        found = sum(len(u) for u, _, _ in r.pairs(lambda rows: np.ones(len(rows), dtype=bool)))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert found == n * (n - 1) // 2
    assert peaks[1] < 200_000_000 and peaks[1] < 1.3 * peaks[0]


def nodes_of(spark, n):
    b = B.Blocks(2, 12, 10, 2.4)
    return b, cut(spark.range(n).select(F.col("id").alias("node"), F.lit(50).cast("long").alias("size"), *[F.lit(7 + k).cast("long").alias(c) for k, c in enumerate(B.print_columns(b.words))]), "nodes")


def test_every_pair_is_tried_where_none_holds(spark):
    """Equal prints whose texts are all refuted: each pair comes up once, over several rounds."""
    b, nodes = nodes_of(spark, 150)
    tried = []

    def verify(links):
        tried.append({tuple(r) for r in links.collect()})
        return links.where("false")

    assert B.groups(nodes, b, verify, 0.8).count() == 0
    assert sum(map(len, tried)) == len(set.union(*tried)) == 150 * 149 // 2 and len(tried) > 2


def test_no_more_pairs_than_needed_where_all_hold(spark):
    b, nodes = nodes_of(spark, 300)
    tried = []

    def verify(links):
        links = cut(links, "links")
        tried.append(links.count())
        return links

    got = B.groups(nodes, b, verify, 0.8)
    assert got.count() == 300 and got.select("root").distinct().count() == 1 and sum(tried) < 10 * 300


def random_nodes(spark, n, seed):
    """Prints in clusters, with sizes."""
    rng = np.random.default_rng(seed)
    b = B.Blocks(2, 12, 10, 2.4)
    base = rng.integers(0, 2**63, (n // 6, 2), dtype=np.uint64)
    prints = base[rng.integers(0, len(base), n)] ^ (np.uint64(1) << rng.integers(0, 64, (n, 2)).astype(np.uint64))
    rows = [(i, int(s), *map(int, p)) for i, (s, p) in enumerate(zip(rng.integers(40, 60, n), prints.view(np.int64), strict=True))]
    return b, prints, cut(spark.createDataFrame(rows, "node long, size long, p0 long, p1 long"), "nodes")


def all_pairs(prints, size, b, least):
    """Pairs that meet on a block and pass, by brute force."""
    found = set()
    for k in range(b.count):
        key, check = B._at(prints, k * b.bits) & np.uint64((1 << b.bits) - 1), B._at(prints, (k + 1) * b.bits)
        for i in range(len(prints)):
            j = np.flatnonzero((key[:i] == key[i]) & (least * np.maximum(size[:i], size[i]) <= np.minimum(size[:i], size[i]) + 1e-6))
            x = check[j] ^ check[i]
            apart = np.bitwise_count(prints[j, -1] ^ prints[i, -1]).astype(int) + np.bitwise_count(x)
            found |= {(i, int(y)) for y in j[B._chain(x, b) & (apart <= B.TOGETHER * 128 / b.bits * b.budget)]}
    return found


def test_dealt_keys_and_hot_keys_give_all_pairs(spark):
    """Each row a root of its own: untried gives every pair, whether keys are dealt as bytes or, if hot, row by row."""
    B.ship(spark)
    b, prints, nodes = random_nodes(spark, 400, 3)
    size = np.array([r["size"] for r in nodes.orderBy("node").select("size").collect()])
    want = all_pairs(prints, size, b, 0.8)
    rooted = cut(nodes.withColumn("root", F.col("node")), "rooted")
    for max_run in (20_000, 8, 3):  # no hot key; some; nearly all
        got = {(r["u"], r["v"]) for r in B.untried(rooted, b, 0.8, 10**6, max_run, 1).collect()}
        assert got == want and len(want) > 400


def test_entries_move_many_in_a_row(spark):
    """One row of a shuffle holds the entries of a part of the keys, not one."""
    B.ship(spark)
    b, _, nodes = random_nodes(spark, 6000, 5)
    rows = B._dealt(nodes.coalesce(1), b, False, np.zeros(0, dtype=np.int64))
    got = rows.selectExpr("count(*) as n", "sum(octet_length(rows)) as b", "count(distinct part) as parts").first()
    assert got["b"] == 6000 * b.count * 40 and got["n"] <= 2 * got["parts"] < 6000 * b.count / 5


def test_no_part_is_split_and_bounds_hold(monkeypatch):
    """Parts of many batches come whole, in order of key and size, some 200,000 entries at a time."""
    pa, rng, b = B.pa, np.random.default_rng(2), B.Blocks(2, 12, 10, 2.4)
    batches, every = [], []
    for part in range(40):
        for _ in range(3):
            t = np.stack([np.full(5000, part << 40) + rng.integers(0, 50, 5000), *rng.integers(0, 99, (4, 5000))], axis=1)
            every.append(t)
            batches.append(pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([t.tobytes()], pa.binary())], names=["part", "rows"]))
    batches = pa.Table.from_batches(batches).combine_chunks().to_batches(max_chunksize=7)
    got = list(B._of_parts(batches, 5, b, lambda t: [t]))
    assert sorted(map(tuple, np.concatenate(got, axis=1).T.tolist())) == sorted(map(tuple, np.concatenate(every).tolist()))
    keys = [set(t[0].tolist()) for t in got]
    assert len(got) > 2 and max(t.shape[1] for t in got) < 220_000 and sum(map(len, keys)) == len(set.union(*keys))
    for t in got:
        assert (np.diff(t[0] * 100 + t[3]) >= 0).all()


def test_near_pairs_by_row_and_by_distance(monkeypatch):
    """Rows with many partners and few are looked at in two ways, which agree."""
    rng, b = np.random.default_rng(7), B.Blocks(2, 12, 10, 2.4)
    t = np.stack([np.sort(rng.integers(0, 9, 900)), rng.integers(0, 2**10, 900), rng.integers(0, 4, 900), rng.integers(40, 70, 900), np.arange(900)]).astype(np.int64)
    r = B._Run(t, 5, b, 0.8)
    rows = np.flatnonzero(r.meets > 0)
    many = set(zip(*(c.tolist() for c in r._near(rows)), strict=True))
    few = set()
    for i in rows:
        few |= set(zip(*(c.tolist() for c in r._near(np.array([i]))), strict=True))
    assert many == few and len(many) > 1000
