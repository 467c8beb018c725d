"""Connected components of a graph given as edges, by alternating stars.

Edges of 64-bit integers are contracted first where they lie, some 300,000 at a time, to stars of their own, which leaves few rounds
to do. Each round of large stars (every node's larger neighbours move to the least neighbour) and small
stars (its smaller ones do) is two joins on the node; the rounds end when nothing changes, after
about log(nodes) of them. Each round is written to the shared folder, so a lost executor costs one
round. No node, whatever its degree, meets in one task: minima are pre-aggregated where the edges
lie, and the joins may be split by AQE where a node is hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringspan.llm._shared import cut, few_tasks, ship

#: Edges that are contracted together at most.
TOGETHER = 300_000


def _mark(edges: DataFrame) -> tuple:
    """What tells one set of edges from another."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum((h % 1_000_003).cast("long")), F.lit(0)), F.coalesce(F.bit_xor(h), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node that has an edge to another, with the least node of its component.
    edges: (u, v), of one orderable type; loops, nulls and repeated edges do no harm."""
    with few_tasks(edges.sparkSession):
        return _components(edges)


def _stars(batches):
    """Edges (u, v), u > v, that join the same nodes as those of batches: of some TOGETHER edges at a time each node to the least that it reaches."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= TOGETHER:
            yield _contracted(held)
            held, n = [], 0
    if n:
        yield _contracted(held)


def _contracted(held) -> pa.RecordBatch:
    nodes, at = np.unique(np.concatenate([b.column(k).to_numpy() for k in (0, 1) for b in held]), return_inverse=True)
    root = list(range(len(nodes)))
    for x, y in at.reshape(2, -1).T.tolist():
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[max(x, y)] = min(x, y)
    for x in range(len(root)):  # no root is greater than its node
        root[x] = root[root[x]]
    moved = np.flatnonzero(np.array(root) != np.arange(len(root)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[np.array(root)[moved]])], names=["u", "v"])


def _components(edges: DataFrame) -> DataFrame:
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    if [kind for _, kind in e.dtypes] == ["bigint", "bigint"]:
        ship(e.sparkSession)
        e = e.mapInArrow(_stars, "u long, v long")
    e = cut(e, "edges")
    seen = _mark(e)
    while seen[0]:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small_least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(moved.union(small_least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        mark = _mark(new)
        if mark == seen:
            break
        e, seen = new, mark
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return cut(e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots), "components")
