"""b-bit MinHash against all pairs of whole sets."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringspan.llm import minhash as M
from ringspan.llm._shared import cut
from ringspan.llm.queries import op11_minhash

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOW))
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, percent=85):
    """{(id, size, component, kept)} of all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        if k is not None and (least.get(r) is None or k < least[r]):
            least[r] = k
        least.setdefault(r, None)
    return sorted(((k, len(s), least[find(i)], k == least[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def found(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in M.near_duplicates(docs, **how).collect()), key=str)


def varied(rng, n_base, copies, words=80, edits=4):
    rows = []
    for _ in range(n_base):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(words)] = f"x{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(w)))
    return rows


def test_components_are_those_of_all_pairs(spark):
    rows = varied(random.Random(1), 30, 8) + [(1000 + i, f"passage that many share {'a b c d e f g h ' * 6} {i} {i}") for i in range(20)]
    assert found(spark, rows) == brute(rows)


def test_a_dense_group_near_the_bound(spark):
    """Most pairs of the group lie around the similarity asked for, so many candidates are refuted and others must be tried."""
    rows = varied(random.Random(2), 1, 150, 100, 3) + varied(random.Random(3), 2, 40, 60, 3)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    want = brute(rows)
    assert len({c for _, _, c, _ in want}) > 5
    assert found(spark, rows) == want


def test_hot_keys_are_dealt_in_parts(spark):
    rows = varied(random.Random(4), 3, 60, 70, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = cut(M.signatures(docs).where("n > 0"), "made").dropDuplicates(["d1", "d2"]).withColumnRenamed("id", "node")
    nodes = cut(made.select("node", "n", *M._words(192), "bands"), "nodes")

    def joined(links):
        root = {}

        def find(i):
            while root.get(i, i) != i:
                i = root[i]
            return i

        for u, v in links.where("u <> v").collect():
            root[find(u)] = find(v)
        return {(k, min(j for j in range(len(rows)) if find(j) == find(k))) for k in range(len(rows))}

    assert joined(M.candidates(nodes, 85, 192, max_run=7, sampled=1)) == joined(M.candidates(nodes, 85, 192))


def test_second_look_joins_what_all_linked_candidates_do(spark):
    """With each node a root of its own the components are those of all linked pairs that share a key, in parts or not."""
    rows = varied(random.Random(5), 2, 25, 60, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = cut(M.signatures(docs).dropDuplicates(["d1", "d2"]).withColumnRenamed("id", "node"), "made")
    nodes = cut(made.select("node", "n", *M._words(192), "bands", F.col("node").alias("root")), "nodes")
    sets = spark.createDataFrame([(i, M._set_of(t, 5).tobytes()) for i, t in rows], "node long, held binary")
    least = {k: c for k, _, c, _ in brute(rows)}
    for size in (M.CELL_BYTES, 3000):
        got = M.joined_on_sets(nodes, sets, 85, 192, size).collect()
        assert all(least[a] == least[b] for a, b in got)
        root = {k: k for k in least}
        for a, b in got:
            x, y = root[a], root[b]
            root = {k: min(x, y) if r in (x, y) else r for k, r in root.items()}
        kept = {r["node"] for r in nodes.collect()}
        assert len({root[k] for k in kept}) == len({least[k] for k in kept})


@pytest.mark.parametrize("similarity", [0.0, 0.5, 0.85, 1.0])
def test_estimates(similarity):
    rng = np.random.default_rng(int(100 * similarity) + 1)
    of, off = M.Functions(192, 3), []
    for _ in range(60):
        h = rng.integers(0, 2**64, 1000, dtype=np.uint64)
        common = int(round(1000 * 2 * similarity / (1 + similarity)))
        other = np.concatenate([h[:common], rng.integers(0, 2**64, 1000 - common, dtype=np.uint64)])
        a, b = M.packed(of.minima(h)[None]), M.packed(of.minima(other)[None])
        off.append(float(M.estimate(M.agreeing(a, b, 192)[0], 192)) - similarity)
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


def test_odd_rows(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = sorted((tuple(r) for r in M.near_duplicates(odd).collect()), key=str)
    assert got == brute(rows)
    assert (4, 0, 4, True) in got and (7, got[[g[0] for g in got].index(7)][1], 6, False) in got


def test_nulls_short_texts_and_ties(spark):
    rows = [(5, "One two"), (2, "one TWO "), (None, "one two"), (None, "alone here"), (7, "one two three four five"), (7, "one two three four five"), (3, " \t"), (4, None), (9, "Ärger ÄRGER")]
    got = found(spark, rows)
    assert got == sorted([(5, 1, 2, False), (2, 1, 2, True), (None, 1, 2, False), (None, 1, None, True), (7, 1, 7, True), (7, 1, 7, True), (3, 0, 3, True), (4, 0, 4, True), (9, 1, 9, True)], key=str)


def test_empty_table(spark, none):
    assert M.near_duplicates(none).count() == 0


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op11_minhash(spark, d).collect()), key=str) == brute(rows)
