"""SimHash near-duplicates against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ringspan.llm import simhash as S
from ringspan.llm.components import components


def slow_print(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_roots(fps, bits=3):
    at = {f: f for f in fps}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= bits:
                at[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def clusters(seed, n=60, size=12):
    rng = random.Random(seed)
    out = set()
    for _ in range(n):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, size)):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5)))
            out.add(f - 2**64 if f >= 2**63 else f)
    return sorted(out)


def test_fingerprint_brute(odd):
    for r in odd.collect():
        assert S.fingerprint(r["text"] or "") == slow_print(r["text"])


def run(spark, fps, **kw):
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    return {r["node"]: r["root"] for r in components(S.near_links(df, **kw)).collect()}


def test_links_join_what_all_pairs_join(spark):
    fps = clusters(1)
    got, want = run(spark, fps), slow_roots(fps)
    assert {f: got.get(f, f) for f in fps} == want


def test_hot_keys_in_blocks(spark):
    rng = random.Random(5)
    base = rng.getrandbits(62)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(700)})
    fps = sorted(f - 2**64 if f >= 2**63 else f for f in fps)
    got, want = run(spark, fps, max_run=40, sampled=4), slow_roots(fps)
    assert {f: got.get(f, f) for f in fps} == want


def test_near_duplicates_of_odd_rows(spark, odd):
    rows = S.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r["id"], set()).add(r["component_id"])
    assert by[3] == by[4] == by[5] == {3} and by[6] == by[7] == {6} and by[2] == {2}


def test_empty_table(spark, none):
    assert S.near_duplicates(none).count() == 0


def test_forest_is_a_forest():
    fps = np.array([0, 1, 3, 7, 0xF0F0 << 40], dtype=np.uint64)
    links = S.forest(fps, 3, 1)
    assert len(links) <= 4 and all(4 not in x for x in links)


def test_components_of_a_path(spark):
    n = 40
    e = spark.range(n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r["root"] for r in components(e).collect()} == {0}
    assert components(e.limit(0)).count() == 0


def slow_near(texts, similarity=0.8):
    """Least member of the group of each text, over all pairs of shingle sets."""
    sets = [set(S.shingles(t or "").tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) + 1e-9 >= similarity * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def near(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    got = {r["row"]: r["root"] for r in S.near_texts(rows, "row").collect()}
    return [got[i] for i in range(len(texts))]


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"w{rng.getrandbits(30)}"
    return " ".join(out)


def test_near_texts_are_those_of_all_pairs(spark):
    rng = random.Random(21)
    texts = [None, "", " \n", "a b", "A  B", "one two three four five six", "repeat " * 50, "repeat " * 50 + "tail of it"]
    for i in range(60):
        base = [f"w{rng.getrandbits(30)}" for _ in range(rng.randint(60, 400))]
        texts += [edited(rng, base, k) for k in (0, 0, 1 + len(base) // 150, len(base) // 12)]
    assert near(spark, texts) == slow_near(texts)


def test_a_dense_group_whose_members_are_near_only_to_its_base(spark):
    """Copies are at about 0.73 to each other and at 0.85 to the base: no link between copies holds."""
    rng = random.Random(3)
    base = [f"w{rng.getrandbits(30)}" for _ in range(500)]
    texts = [edited(rng, base, 9) for _ in range(60)] + [" ".join(base)]
    got, want = near(spark, texts), slow_near(texts)
    assert len(set(want)) == 1
    assert sum(g == got[-1] for g in got) >= 58


def test_expected_difference():
    rng = np.random.default_rng(1)
    common, own = rng.integers(0, 2**63, 1600, dtype=np.uint64), rng.integers(0, 2**63, (2, 200), dtype=np.uint64)
    x, y = (S.wide_print(np.concatenate([common, o]), 64) for o in own)
    assert abs(np.bitwise_count(x ^ y).sum() / 4096 - S.expected_difference(0.8)) < 0.02


def test_near_texts_of_an_empty_table(spark):
    assert S.near_texts(spark.createDataFrame([], "row long, text string"), "row").count() == 0


def test_a_path_is_contracted_before_the_rounds(spark, monkeypatch):
    """Edges are joined where they lie first: a long path takes a round or two, not one for each doubling."""
    from ringspan.llm import components as C

    names = []
    monkeypatch.setattr(C, "cut", lambda df, name, f=C.cut: names.append(name) or f(df, name))
    e = spark.range(1, 3000).selectExpr("id as u", "id - 1 as v")
    got = components(e)
    assert got.count() == 3000 and got.where("root <> 0").isEmpty() and names.count("edges") <= 4


@pytest.mark.parametrize("together", [3, 50, 10**6])
def test_contracted_edges_join_the_same_nodes(monkeypatch, together):
    import pyarrow as pa

    from ringspan.llm import components as C

    monkeypatch.setattr(C, "TOGETHER", together)
    rng = np.random.default_rng(together)
    for _ in range(40):
        u, v = rng.integers(-40, 40, (2, rng.integers(1, 60)))
        u, v = np.maximum(u, v)[u != v], np.minimum(u, v)[u != v]
        made = [x for b in C._stars([pa.RecordBatch.from_arrays([pa.array(u[k : k + 4]), pa.array(v[k : k + 4])], names=["u", "v"]) for k in range(0, len(u), 4)]) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]

        def least(edges):
            root = {x: x for e in edges for x in e}
            for _ in root:
                for x, y in edges:
                    root[x] = root[y] = min(root[x], root[y])
            return root

        assert all(x > y for x, y in made) and least(made) == least(list(zip(u.tolist(), v.tolist(), strict=True)))
