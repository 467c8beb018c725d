"""Jump hashing against its published loop, and slots."""

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from ringspan.llm import sharding as S


def slow_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_is_the_published_one():
    keys = np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.uint64)
    for n in (1, 2, 8, 9, 100):
        assert S.jump(keys, n).tolist() == [slow_jump(int(k), n) for k in keys]


def test_growth_moves_rows_into_the_new_shard_only():
    k = S.mix64(np.arange(20000).astype(np.uint64))
    a, b = S.jump(k, 8), S.jump(k, 9)
    moved = a != b
    assert (b[moved] == 8).all() and 0.09 < moved.mean() < 0.13
    assert max(Counter(a.tolist()).values()) < 1.1 * 20000 / 8


def test_slots_are_gapless(spark, odd):
    rows = S.number(S.assign(odd.select("doc_id", "text"), "doc_id", 3), "shard", "doc_id", rows_per_cell=2).collect()
    assert len(rows) == odd.count()
    at = defaultdict(list)
    for r in rows:
        at[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in at.values())


def test_equal_keys_share_a_shard_and_strings_work(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,)], "k string")
    rows = S.assign(df, "k", 5).collect()
    assert len({r["shard"] for r in rows if r["k"] == "a"}) == 1 and len({r["shard"] for r in rows if r["k"] is None}) == 1


def test_empty_table(spark, none):
    assert S.number(S.assign(none.select("doc_id", "text"), "doc_id", 3), "shard", "doc_id").count() == 0


def test_slots_follow_the_key_in_stretches(spark):
    rows = [(i * 7919 % 1000, i % 3) for i in range(1000)]
    got = S.number(spark.createDataFrame(rows, "k long, shard int"), "shard", "k", rows_per_cell=70).collect()
    for s in range(3):
        assert [r["k"] for r in sorted((r for r in got if r["shard"] == s), key=lambda r: r["slot"])] == sorted(k for k, x in rows if x == s)


def test_rows_of_one_key_are_split(spark):
    """A null key holds a third of the rows, all alike: no task may take them all."""
    df = spark.createDataFrame([(None, 1)] * 1000 + [(i, 1) for i in range(2000)], "k long, size int")
    got = S.number(S.assign(df, "k", 4), "shard", "k", rows_per_cell=100)
    rows = got.collect()
    for s in range(4):
        mine = [r["slot"] for r in rows if r["shard"] == s]
        assert sorted(mine) == list(range(len(mine)))
    ranged = S.assign(df, "k", 4).withColumn("seat", F.monotonically_increasing_id()).repartitionByRange(30, "shard", "k", "size", "seat")
    assert max(r["n"] for r in ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()) < 400


def test_names_of_its_own_columns(spark):
    names = ["seat", "at", "part", "first", "start", "_cell", "_n", "_start", "_at"]
    df = spark.createDataFrame([(i, *range(len(names))) for i in range(20)], "k long, " + ", ".join(f"{n} int" for n in names))
    got = S.number(S.assign(df, "k", 2), "shard", "k", rows_per_cell=3)
    assert got.columns == ["k", *names, "shard", "slot"]
    assert all([r[n] for n in names] == list(range(len(names))) for r in got.collect())


def test_op3_over_whole_documents(spark, tmp_path):
    from zlib import crc32

    from ringspan.llm.queries import op3_sharding

    texts = [(1, "some text"), (2, None), (2, None), (3, ""), (None, "é"), (-7, "東京" * 900)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = op3_sharding(spark, str(tmp_path)).collect()
    key = lambda i: int(S.mix64(np.array([-1 if i is None else i], dtype=np.int64).view(np.uint64))[0])
    want = sorted((str(i), len((t or "").encode()) + 1, crc32((t or "").encode()), "key", slow_jump(key(i), 8), slow_jump(key(i), 9)) for i, t in texts)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in rows) == want
    at = defaultdict(list)
    for r in rows:
        at[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in at.values())
