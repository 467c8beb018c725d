"""Cases that a review found: each failed before it was mended."""

import random
import re
import time

import duckdb
from pyspark.sql import functions as F

from ringspan import oracles, queries
from ringspan.functions import kernels
from ringspan.operators import enzymes, excision, fragments, inventory, pcr, reagents


def agrees(spark, tmp_path, name, **tables):
    """The rows of a query over small tables (name = (rows, schema)); they must be those of its SQL."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    got = queries.QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in got.columns)} FROM ({oracles.SQL[name]})").fetchall()
    rows = sorted((tuple(r) for r in got.collect()), key=repr)
    assert rows == sorted(want, key=repr)
    return rows


def documents(texts):
    return [(i, t) for i, t in enumerate(texts)], "doc_id long, text string"


def test_origin_of_tiny_circles(spark, tmp_path):
    assert len(agrees(spark, tmp_path, "seq_projections", documents=documents(["a", "ab", "bx", "abc", "abcd", "abcdefg", "-"]))) == 6


def test_extension_time_at_a_half(spark):
    r = spark.createDataFrame([(4150,), (2050,), (1,)], "bp int")
    assert [tuple(x) for x in r.select(pcr.extension_seconds(F.col("bp")), reagents.extension_seconds(F.col("bp"), F.lit(False))).collect()] == [(124, 124), (62, 62), (15, 15)]


def test_pcr_deletion_at_a_half(spark, tmp_path):
    rng = random.Random(6)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n + 10)) for n in (2050, 4150, 6150)]
    agrees(spark, tmp_path, "pcr_deletions", documents=documents(texts))


def test_digest_of_a_long_circle_is_linear(spark):
    """6,000 cuts of one circle: with the cuts sorted again for each fragment this took more than minutes."""
    s = "".join(random.Random(2).choices("ACGT", k=1_500_000))
    cuts = [("p", m.start() + 2, m.start() + 2) for m in re.finditer("GGCC", s)]
    began = time.time()
    f = fragments.digest(spark.createDataFrame([("p", s)], "id string, s string"), spark.createDataFrame(cuts, "id string, top int, bottom int"))
    r = f.agg(F.count("*"), F.sum(F.length("top")), F.min("n_frags"), F.sum((F.col("top") == F.col("bottom")).cast("int"))).first()
    assert tuple(r) == (len(cuts), len(s), len(cuts), len(cuts)) and time.time() - began < 60


def test_search_is_the_finder_for_a_few():
    find, search, rng = enzymes.Finder("All"), enzymes.Search("All"), random.Random(9)
    for n in (0, 3, 5, 12, 40, 900):
        for letters in ("ACGT", "ACGTN", "AC"):
            s = "".join(rng.choices(letters, k=n))
            enzyme, top, _ = find.cuts(s)
            for i, name in enumerate(find.names):
                want = [(int(t), int(find.ovhg[i])) for t in top[enzyme == i]]
                assert search.cuts(s, [name]) == want and search.any(s, [name]) == bool(want)


def test_first_plan_is_that_of_all_plans(spark):
    rng = random.Random(12)
    seqs = spark.createDataFrame([(i, "".join(rng.choices("ACGT", k=rng.choice([150, 400, 2500])))) for i in range(40)], "id long, s string")
    t, arms = queries.targets(seqs), queries.guarded(seqs)
    plans, why = excision.plan(seqs, t, arms)
    first, said = excision.first_plan(seqs, t, arms)
    rows = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    assert rows(first) == rows(plans.where("alt_rank = 0")) and rows(why) == rows(said) and first.count()


def test_names_are_never_sent_whole_to_all(spark):
    names = spark.createDataFrame([("ab_x",), ("abc_y",)], "label string")
    r = inventory.resolve_name(names, spark.createDataFrame([("ab",), ("bc",), ("q",)], "asked string"))
    assert sorted(map(tuple, r.collect()), key=repr) == [("ab", 2, 1, "ab_x"), ("bc", 4, 1, "abc_y"), ("q", None, 0, None)]
    assert "BroadcastHashJoin" not in r._jdf.queryExecution().executedPlan().toString()


def test_short_circles_by_fingerprint(spark, tmp_path):
    rows = [(i, f"Customer#{i:09d}", ("BUILDING", "MACHINERY")[i % 2]) for i in range(40)] + [(99, "", "a"), (98, "", "--"), (97, "", "abab")]
    agrees(spark, tmp_path, "short_dup_groups", customer=(rows, "c_custkey long, c_name string, c_mktsegment string"))


def test_related_is_relationships(spark):
    """Of random circles next to no k-mer leaves the scan; the pairs are those of whole sets."""
    rng, rows = random.Random(21), []
    for i in range(40):
        s = "".join(rng.choices("ACGT", k=rng.choice([20, 31, 80, 400])))
        rows += [s, s[7:] + s[:7], s[: len(s) // 2] + "".join(rng.choices("ACGTN", k=len(s) // 2)), kernels.reverse_complement(s) + "A"]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, s string")
    got = sorted(map(tuple, inventory.related(df, 0.3).collect()))
    assert got == sorted(map(tuple, inventory.relationships(inventory.kmers(df), 0.3).collect())) and len(got) > 40
