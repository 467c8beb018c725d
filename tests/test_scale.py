"""What a query reads and moves: each case failed before its step was mended."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringspan import queries
from ringspan.functions import sequences as S
from ringspan.operators import enzymes, excision, fragments, insertion, inventory, pcr
from tests.test_findings import agrees, documents


def texts(seed, n=12):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=rng.choice([150, 600, 3000]))) for _ in range(n)]


def rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def circles(spark, seed=3, n=30):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, "".join(rng.choices("ACGT", k=rng.choice([5, 70, 150, 2500])))) for i in range(n)] + [(n, ""), (n + 1, None), (n + 2, "ACGTN" * 40)], "id long, s string")


def planned(spark, tmp_path, name):
    """The physical plan of a query over a small table."""
    spark.createDataFrame(*documents(texts(1))).coalesce(1).write.parquet(f"{tmp_path}/planned/documents.parquet")
    return queries.QUERIES[name](spark, f"{tmp_path}/planned")._jdf.queryExecution().executedPlan().toString()


# F10 to F12, and what the others share


@pytest.mark.parametrize("pool", ["All", ["SfiI"], ["BsaI", "XmnI", "EcoRI"]])
def test_cuts_by_one_table_are_those_by_size(pool):
    find, rng = enzymes.Finder(pool), random.Random(4)
    for n in [*range(60, 80), 400, 5000]:
        for letters in ("ACGT", "AC", "ACGTN"):
            s = "".join(rng.choices(letters, k=n))
            assert all(np.array_equal(x, y) for x, y in zip(find.cuts(s), find._cuts_by_size(s), strict=True))


def test_bases_by_bytes_are_those_by_letters(spark):
    odd = ["", None, "Abc zZ-9", "KİÅ k", "中", "x" * 9, "naïve \U0001f600 B"]
    df = spark.createDataFrame(list(enumerate(odd)), "id long, text string")
    want = df.select("id", S.dna_like("text").alias("s")).where(F.length("s") > 0)
    assert rows(S.read_as_bases(df)) == rows(want) and want.count() == 4


@pytest.mark.parametrize("name", ["insertion_routes", "insertion_reasons", "insertion_protected", "insertion_openings", "insertion_openings_protected"])
def test_pairs_are_made_once(spark, tmp_path, name):
    plan = planned(spark, tmp_path, name)
    assert plan.count("FileScan parquet") == 2
    agrees(spark, tmp_path, name, documents=documents(texts(2)))


# F13, F20


@pytest.mark.parametrize("name", ["excision_reasons", "excision_best"])
def test_excisions_are_judged_in_one_pass(spark, tmp_path, name):
    plan = planned(spark, tmp_path, name)
    assert "Exchange" not in plan and plan.count("FileScan parquet") == 1
    agrees(spark, tmp_path, name, documents=documents(texts(5)))


def test_judged_rows_are_those_that_are_joined(spark):
    s = circles(spark)
    t, arms = queries.targets(s), queries.guarded(s)
    arms_of = arms.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("p_s", "p_e", "label"))).alias("arms"))
    want = excision.judge(s, t, arms)
    assert rows(excision.judge_rows(t.join(s, "id").join(arms_of, "id"))) == rows(want) and want.count()


# F14, F23


def test_single_cutters_and_counts_where_the_circle_is(spark):
    s = circles(spark)
    cuts = enzymes.cut_sites(s)
    once = enzymes.single_cutters(s, 7)
    assert rows(once) == rows(enzymes.unique_cutters(cuts, 7)) and once.count()
    assert rows(enzymes.cut_sites(s, once=True)) == rows(cuts.where("n_cuts = 1"))
    assert rows(enzymes.site_counts(s)) == rows(cuts.select("id", F.col("enzyme").alias("name"), F.col("n_cuts").alias("n")).distinct())


def test_single_cutters_move_nothing(spark, tmp_path):
    assert "Exchange" not in planned(spark, tmp_path, "unique_cutters")
    agrees(spark, tmp_path, "unique_cutters", documents=documents(texts(6)))


# F22


def test_digest_where_the_circle_is(spark, tmp_path):
    s, few = circles(spark), list(queries.DIGEST)
    assert rows(fragments.digest_by(s, few)) == rows(fragments.digest(s, enzymes.cut_sites(s, few)))
    assert "Exchange" not in planned(spark, tmp_path, "digest_products")


# F21, F25


def test_fingerprints_are_made_once(spark, tmp_path):
    s = circles(spark)
    twice = s.union(s.select(F.col("id") + 100, F.concat(F.substr("s", F.lit(4)), F.substring("s", 1, 3))))
    want = inventory.duplicate_groups(inventory.classes(twice))
    assert rows(inventory.copies(twice)) == rows(want) and want.count() > 20
    assert planned(spark, tmp_path, "dup_groups").count("ArrowEvalPython") == 1
    assert "ArrowEvalPython" not in inventory.classes(twice)._jdf.queryExecution().executedPlan().toString()


# F17


def test_only_single_cuts_leave_the_scan_of_a_job(spark):
    from jobs import digest_sheets

    rng = random.Random(8)
    df = spark.createDataFrame([(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=900)), "ab"[i % 2]) for i in range(9)], "doc_id long, text string, source string")
    made = digest_sheets.sheets(spark, df, digest_sheets.DEFAULTS)
    own = df.select(F.col("doc_id").alias("id"), S.dna_like("text").alias("s"))
    assert rows(made.select("id", "enzyme", "top")) == rows(enzymes.cut_sites(own).where("n_cuts = 1").select("id", "enzyme", "top"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "n_cuts" not in plan.split("Join")[0] and "regexp_replace" not in plan


# F19


def test_texts_are_read_once_for_deletions(spark, tmp_path):
    plan = planned(spark, tmp_path, "deletion_routes")
    assert "regexp_replace" not in plan and "planned/documents" not in plan
    agrees(spark, tmp_path, "deletion_routes", documents=documents(texts(9)))


# F24


def test_windows_of_assemblies_hold_ends(spark, tmp_path):
    spark.createDataFrame(*documents(texts(10))).coalesce(1).write.parquet(f"{tmp_path}/pieces/documents.parquet")
    plan = queries.assembly_pieces(spark, f"{tmp_path}/pieces")._jdf.queryExecution().executedPlan().toString()
    assert "lag(tail" in plan and "lag(own" not in plan and "nth_value(head" in plan
    agrees(spark, tmp_path, "assemblies", documents=documents(texts(10)))


# F18


@pytest.mark.parametrize("name", ["insertion_preps", "insertion_homology"])
def test_a_vector_moves_once_to_its_insert(spark, tmp_path, name):
    agrees(spark, tmp_path, name, documents=documents(texts(11)))
    plan = planned(spark, tmp_path, name)
    assert plan.count("Exchange hashpartitioning") == plan.count("FileScan") == 2 and "SortMergeJoin" not in plan


@pytest.mark.parametrize("prep", insertion.PREPS)
def test_assemblies_where_the_vector_is(spark, prep):
    s = circles(spark).where("s is not null").select(F.col("id").alias("pair_id"), F.col("s").alias("v"), F.floor(F.length("s") / 2).cast("int").alias("v_s"), F.ceil(F.length("s") / 2).cast("int").alias("v_e"))
    put = s.where("pair_id % 3 > 0").select(F.col("pair_id").alias("id"), F.lit("ACGTTGCA" * 4).alias("insert"))
    d = s.select((F.col("pair_id") + 1).alias("pair_id"), F.col("v").alias("d"), F.lit(3).alias("d_s"), F.lit(60).alias("d_e"))
    got = {r["id"]: r for r in insertion.homology_routes(s, put, d, vector_prep=prep).collect()}
    assert len(got) == s.count()
    opened = {r["id"]: r for r in insertion.openings_of_vectors(s).collect()} if prep != "pcr" else {}
    spans = lambda x, a: x.select(F.col("pair_id").alias("id"), F.col(a).alias("s"), F.col(f"{a}_s").alias("t_s"), F.col(f"{a}_e").alias("t_e"))
    outer, inner = ({r["id"]: r for r in pcr.best_pairs(spans(x, a), inside).collect()} for x, a, inside in ((s, "v", False), (d, "d", True)))
    assert any(i in inner for i in got) and (prep == "pcr" or opened)
    for i, r in got.items():
        own, way = opened.get(i), outer.get(i) if prep != "digest" else None
        assert r["prep"] == ("digest" if own else "pcr" if way else None) and (r["reason"] is None) == bool(own or way)
        assert (r["ue"], r["de"]) == ((own["ue"], own["de"]) if own else (None, None))
        assert (r["vector_f"], r["vector_r"]) == ((way["f_seq"], way["r_seq"]) if way and not own else (None, None))
        held = bool(own or way) and i % 3 > 0
        assert (r["product"] is not None) == r["verified"] == held and r["order"] is None
        assert r["insert_f"] == (r["up_arm"] + inner[i]["f_seq"] if held and i in inner else None)
    whole = s.join(put.select(F.col("id").alias("pair_id"), "insert"), "pair_id")
    one = insertion.homology_of_vectors(whole, vector_prep=prep)
    assert rows(one) == rows(insertion.homology_routes(s, put, vector_prep=prep).where("id % 3 > 0"))
    held = spark.createDataFrame([(1, "ACGT" * 40, 5, 9, "AC")], "pair_id long, v string, v_s int, v_e int, insert string")
    assert "Exchange" not in insertion.homology_of_vectors(held, vector_prep=prep)._jdf.queryExecution().executedPlan().toString()
