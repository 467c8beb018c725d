"""Planners on circles with planted sites."""

import random

import pytest

from ringspan.operators import excision, insertion, intervals, pcr


def filler(n, seed, forbidden):
    rng, out = random.Random(seed), ""
    while len(out) < n:
        c = out + rng.choice("ACGT")
        if not any(c.endswith(f) for f in forbidden):
            out = c
    return out


SITES = ("CTGCAG", "CCCGGG", "GAGCTC", "CTCGAG", "TCTAGA")


def circle(up, down, seed=7):
    t = filler(30, seed + 1, SITES)
    return filler(200, seed, SITES) + up + t + down + filler(200, seed + 2, SITES), (206, 236)


def plan(spark, s, span, pool, protected=None):
    seqs = spark.createDataFrame([("p", s)], "id string, s string")
    t = spark.createDataFrame([("p", *span)], "id string, t_s int, t_e int")
    p = spark.createDataFrame(protected, "id string, label string, p_s int, p_e int") if protected else None
    plans, why = excision.plan(seqs, t, p, pool)
    return excision.best_or_refusal(plans, why, t).first()


def test_same_enzyme_twice(spark):
    s, span = circle("CTGCAG", "CTGCAG")
    r = plan(spark, s, span, ["PstI"])
    assert len(s) == 442 and r["feasible"] and r["strategy"] == "same_enzyme" and r["site_regenerated"] and r["verified"]
    assert len(r["product"]) == 442 - 36


def test_blunt(spark):
    s, span = circle("CCCGGG", "GAGCTC")
    r = plan(spark, s, span, ["SmaI", "Ecl136II"])
    assert r["feasible"] and r["strategy"] == "blunt" and not r["site_regenerated"]


def test_incompatible(spark):
    s, span = circle("CCCGGG", "GAGCTC")
    r = plan(spark, s, span, ["SmaI", "SacI"])
    assert not r["feasible"] and r["reasons"]["incompatible ends"] == 1


def test_margin_blocks(spark):
    s, span = circle("CTGCAG", "CTGCAG")
    r = plan(spark, s, span, ["PstI"], [("p", "marker", 190, 206)])
    assert not r["feasible"] and "would damage marker" in r["reasons"]


def test_many_cuts_are_told(spark):
    s, span = circle("CTGCAG", "CTGCAG")
    r = plan(spark, s + "CTGCAG", span, ["PstI"])
    assert not r["feasible"] and r["reasons"]["enzyme cuts more than twice"] == 1
    assert r["reasons"]["no unique site upstream of the target"] == 1


def test_pcr_deletion_exact(spark):
    s = filler(600, 3, ())
    rows = spark.createDataFrame([(1, s, 200, 260), (2, s, 590, 620), (3, s, 0, 580)], "id long, s string, t_s int, t_e int")
    got = {r["id"]: r for r in pcr.plan_deletions(rows).collect()}
    assert got[1]["product"] == s[:200] + s[260:]
    assert s[260:].startswith(got[1]["f_seq"])
    assert len(got[2]["product"]) == 570 and got[2]["product"] == s[20:590]
    assert not got[3]["feasible"]


def test_gibson_tails_make_an_overlap(spark):
    s = filler(600, 4, ())
    rows = spark.createDataFrame([(1, s, 200, 260)], "id long, s string, t_s int, t_e int")
    r = pcr.plan_deletions(rows, method="gibson").first()
    assert r["f_tail"] == s[190:200] and len(r["f_tail"]) + len(r["r_tail"]) == 20


def test_melting_temperature_golden(spark):
    from pyspark.sql import functions as F

    from ringspan.functions.sequences import melting_temperature

    r = spark.createDataFrame([("ACGT" * 6,)], "s string").select(melting_temperature("s").alias("t"), F.lit(1)).first()
    assert 55 < r["t"] < 70


def test_restriction_insertion(spark):
    v = filler(150, 11, SITES) + "CTCGAG" + filler(10, 12, SITES) + "TCTAGA" + filler(150, 13, SITES)
    d = filler(100, 14, SITES) + "CTCGAG" + filler(60, 15, SITES) + "TCTAGA" + filler(100, 16, SITES)
    vs = spark.createDataFrame([(1, v, 158, 164)], "pair_id long, v string, v_s int, v_e int")
    ds = spark.createDataFrame([(1, d, 106, 166)], "pair_id long, d string, d_s int, d_e int")
    best, _ = insertion.restriction_routes(vs, ds, None, ["XhoI", "XbaI"])
    r = insertion.restriction_products(best, vs, ds).first()
    assert (r["ue"], r["de"]) == ("XhoI", "XbaI") and r["directional"] and r["verified"] and d[106:166] in r["product"]


def test_insertion_refusal(spark):
    vs = spark.createDataFrame([(1, filler(300, 21, SITES), 150, 150)], "pair_id long, v string, v_s int, v_e int")
    ds = spark.createDataFrame([(1, filler(300, 22, SITES), 100, 150)], "pair_id long, d string, d_s int, d_e int")
    best, why = insertion.restriction_routes(vs, ds, None, ["XhoI", "XbaI"])
    assert best.count() == 0 and why.count() == 0


def test_tight_arc(spark):
    rows = [("a", 160, 214), ("a", 165, 175), ("b", 5740, 5770), ("b", 0, 20), ("c", 10, 20)]
    got = {r["k"]: (r["arc_start"], r["arc_end"]) for r in intervals.tight_arc(spark.createDataFrame(rows, "k string, s int, e int"), 5770).collect()}
    assert got == {"a": (160, 214), "b": (5740, 5790), "c": (10, 20)}


def test_remap_is_asymmetric_at_an_insertion(spark):
    f = spark.createDataFrame([("k", 1, 0, 50), ("k", 2, 50, 80), ("k", 3, 40, 60)], "k string, f int, s int, e int")
    from pyspark.sql import functions as F

    got = {r["f"]: (r["s"], r["e"], r["truncated"]) for r in intervals.remap(f, F.lit(50), F.lit(50), F.lit(10)).collect()}
    assert got == {1: (0, 50, False), 2: (60, 90, False), 3: (40, 70, True)}


def test_gc_limits_decide_and_unknown_parameters_are_refused(spark):
    from ringspan.operators import pcr

    s = "".join(random.Random(8).choices("ACGT", k=400))
    spans = spark.createDataFrame([(1, s, 150, 250)], "id long, s string, t_s int, t_e int")
    a, b = (pcr.plan_deletions(spans, **kw).first() for kw in ({}, {"min_gc": 70.0, "max_gc": 71.0}))
    assert a["score"] < b["score"]
    with pytest.raises(TypeError):
        pcr.plan_deletions(spans, min_cg=40)
