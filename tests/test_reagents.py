"""Bench arithmetic against an independent sheet, whose numbers are fixed values."""

import random

import pytest
from pyspark.sql import functions as F

from ringspan.operators import reagents as R


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_molarity(spark):
    assert one(spark, R.ng_to_fmol(F.lit(100.0), F.lit(5770))) == pytest.approx(26.66, abs=0.01)


def test_gibson_sheet(spark):
    df = spark.createDataFrame([(1, 5770, 43.6, 137, 10.0), (2, 5770, None, 137, 10.0)], "reaction int, b_bp int, b_conc double, i_bp int, i_conc double")
    got = {(r["reaction"], r["component"]): r["ul"] for r in R.gibson_mix(df).collect()}
    assert got[1, "backbone"] == pytest.approx(2.29, abs=0.005) and got[1, "insert"] == pytest.approx(0.71, abs=0.005) and got[1, "water"] == pytest.approx(1.99, abs=0.01)
    assert got[2, "backbone"] is None and got[2, "water"] is None


def test_ligation_sheet(spark):
    df = spark.createDataFrame([(1, 7462, 41.1, 300, 3.3)], "reaction int, b_bp int, b_conc double, i_bp int, i_conc double")
    got = {r["component"]: r["ul"] for r in R.ligation_mix(df).collect()}
    assert got["backbone"] == pytest.approx(1.797, abs=0.001) and got["insert"] == pytest.approx(4.50, abs=0.005)


def test_dilutions_are_pipettable_and_exact(spark):
    """Two hundred stocks over four decades, and targets that they are above."""
    rng = random.Random(14)
    rows = [(10 ** rng.uniform(0.01, 4), 10 ** rng.uniform(-1, 0)) for _ in range(200)]
    df = spark.createDataFrame(rows, "stock double, target double").withColumn("p", R.dilution(F.col("stock"), F.col("target")))
    got = df.collect()
    assert len(got) == 200
    for r in got:
        p = r["p"]
        assert p["status"] == "ok" and p["take_ul"] >= 1.0 and p["take_ul"] + p["water_ul"] == pytest.approx(p["final_ul"])
        assert r["stock"] / 100 ** p["pre_steps"] * p["take_ul"] / p["final_ul"] == pytest.approx(r["target"])


def test_dilutions_without_a_reading_or_a_need(spark):
    state = lambda stock, target: one(spark, R.dilution(F.lit(stock).cast("double"), F.lit(target)))["status"]
    assert [state(None, 2.5), state(-3.0, 2.5), state(2.4, 2.5), state(2.5, 2.5), state(2.6, 2.5)] == ["unknown", "unknown", "neat", "neat", "ok"]


def test_extension_and_gel(spark):
    assert one(spark, R.extension_seconds(F.lit(5698), F.lit(False))) == 171
    assert one(spark, R.extension_seconds(F.lit(5698), F.lit(True))) == 256
    assert [one(spark, R.gel_percent(F.lit(b))) for b in (300, 700, 5704)] == [1.5, 1.2, 1.0]


def test_digest_mix(spark):
    df = spark.createDataFrame([(1, 1364.0)], "reaction int, conc double")
    got = {r["component"]: r["ul"] for r in R.digest_mix(df).collect()}
    assert got["DNA"] == pytest.approx(0.733, abs=0.001) and got["water"] == pytest.approx(15.267, abs=0.001)


def test_config_merges_one_level():
    c = R.bench_config({"gibson": {"total_ul": 20}, "growth_temp_c": 36})
    assert c["gibson"]["total_ul"] == 20 and c["gibson"]["backbone_ng"] == 100 and c["growth_temp_c"] == 36
    assert R.BENCH["gibson"]["total_ul"] == 10
