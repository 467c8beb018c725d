"""Features with compound locations, and joins of features on crowded circles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringspan.operators import intervals
from ringspan.sources import library

PARTS = "parts array<struct<start:int,end:int,strand:int>>"


def located(spark, rows):
    return intervals.located(spark.createDataFrame(rows, f"k long, f int, type string, {PARTS}, qualifiers map<string,array<string>>").withColumns({"s": F.lit(0), "e": F.lit(0)}))


def parts_of(df):
    return {r["f"]: [tuple(p) for p in r["parts"]] for r in df.collect()}


def test_remap_moves_each_part(spark):
    f = located(spark, [
        (1, 1, "CDS", [(0, 10, 1), (20, 28, 1), (40, 50, 1)], {"note": ["old"], "label": ["a"]}),  # loses its middle part whole
        (1, 2, "CDS", [(5, 25, -1), (0, 3, -1)], {"label": ["b"]}),  # is cut
        (1, 3, "primer_bind", [(12, 22, 1)], {}),  # a cut primer goes
        (1, 4, "CDS", [(16, 29, 1)], None),  # lies inside
        (1, 5, "source", [(0, 100, 1)], {}),  # so does other bookkeeping that is cut
        (1, 6, "CDS", [(30, 35, 1)], None),
    ])
    r = {x["f"]: x for x in intervals.remap(f, F.lit(15), F.lit(30), F.lit(4)).collect()}
    assert {k: [tuple(p) for p in x["parts"]] for k, x in r.items()} == {1: [(0, 10, 1), (29, 39, 1)], 2: [(5, 15, -1), (0, 3, -1)], 6: [(19, 24, 1)]}
    assert [(r[k]["s"], r[k]["e"], r[k]["truncated"]) for k in (1, 2, 6)] == [(0, 39, False), (0, 15, True), (19, 24, False)]
    assert r[1]["qualifiers"] == {"note": ["old"], "label": ["a"]} and r[2]["qualifiers"] == {"label": ["b"], "note": ["truncated by edit"]}


def test_rotation_splits_and_joins(spark):
    f = located(spark, [(1, 1, "CDS", [(80, 95, 1)], None), (1, 2, "CDS", [(80, 95, -1)], None), (1, 3, "CDS", [(90, 100, 1), (0, 10, 1)], None), (1, 4, "CDS", [(10, 20, 1), (20, 30, 1)], None)])
    turned = intervals.rotate(f, F.lit(90), F.lit(100))
    got = parts_of(turned)
    assert got[1] == [(90, 100, 1), (0, 5, 1)] and got[2] == [(0, 5, -1), (90, 100, -1)]
    assert got[3] == [(0, 20, 1)] and got[4] == [(20, 30, 1), (30, 40, 1)]
    back = parts_of(intervals.rotate(turned, F.lit(10), F.lit(100)))
    assert back[1] == [(80, 95, 1)] and back[2] == [(80, 95, -1)] and back[3] == [(90, 100, 1), (0, 10, 1)] and back[4] == [(10, 20, 1), (20, 30, 1)]


def test_graft_and_turn_over(spark):
    f = located(spark, [(1, 1, "CDS", [(0, 10, 1), (20, 30, 1)], None)])
    got = intervals.graft(f.where("f > 9"), intervals.turn_over(f, F.lit(50)), 7).first()
    assert [tuple(p) for p in got["parts"]] == [(47, 57, -1), (27, 37, -1)] and (got["s"], got["e"]) == (27, 57)


def test_features_survive_export_and_import(spark, tmp_path):
    rows = [("a", "ACGTACGTAC" * 9, [("CDS", "x", 0, 40, 0, [(30, 40, -1), (0, 10, -1)], {"label": ["x y"], "note": ["one", "two"]}), ("misc_feature", "misc_feature", 5, 6, 1, [(5, 6, 1)], {})]), ("b", "ACGT", None), ("c", "GGCC" * 40, [])]
    kind = f"name string, sequence string, features array<struct<type:string,label:string,start:int,end:int,strand:int,{PARTS.replace(' ', ':', 1)},qualifiers:map<string,array<string>>>>"
    library.write_genbank(spark.createDataFrame(rows, kind).coalesce(1), str(tmp_path / "out"))
    (tmp_path / "out" / "part-bad.txt").write_text("LOCUS nothing\n//\n")
    good, bad = library.read_genbank(spark, str(tmp_path / "out"))
    got = {r["name"]: r for r in good.collect()}
    assert set(got) == {"a", "b", "c"} and bad.count() == 1 and got["a"]["sequence"] == rows[0][1] and got["b"]["features"] == []
    x, y = got["a"]["features"]
    assert [tuple(p) for p in x["parts"]] == [(30, 40, -1), (0, 10, -1)] and x["qualifiers"] == {"label": ["x y"], "note": ["one", "two"]} and (x["start"], x["end"], x["strand"]) == (0, 40, -1)
    assert [tuple(p) for p in y["parts"]] == [(5, 6, 1)]


@pytest.mark.parametrize("n", [20, 400])
def test_pairs_are_those_of_all_pairs(spark, n):
    rng = np.random.default_rng(n)
    s = rng.integers(-50, 3000, n)
    w = np.where(rng.random(n) < 0.1, rng.integers(0, 2000, n), rng.integers(0, 60, n))
    rows = [(k, i, int(a), int(a + b), "x") for k in (1, 2) for i, (a, b) in enumerate(zip(s, w, strict=True))] + [(1, n, None, 5, "x"), (3, 0, 5, 9, "x")]
    f = spark.createDataFrame(rows, "k long, f int, s int, e int, label string")
    over = {(k, i, j) for k in (1, 2) for i in range(n) for j in range(i + 1, n) if s[i] < s[j] + w[j] and s[j] < s[i] + w[i]}
    inside = {(k, i, j) for k in (1, 2) for i in range(n) for j in range(n) if s[i] <= s[j] and s[j] + w[j] <= s[i] + w[i] and w[i] > w[j]}
    got = [tuple(r) for r in intervals.overlapping_pairs(f).collect()]
    nested = [tuple(r)[:3] for r in intervals.nested_pairs(f).collect()]
    assert len(got) == len(over) and set(got) == over
    assert len(nested) == len(inside) and set(nested) == inside


def test_a_circle_with_very_many_features(spark):
    """300,000 features of one circle, of which neighbours overlap and one covers all."""
    n = 300_000
    f = spark.range(n).selectExpr("1L as k", "id as f", "cast(id * 10 as int) as s", "cast(id * 10 + 15 as int) as e", "'x' as label")
    f = f.union(spark.createDataFrame([(1, n, -5, 10 * n + 50, "all")], "k long, f long, s int, e int, label string"))
    assert intervals.overlapping_pairs(f).count() == (n - 1) + n
    assert intervals.nested_pairs(f).count() == n
