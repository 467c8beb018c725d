"""The enzyme dimension, cut sites and ends."""

import pytest
from pyspark.sql import functions as F

from ringspan.functions import kernels
from ringspan.operators import enzymes as E


def by_name():
    return {r["name"]: r for r in E.catalogue()}


def test_dimension_is_sound():
    rows = E.catalogue("All")
    assert len({r["name"] for r in rows}) == len(rows) > 190
    for r in rows:
        assert len(r["ovhg_seq"]) == abs(r["ovhg"])
        assert (r["kind"] == "blunt") == (r["ovhg"] == 0) == (r["end"] == "blunt:")
        if kernels.reverse_complement(r["site"]) == r["site"]:  # such enzymes cut both strands alike
            assert r["top_off"] + (r["top_off"] - r["ovhg"]) == r["size"], r["name"]


def test_pools():
    sold, every = ({r["name"] for r in E.catalogue(p)} for p in ("CommOnly", "All"))
    assert sold < every and "MstI" in every - sold and "EcoRI" in sold
    assert "SnaI" not in every and E.catalogue(["SnaI"]) == []  # its cut is not known
    assert [r["canonical"] for r in E.catalogue(["MstI", "AhaIII"])] == ["DraI", "FspI"]


def test_cuts_beside_the_site(spark):
    s = "A" * 20 + "GGTCTC" + "ACGTACGT" + "A" * 20 + "GAGACC" + "A" * 10
    got = sorted((r["top"], r["bottom"]) for r in E.cut_sites(spark.createDataFrame([(1, s)], "id long, s string"), ["BsaI"]).collect())
    # one base behind the site on its strand, five on the other; 54 is where GAGACC starts
    assert got == [(27, 31), (54 - 5, 54 - 1)]
    assert E.catalogue(["BsaI"])[0]["end"] is None


def test_facts_about_ends():
    e = by_name()
    assert e["MfeI"]["ovhg_seq"] == e["EcoRI"]["ovhg_seq"] == "AATT" and e["EcoRI"]["ovhg"] == -4
    assert e["KpnI"]["ovhg_seq"] == e["Acc65I"]["ovhg_seq"] and e["KpnI"]["kind"] != e["Acc65I"]["kind"]
    assert e["MunI"]["canonical"] == "MfeI"


def test_ligation(spark):
    got = {(r["a"], r["b"]): r["strategy"] for r in E.ligation_pairs(spark).collect()}
    assert ("KpnI", "Acc65I") not in got
    assert got["MfeI", "EcoRI"] == E.STICKY and got["SmaI", "Ecl136II"] == E.BLUNT and got["PstI", "PstI"] == E.SAME
    assert ("SmaI", "SacI") not in got


def test_unknown_pool(spark):
    with pytest.raises(ValueError):
        E.enzymes(spark, "Some")
    with pytest.raises(ValueError):
        E.enzymes(spark, ["NoSuchI"])


def test_cut_sites_wrap_the_origin(spark):
    s = "ATTC" + "A" * 40 + "GA"  # GAATTC across the origin
    got = E.cut_sites(spark.createDataFrame([(1, s), (2, "ACGT"), (3, None)], "id long, s string"), ["EcoRI"]).collect()
    assert [(r["id"], r["enzyme"], r["top"], r["bottom"], r["n_cuts"]) for r in got] == [(1, "EcoRI", 45, 49, 1)]


def slow_cuts(s, pool="CommOnly"):
    """{(enzyme, top, bottom)} of a circle, place by place and letter by letter."""
    out = set()
    for e in E.catalogue(pool):
        if len(s) < e["size"]:
            continue
        ext, bottom = s + s[: e["size"] - 1], e["top_off"] - e["ovhg"]
        for site, top in ((e["site"], e["top_off"]), (kernels.reverse_complement(e["site"]), e["size"] - bottom)):
            for p in range(len(s)):
                if all(c in E.LETTERS[x] for c, x in zip(ext[p : p + e["size"]], site, strict=True)):
                    at = (p + top) % len(s)
                    out.add((e["name"], at, at - e["ovhg"]))
    return out


def test_cut_sites_brute(spark):
    import random

    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("ACGTN" if i % 5 == 0 else "ACGT", weights=[9, 9, 9, 9, 1][: 5 if i % 5 == 0 else 4], k=rng.randint(1, 500)))) for i in range(24)]
    got = {}
    for r in E.cut_sites(spark.createDataFrame(rows, "id long, s string"), "All").collect():
        got.setdefault(r["id"], []).append((r["enzyme"], r["top"], r["bottom"], r["n_cuts"]))
    for i, s in rows:
        want = slow_cuts(s, "All")
        mine = got.get(i, [])
        assert {x[:3] for x in mine} == want and len(mine) == len(want)
        assert all(n == sum(w[0] == e for w in want) for e, _, _, n in mine)


def test_conditions(spark):
    from ringspan.sources.conditions import conditions, rows

    assert len(rows()) == 176
    names = spark.createDataFrame([("MfeI",), ("XbaI",), ("AgeI",), ("NoSuchI",)], "enzyme string")
    got = {r["enzyme"]: r for r in E.conditions_lookup(names, conditions(spark), E.enzymes(spark)).collect()}
    assert got["MfeI"]["sold_as"] == "MunI" and got["XbaI"]["sold_as"] == "XbaI" and got["NoSuchI"]["sold_as"] is None


def test_describe(spark):
    e = E.enzymes(spark, ["SmaI", "EcoRI"]).select(E.describe(F.col("name"), F.col("site"), F.col("kind"), F.col("ovhg_seq")).alias("d")).orderBy("d")
    assert [r["d"] for r in e.collect()] == ["EcoRI GAATTC (5' AATT)", "SmaI CCCGGG (blunt)"]


def test_site_counts_against_brute_force(spark, tmp_path):
    import random

    from ringspan import queries as Q

    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("abcd", k=n))) for i, n in enumerate((3, 5, 300, 2000))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for r in Q.seqs(spark, str(tmp_path)).collect():
        for name, _, _ in slow_cuts(r["s"]):
            want[r["id"], name] = want.get((r["id"], name), 0) + 1
    assert {(r["id"], r["name"]): r["n"] for r in Q.QUERIES["site_counts"](spark, str(tmp_path)).collect()} == want and len(want) > 100
