"""The smaller public functions, each against a plain computation."""

import random

import pytest
from pyspark.sql import functions as F

from ringspan.functions import kernels as K
from ringspan.functions import sequences as S
from ringspan.operators import enzymes, insertion, intervals, pcr, reagents
from ringspan.sources import conditions, library


def vals(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_circular_slice_and_edits(spark):
    s = "ACGTTGCA"
    got = vals(spark, [(s,)], "s string", S.circular_slice("s", F.lit(-2), F.lit(3)), S.circular_slice("s", F.lit(6), F.lit(10)), S.replace_span("s", F.lit(2), F.lit(2), "NN"), S.delete_span("s", F.lit(1), F.lit(3)), S.rotate("s", F.lit(3)))[0]
    assert got == ("CAACG", "CAAC", "ACNNGTTGCA", "ATTGCA", "TTGCAACG")


def test_rotation_offset_and_equality(spark):
    rows = [("ACGTT", "GTTAC"), ("ACGTT", "AACGT"), ("ACGTT", "ACGT"), ("ACGTT", "AAGTA")]
    got = vals(spark, rows, "a string, b string", S.rotation_offset("a", "b"), S.circular_equal("a", "b"))
    assert got == [(2, True), (None, True), (None, False), (None, False)]


def test_occurrences_and_site_count(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choices("AC", k=rng.randint(1, 40))), "".join(rng.choices("AC", k=rng.randint(1, 3)))) for _ in range(50)]
    for (t, p), (n, m) in zip(rows, vals(spark, rows, "t string, p string", S.occurrences("t", "p"), S.site_count("t", "p")), strict=True):
        count = lambda x, y: sum(x[i : i + len(y)] == y for i in range(len(x) - len(y) + 1))
        assert n == count(t, p)
        ext, rc = t + t[: len(p) - 1], K.reverse_complement(p)
        assert m == count(ext, p) + (count(ext, rc) if rc != p else 0)


def test_self_complementarity_and_dimer(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choices("ACGT", k=rng.randint(6, 32))),) for _ in range(60)] + [("GAATTCGAATTC",)]
    for (s,), (c, d) in zip(rows, vals(spark, rows, "s string", S.self_complementarity("s"), S.three_prime_dimer("s")), strict=True):
        rc = K.reverse_complement(s)
        assert c == max((k for k in range(5, 13) if any(s[i : i + k] in rc for i in range(len(s) - k + 1))), default=0)
        assert d == (K.reverse_complement(s[-5:]) in s[:-5])


def test_small_sequence_functions(spark):
    q = spark.createDataFrame([({"gene": [" g1 "], "note": []}, "CDS"), ({}, "misc"), ({"label": ["L"], "gene": ["x"]}, "CDS")], "q map<string,array<string>>, t string")
    assert [r[0] for r in q.select(S.feature_label("q", F.col("t"))).collect()] == ["g1", "misc", "L"]
    got = vals(spark, [("",), ("ACGTTTTACG",)], "s string", S.longest_homopolymer("s"), S.gc_percent("s"), F.size(S.windows("s", 4)), S.canonical_short("s"), S.least_rotation("s"))
    assert got[0][:2] == (0, None) and got[1][:3] == (4, 40.0, 7) and got[1][3] == K.canonical("ACGTTTTACG") and got[1][4] == K.least_rotation("ACGTTTTACG")


def test_insert_normalisation(spark):
    got = [r[0] for r in spark.createDataFrame([(" ac gt\nn ",), ("ACX",), ("",)], "t string").select(insertion.normalise_insert(F.col("t"))).collect()]
    assert got == ["ACGTN", None, None]


def test_spans_parts_and_footprint(spark):
    f = spark.createDataFrame([("k", 10, 20), ("k", 5, 12)], "k string, s int, e int")
    assert [tuple(r) for r in intervals.inside_span(f, 8, 30).collect()] == [("k", 2, 12)]
    parts = spark.createDataFrame([([(0, 10, 1), (12, 18, 1), (20, 30, -1)],)], "p array<struct<start:int,end:int,strand:int>>")
    got = parts.select(intervals.remap_parts(F.col("p"), F.lit(11), F.lit(19), F.lit(2)).alias("p")).first()["p"]
    assert [tuple(x) for x in got] == [(0, 10, 1), (14, 24, -1)]
    assert vals(spark, [(5, 1)], "t int, b int", *enzymes.footprint(F.col("t"), F.col("b"))) == [(1, 5)]


def test_inward_primers_and_notes(spark):
    s = "".join(random.Random(6).choices("ACGT", k=300))
    spans = spark.createDataFrame([(1, s, 100, 200)], "id long, s string, t_s int, t_e int")
    best = pcr.best_pairs(spans, inside=True).first()
    assert s[100:].startswith(best["f_seq"]) and K.reverse_complement(s[:200]).startswith(best["r_seq"])
    rows = [(s[:20], s), ("ACGTACGTACGTACGTACGAAAA", "ACGTACGTACGTACGTACGAAAA" * 2)]
    got = [r[0] for r in spark.createDataFrame(rows, "p string, t string").select(pcr.notes(F.col("p"), F.col("t"))).collect()]
    assert "3' end anneals at more than one place" in got[1] and "run of four or more equal bases" in got[1]


def test_reagent_forms(spark):
    assert dict(reagents.pcr_mix())["water"] == pytest.approx(10.0) and sum(v for _, v in reagents.pcr_mix()) == 25
    r = spark.range(1).select(reagents.agarose_grams(F.lit(700)), reagents.growth_temperature(F.lit(True)), reagents.growth_temperature(F.lit(False)), reagents.shown(F.lit(None).cast("double")), reagents.shown(F.lit(1234.5)), reagents.two_band_caveat(F.lit(5000), F.lit(1000))).first()
    assert tuple(r) == (pytest.approx(0.6), 30, 37, "____", "1,234.50", True)
    df = spark.createDataFrame([(1, 5770, 43.6, 137, 10.0)], "reaction int, b_bp int, b_conc double, i_bp int, i_conc double")
    assert '"component":"backbone"' in reagents.spec_json(reagents.gibson_mix(df)).first()["spec"]


def test_lab_helpers(tmp_path):
    assert conditions.is_base_vector("pX", {"base_vectors": ["pX"]}) and not conditions.is_base_vector("pY", {})
    (tmp_path / "a.fa").write_text(">a\nACGT\n")
    assert library.load_record(str(tmp_path / "a.fa"))["sequence"] == "ACGT"
    with pytest.raises(ValueError):
        library.load_record(str(tmp_path / "a.txt"))


def test_prune_and_arrays(spark):
    rows = [("k", 1, 0, 900, "umbrella", "misc"), ("k", 2, 10, 300, "a", "misc"), ("k", 3, 400, 700, "b", "misc"), ("k", 4, 20, 100, "a1", "misc"), ("k", 5, 800, 830, "tiny", "misc"), ("k", 6, 0, 950, "primer", "primer_bind")]
    f = spark.createDataFrame(rows, "k string, f int, s int, e int, label string, type string")
    assert sorted(r["label"] for r in intervals.prune(f).collect()) == ["a", "b"]
    assert sorted(r["label"] for r in intervals.prune(f, protect=["tiny"]).collect()) == ["a", "b", "tiny"]
    reps = [("k", 1, 0, 100, "array", "m"), *[("k", i, 10 * i, 10 * i + 5, "unit", "m") for i in range(2, 6)]]
    got = intervals.repeat_arrays(spark.createDataFrame(reps, "k string, f int, s int, e int, label string, type string")).first()
    assert (got["array"], got["label"], got["copies"]) == (1, "unit", 4)


def test_targets_resolve_and_centre(spark):
    s = "".join(random.Random(8).choices("ACGT", k=100))
    f = spark.createDataFrame([("k", 95, 100, "boxA", "misc"), ("k", 0, 7, "BOXb", "misc"), ("k", 50, 60, "other", "misc"), ("k", 90, 99, "box", "primer_bind")], "k string, s int, e int, label string, type string")
    n = spark.createDataFrame([("k", 100)], "k string, n int")
    t = intervals.resolve_targets(f, n, ["box"]).first()
    assert (t["t_s"], t["t_e"], t["labels"]) == (95, 107, ["BOXb", "boxA"])
    c = intervals.centred(spark.createDataFrame([(s, 95, 107), (s, 10, 20)], "s string, t_s int, t_e int")).collect()
    assert c[0]["s"][c[0]["t_s"] : c[0]["t_e"]] == (s + s)[95:107] and c[0]["t_s"] == 44 and (c[1]["turned"], c[1]["s"], c[1]["t_s"]) == (0, s, 10)


def test_labels_notes_and_sink(spark, tmp_path):
    from ringspan.operators import inventory

    lib = spark.createDataFrame([("pA_long", 10), ("pA_x", 12), ("pB", 10)], "label string, length int")
    got = {r["name"]: r["label"] for r in inventory.label_of(spark.createDataFrame([("pA", 10), ("pC", 10)], "name string, length int"), lib).collect()}
    assert got == {"pA": "pA_long", "pC": None}
    df = spark.createDataFrame([(5, "37", 1.0, ["SdaI"], ["NoI"]), (None, None, None, [], [])], "m int, t string, s double, k array<string>, u array<string>")
    notes = [r[0] for r in df.select(reagents.digest_note(*[F.col(c) for c in "mtsku"])).collect()]
    assert notes[0] == "Incubate at 37 °C for 5 min. Stop within 1 h. Heat does not stop SdaI; purify. Look up NoI." and "one after the other" in notes[1]
    assert reagents.gel_recipe(700)[0] == ("agarose", "0.60 g (1.2 %)") and "3 µL" in reagents.cleanup_note()
    library.write_genbank(spark.createDataFrame([("a", "ACGT")], "name string, sequence string"), str(tmp_path / "out"))
    assert "ORIGIN" in "".join(f.read_text() for f in (tmp_path / "out").glob("part-*"))
