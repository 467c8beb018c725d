"""Sessions, reports and maps."""

import json
import random

import pytest

from ringspan.plans import maps, report
from ringspan.plans.session import GATED, TOOLS, Session, clean_numbers, no_sequences, parse_site
from tests.test_planners import circle


@pytest.fixture(scope="module")
def session(spark):
    s, span = circle("CTGCAG", "CTGCAG")
    rng = random.Random(8)
    other = "".join(rng.choices("ACGT", k=900))
    lib = spark.createDataFrame([("p1", "pAB_vector", s, len(s)), ("p2", "pCD_donor", other, 900)], "plasmid_id string, label string, sequence string, length int")
    feats = spark.createDataFrame([("p1", "target", "misc_feature", *span), ("p1", "ampR", "CDS", 300, 400), ("p1", "oligo", "primer_bind", 206, 220)], "plasmid_id string, label string, type string, s int, e int")
    said = []
    return Session(spark, lib, feats, confirm=lambda what: said.append(what) or True)


def ask(answer):
    assert "CTGCAG" * 7 not in answer
    return json.loads(answer)


def test_delete_by_name_and_export(session, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    r = ask(session.plan_deletion("pAB", "target"))
    assert r["route"] == "restriction" and r["enzymes"] == ["PstI", "PstI"]
    assert ask(session.export_product(r["handle"], "out.gb"))["written"] and "LOCUS" in (tmp_path / "out.gb").read_text()
    assert ask(session.save_protocol(r["handle"], "p.txt"))["written"]
    assert ask(session.generate_report(r["handle"], "r.html", {"pAB_vector": "50"}, "<script>x</script>"))["written"]
    page = (tmp_path / "r.html").read_text()
    assert "<script>x" not in page and "http" not in page.replace("http://www.w3.org/2000/svg", "") and "20.00" in page
    with pytest.raises(ValueError):
        session.export_product(r["handle"], "../out.gb")
    assert ask(session.compare_product(r["handle"], "pCD"))["same"] is False
    assert ask(session.report_inputs(r["handle"]))["needs_concentration"] == ["pAB_vector"]


def test_wrapped_target(session):
    r = ask(session.plan_deletion("pCD", "880:930", "pcr"))
    p, seq = session.products[r["handle"]], session.library.where("plasmid_id = 'p2'").first()["sequence"]
    assert len(p["product"]) == 850 and p["product"] in (seq[30:880] * 2)


def test_pcr_when_no_digest(session):
    r = ask(session.plan_deletion("pCD", "300:360", "pcr"))
    assert r["route"] == "pcr" and r["verification"] == "length"


def test_insert_synthetic(session):
    r = ask(session.plan_insertion("pAB", "100", sequence="ACGT" * 40))
    assert r["route"] == "gibson" and r["order_bp"] == 210
    assert ask(session.plan_insertion("pAB", "100", sequence="ACGT", method="restriction"))["feasible"] is False


def test_search_and_inspect(session):
    assert ask(session.search_inventory("donor"))["hits"] == ["pCD_donor"]
    seq = session.library.where("plasmid_id = 'p2'").first()["sequence"]
    assert ask(session.search_inventory(seq[890:] + seq[:10]))["hits"][0]["start"] == 890
    assert ask(session.search_inventory("ampr"))["kind"] == "feature"
    assert [f["label"] for f in ask(session.inspect_plasmid("pAB"))["features"]] == ["target", "ampR"]
    with pytest.raises(KeyError):
        session.resolve("nothing")


def test_sourcing(session):
    assert ask(session.source_sequence("x"))["route"] == "ask_user"
    seq = session.library.where("plasmid_id = 'p2'").first()["sequence"]
    assert ask(session.source_sequence("x", seq[10:200]))["route"] == "from_inventory"


def test_small_helpers():
    assert parse_site("1491") == (1491, 1491) and parse_site("1491:1512") == (1491, 1512) and parse_site("MCS") == "MCS"
    assert clean_numbers({"a": "3.5", "b": "n/a", "c": None, "d": 0}) == {"a": 3.5}
    assert no_sequences({"s": "A" * 50, "t": ["ACGT"]}) == {"s": "<50 bases>", "t": ["ACGT"]}
    assert len(TOOLS) == 11 and set(GATED) < set(TOOLS)


def test_maps():
    f = [{"label": f"f<{i}>", "s": i * 100, "e": i * 100 + 80} for i in range(20)]
    svg = maps.circular("p", 2000, f)
    assert svg.count("<path") == 2 * maps.MAX_LABELS and "f<" not in svg
    assert maps.linear("p", 0, 500, f).count("<rect") == 5
    assert maps.label_rings([0, 1, 2, 50]) == [0, 1, 2, 0]


def test_caveat_and_blanks():
    assert report.two_band_caveat(5000, 500) and not report.two_band_caveat(500, 400)
    assert report.number(None) == "____" and report.short_id("pHL_x_y") == "pHL"


def test_deletion_by_pcr_says_what_a_bench_should_know(session):
    r = ask(session.plan_deletion("pAB", "target", "pcr"))
    assert r["route"] == "pcr" and any("a digest with PstI and PstI would do" in w for w in r["warnings"])
    page = report.render(session._report(r["handle"]))
    assert "Cycler" in page and "Oligos" in page and "product" in page


def test_protected_features_are_refused_and_essential_ones_named(session):
    with pytest.raises(KeyError, match="to be protected"):
        session.plan_deletion("pAB", "290:420", "pcr", protect=["amp"])
    r = ask(session.plan_deletion("pAB", "290:420", "pcr"))
    assert any("ampR looks essential" in w for w in r["warnings"])


def test_insertion_spares_what_is_beside_the_site(spark):
    """The nearest pair of cuts would take a feature along; a wider one is beyond the collateral."""
    rng = random.Random(3)
    fill = lambda n: "".join(rng.choices("AC", k=n))
    s = fill(300) + "GAATTC" + fill(30) + "GGATCC" + fill(300)
    lib = spark.createDataFrame([("v", "pV", s, len(s))], "plasmid_id string, label string, sequence string, length int")
    feats = spark.createDataFrame([("v", "promoter", "promoter", 310, 318)], "plasmid_id string, label string, type string, s int, e int")
    put = "ACGT" * 40
    free = Session(spark, lib, None, pool=["EcoRI", "BamHI"])
    a = ask(free.plan_insertion("pV", "322", sequence=put))
    assert a["vector_prep"] == "digest" and a["vector"] == ["EcoRI", "BamHI"] and a["product_bp"] == len(s) - 36 + 160
    held = Session(spark, lib, feats, pool=["EcoRI", "BamHI"])
    b = ask(held.plan_insertion("pV", "322", sequence=put))
    assert b["vector_prep"] == "pcr" and b["product_bp"] == len(s) + 160 and b["verification"] == "length and presence"
    c = ask(held.plan_insertion("pV", "322", sequence=put, vector_prep="digest"))
    assert c == {"feasible": False, "reasons": {"no pair of unique cuts opens the vector": 1}}
    assert ask(free.plan_insertion("pV", "322", sequence=put, max_digest_collateral=10))["vector_prep"] == "pcr"
    d = ask(held.plan_insertion("pV", "314", sequence=put))
    assert any("promoter spans the site" in w for w in d["warnings"])
    with pytest.raises(ValueError):
        held.plan_insertion("pV", "322", sequence=put, vector_prep="magic")
    page = report.render(held._report(b["handle"]))
    assert "Assembly" in page and "vector forward" in page and "inverse PCR" in page


def test_insert_from_a_donor_by_homology(session):
    r = ask(session.plan_insertion("pAB", "100", donor="pCD", what="300:500", method="gibson", vector_prep="pcr"))
    p = session.products[r["handle"]]
    donor = session.library.where("plasmid_id = 'p2'").first()["sequence"]
    assert r["order_bp"] is None and r["product_bp"] == len(p["product"]) and donor[300:500] in p["product"]
    assert p["insert_f"].startswith(p["up_arm"]) and donor[300:].startswith(p["insert_f"][25:])


def test_export_with_features(session, tmp_path, monkeypatch):
    from ringspan.sources.formats import parse_genbank

    monkeypatch.chdir(tmp_path)
    r = ask(session.plan_deletion("pAB", "target"))
    session.export_product(r["handle"], "out.gb")
    got = parse_genbank((tmp_path / "out.gb").read_text())
    assert "ampR" in [f["label"] for f in got["features"]] and got["sequence"] == session.products[r["handle"]]["product"].upper()


def test_calculators_of_each_route(session):
    a = session.products[ask(session.plan_deletion("pAB", "target"))["handle"]]
    b = session.products[ask(session.plan_insertion("pAB", "100", sequence="ACGT" * 40, vector_prep="pcr"))["handle"]]
    c = session.products[ask(session.plan_deletion("pCD", "300:360", "pcr"))["handle"]]
    forms = [report.calculators(p, {"name": "pAB<"}) for p in (a, b, c)]
    assert [len(f) for f in forms] == [2, 2, 1] and all("pAB<" not in x for f in forms for x in f)
    # 100 ng of the vector, and three times its moles of the 210 bases to order
    n = len(b["product"]) - 160
    assert f'data-ng="{100 / n * 3 * 210:.6f}"' in forms[1][1] and 'data-total="10"' in forms[1][1]
