"""File formats, scans and ingest."""

import struct

import pytest

from ringspan.sources import conditions, formats, library
from ringspan.streaming.ingest import ingest_available

GB = """LOCUS       pTest        24 bp    DNA     circular SYN
DEFINITION  .
FEATURES             Location/Qualifiers
     CDS             complement(join(1..5,10..12))
                     /label="my gene"
                     /note="two
                     lines"
     misc_feature    <3..>8
     gene            join(20..24,1..2)
                     /gene="wrapped"
ORIGIN
        1 acgtacgtac gtacgtacgt
       21 acgt
//
"""


def test_genbank():
    r = formats.parse_genbank(GB)
    assert r["name"] == "pTest" and r["sequence"] == "ACGT" * 6 and r["circular"]
    a, b, c = r["features"]
    assert (a["label"], a["strand"], a["start"], a["end"]) == ("my gene", -1, 0, 12) and a["qualifiers"]["note"] == ["two lines"]
    assert (b["label"], b["start"], b["end"]) == ("misc_feature", 2, 8)
    assert [p["start"] for p in c["parts"]] == [19, 0]


def test_genbank_round_trip():
    r = formats.parse_genbank(GB)
    again = formats.parse_genbank(formats.format_genbank(r["name"], r["sequence"], r["features"]))
    assert again["sequence"] == r["sequence"] and [f["label"] for f in again["features"]] == [f["label"] for f in r["features"]]


def test_fasta_and_snapgene():
    assert formats.parse_fasta(">a b\nACGT\nNN\n")["sequence"] == "ACGTNN"
    for bad in ("", ">a\nACGT\n>b\nAC", ">a\nAC!T"):
        with pytest.raises(ValueError):
            formats.parse_fasta(bad)
    packet = lambda k, b: bytes([k]) + struct.pack(">I", len(b)) + b
    data = packet(9, b"SnapGene") + packet(0, b"\x01acgtac")
    assert formats.parse_snapgene(data)["sequence"] == "ACGTAC" and formats.parse_snapgene(data)["circular"]
    with pytest.raises(ValueError):
        formats.parse_snapgene(b"xx")


def test_names_and_suffixes():
    assert formats.clean_name("untitled", "pABC_1") == "pABC_1" and formats.clean_name("a b/c" * 5) == "a_b_ca_b_ca_b_ca"
    assert formats.format_of("x/y.GBK") == "genbank"
    with pytest.raises(ValueError):
        formats.format_of("x.doc")


def test_directory_scan_with_dead_letters(spark, tmp_path):
    (tmp_path / "a.gb").write_text(GB)
    (tmp_path / "b.gb").write_text("LOCUS nothing")
    (tmp_path / "c.txt").write_text("no")
    good, bad = library.scan(library.directory(spark, str(tmp_path), "*.gb"))
    assert [(r["label"], r["length"]) for r in good.collect()] == [("a", 24)] and bad.count() == 1


def test_files_keep_their_order(spark, tmp_path):
    for n in ("z.fa", "a.fa"):
        (tmp_path / n).write_text(f">{n}\nACGT\n")
    got = library.files(spark, [str(tmp_path / "z.fa"), str(tmp_path / "a.fa")]).orderBy("nth").collect()
    assert [r["plasmid_id"][-4:] for r in got] == ["z.fa", "a.fa"]


def test_sources_agree(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">a\nACGTT\n")
    by_file, _ = library.scan(library.as_source(spark, [str(tmp_path / "a.fa")]))
    by_dir, _ = library.scan(library.as_source(spark, str(tmp_path), "*.fa"))
    assert by_file.first()["sequence"] == by_dir.first()["sequence"] == library.as_source(spark, {"a": "acgtt"}).first()["sequence"]
    with pytest.raises(FileNotFoundError):
        library.as_source(spark, str(tmp_path / "none"))


def test_first_owner_wins(spark):
    a, b = spark.createDataFrame([("x", 1)], "plasmid_id string, v int"), spark.createDataFrame([("x", 2), ("y", 3)], "plasmid_id string, v int")
    assert {(r["plasmid_id"], r["v"], r["source"]) for r in library.first_owner([a, b]).collect()} == {("x", 1, 0), ("y", 3, 1)}


def test_callable_source(spark):
    store = {"a": b">a\nACGT\n"}
    df = library.callable_source(spark, "remote_test", ["a", "b"], lambda i: store[i])
    got = {r["plasmid_id"]: r for r in df.collect()}
    assert got["a"]["content"] == store["a"] and got["b"]["error"]


def test_library_discovery(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert library.find_library() is None
    (tmp_path / "plasmid").mkdir()
    assert library.find_library() is None
    (tmp_path / "plasmid" / "a.gb").write_text("x")
    assert library.find_library() == "./plasmid"


def test_lab_config(tmp_path):
    f = tmp_path / "lab.json"
    f.write_text('{"unavailable": ["pX"], "enzyme_stock": ["PstI"]}')
    c = conditions.lab_config(str(f))
    assert c["base_vectors"] == [] and not conditions.is_available("pX", c) and conditions.in_stock("PstI", c) and not conditions.in_stock("SmaI", c)


def test_ingest(spark, tmp_path):
    spark.createDataFrame([(1, "acgt acgt"), (2, "tacg"), (3, "12")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = ingest_available(spark, str(tmp_path), "documents.parquet", spark.read.parquet(str(tmp_path / "documents.parquet")).schema).collect()
    assert sorted(r["id"] for r in rows) == [1, 2]


def test_names_without_a_format_are_failures(spark):
    rows = [("a.fasta", b">a\nACGT\n"), ("b.xyz", b"?"), ("c", b"?"), (None, b"?"), ("d.fa", b"no record")]
    good, bad = library.scan(spark.createDataFrame(rows, "plasmid_id string, content binary"))
    assert [r["plasmid_id"] for r in good.collect()] == ["a.fasta"]
    assert sorted(str(r["plasmid_id"]) for r in bad.collect()) == ["None", "b.xyz", "c", "d.fa"] and all(r["error"] for r in bad.collect())


def test_snapgene_features():
    def packet(kind, body):
        return bytes([kind]) + struct.pack(">I", len(body)) + body

    xml = '<Features><Feature name="ampR" type="CDS" directionality="2"><Segment range="3-6"/><Q name="gene"><V text="&lt;b&gt;bla&lt;/b&gt;"/></Q></Feature><Feature name="wrap" type="misc_feature"><Segment range="9-2"/></Feature></Features>'
    data = packet(9, b"SnapGene\0\1\0\1\0\1") + packet(0, b"\1ACGTACGTAC") + packet(10, xml.encode())
    r = formats.parse_snapgene(data)
    a, b = r["features"]
    assert (a["label"], a["type"], a["start"], a["end"], a["strand"], a["qualifiers"]["gene"]) == ("ampR", "CDS", 2, 6, -1, ["bla"])
    assert (b["label"], b["start"], b["end"]) == ("wrap", 8, 12) and r["circular"]
    with pytest.raises(ValueError):
        formats.parse_snapgene(packet(9, b"SnapGene") + packet(0, b"\1ACGT") + packet(10, b"<Features"))
