"""The command line and the request schemas."""

import json

from pyspark.sql import functions as F

from ringspan import schemas
from ringspan.__main__ import main
from ringspan.sources.formats import feature, format_genbank
from tests.test_planners import circle


def test_commands(spark, tmp_path, capsys):
    s, span = circle("CTGCAG", "CTGCAG")
    f = feature("misc_feature", [{"start": span[0], "end": span[1], "strand": 1}], {"label": ["target"]})
    (tmp_path / "pA.gb").write_text(format_genbank("pA", s, [f]))
    (tmp_path / "pB.fa").write_text(f">b\n{s[50:] + s[:50]}\n")
    (tmp_path / "bad.fa").write_text("nothing")
    assert main(["--library", str(tmp_path), "report"]) == 0
    out = capsys.readouterr().out
    assert "n_distinct: 1" in out and "unreadable: 1" in out and "pA  442 bp" in out
    assert main(["--library", str(tmp_path), "delete", "pA", "target"]) == 0
    assert json.loads(capsys.readouterr().out)["route"] == "restriction"
    assert main(["--library", str(tmp_path), "search", "pB"]) == 0
    assert main(["--library", str(tmp_path / "none"), "report"]) == 2


def test_schemas(spark):
    df = spark.createDataFrame([('{"backbone": "pA", "parts": ["x"]}', '{"matches": [{"part": "x", "confidence": 0.5}, {"part": "y", "confidence": 7}], "missing": []}')], "a string, b string")
    r = df.select(schemas.parse_spec(F.col("a")).alias("s"), schemas.parse_resolution(F.col("b")).alias("r"), schemas.is_sequence(F.lit("acgtn")).alias("q")).first()
    assert r["s"]["backbone"] == "pA" and [m["part"] for m in r["r"]["matches"]] == ["x"] and r["q"]
