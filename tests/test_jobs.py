"""The jobs over copies of tables that grow, run again, and after a failure."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import common, digest_sheets, library_intake

RAW = {"as_bases": False}
SCHEMA = "doc_id long, text string, source string, extra int"
A, B, C = "ACGTTGCAAT" * 3, "GGGTTTACGACCATAGAC", "TTTTACGACGGGCC"


def add(spark, path, name, rows):
    """A file of records, as a lab would drop it."""
    tmp = f"{path}-{name}"
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(tmp)
    os.makedirs(path, exist_ok=True)
    shutil.copy(next(Path(tmp).glob("part-*.parquet")), f"{path}/{name}.parquet")


def turned(s, k):
    return s[k:] + s[:k]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def status(df):
    return {(r["id"], r["status"], r["first_id"]) for r in df.collect()}


def test_intake_takes_only_what_is_new(spark, tmp_path):
    at = [str(tmp_path / x) for x in ("in", "out", "state")]
    add(spark, at[0], "one", [(5, A, "x", 1), (3, turned(A, 7), "y", 1), (9, B, None, 1), (8, None, "x", 1), (7, "", "x", 1), (9, B, None, 1)])
    first = status(library_intake.run(spark, *at, RAW))
    assert first == {(3, "first", 3), (5, "copy", 3), (9, "first", 9)}
    assert status(library_intake.run(spark, *at, RAW)) == first
    # a copy with a lesser id, a known record once more, a new one with its copy, a record without an id
    add(spark, at[0], "two", [(1, A, "x", 1), (9, B, None, 1), (11, C, "z", 1), (12, C, "z", 1), (None, C + "A", "z", 1)])
    second = status(library_intake.run(spark, *at, RAW))
    assert second == first | {(1, "copy", 3), (9, "copy", 9), (11, "first", 11), (12, "copy", 11), (None, "first", None)}
    got = library_intake.registry(spark, at[1])
    assert {r["batch"] for r in got.where("id in (1, 11)").collect()} == {1} and got.count() == 8
    total = spark.read.parquet(f"{at[1]}/summary").agg(F.sum("n_records"), F.sum("n_first"), F.sum("n_copies")).first()
    assert tuple(total) == (8, 4, 4)
    assert rows_of(library_intake.run(spark, *at, RAW)) == rows_of(got.select(library_intake.COLUMNS))


def test_intake_after_a_failure(spark, tmp_path):
    """A batch that was written but not committed is run again, and gives the same rows."""
    at = [str(tmp_path / x) for x in ("in", "out", "state")]
    add(spark, at[0], "one", [(5, A, "x", 1), (9, B, "x", 1)])
    library_intake.run(spark, *at, RAW)
    add(spark, at[0], "two", [(1, turned(A, 3), "x", 1), (2, C, "x", 1)])
    want = rows_of(library_intake.run(spark, *at, RAW))
    for f in Path(at[2], "commits").glob("*1*"):
        f.unlink()
    assert rows_of(library_intake.run(spark, *at, RAW)) == want


def test_intake_of_nothing(spark, tmp_path):
    at = [str(tmp_path / x) for x in ("in", "out", "state")]
    add(spark, at[0], "one", [(5, "", "x", 1)])
    assert library_intake.run(spark, *at, RAW).count() == 0
    empty = tmp_path / "empty"
    empty.mkdir()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9999")
    assert library_intake.run(spark, str(empty), str(tmp_path / "out2"), str(tmp_path / "state2"), RAW).count() == 0
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "9999"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_intake_in_many_batches_files_what_one_does(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = str(tmp_path / "in")
    docs.repartition(4, "doc_id").write.parquet(path)
    got = library_intake.run(spark, path, str(tmp_path / "a"), str(tmp_path / "sa"), {"files_per_batch": 1})
    one = library_intake.run(spark, path, str(tmp_path / "b"), str(tmp_path / "sb"))
    assert library_intake.registry(spark, str(tmp_path / "a")).select("batch").distinct().count() > 1
    assert rows_of(got.select("id", "source", "length", "gc", "fingerprint")) == rows_of(one.select("id", "source", "length", "gc", "fingerprint"))
    assert rows_of(got.groupBy("fingerprint").agg(F.sum((F.col("status") == "first").cast("int")), F.count_distinct("first_id"))) == rows_of(one.groupBy("fingerprint").agg(F.sum((F.col("status") == "first").cast("int")), F.count_distinct("first_id")))


ECO = "GAATTC"


def test_sheets(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    pool = {"as_bases": False, "pool": ["EcoRI", "BamHI"]}
    add(spark, src, "one", [(1, "ACGTACGTAC" + ECO, "x", 1), (2, ECO + "TTTT" + ECO + "GGATCC", "y", 1), (3, None, "x", 1), (4, "TTC" + "ACGACGACG" + "GAA", None, 1)])
    got = digest_sheets.run(spark, src, out, pool)
    assert {(r["id"], r["enzyme"], r["top"], r["source"]) for r in got.collect()} == {(1, "EcoRI", 11, "x"), (2, "BamHI", 17, "y"), (4, "EcoRI", 13, None)}
    assert all(r["temp_c"] and r["sold_as"] for r in got.collect())
    before = rows_of(got)
    assert rows_of(digest_sheets.run(spark, src, out, pool)) == before
    # a run over one source leaves the others alone
    only = str(tmp_path / "later")
    add(spark, only, "one", [(1, "ACGTACGTACAA" + ECO, "x", 1), (5, ECO, "y", 1)])
    again = digest_sheets.run(spark, only, out, {**pool, "sources": ["x"]})
    assert {(r["id"], r["top"]) for r in again.collect()} == {(1, 13), (2, 17), (4, 13)}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").upper() == "STATIC"
    assert spark.read.parquet(f"{out}/enzymes").where("enzyme = 'EcoRI'").agg(F.sum("n_records")).first()[0] == 2


def test_settings(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"id": "k", "as_bases": False}))
    got = common.settings(spark, str(path), library_intake.DEFAULTS)
    assert got["id"] == "k" and got["as_bases"] is False and got["files_per_batch"] == 1000
    path.write_text(json.dumps({"idd": "k"}))
    with pytest.raises(ValueError, match="idd"):
        common.settings(spark, str(path), library_intake.DEFAULTS)


@pytest.mark.parametrize("job", ["library_intake", "digest_sheets"])
def test_command_line(tmp_path, job):
    """From another folder, with the config file that is shipped."""
    root = Path(__file__).resolve().parent.parent
    args = ["--records", "/root/testdata/sf0.001/documents.parque[t]", "--out", str(tmp_path / "out"), "--config", str(root / f"jobs/{job}.json")]
    args += ["--checkpoint", str(tmp_path / "state")] if job == "library_intake" else []
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    done = subprocess.run([sys.executable, str(root / f"jobs/{job}.py"), *args], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read " in done.stderr and "holds " in done.stderr
    assert list((tmp_path / "out").glob("*/**/*.parquet"))
