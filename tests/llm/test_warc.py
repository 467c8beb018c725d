"""WARC round trips and transaction assembly."""

import gzip
import hashlib

import pytest

from ringspan.llm import warc as W
from ringspan.llm.queries import op2_warc

BIG = "<p>" + "same " * 300 + "</p>"
ROWS = [(1, "http://a.example/1", BIG, "x"), (2, "http://a.example/2", BIG, "x"), (3, "http://a.example/3", "<p>\r\n\r\nWARC/1.1\r\nWARC-Type: fake\r\n\r\n</p>", "x"), (4, None, None, None), (5, "http://a.example/5", "short", "x"), (6, "http://a.example/6", "short", "x"), (7, "http://a b/\r\n", "é" * 700, "x"), (8, "u", BIG, "x"), (8, "u", BIG, "x"), (None, "http://a.example/9", "", "x")]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string, record_id string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    rows = op2_warc(spark, str(tmp_path)).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        html = next(h for i, _, h, _ in ROWS if i == r["page_id"])
        data = (html or "").encode()
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == hashlib.sha1(data).hexdigest()
        revisit = r["page_id"] in (1, 2)
        assert (r["record_type"], r["refers_to"]) == (("revisit", 8) if revisit else ("response", None))


def record(kind, rid, block=b"", **heads):
    lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: " + rid.encode()]
    for k, v in heads.items():
        for x in [v] if isinstance(v, str) else v:
            lines.append(k.replace("_", "-").encode() + b": " + x.encode())
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(block), b"", block, b"", b""])


def test_parse_members_and_plain():
    a, b = record("response", "<a>", b"HTTP/1.1 200 OK\r\n\r\nbody\r\n\r\n", Content_Type="application/http"), record("metadata", "<b>", b"k: v\r\n", Content_Type="application/warc-fields")
    for data in (a + b, gzip.compress(a) + gzip.compress(b), gzip.compress(a + b)):
        got = list(W.parse(W.inflated(data)))
        assert [r["record_id"] for r in got] == ["<a>", "<b>"] and got[0]["payload"] == b"body\r\n\r\n" and got[1]["fields"] == [("k", "v")]
    assert list(W.parse(W.inflated(b""))) == []


@pytest.mark.parametrize("n", [1, 2, 3, 7, 1000])
def test_blocks_of_any_length(n):
    data = b"".join(record("response", f"<{k}>", b"\r\n" * k + b"x\r\n\r\nWARC/1.1\r\n" + b"\r\n" * (k % 3)) for k in range(9))
    got = list(W.parse(data[i : i + n] for i in range(0, len(data), n)))
    assert [(r["record_id"], r["payload"]) for r in got] == [(f"<{k}>", b"\r\n" * k + b"x\r\n\r\nWARC/1.1\r\n" + b"\r\n" * (k % 3)) for k in range(9)]


def test_a_record_at_a_time():
    """Nothing past a record is asked for before it is out."""
    asked = []

    def blocks():
        for k in range(100):
            asked.append(k)
            yield record("response", f"<{k}>", b"x" * 100_000)

    got = W.parse(blocks())
    next(got)
    next(got)
    assert len(asked) <= 3


def test_gzipped_and_plain_archives_side_by_side(spark, tmp_path):
    a, b, c = (record("response", f"<{x}>", f"{x}\r\n\r\né".encode() + b"\xff\x00\r\n\r\n\r\n\r\n") for x in "abc")
    (tmp_path / "part-0.warc").write_bytes(a)
    (tmp_path / "part-1.warc.gz").write_bytes(gzip.compress(b) + gzip.compress(c))
    (tmp_path / "part-2.warc.gz").write_bytes(gzip.compress(b[:40]))
    (tmp_path / "part-3.warc.gz").write_bytes(gzip.compress(b""))
    (tmp_path / "part-4.warc").write_bytes(b"")
    (tmp_path / "part-5.warc.gz").write_bytes(gzip.compress(a + c[:60]))
    got = sorted((r["record_id"], bytes(r["payload"])) for r in W.read_records(spark, str(tmp_path)).collect())
    assert got == [(f"<{x}>", f"{x}\r\n\r\né".encode() + b"\xff\x00\r\n\r\n\r\n\r\n") for x in "aabc"]


def test_archives_roll_by_bytes(spark, tmp_path):
    pages = spark.range(40).selectExpr("id as page_id", "concat('http://a/', id) as url", "concat(id, repeat('x', 1000)) as html").coalesce(1)
    path = W.write(pages, str(tmp_path / "out"), archive_bytes=10_000)
    assert len(list((tmp_path / "out").glob("part-*.gz"))) >= 4
    assert W.assemble(W.read_records(spark, path)).count() == 40


def test_large_gzipped_archives_are_read_as_streams_only(spark, tmp_path):
    """Spark may not read the archives into one value each; other files beside them may be."""
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * 2000) for i in range(20)], "page_id long, url string, html string")
    path = W.write(pages, str(tmp_path / "a"))
    for name in ("z", "gz", "xz", "x.z", "xgz", "a.gzz"):
        (tmp_path / "a" / f"part-{name}").write_bytes(b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <" + name.encode() + b">\r\nContent-Length: 2\r\n\r\nok\r\n\r\n")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "200")
    try:
        got = W.read_records(spark, path).collect()
        assert W.read_records(spark, path, "part-*.gz").count() == 60
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert len(got) == 66 and {r["record_id"] for r in got if r["type"] == "resource"} == {f"<{n}>" for n in ("z", "gz", "xz", "x.z", "xgz", "a.gzz")}


def test_links_both_ways_and_by_a_hop(spark, tmp_path):
    data = b"".join([
        record("request", "<q1>", WARC_Concurrent_To="<r1>"), record("response", "<r1>"), record("metadata", "<m1>", WARC_Concurrent_To="<q1>"),
        record("response", "<r2>", WARC_Concurrent_To=["<q2>", "<m2>"]), record("request", "<q2>"), record("metadata", "<m2>"),
        record("response", "<r3>"), record("request", "<q9>", WARC_Concurrent_To="<gone>"),
    ])
    (tmp_path / "part-0.warc").write_bytes(data)
    got = {r["record_id"]: r for r in W.assemble(W.read_records(spark, str(tmp_path))).collect()}
    names = {k: tuple(r[p]["record_id"] if r[p] else None for p in ("request", "metadata")) for k, r in got.items()}
    assert names == {"<r1>": ("<q1>", "<m1>"), "<r2>": ("<q2>", "<m2>"), "<r3>": (None, None)}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert op2_warc(spark, str(tmp_path)).count() == 0
