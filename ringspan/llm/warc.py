"""WARC archives: writing captures, reading records, assembling transactions.

`write` puts a request, a response (or revisit) and a metadata record per capture into gzipped
archives with Spark's own writer, so any store that Spark reaches will do. `read_records` parses
archives, each by itself, by content lengths. `assemble` joins request and metadata records to
the response they are concurrent to and emits one nested row per capture; a link may be named on
either record, and a metadata record may name a request instead of the response.

Scale: payloads move only in the join that marks revisits, and not even then while the table of
repeated payloads is small enough for Spark to broadcast (its size is known, it is a written
table). An archive has at most `captures_per_file` captures, and no more than come to `archive_bytes` at
the mean size of a payload. Gzipped archives are read as a stream, a record at a time, and records leave
in batches of about 4 MB: a task holds one record and one batch, however large the archive. They are left out of the scan that
reads other archives whole. A file is
gzipped as a whole, not record by record, since Spark's writer does so; both are read. Assembly shuffles
record heads only, unless payloads are kept. Links are pre-aggregated per capture, captures stay rows of
their own: a hot identifier is no hot group.

Cases: a null html is an empty payload; a null url becomes urn:none; blanks and control characters in a
url are written as %20, since they would end the header; a null page id has no
page-id field and reads back as null; rows with equal page id and payload are each a capture, all
of one type; an empty table gives no archives and no rows; other columns are ignored; a record
whose transaction has no response gives no row; a file that breaks off gives the records before the break.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringspan.llm._shared import cut, new_path, ship

_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uuid(kind: str, *cols: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]).cast("binary"))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def _record(heads: list[tuple[str, Column]], block: Column) -> Column:
    lines = F.concat_ws("\r\n", F.lit("WARC/1.1"), *[F.concat(F.lit(f"{k}: "), v) for k, v in heads], F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(lines, F.lit(_END), block)


def write(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 1000, date: str = "2025-01-01T00:00:00Z", captures_per_file: int = 10_000, archive_bytes: int = 1 << 30) -> str:
    """Write the captures; the path of the archives. Of equal payloads of at least
    min_revisit_bytes, that with the largest id is a response, others revisit it."""
    spark = pages.sparkSession
    path = path or new_path(spark, "archives")
    src = pages.select(F.col(id_col).alias("id"), F.coalesce(F.regexp_replace(F.col(url_col), r"[\x00-\x20\x7f]", "%20"), F.lit("urn:none")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    src = src.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html")})
    slim = cut(src.select("id", "digest", "bytes"), "payloads")
    again = slim.where(F.col("bytes") >= min_revisit_bytes).groupBy("digest").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    again = cut(again.where("n > 1 and keep is not null").select(F.col("digest").alias("same"), "keep"), "repeated")
    mean = int(slim.agg(F.avg("bytes")).first()[0] or 0) + 1
    captures_per_file = max(1, min(captures_per_file, archive_bytes // mean))
    src = src.join(again, src["digest"] == again["same"], "left").withColumn("revisit", F.col("keep").isNotNull() & ~F.col("id").eqNullSafe(F.col("keep")))
    own, sent, meta = (_uuid(kind, F.col("id"), F.col("digest")) for kind in ("capture", "request", "metadata"))
    when, url = F.lit(date), F.col("url")
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    host = F.coalesce(F.nullif(F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1), F.lit("")), F.lit("none"))
    request = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", sent), ("WARC-Date", when), ("WARC-Target-URI", url), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http;msgtype=request"))], F.concat(F.lit("GET / HTTP/1.1\r\nHost: "), host, F.lit(_END)))
    answer = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(_END))
    common = [("WARC-Record-ID", own), ("WARC-Date", when), ("WARC-Target-URI", url), ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http;msgtype=response"))]
    response = _record([("WARC-Type", F.lit("response")), *common], F.concat(answer, F.col("html")))
    revisit = _record([("WARC-Type", F.lit("revisit")), *common, ("WARC-Profile", F.lit(_PROFILE)), ("WARC-Refers-To", _uuid("capture", F.col("keep"), F.col("digest")))], answer)
    fields = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit("\r\n")), F.lit("")), F.lit("via: "), url, F.lit("\r\n"))
    metadata = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", meta), ("WARC-Date", when), ("WARC-Target-URI", url), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))], fields)
    rows = src.select(F.concat(request, F.lit(_END), F.when(F.col("revisit"), revisit).otherwise(response), F.lit(_END), metadata).alias("value"))
    rows.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", captures_per_file).text(path)
    return path


RECORD = "record_id string, type string, date string, target_uri string, concurrent_to array<string>, refers_to string, digest_head string, http_head string, fields map<string,string>, payload binary"


#: Bytes of payloads that a batch of records holds, or one record if that is larger.
BATCH_BYTES = 4_000_000


def parse(blocks: Iterable[bytes]) -> Iterator[dict]:
    """The records of an archive that comes in blocks of any length, one at a time."""
    blocks, held, at = iter(blocks), bytearray(), 0

    def more() -> bool:
        nonlocal at
        if at > 1 << 20:
            del held[:at]
            at = 0
        block = next(blocks, None)
        held.extend(block or b"")
        return block is not None

    def upto(n: int) -> bool:
        """Whether so many bytes are at hand from here on."""
        while len(held) - at < n:
            if not more():
                return False
        return True

    while True:
        while upto(2) and held[at : at + 2] == b"\r\n":
            at += 2
        looked = 0
        while (end := held.find(b"\r\n\r\n", at + looked)) < 0:
            looked = max(0, len(held) - at - 3)
            if not more():
                return
        heads: dict[str, list[str]] = {}
        for line in held[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            heads.setdefault(k.strip().lower(), []).append(v.strip())
        at = end + 4
        n = heads.get("content-length", [""])[0]
        if not n.isdecimal() or not upto(int(n)):
            return
        n = int(n)
        yield _record_of(heads, bytes(held[at : at + n]))
        at += n


def _record_of(heads: dict[str, list[str]], block: bytes) -> dict:
    one = lambda k: heads.get(k, [None])[0]
    mime = one("content-type") or ""
    http, payload, fields = None, block, None
    if mime.startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        http = head.decode("utf-8", "replace")
    elif mime == "application/warc-fields":
        fields = [tuple(x.strip() for x in line.split(":", 1)) for line in block.decode("utf-8", "replace").split("\r\n") if ":" in line]
        fields = list(dict(fields).items())
    return {"record_id": one("warc-record-id"), "type": one("warc-type"), "date": one("warc-date"), "target_uri": one("warc-target-uri"), "concurrent_to": heads.get("warc-concurrent-to", []), "refers_to": one("warc-refers-to"), "digest_head": one("warc-payload-digest"), "http_head": http, "fields": fields, "payload": payload}


def inflated(data: bytes) -> Iterator[bytes]:
    """The content of a file in blocks: of gzip members, one or many, else as it is."""
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        block = z.decompress(data, 1 << 20)
        while block:
            yield block
            block = z.decompress(z.unconsumed_tail, 1 << 20)
        data = z.unused_data
    yield data


def _batched(records: Iterable[dict], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for r in records:
        rows.append(r)
        held += len(r["payload"]) + 500
        if held > BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=kinds)


def _unzipped(names: str) -> str:
    """The pattern of those names that fit one and do not end in .gz: they are left out before the scan, which would
    read each into one value."""
    if not names.endswith("*"):
        return names
    stem = names.rstrip("*")
    return "{" + ",".join([f"{names}[^z]", f"{names}[^g]z", f"{names}[^.]gz", f"{stem}z", f"{stem}gz"]) + "}"


def read_records(spark: SparkSession, path: str, names: str = "part-*") -> DataFrame:
    """A row per record of the archives under a path whose names fit the pattern. Those ending in .gz are
    read as a stream of stretches between blank lines; others, which Spark would split, are read whole."""
    ship(spark)
    kinds = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("date", pa.string()), ("target_uri", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("digest_head", pa.string()), ("http_head", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])

    def streamed(batches):
        rows = ((name, part) for b in batches for name, part in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        ahead = next(rows, None)

        def blocks():
            nonlocal ahead
            name = ahead[0]
            while ahead and ahead[0] == name:
                yield ahead[1].as_py() + _END.encode()
                ahead = next(rows, None)

        def records():
            while ahead:
                of_file = blocks()
                yield from parse(of_file)
                for _ in of_file:  # what a broken file has left
                    pass

        yield from _batched(records(), kinds)

    def whole(batches):
        yield from _batched((r for b in batches for data in b.column(0) for r in parse(inflated(data.as_py()))), kinds)

    parts = spark.read.option("lineSep", _END).option("pathGlobFilter", names if names.endswith(".gz") else f"{names}.gz").schema("value string").text(path)
    stretches = parts.select(F.col("_metadata.file_path").alias("name"), F.col("value").cast("binary").alias("part"))
    gzipped = stretches.mapInArrow(streamed, RECORD)
    if names.endswith(".gz"):
        return gzipped
    files = spark.read.format("binaryFile").option("pathGlobFilter", _unzipped(names)).schema("path string, modificationTime timestamp, length long, content binary").load(path)
    others = files.where(~F.col("path").endswith(".gz") & (F.col("length") > 0)).select("content")
    return gzipped.union(others.mapInArrow(whole, RECORD))


def assemble(records: DataFrame) -> DataFrame:
    """A nested row per capture: response (or revisit), request and metadata."""
    heads = [c for c in records.columns if c != "concurrent_to"]
    anchors = records.where(F.col("type").isin("response", "revisit", "resource"))
    others = records.where(F.col("type").isin("request", "metadata"))
    named = others.select("record_id", F.explode("concurrent_to").alias("to")).distinct()
    ids = anchors.select(F.col("record_id").alias("anchor")).distinct()
    direct = named.join(ids, F.col("to") == F.col("anchor")).select("record_id", "anchor")
    back = anchors.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("anchor"))
    known = direct.union(back).distinct()
    hop = named.join(ids, F.col("to") == F.col("anchor"), "left_anti").join(known.select(F.col("record_id").alias("to"), "anchor"), "to").select("record_id", "anchor")
    links = known.union(hop).distinct()
    whole = F.struct(*heads)
    joined = others.select("record_id", "type", whole.alias("r")).join(links, "record_id")
    parts = joined.groupBy("anchor").agg(F.min_by(F.when(F.col("type") == "request", F.col("r")), F.when(F.col("type") == "request", F.col("record_id"))).alias("request"), F.min_by(F.when(F.col("type") == "metadata", F.col("r")), F.when(F.col("type") == "metadata", F.col("record_id"))).alias("metadata"))
    return anchors.select("record_id", whole.alias("response")).join(parts, F.col("record_id") == F.col("anchor"), "left").select("record_id", "response", "request", "metadata")
