"""The queries that apply the operators of this subpackage to whole tables, with production
parameters, and derive the columns that results are compared by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringspan.llm import ann, hard_negatives, line_dedup, minhash, outliers, packing, quality, secret_scan, sharding, simhash, spiece, warc
from ringspan.llm._shared import cut


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file, the same on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = packing.tokenize_pieces(docs, vocabulary("word_bpe_49k.json"))
    slim = pieces.select("doc_id", "seat", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.place(slim, packing.packers_for(docs.count())).drop("seat")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write(table(spark, sf_dir, "pages"))
    records = warc.read_records(spark, path)
    digested = records.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")}).drop("payload", "http_head")
    captures = warc.assemble(cut(digested, "records"))
    page = captures.select("record_id", F.col("metadata.fields")["page-id"].cast("long").alias("page_id"), "response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("to"))
    page = cut(page, "captures")
    first = page.where("record_type = 'response'").groupBy(F.col("record_id").alias("to")).agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("_bytes"), F.min("payload_digest").alias("_digest"))
    again = page.where("record_type = 'revisit'").select("page_id", "record_type", "to").join(first, "to", "left")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return page.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(out).union(again.withColumnsRenamed({"_bytes": "payload_bytes", "_digest": "payload_digest"}).select(out))


def op3_sharding(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    placed = sharding.assign(sharding.assign(docs, "doc_id", shards), "doc_id", shards + 1, "grown_shard")
    return sharding.number(placed, "shard", "doc_id").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op4_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("piece_bpe_32k.model")
    back = spiece.decoded(spiece.encode(table(spark, sf_dir, "documents"), path), path)
    return back.select("doc_id", (F.octet_length("ids") / F.col("ids_width")).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.octet_length("text").cast("long").alias("text_bytes"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken")))


def fit_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    """The classifier, learnt from the labels of rows that are not held out."""
    return quality.fit(docs, table(spark, sf_dir, "labels").where(~quality.held_out("doc_id")))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, fit_quality(spark, docs, sf_dir))
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    clean = line_dedup.dedup(docs)
    return clean.select("doc_id", F.size("dropped_lines").cast("long").alias("n_dropped"), F.array_join(F.col("dropped_lines").cast("array<string>"), ",").alias("dropped_lines"), "text")


def op10_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    judged = outliers.judge(outliers.statistics(docs).drop("text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_pivot_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = F.col("embedding").cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = table(spark, sf_dir, "embeddings").where(finite).select("vec_id", label.alias("label"), F.transform(vec, lambda x: F.floor(256 * x)).alias("scaled"))
    return hard_negatives.mine(whole, F.col("id") % 100 == 0, vec_col="scaled")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_warc, op3_sharding, op4_hilbert_neighbours, op5_sentencepiece, op6_simhash, op7_secret_scan, op8_quality_classifier, op9_line_dedup, op10_quality_outliers, op11_minhash, op12_pivot_negatives, pipeline)}

#: DuckDB SQL for what SQL can express on whole tables.
SQL = {
    "op3_sharding": """
WITH RECURSIVE
bit AS (SELECT n, 0 AS k, n AS c FROM (SELECT unnest(range(256)) AS n) UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bit WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY n) AS t FROM bit WHERE k = 8),
d AS (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, CAST(length(h) // 2 + 1 AS BIGINT) AS size, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(h, '..'), lambda b: CAST('0x' || b AS BIGINT))), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) AS text_crc32 FROM d, crc_table),
x0 AS (SELECT *, CAST(CASE WHEN coalesce(doc_id, -1) < 0 THEN CAST(coalesce(doc_id, -1) AS HUGEINT) + 18446744073709551616 ELSE coalesce(doc_id, -1) END AS UHUGEINT) AS x FROM c),
x1 AS (SELECT * REPLACE ((xor(x, x // 1073741824::UHUGEINT) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS x) FROM x0),
x2 AS (SELECT * REPLACE ((xor(x, x // 134217728::UHUGEINT) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS x) FROM x1),
x3 AS (SELECT DISTINCT doc_id, xor(x, x // 2147483648::UHUGEINT) AS x FROM x2),
jump AS (SELECT doc_id, n, x AS k, 0::BIGINT AS b, 0::BIGINT AS j FROM x3, (VALUES (8), (9)) AS v(n)
 UNION ALL SELECT doc_id, n, k2, j, CAST(trunc((j + 1) * (2147483648.0::DOUBLE / (CAST(k2 // 8589934592::UHUGEINT AS DOUBLE) + 1))) AS BIGINT) FROM (SELECT doc_id, n, j, (k * 2862933555777941757::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT AS k2 FROM jump WHERE j < n)),
placed AS (SELECT doc_id, CAST(max(b) FILTER (n = 8) AS INTEGER) AS shard, CAST(max(b) FILTER (n = 9) AS INTEGER) AS grown_shard FROM jump GROUP BY doc_id)
SELECT c.doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY c.doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard FROM c JOIN placed ON c.doc_id IS NOT DISTINCT FROM placed.doc_id
""",
    "op2_warc": "WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p), k AS (SELECT payload_digest, max(page_id) AS keep FROM d WHERE payload_bytes >= 1000 GROUP BY 1) SELECT page_id, payload_bytes, payload_digest, CASE WHEN keep <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN keep <> page_id THEN keep END AS refers_to FROM d LEFT JOIN k USING (payload_digest)",
    "op11_minhash": r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM common JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(doc_id, least) AS (SELECT doc_id, doc_id FROM documents UNION SELECT v, least FROM reach JOIN ways ON u = doc_id),
c AS (SELECT doc_id, min(least) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
""",
    "op12_pivot_negatives": """
WITH e AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score QUALIFY rank <= 5
""",
}
