"""A training-data pipeline in five stages over `documents`; each stage reads what the one before
wrote. All but the last keep the columns of `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringspan.llm import line_dedup, packing, quality, secret_scan, simhash
from ringspan.llm._shared import cut, new_path
from ringspan.llm.queries import table, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _as_documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars following the text."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3 go. Labels are learnt from `docs`, held-out rows excepted. Rows are judged
    one by one, whole texts however long; a null text scores as an empty one, by the bias alone; with no label
    to learn from all stay; an empty table gives no rows."""
    weights = quality.fit(docs, table(spark, sf_dir, "labels").where(~quality.held_out("doc_id")))
    return quality.score(docs, weights, out="_score").where("_score >= 0.3").select(*COLUMNS)


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines alike across documents, one occurrence stays. No row goes: a document of which all lines were
    others' is left empty. A null text stays null; rows equal in id and text keep the same lines; ties go to
    the least doc_id and the earlier line; an empty table gives no rows."""
    return _as_documents(line_dedup.dedup(docs.select(*COLUMNS)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group whose five-word shingles are alike at 0.8 or more stays: that of the
    least doc_id, nulls last, and of its rows the first. Rows are told apart by a key of their own, so
    repeated rows are copies of each other, and rows of one doc_id, or of none, with unlike texts all stay.
    Null and wordless texts are alike. An empty table gives no rows."""
    rows = cut(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = simhash.near_texts(rows, "_row").join(rows.select(F.col("_row").alias("row"), "doc_id"), "row")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first"))
    return rows.join(first.select(F.col("first.row").alias("_row")), "_row", "left_semi").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, in whole texts however long. Every row stays; a null text stays null; an
    empty table gives no rows."""
    return _as_documents(secret_scan.redact(docs.select(*COLUMNS), vocabulary("byte_bpe_50k.tiktoken")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 2048 tokens: a row per piece, with its ids and place. A null text gives its
    end id alone; longer texts are cut; rows of one id, or of none, are packed each; an empty table gives no
    rows."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality_classifier", quality_classifier), ("line_dedup", deduplicate_lines), ("simhash_near_dedup", near_duplicates), ("secret_scan", redact_secrets), ("best_fit_packing", pack_sequences)]

#: A trained classifier, near-duplicates and tokenizers are beyond SQL; the stages have tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
