"""Intake of new records into a library, as they arrive.

    python jobs/library_intake.py --records RECORDS --out OUT --checkpoint CHECKPOINT [--config jobs/library_intake.json]

Reads what RECORDS (a folder of Parquet files, or a pattern) holds beyond the checkpoint, identifies each record as a
circle (length, GC content, fingerprint of the canonical rotation), and files it: `first` if no record with its
fingerprint came before, else `copy`, with the id of the first one. Of the records of one batch the least id is the first.

OUT/registry is partitioned by batch, status and source. A batch looks up only the first records of earlier batches
(batch and status are partitions, two columns are read) and writes nothing but its own partition, in overwrite mode: a
batch that is run again after a failure gives the same rows. OUT/summary counts records by source, from the registry.

Scale: one shuffle by fingerprint for a batch and its look-up; a fingerprint that many records share is
pre-aggregated before it, and the join that takes it back to its records may be split where it is hot. Files are
written by source in tasks that Spark balances, so a large source is several files and small ones share a task.

Cases: records without bases are not filed; rows repeated with id and sequence in a batch are filed once, in later batches
as copies; a null id is filed and is the first of its circle only among null ids; no new files means no new batch, and a folder without files an
empty registry.
"""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from jobs.common import command_line, record_schema, sequences, settings  # noqa: E402
from ringspan.functions import sequences as S  # noqa: E402
from ringspan.session import settled  # noqa: E402

log = logging.getLogger("library_intake")

DEFAULTS = {"id": "doc_id", "sequence": "text", "group": "source", "as_bases": True, "files_per_batch": 1000}
REGISTRY = "id long, length int, gc double, fingerprint string, first_id long, batch long, status string, source string"
COLUMNS = ["id", "source", "length", "gc", "fingerprint", "first_id", "status"]


def identified(rows: DataFrame, config: dict) -> DataFrame:
    """(id, source, length, gc, fingerprint) of records."""
    s = sequences(rows, config)
    return s.select("id", "source", F.length("s").alias("length"), F.round(S.gc_percent("s"), 6).alias("gc"), S.fingerprint(F.col("s")).alias("fingerprint"))


def judged(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """rows with first_id and status; known: (fingerprint, known_id) of earlier batches, one row each."""
    least = rows.groupBy("fingerprint").agg(F.min("id").alias("least"))
    if known is None:
        firsts = least.select("fingerprint", "least", F.lit(False).alias("seen"))
    else:
        seen = known.withColumn("seen", F.lit(True))
        firsts = least.join(seen, "fingerprint", "left").select("fingerprint", F.when(F.col("seen"), F.col("known_id")).otherwise(F.col("least")).alias("least"), F.coalesce("seen", F.lit(False)).alias("seen"))
    first = ~F.col("seen") & F.col("id").eqNullSafe(F.col("least"))
    return rows.join(firsts, "fingerprint").select("id", "length", "gc", "fingerprint", F.col("least").alias("first_id"), F.when(first, "first").otherwise("copy").alias("status"), "source")


def registry(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(REGISTRY).parquet(f"{out}/registry")


def file_batch(batch: DataFrame, epoch: int, out: str, config: dict) -> None:
    spark = batch.sparkSession
    rows = identified(batch, config).dropDuplicates(["id", "fingerprint"]).persist()
    try:
        known = registry(spark, out).where((F.col("batch") < epoch) & (F.col("status") == "first")).groupBy("fingerprint").agg(F.min("id").alias("known_id")) if epoch else None
        n = rows.count()
        judged(rows, known).hint("rebalance", "source").write.mode("overwrite").partitionBy("status", "source").parquet(f"{out}/registry/batch={epoch}")
        log.info("batch %d: filed %d records under %s/registry/batch=%d", epoch, n, out, epoch)
    finally:
        rows.unpersist()


def summarise(spark: SparkSession, out: str) -> DataFrame:
    """Write and return (source, n_records, n_first, n_copies) of the registry."""
    copy = (F.col("status") == "copy").cast("long")
    rows = registry(spark, out).groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), F.sum(1 - copy).alias("n_first"), F.sum(copy).alias("n_copies"))
    rows.coalesce(1).write.mode("overwrite").parquet(f"{out}/summary")
    return spark.read.schema("source string, n_records long, n_first long, n_copies long").parquet(f"{out}/summary")


def run(spark: SparkSession, records: str, out: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """File what is new; the registry as it stands then (id, source, length, gc, fingerprint, first_id, status)."""
    config = {**DEFAULTS, **(config or {})}
    with settled(spark):
        # the registry is there from the first run on, even if nothing has arrived
        spark.createDataFrame([], REGISTRY).write.mode("append").partitionBy("batch", "status", "source").parquet(f"{out}/registry")
        stream = spark.readStream.schema(record_schema(config)).option("maxFilesPerTrigger", int(config["files_per_batch"])).parquet(records)
        query = stream.writeStream.foreachBatch(lambda batch, epoch: file_batch(batch, epoch, out, config)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        read = sum(p["numInputRows"] for p in query.recentProgress)
        log.info("read %d new records of %s", read, records)
        totals = summarise(spark, out).agg(F.sum("n_records"), F.sum("n_first"), F.sum("n_copies")).first()
        log.info("%s holds %s records: %s first, %s copies", out, *(n or 0 for n in totals))
    return registry(spark, out).select(COLUMNS)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__.split("\n", 1)[0])
    for name in ("records", "out", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config")
    a = p.parse_args(argv)
    spark = command_line("library_intake")
    try:
        run(spark, a.records, a.out, a.checkpoint, settings(spark, a.config, DEFAULTS))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
