"""Incremental ingest: new sequences from a folder, each identified once.

The batch operators run unchanged on streams; this one computes identities, which need no state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ringspan.functions.sequences import dna_like, fingerprint
from ringspan.session import shared_dir


def identities(stream: DataFrame) -> DataFrame:
    """(id, length, fingerprint) of documents read as circles; streaming or not."""
    s = stream.select(F.col("doc_id").alias("id"), dna_like("text").alias("s")).where(F.length("s") > 0)
    return s.select("id", F.length("s").alias("length"), fingerprint(F.col("s")).alias("fingerprint"))


def ingest(stream: DataFrame, path: str, checkpoint: str):
    """Append the identities of a stream's new rows to a Parquet table, exactly once per batch."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return identities(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_available(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """All that a file or directory of a folder holds now, through the streaming route; the table
    that comes of it."""
    out = f"{shared_dir(spark).rstrip('/')}/ingest-{uuid.uuid4().hex[:12]}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    reader = spark.readStream.schema(schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        stream = reader.parquet(f"{folder}/{name}")
    else:
        stream = reader.option("pathGlobFilter", name).parquet(folder)
    q = ingest(stream, f"{out}/table", f"{out}/state")
    q.awaitTermination()
    return spark.read.parquet(f"{out}/table").select("id", "length", "fingerprint")
