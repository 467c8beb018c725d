"""What the jobs share: settings from a file that Spark reads, records as sequences, the session of a command line."""

from __future__ import annotations

import logging
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringspan.functions.sequences import read_as_bases

ROOT = Path(__file__).resolve().parent.parent


def settings(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """The defaults, overridden by the fields of a JSON file. A field that the defaults don't have is an error."""
    if not path:
        return dict(defaults)
    found = spark.read.option("multiLine", "true").json(path).first().asDict(recursive=True)
    if unknown := sorted(set(found) - set(defaults)):
        raise ValueError(f"unknown settings in {path}: {', '.join(unknown)}")
    return {**defaults, **{k: v for k, v in found.items() if v is not None}}


def record_schema(config: dict) -> T.StructType:
    """The columns of the record table that a job reads: only these leave the scan."""
    return T.StructType([T.StructField(config["id"], T.LongType()), T.StructField(config["sequence"], T.StringType()), T.StructField(config["group"], T.StringType())])


def sequences(rows: DataFrame, config: dict) -> DataFrame:
    """(id, source, s): each record's bases, upper case; records without any have no row. With `as_bases`, letters of texts that hold no bases are
    read as some by a fixed mapping."""
    own = rows.select(F.col(config["id"]).alias("id"), F.col(config["group"]).alias("source"), F.col(config["sequence"]).alias("s"))
    if config["as_bases"]:
        return read_as_bases(own, "s")
    return own.withColumn("s", F.upper(F.regexp_replace("s", r"\s", ""))).where(F.length("s") > 0)


def command_line(name: str) -> SparkSession:
    """The session of a command line, made here and stopped by the caller; workers find this repository."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s: %(message)s", stream=sys.stderr)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH")]))
    return SparkSession.builder.appName(name).getOrCreate()
