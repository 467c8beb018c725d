"""Settings that the operators rely on, the shared folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Rows of an Arrow batch at most.
BATCH_ROWS = 2000


def settle(spark: SparkSession) -> None:
    """Turn off partitioning-aware unions: when adaptive execution replaces a branch of such a union
    (by an empty relation, say), Spark 4.1 may join it with the wrong number of partitions and fail.
    Lower the rows of an Arrow batch, which hold whole texts here."""
    if spark.version >= "4.1" and spark.conf.get("spark.sql.unionOutputPartitioning") != "false":
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@contextmanager
def settled(spark: SparkSession):
    """Inside, the settings of `settle`; for steps that run before it ends."""
    keys = ("spark.sql.unionOutputPartitioning", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = {k: spark.conf.get(k, None) for k in keys}
    settle(spark)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """Inside, a setting of the session has another value; for steps that run before it ends."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def few_tasks(spark: SparkSession):
    """Inside, adaptive execution joins small shuffles into tasks of the advised size instead of one for every
    core: for steps on small tables that cost more to start than to run."""
    return setting(spark, "spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else, on a local master only, one
    of our own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_ringspan_shared", None)
    if not found:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = sc._ringspan_shared = "file://" + tempfile.mkdtemp(prefix="ringspan-")
        sc.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/ringspan/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def local_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table that is part of the plan: the planner knows its size, unlike that of an RDD."""
    kinds = T._parse_datatype_string(schema)
    return spark.createDataFrame(pa.Table.from_pylist([{n: r[n] for n in kinds.names} for r in rows], schema=to_arrow_schema(kinds)), kinds)


def cut(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Write df to the shared folder, with options of the writer, and read it back.

    This cuts the lineage in a way that survives lost executors, lets several consumers share
    one computation, and gives the planner the true size, so that Spark's own threshold decides
    whether a join against it is broadcast.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
