"""Library scans: files, directories, records and callables as tables of sequences.

One unreadable record is a row of failures and stops nothing.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ringspan.sources.formats import SUFFIXES, format_genbank_udf, format_of, parse, parse_udf
from ringspan.session import cut, settle

_STEM = r"([^/]+?)(?:\.[^./]*)?$"


def scan(contents: DataFrame, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(plasmids, failures) of (plasmid_id, content). kind: a format, else that of each id's suffix."""
    if kind:
        r = contents.withColumn("r", parse_udf(kind)("content"))
    else:
        suffix = F.lower(F.regexp_extract("plasmid_id", r"(\.[^./]*)$", 1))
        parts = [contents.where(suffix.isin([s for s, k in SUFFIXES.items() if k == k0])).withColumn("r", parse_udf(k0)("content")) for k0 in sorted(set(SUFFIXES.values()))]
        r = reduce(DataFrame.unionByName, parts)
        known = F.coalesce(suffix.isin(list(SUFFIXES)), F.lit(False))
        rest = contents.where(~known).select("plasmid_id", F.concat(F.lit("no format is known for the name "), F.coalesce(F.col("plasmid_id").cast("string"), F.lit("(none)"))).alias("error"))
    r = r.select("plasmid_id", "r.*")
    good = r.where("error is null").select("plasmid_id", F.regexp_extract(F.col("plasmid_id").cast("string"), _STEM, 1).alias("label"), "name", F.length("sequence").alias("length"), "circular", "sequence", "features")
    bad = r.where("error is not null").select("plasmid_id", "error")
    return good, bad if kind else bad.union(rest)


def directory(spark: SparkSession, path: str, pattern: str = "*.dna", recursive: bool = False) -> DataFrame:
    """(plasmid_id, content) of the files of a directory that match a pattern."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select(F.col("path").alias("plasmid_id"), "content")


def files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(plasmid_id, content, nth) of listed files, in the order of the list."""
    for p in paths:
        format_of(p)
    order = spark.createDataFrame([(PurePath(p).name, i) for i, p in enumerate(paths)], "file string, nth int")
    got = spark.read.format("binaryFile").load(list(paths)).select(F.col("path").alias("plasmid_id"), "content", F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))
    return got.join(order, "file").drop("file")


def records(spark: SparkSession, found: dict[str, str]) -> DataFrame:
    """(plasmid_id, sequence) of sequences at hand."""
    return spark.createDataFrame([(k, v.upper()) for k, v in found.items()], "plasmid_id string, sequence string")


class _Ids(DataSourceReader):
    def __init__(self, ids: list[str], load: Callable[[str], bytes]):
        self.ids, self.load = ids, load

    def partitions(self):
        return [InputPartition(i) for i in self.ids]

    def read(self, partition):
        try:
            yield partition.value, bytes(self.load(partition.value)), None
        except Exception as e:  # noqa: BLE001 - a store's errors are data
            yield partition.value, None, str(e)


def callable_source(spark: SparkSession, name: str, ids: list[str], load: Callable[[str], bytes]) -> DataFrame:
    """(plasmid_id, content, error) of a remote store, a partition and one load for each id. What was loaded is
    kept in the shared folder: however often the table is used, the store is asked once (again only for
    a task that is lost)."""

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "plasmid_id string, content binary, error string"

        def reader(self, schema):
            return _Ids(ids, load)

    spark.dataSource.register(Source)
    return cut(spark.read.format(name).load(), name)


def first_owner(sources: list[DataFrame], key: str = "plasmid_id") -> DataFrame:
    """The union of sources; of rows with one key, those of the first source stay. `source` is the
    place of the source in the list."""
    settle(sources[0].sparkSession)
    every = reduce(lambda a, b: a.unionByName(b), [s.withColumn("source", F.lit(i)) for i, s in enumerate(sources)])
    nth = F.row_number().over(Window.partitionBy(key).orderBy("source"))
    return every.withColumn("_n", nth).where("_n = 1").drop("_n")


def as_source(spark: SparkSession, spec, pattern: str = "*.dna") -> DataFrame:
    """Whatever names a library, as a table: a table, records, files, a directory, a list of these."""
    if isinstance(spec, DataFrame):
        return spec
    if isinstance(spec, dict):
        return records(spark, spec)
    if isinstance(spec, (list, tuple)):
        if spec and all(isinstance(p, (str, os.PathLike)) and PurePath(p).suffix.lower() in SUFFIXES for p in spec):
            return files(spark, [str(p) for p in spec]).drop("nth")
        return first_owner([as_source(spark, p, pattern) for p in spec]).drop("source")
    path = os.fspath(spec)
    if os.path.isdir(path):
        return directory(spark, path, pattern)
    if os.path.isfile(path):
        return files(spark, [path]).drop("nth")
    raise FileNotFoundError(path)


def find_library(explicit: str | None = None, variable: str = "RINGSPAN_LIBRARY", default: str = "./plasmid") -> str | None:
    """The first library directory that has something in it: the one named, the variable's, the default."""
    for p in (explicit, os.environ.get(variable), default):
        if p and os.path.isdir(p) and os.listdir(p):
            return p
    return None


def load_record(path: str) -> dict:
    """One file as a record, on the driver."""
    kind = format_of(path)
    with open(path, "rb") as f:
        return parse(f.read(), kind)


def write_genbank(plasmids: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write (name, sequence[, features]) rows as GenBank records, many to a file, to any store Spark reaches. Features keep
    their type, all parts of their location and their qualifiers."""
    features = ["features"] if "features" in plasmids.columns else []
    plasmids.select(format_genbank_udf("name", "sequence", *features).alias("value")).write.mode(mode).option("lineSep", "\n").text(path)


def read_genbank(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, failures) of files of many GenBank records: (name, sequence, circular, features) and (content, error). Spark cuts
    the files at the lines that end records, so a large file is many tasks."""
    text = spark.read.option("lineSep", "\n//\n").text(path).select(F.regexp_replace("value", r"^\s+", "").alias("content")).where("content <> ''")
    r = text.withColumn("r", parse_udf("genbank")(F.concat("content", F.lit("\n//\n"))))
    return r.where("r.error is null").select("r.name", "r.sequence", "r.circular", "r.features"), r.where("r.error is not null").select("content", "r.error")


def library_lines(library: DataFrame, config: dict) -> DataFrame:
    """(label, line): each circle as a line of text, base vectors and unavailable ones marked. Two names of
    one circle are both listed."""
    marked = lambda key, text: F.when(F.col("label").isin(list(config.get(key) or [])), F.lit(f"  [{text}]")).otherwise("")
    line = F.concat(F.col("label"), F.lit("  "), F.col("length").cast("string"), F.lit(" bp"), marked("base_vectors", "base vector"), marked("unavailable", "unavailable"))
    return library.select("label", line.alias("line"))
