"""Digest sheets of a library: which enzymes open each record at one place, and how the supplier has them used.

    python jobs/digest_sheets.py --records RECORDS --out OUT [--config jobs/digest_sheets.json]

Reads records (Parquet), finds the cuts of a pool of enzymes on each circle, keeps those of enzymes that cut it once,
and joins the supplier's conditions: by the enzyme's own name, else those of an enzyme with the same site and cut.
OUT/sheets has a row for each record and single cutter, partitioned by source. Only the partitions of sources that were
read are overwritten, so a run over some sources leaves the others alone and a second run gives the same files' rows. OUT/enzymes
counts the records that each enzyme opens, by source, so that a lab knows what to keep in stock.

Scale: cuts are found in the scan, without a shuffle, and only single cuts leave it; conditions are a
small table. Rows are balanced by source before the write: a large source is several files.

Cases: records without bases or without a single cutter have no rows; enzymes that no supplier lists have null
conditions; repeated rows of records give repeated rows; a null source is a partition of its own.
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
from ringspan.operators import enzymes  # noqa: E402
from ringspan.session import settled  # noqa: E402
from ringspan.sources.conditions import conditions  # noqa: E402

log = logging.getLogger("digest_sheets")

DEFAULTS = {"id": "doc_id", "sequence": "text", "group": "source", "as_bases": True, "pool": "CommOnly", "sources": []}
SHEETS = "id long, enzyme string, top int, sold_as string, temp_c string, minutes string, inactivation string, source string"


def sheets(spark: SparkSession, rows: DataFrame, config: dict) -> DataFrame:
    """(id, enzyme, top, sold_as, temp_c, minutes, inactivation, source)."""
    pool = config["pool"] if isinstance(config["pool"], str) else list(config["pool"])
    own = sequences(rows, config).select(F.struct("id", "source").alias("own"), "s")
    once = enzymes.cut_sites(own, pool, "own", once=True)
    dimension = enzymes.enzymes(spark, pool)
    use = enzymes.conditions_lookup(dimension.select(F.col("name").alias("enzyme")), conditions(spark), dimension)
    named = once.join(use, "enzyme")
    return named.select("id.id", "enzyme", "top", "sold_as", *[F.col(c).cast("string").alias(c) for c in ("temp_c", "minutes", "inactivation")], "id.source")


def run(spark: SparkSession, records: str, out: str, config: dict | None = None) -> DataFrame:
    """Write the sheets of the records; all sheets as they stand then."""
    config = {**DEFAULTS, **(config or {})}
    with settled(spark):
        rows = spark.read.schema(record_schema(config)).parquet(records)
        if config["sources"]:
            rows = rows.where(F.col(config["group"]).isin(list(config["sources"])))
        made = sheets(spark, rows, config).hint("rebalance", "source")
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(f"{out}/sheets")
        every = spark.read.schema(SHEETS).parquet(f"{out}/sheets")
        stock = every.groupBy("source", "enzyme", "sold_as").agg(F.count(F.lit(1)).alias("n_records"))
        stock.write.mode("overwrite").parquet(f"{out}/enzymes")
        read, wrote = rows.count(), every.count()
        log.info("read %d records of %s%s", read, records, f" from {', '.join(config['sources'])}" if config["sources"] else "")
        log.info("%s/sheets holds %d rows, %s/enzymes %d", out, wrote, out, spark.read.schema(stock.schema).parquet(f"{out}/enzymes").count())
    return every


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__.split("\n", 1)[0])
    for name in ("records", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config")
    a = p.parse_args(argv)
    spark = command_line("digest_sheets")
    try:
        run(spark, a.records, a.out, settings(spark, a.config, DEFAULTS))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
