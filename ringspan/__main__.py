"""Command line: scan a library and report on it, search it, or plan a deletion.

    python -m ringspan --library DIR report
    python -m ringspan --library DIR search TEXT
    python -m ringspan --library DIR delete PLASMID FEATURE_OR_SPAN
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ringspan.operators import inventory
from ringspan.plans.session import Session, library_digest
from ringspan.sources import conditions, library


def load(spark: SparkSession, path: str):
    """(plasmids, features, failures) of a directory of sequence files."""
    parts = [library.directory(spark, path, f"*{s}") for s in sorted(library.SUFFIXES)]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    good, bad = library.scan(every)
    good = good.cache()
    feats = good.select("plasmid_id", F.explode("features").alias("f")).select("plasmid_id", "f.label", "f.type", F.col("f.start").alias("s"), F.col("f.end").alias("e"))
    return good, feats, bad


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="ringspan")
    p.add_argument("--library", help="directory of sequence files")
    p.add_argument("--config", help="lab configuration (JSON)")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("report")
    sub.add_parser("search").add_argument("text")
    d = sub.add_parser("delete")
    d.add_argument("plasmid")
    d.add_argument("what")
    args = p.parse_args(argv)
    path = library.find_library(args.library)
    if not path:
        print("no library found: name one with --library", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("ringspan").getOrCreate()
    good, feats, bad = load(spark, path)
    config = conditions.lab_config(args.config)
    if args.command == "report":
        seqs = good.select(F.col("label").alias("id"), F.col("sequence").alias("s"))
        members = inventory.classes(seqs)
        row = inventory.report(members, inventory.relationships(inventory.kmers(seqs))).first().asDict()
        print(library_digest(good, config), *(f"{k}: {v}" for k, v in row.items()), f"unreadable: {bad.count()}", sep="\n")
        return 0
    session = Session(spark, good, feats, config)
    print(session.search_inventory(args.text) if args.command == "search" else session.plan_deletion(args.plasmid, args.what))
    return 0


if __name__ == "__main__":
    sys.exit(main())
