"""Supplier conditions of enzymes and the lab's configuration."""

from __future__ import annotations

import csv
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ringspan.session import local_table

#: When the supplier's table was read. It goes stale.
RETRIEVED = "2026-08-15"
DEFAULTS = {"base_vectors": [], "enzyme_stock": None, "unavailable": [], "bench": {}}


def rows() -> list[dict]:
    with open(Path(__file__).with_name("supplier_conditions.csv"), encoding="utf-8") as f:
        return list(csv.DictReader(x for x in f if not x.startswith("#")))


def conditions(spark: SparkSession) -> DataFrame:
    """(name, temp_c, minutes, bp_from_end, inactivation, star_h), all text as the supplier has it."""
    r = rows()
    return local_table(spark, r, ", ".join(f"{k} string" for k in r[0]))


def lab_config(explicit: str | None = None, variable: str = "RINGSPAN_LAB_CONFIG") -> dict:
    """The first configuration that is there, over the defaults."""
    for p in (explicit, os.environ.get(variable), "config/lab.json", "../config/lab.json"):
        if p and os.path.isfile(p):
            with open(p, encoding="utf-8") as f:
                return {**DEFAULTS, **json.load(f)}
    if explicit:
        raise FileNotFoundError(explicit)
    return dict(DEFAULTS)


def is_available(label: str, config: dict) -> bool:
    return label not in (config.get("unavailable") or [])


def is_base_vector(label: str, config: dict) -> bool:
    return label in (config.get("base_vectors") or [])


def in_stock(enzyme: str, config: dict) -> bool:
    stock = config.get("enzyme_stock")
    return stock is None or enzyme in stock
