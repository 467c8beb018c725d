"""Schemas of the engine's tables and of extracted requests, with their validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLASMIDS = "plasmid_id string, label string, name string, length int, circular boolean, sequence string, fingerprint string, source string"
FEATURES = "plasmid_id string, feature_id int, type string, label string, start int, end int, strand int, parts array<struct<start:int,end:int,strand:int>>, qualifiers map<string,array<string>>"
RELATIONSHIPS = "a string, b string, shared bigint, jaccard double, containment double, kind string"
FAILURES = "plasmid_id string, error string"

#: A request in words, extracted: what to build on, from what parts, and what stayed unclear.
SPEC = "backbone string, parts array<string>, marker string, must_not_contain array<string>, purpose string, ambiguities array<string>"
PART_MATCH = "part string, label string, feature string, confidence double, reason string"
RESOLUTION = f"matches array<struct<{', '.join(':'.join(c.split()) for c in PART_MATCH.split(', '))}>>, missing array<string>"


def parse_spec(text) -> Column:
    """A JSON request as SPEC; null where the text is none."""
    return F.from_json(text, SPEC)


def parse_resolution(text) -> Column:
    """A JSON resolution; matches whose confidence is not between 0 and 1 are left out."""
    r = F.from_json(text, RESOLUTION)
    return F.when(r.isNotNull(), F.struct(F.filter(r["matches"], lambda m: m["confidence"].between(0, 1)).alias("matches"), r["missing"].alias("missing")))


def is_sequence(s) -> Column:
    """Whether a text is made of base codes."""
    return F.coalesce(F.upper(s).rlike("^[ACGTRYSWKMBDHVN]+$"), F.lit(False))
