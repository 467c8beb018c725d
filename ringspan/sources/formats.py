"""Sequence file formats, written from their public descriptions: FASTA, GenBank, SnapGene (a subset).

Parsers take bytes or text and return one record, or raise ValueError; `parse_udf` wraps them for
Spark so that errors are data.
"""

from __future__ import annotations

import re
import struct
from pathlib import PurePath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The suffixes of each format, and names that stand for none.
SUFFIXES = {".dna": "snapgene", ".gb": "genbank", ".gbk": "genbank", ".genbank": "genbank", ".fa": "fasta", ".fasta": "fasta"}
_NO_NAME = {"", "unknown", "exported", "untitled", "<unknown name>", "."}

FEATURE = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("label", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("strand", T.IntegerType()),
    T.StructField("parts", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("strand", T.IntegerType())]))),
    T.StructField("qualifiers", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
])
RECORD = T.StructType([T.StructField("name", T.StringType()), T.StructField("sequence", T.StringType()), T.StructField("circular", T.BooleanType()), T.StructField("features", T.ArrayType(FEATURE)), T.StructField("error", T.StringType())])


def format_of(path: str) -> str:
    suffix = PurePath(path).suffix.lower()
    if suffix not in SUFFIXES:
        raise ValueError(f"unknown file format {suffix!r} of {path}: expected one of {', '.join(sorted(SUFFIXES))}")
    return SUFFIXES[suffix]


def clean_name(name: str, stem: str = "") -> str:
    """At most 16 characters that a GenBank locus line may hold; the file's stem for no name."""
    if name.strip().lower() in _NO_NAME:
        name = stem
    return re.sub(r"[^A-Za-z0-9_.-]", "_", name.strip())[:16]


def _record(name, sequence, circular=True, features=()):
    sequence = re.sub(r"\s", "", sequence).upper()
    if not sequence:
        raise ValueError("the record has no sequence")
    if bad := re.search(r"[^ACGTRYSWKMBDHVNU]", sequence):
        raise ValueError(f"{bad[0]!r} is no base code")
    return {"name": name, "sequence": sequence, "circular": circular, "features": list(features), "error": None}


def parse_fasta(text: str) -> dict:
    heads = [x for x in text.splitlines() if x.startswith(">")]
    if len(heads) != 1:
        raise ValueError(f"expected one record, found {len(heads)}")
    lines = text.split(">", 1)[1].splitlines()
    return _record((lines[0].split() or [""])[0], "".join(lines[1:]))


def label_of(kind: str, qualifiers: dict[str, list[str]]) -> str:
    for k in ("label", "note", "gene", "product"):
        if qualifiers.get(k):
            return qualifiers[k][0].strip()
    return kind


def feature(kind: str, parts: list[dict], qualifiers: dict[str, list[str]]) -> dict:
    strands = {p["strand"] for p in parts}
    return {"type": kind, "label": label_of(kind, qualifiers), "start": min(p["start"] for p in parts), "end": max(p["end"] for p in parts), "strand": strands.pop() if len(strands) == 1 else 0, "parts": parts, "qualifiers": qualifiers}


def _location(text: str) -> list[dict]:
    """The parts of a feature location: a..b, complement(...), join(...), order(...)."""
    text = text.strip()
    for word, turn in (("complement", -1), ("join", 1), ("order", 1)):
        if text.startswith(word + "(") and text.endswith(")"):
            inner, depth, parts, at = text[len(word) + 1 : -1], 0, [], 0
            for i, c in enumerate(inner + ","):
                depth += (c == "(") - (c == ")")
                if c == "," and depth == 0:
                    parts += _location(inner[at:i])
                    at = i + 1
            return [{**p, "strand": p["strand"] * turn} for p in (parts[::-1] if turn < 0 else parts)]
    m = re.fullmatch(r"[<>]?(\d+)(?:\.\.[<>]?(\d+))?", text)
    if not m:
        raise ValueError(f"unreadable location {text!r}")
    return [{"start": int(m[1]) - 1, "end": int(m[2] or m[1]), "strand": 1}]


def parse_genbank(text: str) -> dict:
    if text.count("\nORIGIN") != 1 or not text.lstrip().startswith("LOCUS"):
        raise ValueError(f"expected one record, found {text.count(chr(10) + 'ORIGIN')}")
    head = text.lstrip().splitlines()[0].split()
    body, origin = text.split("\nORIGIN", 1)
    sequence = re.sub(r"[\d\s/]", "", origin.split("\n", 1)[1] if "\n" in origin else "")
    feats = []
    if "\nFEATURES" in body:
        kind = where = None
        quals: dict[str, list[str]] = {}
        key = None

        def close():
            if kind:
                feats.append(feature(kind, _location(where.replace(" ", "")), quals))

        for line in body.split("\nFEATURES", 1)[1].splitlines()[1:]:
            if line[:1].strip():
                break
            name, rest = line[5:21].strip(), line[21:].rstrip()
            if name:
                close()
                kind, where, quals, key = name, rest, {}, None
            elif rest.startswith("/"):
                key, _, value = rest[1:].partition("=")
                quals.setdefault(key, []).append(value.strip('"') if not value.startswith('"') or value.endswith('"') and len(value) > 1 else value[1:])
            elif key:
                quals[key][-1] += (" " if key != "translation" else "") + rest.rstrip('"')
            else:
                where = (where or "") + rest
        close()
    return _record(head[1] if len(head) > 1 else "", sequence, "circular" in (w.lower() for w in head), feats)


def _snapgene_features(xml: str, length: int) -> list[dict]:
    """The features of a SnapGene file's list: segments are 1-based and may run across the origin."""
    out = []
    for f in ElementTree.fromstring(xml).iter("Feature"):
        strand = {"1": 1, "2": -1}.get(f.get("directionality"), 0)
        parts = []
        for segment in f.iter("Segment"):
            lo, hi = (int(x) for x in segment.get("range", "").split("-"))
            parts.append({"start": lo - 1, "end": hi if hi >= lo else hi + length, "strand": strand})
        if not parts:
            continue
        quals: dict[str, list[str]] = {}
        for q in f.iter("Q"):
            found = [re.sub("<[^>]*>", "", x) for v in q.iter("V") for x in (v.get("text"), v.get("int"), v.get("predef")) if x]
            quals.setdefault(q.get("name", ""), []).extend(found)
        if f.get("name"):
            quals.setdefault("label", [f.get("name")])
        out.append(feature(f.get("type") or "misc_feature", parts, {k: v for k, v in quals.items() if k and v}))
    return out


def parse_snapgene(data: bytes) -> dict:
    """The sequence, topology and features of a SnapGene file: typed packets of a byte and a length."""
    at, found, listed = 0, None, None
    while at + 5 <= len(data):
        kind, size = data[at], struct.unpack(">I", data[at + 1 : at + 5])[0]
        body = data[at + 5 : at + 5 + size]
        if kind == 0 and size:
            found = (body[1:].decode("ascii", "replace"), bool(body[0] & 1))
        elif kind == 10:
            listed = body.decode("utf-8", "replace")
        at += 5 + size
    if not data.startswith(b"\x09") or not found:
        raise ValueError("no SnapGene sequence packet")
    try:
        feats = _snapgene_features(listed, len(found[0])) if listed else []
    except ElementTree.ParseError as e:
        raise ValueError(f"unreadable SnapGene features: {e}") from e
    return _record("", found[0], found[1], feats)


def parse(data, kind: str) -> dict:
    if kind == "snapgene":
        return parse_snapgene(data if isinstance(data, bytes) else data.encode("latin-1"))
    text = data.decode("utf-8", "replace") if isinstance(data, bytes) else data
    return (parse_fasta if kind == "fasta" else parse_genbank)(text)


def parse_udf(kind: str):
    """A column of file contents -> RECORD; an unreadable one has nulls and an error."""

    def f(content: pd.Series) -> pd.DataFrame:
        rows = []
        for x in content:
            try:
                rows.append(parse("" if x is None else x, kind))
            except (ValueError, IndexError) as e:
                rows.append({"name": None, "sequence": None, "circular": None, "features": None, "error": str(e)})
        return pd.DataFrame(rows, columns=names)

    names = RECORD.names
    return F.pandas_udf(f, RECORD)


def _place(parts: list[dict]) -> str:
    text = [f"{p['start'] + 1}..{p['end']}" if p["strand"] >= 0 else f"complement({p['start'] + 1}..{p['end']})" for p in parts]
    return text[0] if len(text) == 1 else f"join({','.join(text)})"


def format_genbank(name: str, sequence: str, features=(), circular: bool = True) -> str:
    """A GenBank flat file of one record."""
    s = sequence.lower()
    lines = [f"LOCUS       {clean_name(name, 'record'):<16} {len(s):>11} bp    DNA     {'circular' if circular else 'linear  '} SYN", "DEFINITION  .", "ACCESSION   .", "FEATURES             Location/Qualifiers"]
    for f in features:
        lines.append(f"     {f['type']:<16}{_place(f['parts'])}")
        for k, values in dict(f["qualifiers"] or {}).items():
            lines += [f'                     /{k}="{v}"' for v in (values if values is not None else ())]
    lines.append("ORIGIN")
    for i in range(0, len(s), 60):
        lines.append(f"{i + 1:>9} " + " ".join(s[j : j + 10] for j in range(i, min(i + 60, len(s)), 10)))
    return "\n".join([*lines, "//", ""])


def format_genbank_udf(name, sequence, features=None):
    """A column of GenBank files of names, sequences and, where given, arrays of features."""

    def f(name: pd.Series, sequence: pd.Series) -> pd.Series:
        return pd.Series([format_genbank(n or "", s or "") for n, s in zip(name, sequence, strict=True)])

    def whole(name: pd.Series, sequence: pd.Series, listed: pd.Series) -> pd.Series:
        return pd.Series([format_genbank(n or "", s or "", () if fs is None else fs) for n, s, fs in zip(name, sequence, listed, strict=True)])

    return F.pandas_udf(f, T.StringType())(name, sequence) if features is None else F.pandas_udf(whole, T.StringType())(name, sequence, features)
