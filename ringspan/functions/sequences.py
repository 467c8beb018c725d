"""Column functions over sequences: projections that stay in the JVM, and Arrow functions for the
two that need a linear-time algorithm (least rotation, longest repeat).

Coordinates are 0-based and half-open; a circle's end may exceed its length to wrap the origin.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringspan.functions import kernels
from ringspan.session import settle


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dna_like(text) -> Column:
    """A text as bases: its letters a to z, each mapped to one of ACGT in turn."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_replace(F.lower(col(text)), "[^a-z]", ""), letters, ("ACGT" * 7)[: len(letters)])


_LOWER = b"abcdefghijklmnopqrstuvwxyz"
_BASES = bytes.maketrans(_LOWER + _LOWER.upper(), ("ACGT" * 7)[:26].encode() * 2)
_OTHERS = bytes(set(range(256)) - set(_LOWER + _LOWER.upper()))


def _bases(text: bytes | None) -> bytes | None:
    if text is not None and not text.isascii():  # some signs have an ASCII letter for their lower case
        text = text.decode("utf-8", "replace").lower().encode("ascii", "ignore")
    return None if text is None else text.translate(_BASES, _OTHERS)


def read_as_bases(rows: DataFrame, text: str = "text", out: str = "s") -> DataFrame:
    """rows with a text column replaced by its bases, as `dna_like` has them, a pass over the bytes for each text; rows without bases go."""
    settle(rows.sparkSession)
    others = [c for c in rows.columns if c != text]
    kinds = dict(rows.dtypes)

    def run(batches):
        for b in batches:
            made = pa.array([_bases(t) for t in b.column(len(others)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], names=[*others, out])

    src = rows.select(*others, F.col(text).cast("binary").alias(out))
    return src.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in others) + f", `{out}` string").where(F.length(out) > 0)


def reverse_complement(s) -> Column:
    return F.reverse(F.translate(col(s), kernels.IUPAC, kernels.COMPLEMENT))


def circular_slice(s, start, end) -> Column:
    """The slice of a circle; start may be negative and end may pass the length, by one turn."""
    s, start, end = col(s), col(start), col(end)
    return F.substr(F.concat(s, s, s), F.length(s) + start + 1, end - start)


def replace_span(s, start, end, put) -> Column:
    """The one edit: an insertion where start equals end, a deletion where put is empty."""
    s = col(s)
    return F.concat(F.substr(s, F.lit(1), col(start)), put if isinstance(put, Column) else F.lit(put), F.substr(s, col(end) + 1))


def delete_span(s, start, end) -> Column:
    return replace_span(s, start, end, "")


def rotate(s, k) -> Column:
    """A circle with its origin moved to place k."""
    s, k = col(s), col(k)
    return F.concat(F.substr(s, k + 1), F.substr(s, F.lit(1), k))


def rotation_offset(a, b) -> Column:
    """Where b starts as a rotation of a; null if it is none."""
    a, b = col(a), col(b)
    return F.when(F.length(a) == F.length(b), F.nullif(F.instr(F.concat(a, a), b), F.lit(0)) - 1)


def circular_equal(a, b) -> Column:
    """Whether two circles are one, by rotation of either strand."""
    return F.coalesce(rotation_offset(a, b), rotation_offset(a, reverse_complement(b))).isNotNull()


def gc_percent(s) -> Column:
    s = col(s)
    return F.try_divide(100.0 * F.length(F.regexp_replace(s, "[^GCS]", "")), F.length(s))


def longest_homopolymer(s) -> Column:
    runs = F.regexp_extract_all(col(s), F.lit("(A+|C+|G+|T+)"), 1)
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def windows(s, k: int, circular: bool = False) -> Column:
    """The windows of length k, by place; none where the sequence is shorter."""
    s = col(s)
    n = F.length(s) if circular else F.length(s) - k + 1
    ext = F.concat(s, F.substr(s, F.lit(1), F.lit(k - 1))) if circular else s
    none = F.array().cast("array<string>")
    return F.when(F.length(s) >= k, F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(ext, i, F.lit(k)))).otherwise(none)


def canonical_short(s) -> Column:
    """The canonical rotation of short circles, in the JVM: quadratic in the length."""
    def least(x):
        turns = F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substr(x, i), F.substr(x, F.lit(1), i - 1)))
        return F.array_min(turns)

    s = col(s)
    return F.when(F.length(s) > 0, F.least(least(s), least(reverse_complement(s)))).otherwise("")


def fingerprint_of(canon) -> Column:
    """The first 16 hex digits of the SHA-256 of a canonical sequence."""
    return F.substring(F.sha2(col(canon).cast("binary"), 256), 1, 16)


def _arrow(f, kind: T.DataType):
    """A kernel as an Arrow function of one column; nulls stay null."""

    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else f(v) for v in x], dtype=object)

    return lambda c: F.pandas_udf(run, kind)(col(c))


def _digest(x: str) -> str:
    return hashlib.sha256(kernels.canonical(x.upper()).encode()).hexdigest()[:16]


#: The fingerprint of circles of any length, in linear time.
fingerprint = _arrow(_digest, T.StringType())
least_rotation = _arrow(kernels.least_rotation, T.IntegerType())
longest_repeat = _arrow(kernels.longest_repeat, T.IntegerType())
repeat_fraction = _arrow(kernels.repeat_fraction, T.DoubleType())


def occurrences(text, probe) -> Column:
    """How often a probe occurs, overlaps counted: a look-ahead matches without moving on."""
    text, probe = col(text), col(probe)
    return F.when(F.length(probe) > 0, F.regexp_count(text, F.concat(F.lit("(?=\\Q"), probe, F.lit("\\E)")))).otherwise(0)


def site_count(template, probe) -> Column:
    """Places of a probe on a circle, on both strands, overlaps counted."""
    template, probe = col(template), col(probe)
    ext = F.concat(template, F.substr(template, F.lit(1), F.length(probe) - 1))
    rc = reverse_complement(probe)
    return occurrences(ext, probe) + F.when(rc != probe, occurrences(ext, rc)).otherwise(0)


def self_complementarity(s, least: int = 5, most: int = 12) -> Column:
    """The longest window (5 to 12) that the other strand of the same sequence has too; 0 if none."""
    s = col(s)
    rc = reverse_complement(s)

    def found(k):
        return F.exists(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: F.contains(rc, F.substr(s, i, k)))

    lengths = F.filter(F.sequence(F.lit(least), F.lit(most)), lambda k: (k <= F.length(s)) & found(k))
    return F.coalesce(F.array_max(lengths), F.lit(0))


def three_prime_dimer(s) -> Column:
    """Whether the last five bases can pair with what stands before them."""
    s = col(s)
    return F.contains(F.substr(s, F.lit(1), F.length(s) - 5), reverse_complement(F.right(s, F.lit(5))))


def seed_code(word) -> Column:
    """The integer of a word of at most 15 letters, as kernels.letter_codes() has it."""
    known = F.regexp_replace(col(word), f"[^{kernels.LETTER_ORDER}]", "0")
    return F.conv(F.translate(known, kernels.LETTER_ORDER, "123456789ABCDEF"), 16, 10).cast("long")


def feature_label(qualifiers, kind) -> Column:
    """The first of label, note, gene and product, else the type."""
    q = col(qualifiers)
    return F.trim(F.coalesce(*[F.get(F.try_element_at(q, F.lit(k)), F.lit(0)) for k in ("label", "note", "gene", "product")], col(kind)))


# Published nearest-neighbour enthalpies (kcal/mol) and entropies (cal/mol K).
NEIGHBOURS = {
    "AA": (-7.9, -22.2), "TT": (-7.9, -22.2), "AT": (-7.2, -20.4), "TA": (-7.2, -21.3),
    "CA": (-8.5, -22.7), "TG": (-8.5, -22.7), "GT": (-8.4, -22.4), "AC": (-8.4, -22.4),
    "CT": (-7.8, -21.0), "AG": (-7.8, -21.0), "GA": (-8.2, -22.2), "TC": (-8.2, -22.2),
    "CG": (-10.6, -27.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.9), "CC": (-8.0, -19.9),
}
END_AT, END_GC = (2.3, 4.1), (0.1, -2.8)
SALT, STRANDS, GAS = 0.05, 12.5e-9, 1.987


def melting_temperature(s) -> Column:
    """The nearest-neighbour melting temperature in Celsius, at 50 mM salt and 25 nM of each strand."""
    import math

    s = col(s)
    pairs = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substr(s, i, F.lit(2)))

    def total(which: int) -> Column:
        table = F.create_map(*[x for k, v in NEIGHBOURS.items() for x in (F.lit(k), F.lit(v[which]))])
        ends = sum((F.when(e.isin("A", "T"), END_AT[which]).otherwise(END_GC[which]) for e in (F.left(s, F.lit(1)), F.right(s, F.lit(1)))), F.lit(0.0))
        return F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.coalesce(F.try_element_at(table, p), F.lit(0.0))) + ends

    entropy = total(1) + 0.368 * (F.length(s) - 1) * math.log(SALT)
    return F.when(F.length(s) >= 2, 1000 * total(0) / (entropy + GAS * math.log(STRANDS)) - 273.15)
