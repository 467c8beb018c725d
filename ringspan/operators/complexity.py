"""The synthesis screen: limits on length, composition, runs and repeats.

It is a placeholder for a vendor's own tool and says so in every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringspan.functions.sequences import gc_percent, longest_homopolymer, longest_repeat, repeat_fraction

# The limits, and what each breach adds to the score.
LIMITS = {"min_length": 125, "max_length": 3000, "min_gc": 25.0, "max_gc": 75.0, "max_homopolymer": 9, "max_repeat": 40, "max_repeat_fraction": 0.35}
PENALTIES = {"too short": 0.5, "too long": 0.5, "GC out of range": 0.3, "homopolymer": 0.3, "repeat": 0.5, "repeat fraction": 0.4}


def reasons(limits: dict | None = None) -> Column:
    """The breached limits of a row with length, gc, homopolymer, longest_repeat, repeat_fraction."""
    m = {**LIMITS, **(limits or {})}
    c = F.col
    tests = [
        ("too short", c("length") < m["min_length"]),
        ("too long", c("length") > m["max_length"]),
        ("GC out of range", (c("gc") < m["min_gc"]) | (c("gc") > m["max_gc"])),
        ("homopolymer", c("homopolymer") > m["max_homopolymer"]),
        ("repeat", c("longest_repeat") > m["max_repeat"]),
        ("repeat fraction", c("repeat_fraction") > m["max_repeat_fraction"]),
    ]
    return F.filter(F.array(*[F.when(t, name) for name, t in tests]), lambda x: x.isNotNull())


def score(reason_list: Column) -> Column:
    table = F.create_map(*[x for k, v in PENALTIES.items() for x in (F.lit(k), F.lit(v))])
    return F.least(F.lit(1.0), F.aggregate(reason_list, F.lit(0.0), lambda a, r: a + F.try_element_at(table, r)))


def screen(seqs: DataFrame, limits: dict | None = None, id_col: str = "id", seq_col: str = "s") -> DataFrame:
    """(id, length, gc, homopolymer, longest_repeat, repeat_fraction, reasons, score, synthesizable,
    is_placeholder) of each sequence."""
    base = seqs.select(id_col, F.length(seq_col).alias("length"), F.bround(gc_percent(seq_col), 1).alias("gc"), longest_homopolymer(seq_col).alias("homopolymer"), longest_repeat(seq_col).alias("longest_repeat"), F.bround(repeat_fraction(seq_col), 3).alias("repeat_fraction"))
    judged = base.withColumn("reasons", reasons(limits))
    return judged.withColumns({"score": score(F.col("reasons")), "synthesizable": F.size("reasons") == 0, "is_placeholder": F.lit(True)})
