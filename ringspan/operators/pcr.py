"""Primers that end at a fixed boundary, chosen by length, temperature and composition, and the
deletion of a span by inverse PCR.

Only the bases that a primer may take leave the circle; all lengths are scored at once, in numpy, and the
best pair of a span is chosen where its two words are, so no join and no window is needed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringspan.functions import kernels
from ringspan.functions.sequences import END_AT, END_GC, GAS, NEIGHBOURS, SALT, STRANDS, circular_slice, longest_homopolymer, reverse_complement, self_complementarity, site_count, three_prime_dimer
from ringspan.session import settle

# The defaults of a primer design.
DEFAULTS = {"target_tm": 60.0, "tm_tolerance": 3.0, "max_tm_difference": 3.0, "min_length": 18, "max_length": 32, "min_gc": 35.0, "max_gc": 65.0, "overlap": 20}
#: Annealing is this far below the lower melting temperature, wherever it is printed.
ANNEAL_BELOW = 2.0


def penalty(seq, tm, gc, target_tm: float = 60.0, min_gc: float = 35.0, max_gc: float = 65.0) -> Column:
    """How far a primer is from ideal: temperature, composition, clamp, runs and folding."""
    tail = F.right(seq, F.lit(5))
    strong = F.length(F.regexp_replace(tail, "[^GC]", ""))
    return (
        F.abs(tm - target_tm)
        + F.when(gc < min_gc, 5 + 0.2 * (min_gc - gc)).when(gc > max_gc, 5 + 0.2 * (gc - max_gc)).otherwise(0.0)
        + F.when(F.right(seq, F.lit(1)).isin("G", "C"), 0.0).otherwise(2.0)
        + F.when(strong > 3, 2.0).otherwise(0.0)
        + F.when(longest_homopolymer(seq) >= 4, 2.0).otherwise(0.0)
        + F.greatest(self_complementarity(seq) - 5, F.lit(0)).cast("double")
        + F.when(three_prime_dimer(seq), 3.0).otherwise(0.0)
    )


def _scored(words: list[str], lengths: range, target_tm: float, min_gc: float, max_gc: float) -> dict[str, np.ndarray]:
    """The table of the beginnings of words with their `penalty`, as `penalty` has it; infinite beyond a word."""
    t = kernels.primer_table(words, lengths, NEIGHBOURS, END_AT, END_GC, SALT, STRANDS, GAS)
    gc = t["gc"]
    off = np.where(gc < min_gc, 5 + 0.2 * (min_gc - gc), np.where(gc > max_gc, 5 + 0.2 * (gc - max_gc), 0.0))
    p = np.abs(t["tm"] - target_tm) + off + np.where(t["clamp"], 0.0, 2.0) + np.where(t["strong"] > 3, 2.0, 0.0) + np.where(t["run"], 2.0, 0.0) + np.maximum(t["fold"] - 5, 0) + np.where(t["dimer"], 3.0, 0.0)
    t["penalty"] = np.where(t["fits"], p, np.inf)
    return t


def _word(role, boundary, most: int, s: str = "s") -> Column:
    """The bases that a primer may take, from its 5' end; a whole turn of the circle at most."""
    n = F.least(F.lit(most), F.length(s))
    return F.upper(F.when(role == "forward", circular_slice(s, boundary, boundary + n)).otherwise(reverse_complement(circular_slice(s, boundary - n, boundary))))


def words_at(s: str, start: str, end: str, inside: bool = False, max_length: int = DEFAULTS["max_length"], **_) -> tuple[Column, Column]:
    """The bases that the forward and the reverse primer of a span may take, pointing away from it, or into it."""
    f, r = (start, end) if inside else (end, start)
    return _word(F.lit("forward"), F.col(f), max_length, s), _word(F.lit("reverse"), F.col(r), max_length, s)


def candidates(sites: DataFrame, min_length: int = 18, max_length: int = 32, target_tm: float = 60.0, min_gc: float = 35.0, max_gc: float = 65.0) -> DataFrame:
    """(id, role, len, seq, tm, gc, penalty): primers of every length at each site. sites: (id, s,
    role, boundary): a forward primer starts at the boundary, a reverse one is the other strand of
    what ends there."""
    src = sites.select("id", "role", _word(F.col("role"), F.col("boundary"), max_length).alias("word"))
    lengths = range(min_length, max_length + 1)

    def run(batches):
        for b in batches:
            words = b.column(2).to_pylist()
            if not words:
                continue
            t = _scored(words, lengths, target_tm, min_gc, max_gc)
            row, k = np.nonzero(t["fits"])
            at = pa.array(row)
            seq = [words[i][:n] for i, n in zip(row.tolist(), (k + min_length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array((k + min_length).astype(np.int32)), pa.array(seq, pa.string()), *(pa.array(t[c][row, k]) for c in ("tm", "gc", "penalty"))], names=["id", "role", "len", "seq", "tm", "gc", "penalty"])

    return src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, role string, len int, seq string, tm double, gc double, penalty double")


def best_pairs(spans: DataFrame, inside: bool = False, min_length: int = 18, max_length: int = 32, target_tm: float = 60.0, min_gc: float = 35.0, max_gc: float = 65.0) -> DataFrame:
    """(id, f_len, r_len, f_seq, r_seq, f_tm, r_tm, score): of all pairs of primers that point away from a
    span (id, s, t_s, t_e), or into it, that with the least sum of penalties and twice the temperature
    difference; ties to the shorter forward, then reverse. A circle shorter than a primer has none."""
    f, r = words_at("s", "t_s", "t_e", inside, max_length)
    src = spans.select("id", f.alias("f"), r.alias("r")).where(F.length("f") >= min_length)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), *_best(b.column(1).to_pylist(), b.column(2).to_pylist(), min_length, max_length, target_tm, min_gc, max_gc)], names=["id", "f_len", "r_len", "f_seq", "r_seq", "f_tm", "r_tm", "score"])

    return src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, f_len int, r_len int, f_seq string, r_seq string, f_tm double, r_tm double, score double")


def _best(f: list[str], r: list[str], min_length: int, max_length: int, target_tm: float, min_gc: float, max_gc: float) -> list[pa.Array]:
    """The columns of `best_pairs`, from f_len on, for words that are long enough."""
    lengths = range(min_length, max_length + 1)
    x, y = (_scored(words, lengths, target_tm, min_gc, max_gc) for words in (f, r))
    score = x["penalty"][:, :, None] + y["penalty"][:, None, :] + 2 * np.abs(x["tm"][:, :, None] - y["tm"][:, None, :])
    best = np.round(score, 9).reshape(len(f), -1).argmin(axis=1)
    row, i, j = np.arange(len(f)), best // len(lengths), best % len(lengths)
    cut_to = lambda words, k: pa.array([w[:n] for w, n in zip(words, (k + min_length).tolist(), strict=True)], pa.string())
    return [pa.array((i + min_length).astype(np.int32)), pa.array((j + min_length).astype(np.int32)), cut_to(f, i), cut_to(r, j), pa.array(x["tm"][row, i]), pa.array(y["tm"][row, j]), pa.array(score[row, i, j])]


def pairs_of_words(f: list, r: list, min_length: int = 18, max_length: int = 32, target_tm: float = 60.0, min_gc: float = 35.0, max_gc: float = 65.0) -> tuple[pa.Array, pa.Array]:
    """The primers of `best_pairs` for the words of spans, by row; null where a word is null or too short."""
    at = [k for k, word in enumerate(f) if word is not None and len(word) >= min_length]
    if not at:
        return pa.nulls(len(f), pa.string()), pa.nulls(len(f), pa.string())
    made = _best([f[k] for k in at], [r[k] for k in at], min_length, max_length, target_tm, min_gc, max_gc)
    place = np.full(len(f), -1)
    place[at] = np.arange(len(at))
    back = pa.array(place, mask=place < 0)
    return made[2].take(back), made[3].take(back)


def outward(spans: DataFrame) -> DataFrame:
    """The two sites of primers that point away from a span (id, s, t_s, t_e)."""
    settle(spans.sparkSession)
    f = spans.select("id", "s", F.lit("forward").alias("role"), F.col("t_e").alias("boundary"))
    return f.union(spans.select("id", "s", F.lit("reverse").alias("role"), F.col("t_s").alias("boundary")))


def inward(spans: DataFrame) -> DataFrame:
    """The two sites of primers that point into a span."""
    f = spans.select("id", "s", F.lit("forward").alias("role"), F.col("t_s").alias("boundary"))
    return f.union(spans.select("id", "s", F.lit("reverse").alias("role"), F.col("t_e").alias("boundary")))


def notes(seq, template) -> Column:
    """What a bench worker should know of a primer."""
    tip = F.right(seq, F.lit(15))
    found = F.array(
        F.when(site_count(template, tip) > 1, "3' end anneals at more than one place"),
        F.when(~F.right(seq, F.lit(1)).isin("G", "C"), "no G or C at the 3' end"),
        F.when(longest_homopolymer(seq) >= 4, "run of four or more equal bases"),
        F.when(three_prime_dimer(seq), "3' end may pair with the primer itself"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def plan_deletions(spans: DataFrame, method: str = "KLD", overlap: int = 20, overlap_placement: str = "split", **kw) -> DataFrame:
    """A row per span (id, s, t_s, t_e): the primers that amplify all but the span, the product, the
    amplicon size, warnings; feasible is false, with a reason, where too little is left. kw: any of DEFAULTS."""
    if unknown := set(kw) - set(DEFAULTS):
        raise TypeError(f"no such parameter of a design: {', '.join(sorted(unknown))}")
    d = {**DEFAULTS, **kw}
    n, cut = F.length("s"), F.col("t_e") - F.col("t_s")
    judged = spans.withColumn("reason", F.when(cut <= 0, "nothing to delete").when(cut >= n - 2 * d["max_length"], "too little of the circle would be left for two primers"))
    pairs = best_pairs(judged.where("reason is null"), False, d["min_length"], d["max_length"], d["target_tm"], d["min_gc"], d["max_gc"])
    half = (overlap + 1) // 2
    if method == "gibson" and overlap_placement == "split":
        f_tail, r_tail = circular_slice("s", F.col("t_s") - half, F.col("t_s")), reverse_complement(circular_slice("s", F.col("t_e"), F.col("t_e") + (overlap - half)))
    elif method == "gibson":
        f_tail, r_tail = circular_slice("s", F.col("t_s") - overlap, F.col("t_s")), F.lit("")
    else:
        f_tail, r_tail = F.lit(""), F.lit("")
    full = judged.join(pairs, "id", "left").withColumns({"f_tail": F.upper(f_tail), "r_tail": F.upper(r_tail)})
    # a span may wrap the origin: what is left is then the slice from its end round to its start
    product = circular_slice("s", F.pmod(F.col("t_e"), n), F.pmod(F.col("t_e"), n) + n - cut)
    linear = F.concat(F.substr("s", F.lit(1), F.col("t_s")), F.substr("s", F.col("t_e") + 1))
    warn = F.array(
        F.when(n - cut + F.length("f_tail") + F.length("r_tail") > 6000, "amplicon over 6 kb"),
        F.when(F.abs(F.col("f_tm") - d["target_tm"]) > d["tm_tolerance"], "forward temperature off target"),
        F.when(F.abs(F.col("r_tm") - d["target_tm"]) > d["tm_tolerance"], "reverse temperature off target"),
        F.when(F.abs(F.col("f_tm") - F.col("r_tm")) > d["max_tm_difference"], "temperatures differ"),
    )
    out = full.withColumns({
        "feasible": F.col("reason").isNull(),
        "product": F.when(F.col("reason").isNull(), F.when(F.col("t_e") > n, product).otherwise(linear)),
        "amplicon_bp": F.when(F.col("reason").isNull(), n - cut + F.length("f_tail") + F.length("r_tail")),
        "anneal_c": F.least("f_tm", "r_tm") - ANNEAL_BELOW,
        "warnings": F.filter(warn, lambda x: x.isNotNull()),
        "f_notes": notes(F.col("f_seq"), F.col("s")),
        "r_notes": notes(F.col("r_seq"), F.col("s")),
        "verification": F.lit("length"),
    })
    return out.withColumn("extension_s", extension_seconds(F.col("amplicon_bp"))).drop("s")


def extension_seconds(bp, per_kb: int = 30) -> Column:
    """Half-even, 15 s at least. Multiplied first, so that a half is exact."""
    return F.greatest(F.lit(15), F.bround(bp * per_kb / 1000, 0).cast("int"))
