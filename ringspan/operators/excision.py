"""Deleting a span by restriction digest: candidate pairs, rejection reasons, ranking, simulation.

Everything runs for many (circle, target) rows at once. A refusal is a row with its reasons. Cuts, pairs, ranks and
reasons of a circle depend on that circle alone, so `judge` finds them where the circle is, in one pass without a shuffle
but that which brings circle and target together; only the best plans and the counts leave it.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringspan.functions.sequences import circular_equal, circular_slice, delete_span
from ringspan.operators import fragments
from ringspan.operators.enzymes import BLUNT, SAME, STICKY, Finder, catalogue, still_cut
from ringspan.session import cut, settle

_PLAN = "array<struct<rank:int,up:string,down:string,u_top:int,d_top:int,strategy:string,collateral:int,sites:array<struct<top:int,bottom:int>>>>"
_RANK = {SAME: 0, STICKY: 1, BLUNT: 2}


def _pairs(find: Finder, text: str, t_s: int, t_e: int, arms: list[dict], single: bool) -> tuple[list[dict], Counter]:
    """The pairs of cuts with matching ends that flank a target, best first, and the histogram of refusals."""
    enzyme, top, many = find.cuts(text)
    info, why, pairs = find.info, Counter(), []
    once = [(info[e], int(t)) for e, t in zip(enzyme[many == 1].tolist(), top[many == 1].tolist(), strict=True)]
    up, down = [c for c in once if c[1] <= t_s], [c for c in once if c[1] >= t_e]
    by_end: dict[str, list] = {}
    for e, t in down:
        by_end.setdefault(e["end"], []).append((e, t))
    matched = [(u, u_top, d, d_top) for u, u_top in up if u["end"] for d, d_top in by_end.get(u["end"], ())]
    two = enzyme[many == 2].reshape(-1, 2)[:, 0].tolist()
    for e, (lo, hi) in zip(two, top[many == 2].reshape(-1, 2).tolist(), strict=True) if single else ():
        if info[e]["end"]:
            if lo <= t_s and hi >= t_e:
                matched.append((info[e], lo, info[e], hi))
            else:
                why["enzyme cuts twice but not flanking the target"] += 1
    for u, u_top, d, d_top in matched:
        hurt = next((a["label"] for a in arms if u_top < a["p_e"] and a["p_s"] < d_top), None)
        if hurt is not None:
            why[f"would damage {hurt}"] += 1
            continue
        strategy = SAME if u is d else BLUNT if u["kind"] == "blunt" else STICKY
        pairs.append({"up": u["name"], "down": d["name"], "u_top": u_top, "d_top": d_top, "strategy": strategy, "collateral": d_top - u_top - (t_e - t_s), "order": (_RANK[strategy], d_top - u_top, u["canonical"], d["canonical"], u["name"], d["name"]), "sites": [{"top": t, "bottom": t - e["ovhg"]} for e, t in ((u, u_top), (d, d_top))]})
    best, seen = [], set()
    for p in sorted(pairs, key=lambda p: p["order"]):  # enzymes that cut alike are one plan
        same = (*sorted(p["order"][2:4]), p["u_top"], p["d_top"])
        if same in seen:
            why["duplicate of an equischizomer"] += 1
        else:
            seen.add(same)
            best.append({**p, "rank": len(best) + 1})
    why["incompatible ends"] = len(up) * len(down) - sum(u is not d for u, _, d, _ in matched)
    why["enzyme cuts more than twice"] = len(set(enzyme[many > 2].tolist()))
    why["no unique site upstream of the target"] = int(not up)
    why["no unique site downstream of the target"] = int(not down)
    return best, +why


def judge(seqs: DataFrame, targets: DataFrame, protected: DataFrame | None = None, pool="CommOnly", allow_single_enzyme: bool = True, most: int | None = None) -> DataFrame:
    """(id, t_s, t_e, plans, reasons): for each target (id, t_s, t_e) the pairs of cuts with matching ends that flank it and
    damage nothing protected (id, label, p_s, p_e), ranked by strategy, collateral and canonical names, the first `most` or
    all; and how often what else was refused, and why. Pairs whose ends do not match are never made but counted. A
    target without a circle has neither cuts nor plans."""
    rows = targets.select("id", "t_s", "t_e").join(seqs.select("id", "s"), "id", "left")
    if protected is not None:
        rows = rows.join(protected.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.col("p_s").cast("int").alias("p_s"), F.col("p_e").cast("int").alias("p_e"), "label"))).cast(_ARMS).alias("arms")), "id", "left")
    return judge_rows(rows, pool, allow_single_enzyme, most)


_ARMS = "array<struct<p_s:int,p_e:int,label:string>>"


def judge_rows(rows: DataFrame, pool="CommOnly", allow_single_enzyme: bool = True, most: int | None = None) -> DataFrame:
    """The same for targets that hold their circle, and what is protected as `arms` by place, if anything (id, t_s, t_e, s, arms): a pass
    without a shuffle."""
    settle(rows.sparkSession)
    pool = pool if isinstance(pool, str) else sorted(pool)
    catalogue(pool)
    rows = rows.select("id", "t_s", "t_e", "s", (F.col("arms") if "arms" in rows.columns else F.array()).cast(_ARMS).alias("arms"))
    sent = pa.list_(pa.struct([("rank", pa.int32()), ("up", pa.string()), ("down", pa.string()), ("u_top", pa.int32()), ("d_top", pa.int32()), ("strategy", pa.string()), ("collateral", pa.int32()), ("sites", pa.list_(pa.struct([("top", pa.int32()), ("bottom", pa.int32())])))]))

    def run(batches):
        find = Finder(pool)
        for b in batches:
            plans, reasons = [], []
            for t_s, t_e, s, arms in zip(*(b.column(c).to_pylist() for c in range(1, 5)), strict=True):
                best, why = _pairs(find, s or "", t_s, t_e, arms or [], allow_single_enzyme)
                plans.append([{k: v for k, v in p.items() if k != "order"} for p in best[:most]])
                reasons.append(list(why.items()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(plans, sent), pa.array(reasons, pa.map_(pa.string(), pa.int64()))], names=["id", "t_s", "t_e", "plans", "reasons"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"id {kinds['id']}, t_s {kinds['t_s']}, t_e {kinds['t_e']}, plans {_PLAN}, reasons map<string,bigint>")


def ranked(judged: DataFrame) -> DataFrame:
    """(id, t_s, t_e, rank, up, down, u_top, d_top, strategy, collateral, sites): a row for each plan."""
    return judged.select("id", "t_s", "t_e", F.explode("plans").alias("p")).select("id", "t_s", "t_e", "p.*")


def reasons(judged: DataFrame) -> DataFrame:
    """(id, reason, n): the histogram of refusals of each target."""
    return judged.select("id", F.explode("reasons").alias("reason", "n"))


def simulate(plans: DataFrame, seqs: DataFrame, signatures: DataFrame | None = None, protected: DataFrame | None = None) -> DataFrame:
    """plans (id, up, down, u_top, d_top, sites) with the product of the digest, cross-checked: `product` is the edit
    in the parent's frame; `retained` the fragment that the sites (all cuts of the plan's enzymes) leave and that closes on its own
    ends (see fragments), null with a `refusal` where there is no such one; `verified` that both are one circle, that the
    cut junctions are gone and that every protected stretch (id, p_s, p_e) is in the product."""
    p = plans.join(seqs.select("id", "s"), "id")
    p = p.withColumn("signature", F.lit(None).cast("string")) if signatures is None else p.join(signatures, "id", "left")
    p = p.withColumn("_kept", fragments.kept_fragment(F.col("s"), F.col("sites"), F.col("signature"))).withColumns({"retained": F.col("_kept")["retained"], "refusal": F.col("_kept")["refusal"]}).drop("_kept", "signature", "sites")
    p = p.withColumn("product", delete_span("s", F.col("u_top"), F.col("d_top")))
    around = lambda top: circular_slice("s", F.col(top) - 20, F.col(top) + 20)
    twice = F.concat("product", "product")
    gone = ~F.contains(twice, around("u_top")) & ~F.contains(twice, around("d_top"))
    whole = F.lit(True)
    if protected is not None:
        spans = protected.groupBy("id").agg(F.collect_set(F.struct("p_s", "p_e")).alias("must_stay"))
        p = p.join(spans, "id", "left")
        whole = F.forall(F.coalesce("must_stay", F.array()), lambda x: F.contains(twice, circular_slice("s", x["p_s"], x["p_e"])))
    same = F.coalesce(circular_equal("product", "retained"), F.lit(False))
    return p.withColumns({"verified": same & (gone | (F.length("product") < 40)) & whole, "junction": F.upper(F.concat(circular_slice("s", F.col("u_top") - 6, F.col("u_top")), circular_slice("s", F.col("d_top"), F.col("d_top") + 6)))}).drop("s", "must_stay")


def signature(protected: DataFrame, seqs: DataFrame, width: int = 60) -> DataFrame:
    """(id, signature): the middle of the longest protected feature of each circle."""
    big = protected.groupBy("id").agg(F.max_by(F.struct("p_s", "p_e"), F.struct((F.col("p_e") - F.col("p_s")).alias("w"), -F.col("p_s"))).alias("f")).select("id", "f.*")
    mid = F.floor((F.col("p_s") + F.col("p_e")) / 2).cast("int")
    half = F.least(F.lit(width // 2), F.floor((F.col("p_e") - F.col("p_s")) / 2).cast("int"))
    return big.join(seqs.select("id", "s"), "id").select("id", circular_slice("s", mid - half, mid + half).alias("signature"))


def regenerated(plans: DataFrame, pool="CommOnly") -> DataFrame:
    """plans with `site_regenerated`: whether an enzyme of the plan still cuts the product."""
    return still_cut(plans, "product", ["up", "down"], pool)


def plan(seqs: DataFrame, targets: DataFrame, protected: DataFrame | None = None, pool="CommOnly", max_alternatives: int = 10, tries: int = 15) -> tuple[DataFrame, DataFrame]:
    """(plans, reasons): the verified plans of each target, best first, max_alternatives + 1 at most,
    out of the max_alternatives + tries best candidates; and the refusals."""
    judged = cut(judge(seqs, targets, protected, pool, most=max_alternatives + tries), "excision_plans")
    done = _verified(ranked(judged), seqs, protected)
    nth = F.row_number().over(Window.partitionBy("id").orderBy("rank"))
    plans = done.withColumn("alt_rank", nth - 1).where(F.col("alt_rank") <= max_alternatives)
    return regenerated(plans, pool), reasons(judged)


def _verified(plans: DataFrame, seqs: DataFrame, protected: DataFrame | None) -> DataFrame:
    return simulate(plans, seqs, signature(protected, seqs) if protected is not None else None, protected).where("verified").drop("refusal")


def first_plan(seqs: DataFrame, targets: DataFrame, protected: DataFrame | None = None, pool="CommOnly", max_alternatives: int = 10, tries: int = 15) -> tuple[DataFrame, DataFrame]:
    """What `plan` gives with the first verified plan of each target only: the best candidate is simulated, and the others where
    that one does not hold."""
    judged = cut(judge(seqs, targets, protected, pool, most=max_alternatives + tries), "excision_plans")
    best = cut(_verified(ranked(judged.withColumn("plans", F.slice("plans", 1, 1))), seqs, protected), "first_plans")
    left = judged.where(F.size("plans") > 1).join(best.select("id"), "id", "left_anti").withColumn("plans", F.slice("plans", 2, max_alternatives + tries))
    both = best.unionByName(_verified(ranked(cut(left, "left_plans")), seqs, protected))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("rank"))
    return regenerated(both.withColumn("alt_rank", nth - 1).where("alt_rank = 0"), pool), reasons(judged)


def best_or_refusal(plans: DataFrame, why: DataFrame, targets: DataFrame, top: int = 5) -> DataFrame:
    """A row per target: the best plan, or feasible = false and its most frequent reasons."""
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "reason"))
    said = why.withColumn("r", nth).where(F.col("r") <= top).groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("reasons"))
    first = plans.where("alt_rank = 0").drop("t_s", "t_e")
    return targets.join(first, "id", "left").join(said, "id", "left").withColumn("feasible", F.col("up").isNotNull())
