"""Deletions of many targets at once: by digest where one will do, else by inverse PCR."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringspan.operators import excision, pcr
from ringspan.session import cut

METHODS = ("auto", "restriction", "pcr")


def plan_deletions(seqs: DataFrame, targets: DataFrame, protected: DataFrame | None = None, pool="CommOnly", method: str = "auto", **primers) -> DataFrame:
    """(id, route, up, down, f_seq, r_seq, product, warnings, reasons): a row for each target (id, t_s, t_e). route is restriction, pcr, or null where
    neither works, with the reasons of the refusals. auto takes a digest where there is one; pcr says in its warnings where a digest would
    do as well, and at what cost. primers: parameters of pcr.plan_deletions."""
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}, not {method!r}")
    plans, why = excision.first_plan(seqs, targets, protected, pool, 0)
    best = excision.best_or_refusal(plans, why, targets).select("id", "up", "down", "collateral", F.col("product").alias("d_product"), F.col("reasons").alias("d_reasons"), F.col("feasible").alias("digest"))
    best = cut(best, "digests")
    open_ = targets if method == "pcr" else targets.join(best.where("not digest").select("id"), "id", "left_semi")
    made = pcr.plan_deletions(open_.where("true" if method != "restriction" else "false").join(seqs.select("id", "s"), "id"), **primers)
    made = made.select("id", "f_seq", "r_seq", F.col("product").alias("p_product"), F.col("warnings").alias("said"), F.col("reason").alias("p_reason"), F.col("feasible").alias("amplified"))
    r = best.join(made, "id", "left")
    by_digest = F.col("digest") & F.lit(method != "pcr")
    by_pcr = F.coalesce("amplified", F.lit(False)) & ~by_digest
    none = F.array().cast("array<string>")
    rather = F.when(F.col("digest"), F.array(F.format_string("a digest with %s and %s would do, at %d further bases", "up", "down", "collateral"))).otherwise(none)
    refused = F.map_concat(F.coalesce("d_reasons", F.create_map().cast("map<string,bigint>")), F.when(F.col("p_reason").isNotNull(), F.create_map("p_reason", F.lit(1).cast("long"))).otherwise(F.create_map().cast("map<string,bigint>")))
    return r.select(
        "id",
        F.when(by_digest, "restriction").when(by_pcr, "pcr").alias("route"),
        *[F.when(by_digest, F.col(c)).alias(c) for c in ("up", "down")],
        *[F.when(by_pcr, F.col(c)).alias(c) for c in ("f_seq", "r_seq")],
        F.when(by_digest, F.col("d_product")).when(by_pcr, F.col("p_product")).alias("product"),
        F.when(by_pcr, F.concat(rather, F.coalesce("said", none))).otherwise(none).alias("warnings"),
        F.when(~by_digest & ~by_pcr, refused).alias("reasons"),
    )
