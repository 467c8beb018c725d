"""Decision ladders: where an insert and a backbone come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringspan.operators import complexity, inventory

ASK, INVENTORY, SYNTHESIZE, ORDER = "ask_user", "from_inventory", "synthesize", "order_plasmid"
CONSTRUCT, BASE, ORDER_BACKBONE = "from_construct", "from_base_vector", "order_backbone"


def insert_ladder(inserts: DataFrame, library: DataFrame, allow_split: bool = False, limits: dict | None = None) -> DataFrame:
    """(query_id, route, n_donors, flipped, reasons, ...): unknown sequences are asked for; what the
    library holds comes from there; the rest is synthesised if it passes the screen, else ordered.
    The screen runs on what the library lacks only. inserts: (query_id, q); library: (id, s)."""
    known = inserts.where("q is not null and q <> ''")
    hits = inventory.provenance(known, library).groupBy("query_id").agg(F.count_distinct("id").cast("long").alias("n_donors"), F.count_distinct(F.when(F.col("strand") == -1, F.col("id"))).cast("long").alias("flipped"))
    lacking = known.join(hits, "query_id", "left_anti")
    screened = complexity.screen(lacking, limits, "query_id", "q").select("query_id", "reasons", "score", "synthesizable", "length")
    j = inserts.join(hits, "query_id", "left").join(screened, "query_id", "left")
    route = F.when(F.col("q").isNull() | (F.col("q") == ""), ASK).when(F.col("n_donors") > 0, INVENTORY).when(F.col("synthesizable"), SYNTHESIZE).otherwise(ORDER)
    j = j.withColumn("route", route)
    split = F.lit(allow_split) & (F.col("route") == ORDER) & (F.col("length") >= 250)
    return flags(j.withColumn("split_hint", F.coalesce(split, F.lit(False)))).select("query_id", "route", F.coalesce("n_donors", F.lit(0)).cast("long").alias("n_donors"), F.coalesce("flipped", F.lit(0)).cast("long").alias("flipped"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"), "score", "split_hint", "needs_user_input", "blocks_cloning", "must_order")


def flags(decisions: DataFrame) -> DataFrame:
    r = F.col("route")
    return decisions.withColumns({"needs_user_input": r == ASK, "blocks_cloning": r.isin(ASK, ORDER), "must_order": r.isin(SYNTHESIZE, ORDER, ORDER_BACKBONE)})


def backbone_ladder(goals: DataFrame, ranked: DataFrame, base_vectors: DataFrame, unavailable: DataFrame) -> DataFrame:
    """(goal, route, label): the best ranked construct that is available, else the first available
    base vector, else an order. ranked: (goal, label, rank); base_vectors: (goal, label, rank);
    unavailable: (label)."""
    def first(rows, name):
        ok = rows.join(unavailable, "label", "left_anti")
        nth = F.row_number().over(Window.partitionBy("goal").orderBy("rank", "label"))
        return ok.withColumn("r", nth).where("r = 1").select("goal", F.col("label").alias(name))

    j = goals.select("goal").join(first(ranked, "c"), "goal", "left").join(first(base_vectors, "b"), "goal", "left")
    return j.select("goal", F.when(F.col("c").isNotNull(), CONSTRUCT).when(F.col("b").isNotNull(), BASE).otherwise(ORDER_BACKBONE).alias("route"), F.coalesce("c", "b").alias("label"))
