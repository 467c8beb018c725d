"""Reagent arithmetic: molarity, mixes, dilutions, digests, gels and cycling.

A concentration that was not measured is null, and so is all that follows from it; nothing is
filled in with zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from ringspan.session import settle

# Daltons per base pair (general; ligation sheet), and the bench defaults.
DALTONS, DALTONS_LIGATION = 650, 660
BLANK = "____"
BENCH = {
    "digest": {"buffer": "10x FastDigest Buffer", "buffer_ul": 2, "enzyme_ul": 1, "micrograms": 1.0, "total_ul": 20, "phosphatase": "FastAP", "phosphatase_ul": 1},
    "gel": {"volume_ml": 50, "buffer": "1x TAE", "stain": "SYBR Safe", "stain_ul": 5, "volts": 140, "minutes": 30, "ladder_ul": 5},
    "cleanup": {"kit": "Zymoclean Gel DNA Recovery", "adb_per_mg": 3},
    "gibson": {"master_mix": "Gibson Assembly MasterMix (2x)", "master_mix_fraction": 0.5, "total_ul": 10, "backbone_ng": 100, "insert_molar_excess": 3, "incubation": "50 °C for 30 min"},
    "ligation": {"backbone_fmol": 15, "insert_molar_excess": 5, "enzyme": "T4 DNA ligase", "enzyme_ul": 1, "buffer_ul": 2, "total_ul": 20, "incubation": "room temperature for 30 min"},
    "pcr": {"master_mix": "2X KAPA HiFi HotStart ReadyMix", "reaction_ul": 25, "primer_um": 10, "primer_ul": 0.75, "template_ul": 1, "template_ng_per_ul": 1, "cycles": 30, "seconds_per_kb": 30, "seconds_per_kb_repetitive": 45, "dilution_ladder_ul": [10, 20, 50, 100], "min_pipette_ul": 1.0},
    "transformation": {"cells_ul": 25, "dna_ul": 2, "soc_ul": 500, "outgrowth": "1 h shaking", "plated_ul": 50, "colonies": 3},
    "growth_temp_c": 37,
    "growth_temp_c_repetitive": 30,
}


def bench_config(override: dict | None = None) -> dict:
    """The defaults with an override merged one level deep."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in BENCH.items()}
    for k, v in (override or {}).items():
        out[k] = {**out[k], **v} if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def ng_to_fmol(ng, bp, daltons: int = DALTONS) -> Column:
    return F.try_divide(ng * 1e6, bp * daltons)


def fmol_to_ng(fmol, bp, daltons: int = DALTONS) -> Column:
    return fmol * bp * daltons / 1e6


def volume(ng, ng_per_ul) -> Column:
    """Microlitres that hold so much; null for a stock that is unmeasured or zero."""
    return F.try_divide(ng, F.nullif(ng_per_ul, F.lit(0.0)))


def row_volume(fixed_ul, ng, ng_per_ul) -> Column:
    return F.coalesce(fixed_ul, volume(ng, ng_per_ul))


def water_balance(rows: DataFrame, totals: DataFrame, key: str = "reaction") -> DataFrame:
    """(reaction, water): what is left of the total; null if any volume is, negative if they overflow.
    rows: (reaction, ul); totals: (reaction, total_ul)."""
    used = rows.groupBy(key).agg(F.when(F.count("ul") == F.count(F.lit(1)), F.sum("ul")).alias("used"), F.count(F.lit(1)).alias("n"))
    return totals.join(used, key, "left").select(key, F.when(F.col("n").isNull(), F.col("total_ul")).otherwise(F.col("total_ul") - F.col("used")).alias("water"))


def _first_fit(target: Column, source: Column, ladder: list, least: float) -> Column:
    """The smallest made-up volume that still needs a pipettable amount of a source."""
    fits = F.filter(F.array(*[F.lit(float(x)) for x in ladder]), lambda v: target * v / source >= least)
    return F.get(fits, F.lit(0))


def dilution(stock, target, ladder=(10, 20, 50, 100), least: float = 1.0) -> Column:
    """STRUCT(status, pre_steps, final_ul, take_ul, water_ul): unknown without a stock, neat at or
    below the target, else ok: up to three hundredfold steps, then the last one."""
    ladder = list(ladder)
    empty = lambda s: F.struct(F.lit(s).alias("status"), F.lit(0).alias("pre_steps"), F.lit(None).cast("double").alias("final_ul"), F.lit(None).cast("double").alias("take_ul"), F.lit(None).cast("double").alias("water_ul"))

    def step(n: int) -> Column:
        source = stock / float(100**n)
        final = _first_fit(target, source, ladder, least)
        take = target * final / source
        ok = F.struct(F.lit("ok").alias("status"), F.lit(n).alias("pre_steps"), final.alias("final_ul"), take.alias("take_ul"), (final - take).alias("water_ul"))
        return F.when(final.isNotNull(), ok).otherwise(step(n + 1) if n < 3 else empty("unknown"))

    bad = stock.isNull() | (stock <= 0) | target.isNull() | (target <= 0)
    return F.when(bad, empty("unknown")).when(stock <= target, empty("neat")).otherwise(step(0))


def digest_conditions(rows: DataFrame, key: str = "digest") -> DataFrame:
    """One row per digest, reconciled over its enzymes: the longest time, the one temperature or null,
    all temperatures and inactivations, enzymes that heat won't stop, the shortest time before star
    activity, unknown enzymes. rows: (digest, enzyme, sold_as, temp_c, minutes, inactivation, star_h)."""
    no_kill = F.lower("inactivation").startswith("no")
    known = F.col("sold_as").isNotNull()
    return rows.groupBy(key).agg(
        F.max(F.expr("try_cast(minutes as int)")).alias("minutes"),
        F.when(F.count_distinct("temp_c") == 1, F.min("temp_c")).alias("temp_c"),
        F.sort_array(F.collect_set("temp_c")).alias("temps"),
        F.sort_array(F.collect_set(F.when(~no_kill, F.col("inactivation")))).alias("inactivations"),
        F.sort_array(F.collect_set(F.when(no_kill, F.col("sold_as")))).alias("no_heat_kill"),
        F.min(F.expr("try_cast(star_h as double)")).alias("star_limit_h"),
        F.sort_array(F.collect_set(F.when(~known, F.col("enzyme")))).alias("unknown"),
    )


def gel_percent(bp) -> Column:
    return F.when(bp < 500, 1.5).when(bp < 1000, 1.2).otherwise(1.0)


def agarose_grams(bp, volume_ml: float = 50) -> Column:
    return gel_percent(bp) / 100 * volume_ml


def growth_temperature(repetitive) -> Column:
    return F.when(repetitive, BENCH["growth_temp_c_repetitive"]).otherwise(BENCH["growth_temp_c"])


def extension_seconds(bp, repetitive) -> Column:
    per = F.when(repetitive, BENCH["pcr"]["seconds_per_kb_repetitive"]).otherwise(BENCH["pcr"]["seconds_per_kb"])
    return F.greatest(F.lit(15), F.bround(bp * per / 1000, 0).cast("int"))


def thermocycler(plans: DataFrame) -> DataFrame:
    """(id, step, nth, celsius, seconds, cycles) of plans (id, anneal_c, amplicon_bp, repetitive)."""
    s = lambda name, c, t, n: F.struct(F.lit(name).alias("step"), c.cast("double").alias("celsius"), t.cast("int").alias("seconds"), F.lit(n).cast("int").alias("cycles"))
    cycles = BENCH["pcr"]["cycles"]
    steps = F.array(s("Initial denaturation", F.lit(95), F.lit(180), 1), s("Denaturation", F.lit(98), F.lit(20), cycles), s("Annealing", F.bround("anneal_c", 0), F.lit(15), cycles), s("Extension", F.lit(72), extension_seconds(F.col("amplicon_bp"), F.col("repetitive")), cycles), s("Final extension", F.lit(72), F.lit(120), 1))
    return plans.select("id", F.posexplode(steps).alias("nth", "s")).select("id", "nth", "s.*")


_ROW = "reaction, component, fixed_ul, ng, fmol, ng_per_ul"


def _rows(df: DataFrame, *rows) -> DataFrame:
    """A row per component: (name, fixed_ul, ng, fmol, ng_per_ul) columns or values."""
    c = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    made = F.array(*[F.struct(c(n, "string").alias("component"), c(f, "double").alias("fixed_ul"), c(g, "double").alias("ng"), c(m, "double").alias("fmol"), c(q, "double").alias("ng_per_ul")) for n, f, g, m, q in rows])
    out = df.select("reaction", F.posexplode(made).alias("nth", "r")).select("reaction", "nth", "r.*")
    return out.withColumn("ul", row_volume(F.col("fixed_ul"), F.col("ng"), F.col("ng_per_ul")))


def gibson_mix(pairs: DataFrame, cfg: dict | None = None) -> DataFrame:
    """Component rows of assemblies (reaction, b_bp, b_conc, i_bp, i_conc), with the water."""
    g = bench_config(cfg)["gibson"]
    fmol = ng_to_fmol(F.lit(float(g["backbone_ng"])), F.col("b_bp"))
    rows = _rows(pairs, (g["master_mix"], g["total_ul"] * g["master_mix_fraction"], None, None, None), ("backbone", None, float(g["backbone_ng"]), fmol, F.col("b_conc")), ("insert", None, fmol_to_ng(fmol * g["insert_molar_excess"], F.col("i_bp")), fmol * g["insert_molar_excess"], F.col("i_conc")))
    return with_water(rows, g["total_ul"])


def gibson_mix_many(backbones: DataFrame, inserts: DataFrame, cfg: dict | None = None) -> DataFrame:
    """Component rows of assemblies of any number of inserts, with the water. backbones: (reaction, b_bp, b_conc); inserts: (reaction,
    nth from 1, component, i_bp, i_conc). Each insert gets the molar excess over the backbone; an insert of a reaction without a
    backbone has no row; water is negative where the volumes pass the total, null where one is not known."""
    g = bench_config(cfg)["gibson"]
    fmol = ng_to_fmol(F.lit(float(g["backbone_ng"])), F.col("b_bp"))
    base = _rows(backbones, (g["master_mix"], g["total_ul"] * g["master_mix_fraction"], None, None, None), ("backbone", None, float(g["backbone_ng"]), fmol, F.col("b_conc")))
    each = inserts.join(backbones.select("reaction", (fmol * g["insert_molar_excess"]).alias("fmol")), "reaction")
    null = F.lit(None).cast("double")
    rows = each.select("reaction", (F.col("nth") + 1).cast("int").alias("nth"), "component", null.alias("fixed_ul"), fmol_to_ng(F.col("fmol"), F.col("i_bp")).alias("ng"), "fmol", F.col("i_conc").cast("double").alias("ng_per_ul"))
    return with_water(base.unionByName(rows.withColumn("ul", row_volume(F.col("fixed_ul"), F.col("ng"), F.col("ng_per_ul")))), g["total_ul"])


def ligation_mix(pairs: DataFrame, cfg: dict | None = None) -> DataFrame:
    """Component rows of ligations (reaction, b_bp, b_conc, i_bp, i_conc), with the water."""
    g = bench_config(cfg)["ligation"]
    b, i = F.lit(float(g["backbone_fmol"])), F.lit(float(g["backbone_fmol"] * g["insert_molar_excess"]))
    rows = _rows(pairs, ("backbone", None, fmol_to_ng(b, F.col("b_bp"), DALTONS_LIGATION), b, F.col("b_conc")), ("insert", None, fmol_to_ng(i, F.col("i_bp"), DALTONS_LIGATION), i, F.col("i_conc")), (f"10x {g['enzyme']} buffer", g["buffer_ul"], None, None, None), (g["enzyme"], g["enzyme_ul"], None, None, None))
    return with_water(rows, g["total_ul"])


def digest_mix(digests: DataFrame, n_enzymes: int = 2, dephosphorylate: bool = False, cfg: dict | None = None) -> DataFrame:
    """Component rows of digests (reaction, conc), with the water."""
    g = bench_config(cfg)["digest"]
    parts = [(g["buffer"], g["buffer_ul"], None, None, None), ("DNA", None, g["micrograms"] * 1000, None, F.col("conc")), *[(f"enzyme {i + 1}", g["enzyme_ul"], None, None, None) for i in range(n_enzymes)]]
    if dephosphorylate:
        parts.append((g["phosphatase"], g["phosphatase_ul"], None, None, None))
    return with_water(_rows(digests, *parts), g["total_ul"])


def pcr_mix(cfg: dict | None = None) -> list[tuple[str, float]]:
    """(reagent, µL) of one reaction."""
    g = bench_config(cfg)["pcr"]
    half = g["reaction_ul"] / 2
    return [("water", g["reaction_ul"] - half - 2 * g["primer_ul"] - g["template_ul"]), (g["master_mix"], half), ("forward primer", g["primer_ul"]), ("reverse primer", g["primer_ul"]), ("template", float(g["template_ul"]))]


def with_water(rows: DataFrame, total_ul: float) -> DataFrame:
    """rows with a last one for the water of each reaction."""
    settle(rows.sparkSession)
    every = Window.partitionBy("reaction")
    known = F.count("ul").over(every) == F.count(F.lit(1)).over(every)
    water = rows.withColumn("w", F.when(known, F.lit(float(total_ul)) - F.sum("ul").over(every))).where("nth = 0")
    last = water.select("reaction", F.lit(99).alias("nth"), F.lit("water").alias("component"), *[F.lit(None).cast("double").alias(c) for c in ("fixed_ul", "ng", "fmol", "ng_per_ul")], F.col("w").alias("ul"))
    return rows.unionByName(last)


def shown(value, places: int = 2) -> Column:
    """A number for a form; a blank to fill in where it is null."""
    return F.coalesce(F.format_number(value, places), F.lit(BLANK))


def spec_json(rows: DataFrame) -> DataFrame:
    """(reaction, spec): each reaction's rows as one JSON document."""
    body = F.sort_array(F.collect_list(F.struct("nth", "component", "fixed_ul", "ng", "fmol", "ng_per_ul", "ul")))
    return rows.groupBy("reaction").agg(F.to_json(body).alias("spec"))


def two_band_caveat(a_bp, b_bp) -> Column:
    """Whether the smaller of two bands is at least five times shorter and may be missed."""
    return F.greatest(a_bp, b_bp) >= 5 * F.least(a_bp, b_bp)


def gel_recipe(bp: int, cfg: dict | None = None) -> list[tuple[str, str]]:
    """(component, amount) of a gel that resolves a band."""
    g = bench_config(cfg)["gel"]
    percent = 1.5 if bp < 500 else 1.2 if bp < 1000 else 1.0
    return [("agarose", f"{percent / 100 * g['volume_ml']:.2f} g ({percent:g} %)"), (g["buffer"], f"{g['volume_ml']} mL"), (g["stain"], f"{g['stain_ul']} µL"), ("run", f"{g['volts']} V, {g['minutes']} min")]


def cleanup_note(cfg: dict | None = None) -> str:
    c = bench_config(cfg)["cleanup"]
    return f"Purify with {c['kit']}: {c['adb_per_mg']} µL of dissolving buffer per mg of gel."


def digest_note(minutes, temp_c, star_limit_h, no_heat_kill, unknown) -> Column:
    """A sentence on how to run a reconciled digest."""
    run = F.when(minutes.isNotNull() & temp_c.isNotNull(), F.format_string("Incubate at %s °C for %d min.", temp_c, minutes)).otherwise("Enzymes differ in temperature or are not in the table: digest one after the other.")
    limit = F.when(star_limit_h.isNotNull(), F.format_string(" Stop within %s h.", F.regexp_replace(star_limit_h.cast("string"), r"\.0$", ""))).otherwise("")
    kill = F.when(F.size(no_heat_kill) > 0, F.concat(F.lit(" Heat does not stop "), F.array_join(no_heat_kill, ", "), F.lit("; purify."))).otherwise("")
    ask = F.when(F.size(unknown) > 0, F.concat(F.lit(" Look up "), F.array_join(unknown, ", "), F.lit("."))).otherwise("")
    return F.concat(run, limit, kill, ask)


def forms(plans: DataFrame) -> DataFrame:
    """(id, gel_percent, agarose_g, growth_c, extension_s, amplicon): the numbers that a form shows for a
    plan (id, bp, repetitive), and the amplicon's size as it is printed, a blank where it is not known."""
    bp, rep = F.col("bp"), F.col("repetitive")
    return plans.select("id", gel_percent(bp).alias("gel_percent"), agarose_grams(bp).alias("agarose_g"), growth_temperature(rep).alias("growth_c"), extension_seconds(bp, rep).alias("extension_s"), shown(bp, 0).alias("amplicon"))


def pcr_rows(plans: DataFrame, cfg: dict | None = None) -> DataFrame:
    """(id, nth, component, ul): the reaction of each plan (id)."""
    made = F.array(*[F.struct(F.lit(n).alias("component"), F.lit(float(u)).alias("ul")) for n, u in pcr_mix(cfg)])
    return plans.select("id", F.posexplode(made).alias("nth", "r")).select("id", "nth", "r.*")
