"""A design session: one library, handles for products, and answers as JSON without sequences.

What goes out of the session (files, orders) asks a confirm callback first.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringspan.functions import kernels
from ringspan.operators import enzymes, excision, insertion, intervals, inventory, pcr, sourcing
from ringspan.plans import maps, report
from ringspan.sources.formats import format_genbank
from ringspan.sources.library import library_lines

#: Runs of bases at least this long never leave in an answer; hits that are listed at most.
LONGEST_BASES, MOST_HITS = 40, 12
_BASES = re.compile(r"[ACGTacgt]{%d,}" % LONGEST_BASES)

# The names of the tools, and those that ask first.
TOOLS = ("search_inventory", "inspect_plasmid", "plan_deletion", "plan_insertion", "source_sequence", "compare_product", "export_product", "save_protocol", "ask_user", "report_inputs", "generate_report")
GATED = ("export_product", "save_protocol", "generate_report")


def parse_site(text: str):
    """A place, a span or a label: "1491", "1491:1512", "MCS"."""
    if m := re.fullmatch(r"\s*(\d+)\s*(?::\s*(\d+)\s*)?", text):
        return (int(m[1]), int(m[2] or m[1]))
    return text.strip()


def clean_numbers(values: dict) -> dict[str, float]:
    """The entries that are positive numbers; the rest were not measured."""
    out = {}
    for k, v in values.items():
        try:
            n = float(v)
        except (TypeError, ValueError):
            continue
        if n > 0 and n != float("inf"):
            out[k] = n
    return out


def no_sequences(value):
    """An answer with every long run of bases replaced by its length."""
    if isinstance(value, dict):
        return {k: no_sequences(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [no_sequences(v) for v in value]
    return _BASES.sub(lambda m: f"<{len(m[0])} bases>", value) if isinstance(value, str) else value


def inside(path: str, folder: str = ".") -> Path:
    """A path inside a folder, else an error."""
    p, base = Path(path).resolve(), Path(folder).resolve()
    if base != p and base not in p.parents:
        raise ValueError(f"{path} is outside {base}")
    return p


class Session:
    """library: (plasmid_id, label, sequence, length); features: (plasmid_id, label, type, s, e)."""

    def __init__(self, spark: SparkSession, library: DataFrame, features: DataFrame | None = None, config: dict | None = None, confirm: Callable[[str], bool] = lambda what: False, ask: Callable[[str], str] | None = None, pool="CommOnly"):
        self.spark, self.library, self.confirm, self.ask, self.pool = spark, library.cache(), confirm, ask, pool
        self.features = features
        self.config = config or {}
        self.products: dict[str, dict] = {}

    # -- answers

    def answer(self, **values) -> str:
        return json.dumps(no_sequences(values), ensure_ascii=False, default=str)

    def register(self, product: dict) -> str:
        handle = f"prod_{len(self.products) + 1}"
        self.products[handle] = product
        return handle

    def resolve(self, name: str) -> str:
        asked = self.spark.createDataFrame([(name,)], "asked string")
        r = inventory.resolve_name(self.library.select("label"), asked).first()
        if r["label"]:
            return r["label"]
        if not r["n"]:
            raise KeyError(f"nothing in the library is called {name!r}")
        some = [x["label"] for x in self.library.where(F.contains(F.lower("label"), F.lit(name.lower()))).select("label").orderBy("label").limit(5).collect()]
        raise KeyError(f"{name!r} is ambiguous ({r['n']} matches): {', '.join(some)}")

    def _row(self, name: str):
        label = self.resolve(name)
        return self.library.where(F.col("label") == label).first()

    # -- tools

    def search_inventory(self, query: str) -> str:
        """By name; else by sequence if it is one of 12 bases or more; else by feature label."""
        named = self.library.where(F.contains(F.lower("label"), F.lit(query.lower()))).select("label")
        names = [r["label"] for r in named.orderBy("label").limit(MOST_HITS).collect()]
        if names:
            return self.answer(kind="name", hits=names, total=named.count())
        clean = re.sub(r"\s", "", query).upper()
        if len(clean) >= 12 and re.fullmatch(f"[{kernels.IUPAC}]+", clean):
            q = self.spark.createDataFrame([(0, clean)], "query_id long, q string")
            hits = inventory.provenance(q, self.library.select(F.col("label").alias("id"), F.col("sequence").alias("s")))
            got = [r.asDict() for r in hits.orderBy("id", "start").limit(MOST_HITS).collect()]
            return self.answer(kind="sequence", hits=got, total=hits.count())
        if self.features is None:
            return self.answer(kind="feature", hits=[], total=0)
        f = intervals.functional(self.features).where(intervals.label_matches(F.col("label"), [query]))
        first = f.groupBy("plasmid_id").agg(F.min(F.struct("s", "e", "label")).alias("f")).orderBy("plasmid_id")
        return self.answer(kind="feature", hits=[{"plasmid": r["plasmid_id"], "label": r["f"]["label"], "start": r["f"]["s"], "end": r["f"]["e"]} for r in first.limit(MOST_HITS).collect()], total=first.count())

    def inspect_plasmid(self, name: str) -> str:
        row = self._row(name)
        one = self.spark.createDataFrame([(row["label"], row["sequence"])], "id string, s string")
        cutters = enzymes.unique_cutters(enzymes.cut_sites(one, self.pool)).orderBy("nth").collect()
        feats = [] if self.features is None else [r.asDict() for r in intervals.functional(self.features).where(F.col("plasmid_id") == row["plasmid_id"]).orderBy("s").collect()]
        return self.answer(label=row["label"], length=row["length"], features=feats, unique_cutters=[{"enzyme": c["enzyme"], "cut": c["top"]} for c in cutters], total=cutters[0]["total"] if cutters else 0)

    def _span(self, row, what) -> tuple[int, int]:
        site = parse_site(what) if isinstance(what, str) else tuple(what)
        if isinstance(site, tuple):
            return site
        if self.features is None:
            raise KeyError("the library has no features to name")
        f = intervals.functional(self.features).where((F.col("plasmid_id") == row["plasmid_id"]) & intervals.label_matches(F.col("label"), [site])).select(F.col("plasmid_id").alias("k"), "s", "e")
        arc = intervals.tight_arc(f, row["length"]).first()
        if not arc:
            have = [r["label"] for r in self.features.where(F.col("plasmid_id") == row["plasmid_id"]).select("label").distinct().orderBy("label").collect()]
            raise KeyError(f"no feature {site!r}; there are: {', '.join(have)}")
        return arc["arc_start"], arc["arc_end"]

    def _features(self, row, turned: int = 0):
        """The features of a plasmid, its origin moved to a place."""
        s, e = intervals.rotate_span(F.col("s"), F.col("e"), F.lit(turned), F.lit(row["length"]))
        return self.features.where(F.col("plasmid_id") == row["plasmid_id"]).select(F.col("plasmid_id").alias("k"), s.cast("int").alias("s"), e.cast("int").alias("e"), "label", "type")

    def _classes(self, row, span, turned: int = 0, protect: list[str] | None = None):
        """The features of a plasmid by what becomes of them; a KeyError if one is to go and to stay."""
        t = self.spark.createDataFrame([(row["plasmid_id"], *span)], "k string, t_s int, t_e int")
        f = intervals.classify(self._features(row, turned), t, protect)
        torn = f.where("contradiction").orderBy("s").first()
        if torn:
            raise KeyError(f"{torn['label']!r} lies inside what is to go, and is to be protected")
        return f

    def _protected(self, row, span, turned: int = 0, protect: list[str] | None = None):
        if self.features is None:
            return None
        return self._classes(row, span, turned, protect).where("class = 'protected'").select(F.lit(row["label"]).alias("id"), "label", "p_s", "p_e")

    def _lost(self, row, span, turned: int = 0) -> list[str]:
        """Warnings of what goes with a span, and of what an insertion interrupts."""
        if self.features is None:
            return []
        gone = self._classes(row, span, turned).where("class <> 'protected'").select("label", "class", intervals.looks_essential(F.col("label")).alias("essential")).distinct().orderBy("label").collect()
        lost = [f"{r['label']} looks essential and goes" for r in gone if r["class"] == "removed" and r["essential"]]
        return lost + ([f"{r['label']} spans the site and is interrupted" for r in gone if r["class"] == "umbrella"] if span[0] == span[1] else [])

    def plan_deletion(self, name: str, what, method: str = "auto", protect: list[str] | None = None) -> str:
        """By digest if a route exists, else by inverse PCR; a refusal is an answer with reasons. protect: names
        of features that must stay, whatever is asked for."""
        row = self._row(name)
        span = self._span(row, what)
        whole = intervals.centred(self.spark.createDataFrame([(row["label"], row["sequence"], *span)], "id string, s string, t_s int, t_e int")).first()
        span, turned = (whole["t_s"], whole["t_e"]), whole["turned"]
        guarded, lost = self._protected(row, span, turned, protect), self._lost(row, span, turned)
        one = self.spark.createDataFrame([(row["label"], whole["s"])], "id string, s string")
        t = self.spark.createDataFrame([(row["label"], *span)], "id string, t_s int, t_e int")
        plans, why = excision.plan(one, t, guarded, self.pool)
        best = excision.best_or_refusal(plans, why, t).first()
        if method in ("auto", "restriction"):
            if best["feasible"]:
                plan = {**best.asDict(), "product_bp": len(best["product"]), "parent": row["label"], "route": "restriction", "edit": (best["u_top"], best["d_top"], 0), "turned": turned, "warnings": lost}
                h = self.register(plan)
                return self.answer(handle=h, route="restriction", enzymes=[best["up"], best["down"]], product_bp=plan["product_bp"], site_regenerated=best["site_regenerated"], warnings=lost, verification="digest simulated")
            if method == "restriction":
                return self.answer(feasible=False, reasons=best["reasons"] or {})
        got = pcr.plan_deletions(t.join(one, "id")).first()
        if not got["feasible"]:
            return self.answer(feasible=False, reasons={got["reason"]: 1})
        rather = [f"a digest with {best['up']} and {best['down']} would do, at {best['collateral']} further bases"] if best["feasible"] else []
        said = [f"{who} primer: {x}" for who, notes in (("forward", got["f_notes"]), ("reverse", got["r_notes"])) for x in notes]
        warnings = [*rather, *got["warnings"], *said, *lost]
        h = self.register({**got.asDict(), "parent": row["label"], "route": "pcr", "edit": (*span, 0), "turned": turned, "warnings": warnings})
        return self.answer(handle=h, route="pcr", amplicon_bp=got["amplicon_bp"], anneal_c=got["anneal_c"], warnings=warnings, verification="length")

    def plan_insertion(self, name: str, at, sequence: str | None = None, donor: str | None = None, what=None, method: str = "auto", protect: list[str] | None = None, vector_prep: str = "auto", max_digest_collateral: int = 200, homology: int = 25, **primers) -> str:
        """By subcloning if a route exists, else by assembly. Features beside the site are protected; protect
        names some that must stay even if they lie in what is replaced. vector_prep: how the vector is opened
        for assembly, by digest, by pcr, or (auto) by digest if that costs max_digest_collateral bases at
        most. primers: parameters of pcr.best_pairs."""
        row = self._row(name)
        span = self._span(row, at)
        guarded = self._protected(row, span, 0, protect)
        guarded = None if guarded is None else guarded.withColumn("id", F.lit(1).cast("long"))
        lost = self._lost(row, span)
        v = self.spark.createDataFrame([(1, row["sequence"], *span)], "pair_id long, v string, v_s int, v_e int")
        w, reasons = None, {}
        if donor is not None:
            d = self._row(donor)
            d_span = self._span(d, what) if what is not None else (0, d["length"])
            sequence = (d["sequence"] * 2)[d_span[0] : d_span[1]]
            w = self.spark.createDataFrame([(1, d["sequence"], *d_span)], "pair_id long, d string, d_s int, d_e int")
            if method in ("auto", "restriction"):
                best, why = insertion.restriction_routes(v, w, guarded, self.pool)
                got = insertion.restriction_products(best, v, w, self.pool).where("verified").first()
                if got:
                    warnings = [*got["warnings"], *lost]
                    h = self.register({**got.asDict(), "parent": row["label"], "insert": donor, "route": "restriction", "warnings": warnings})
                    return self.answer(handle=h, route="restriction", vector=[got["ue"], got["de"]], donor=[got["ude"], got["dde"]], directional=got["directional"], site_regenerated=got["site_regenerated"], product_bp=len(got["product"]), warnings=warnings, verification="length and presence")
                reasons = {r["reason"]: r["n"] for r in why.orderBy(F.desc("n"), "reason").limit(4).collect()}
        elif method == "restriction":
            reasons = {"insert is synthetic, so there is nothing to digest": 1}
        if method == "restriction":
            return self.answer(feasible=False, reasons=reasons)
        clean = re.sub(r"\s", "", sequence or "").upper()
        if not re.fullmatch(f"[{kernels.IUPAC}]+", clean):
            raise ValueError("the insert is no sequence of base codes")
        put = self.spark.createDataFrame([(1, clean)], "id long, insert string")
        got = insertion.homology_routes(v, put, w, guarded, self.pool, vector_prep, max_digest_collateral, homology, **primers).first()
        if not got["verified"]:
            return self.answer(feasible=False, reasons={**reasons, got["reason"] or "the product failed its checks": 1})
        warnings = [*got["warnings"], *lost]
        h = self.register({**got.asDict(), "parent": row["label"], "insert": donor or "insert", "route": "gibson", "warnings": warnings, "edit": (got["o_s"], got["o_e"], len(clean))})
        return self.answer(handle=h, route="gibson", vector_prep=got["prep"], vector=[got["ue"], got["de"]] if got["prep"] == "digest" else None, order_bp=len(got["order"]) if got["order"] else None, product_bp=len(got["product"]), warnings=warnings, reasons=reasons, verification="length and presence")

    def source_sequence(self, name: str, sequence: str | None = None) -> str:
        q = self.spark.createDataFrame([(0, (sequence or "").upper() or None)], "query_id long, q string")
        r = sourcing.insert_ladder(q, self.library.select(F.col("label").alias("id"), F.col("sequence").alias("s"))).first()
        return self.answer(name=name, **{k: v for k, v in r.asDict().items() if k != "query_id"})

    def compare_product(self, handle: str, name: str) -> str:
        p, row = self.products[handle], self._row(name)
        same = kernels.canonical(p["product"].upper()) == kernels.canonical(row["sequence"].upper())
        p["compared"] = row["label"]
        return self.answer(same=same, length_difference=len(p["product"]) - row["length"])

    def export_product(self, handle: str, path: str) -> str:
        out = inside(path)
        if not self.confirm(f"write {out}"):
            return self.answer(written=False)
        p = self.products[handle]
        out.write_text(format_genbank(handle, p["product"], self._product_features(p)), encoding="utf-8")
        return self.answer(written=str(out))

    def _product_features(self, p: dict) -> list[dict]:
        """The parent's features in the product's frame, for a GenBank file; none if the edit is not known."""
        if self.features is None or "edit" not in p:
            return []
        row = self.library.where(F.col("label") == p["parent"]).first()
        start, end, put = p["edit"]
        n, out = len(p["product"]), []
        for f in intervals.remap(self._features(row, p.get("turned", 0)), F.lit(start), F.lit(end), F.lit(put)).orderBy("s", "e").collect():
            spans = [(f["s"], f["e"])] if f["e"] <= n else [(f["s"], n), (0, f["e"] - n)]
            quals = {"label": [f["label"]], **({"note": ["truncated"]} if f["truncated"] else {})}
            out.append({"type": f["type"], "parts": [{"start": a, "end": b, "strand": 1} for a, b in spans], "qualifiers": quals})
        return out

    def _report(self, handle: str, concentrations: dict | None = None):
        p = self.products[handle]
        row = self.library.where(F.col("label") == p["parent"]).first()
        conc = clean_numbers(concentrations or {})
        parent = {"name": p["parent"], "length": row["length"], "ng_per_ul": conc.get(p["parent"])}
        figures = self._figures(p, row)
        bench = self.config.get("bench")
        if "insert" in p:
            return report.insertion_report(p, parent, {"name": p["insert"], "ng_per_ul": conc.get(p["insert"])}, bench, figures)
        return (report.excision_report if p["route"] == "restriction" else report.pcr_report)(p, parent, bench, figures)

    def _figures(self, p: dict, row) -> list[tuple[str, str]]:
        """Maps of parent and product, whole and around the change."""
        turned = p.get("turned", 0)
        feats = self._features(row, turned) if self.features is not None else None
        before = [] if feats is None else [r.asDict() for r in intervals.functional(feats).collect()]
        out = [(f"{p['parent']} before the change", maps.circular(p["parent"], row["length"], before))]
        if "edit" not in p:
            return out
        start, end, put = p["edit"]
        after = [] if feats is None else [r.asDict() for r in intervals.functional(intervals.remap(feats, F.lit(start), F.lit(end), F.lit(put))).collect()]
        n = len(p["product"])
        out.append(("after the change", maps.circular("product", n, after)))
        pad = max(300, (end - start) // 4)
        out.append(("the change, before", maps.linear(p["parent"], max(0, start - pad), min(row["length"], end + pad), before)))
        out.append(("the change, after", maps.linear("product", max(0, start - pad), min(n, start + put + pad), after)))
        return out

    def save_protocol(self, handle: str, path: str) -> str:
        out = inside(path)
        if not self.confirm(f"write {out}"):
            return self.answer(written=False)
        out.write_text(report.protocol_text(self._report(handle)), encoding="utf-8")
        return self.answer(written=str(out))

    def ask_user(self, question: str) -> str:
        return self.answer(answer=self.ask(question) if self.ask else None)

    def report_inputs(self, handle: str) -> str:
        p = self.products[handle]
        return self.answer(needs_concentration=[x for x in (p["parent"], p.get("insert")) if x])

    def generate_report(self, handle: str, path: str, concentrations: dict | None = None, aim: str = "") -> str:
        out = inside(path)
        if not self.confirm(f"write {out}"):
            return self.answer(written=False)
        r = self._report(handle, concentrations)
        r.aim = aim
        p = self.products[handle]
        report.write_report(r, str(out), report.calculators(p, {"name": p["parent"]}, self.config.get("bench")))
        return self.answer(written=str(out))


def library_digest(library: DataFrame, config: dict) -> str:
    """The library as sorted lines, base vectors and unavailable ones marked."""
    return "\n".join(r["line"] for r in library_lines(library, config).orderBy("label").toLocalIterator())
