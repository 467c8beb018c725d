"""Bench reports: one self-contained HTML file from the collected rows of one plan.

Nothing is fetched; numbers that were not measured are forms to fill in, recomputed in the page.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from html import escape
from pathlib import Path

from ringspan.operators.reagents import BLANK, DALTONS, DALTONS_LIGATION, bench_config, cleanup_note, gel_recipe, pcr_mix


@dataclass
class Table:
    title: str
    columns: list[str]
    rows: list[list]
    note: str = ""


@dataclass
class Report:
    title: str
    aim: str = ""
    author: str = ""
    strategy: list[str] = field(default_factory=list)
    materials: list[Table] = field(default_factory=list)
    steps: list[tuple[str, list[str]]] = field(default_factory=list)
    tables: list[Table] = field(default_factory=list)
    figures: list[tuple[str, str]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    generated: str = field(default_factory=lambda: date.today().isoformat())


def short_id(label: str) -> str:
    return label.split("_", 1)[0]


def number(value, places: int = 2) -> str:
    return BLANK if value is None else f"{value:,.{places}f}"


def two_band_caveat(a: int, b: int) -> str | None:
    big, small = max(a, b), min(a, b)
    return f"the {small:,} bp band is at least five times shorter than the {big:,} bp one and may run off or stay faint" if small and big >= 5 * small else None


def transformation(repetitive: bool, cfg: dict | None = None) -> list[str]:
    c = bench_config(cfg)
    t, temp = c["transformation"], c["growth_temp_c_repetitive" if repetitive else "growth_temp_c"]
    why = "repeat arrays recombine at higher temperature; use a recombination-deficient strain" if repetitive else "standard growth"
    return [f"Thaw {t['cells_ul']} µL competent cells on ice, add {t['dna_ul']} µL of the reaction; run the control alongside.", f"Add {t['soc_ul']} µL SOC, {t['outgrowth']} at {temp} °C.", f"Plate {t['plated_ul']} µL and grow overnight at {temp} °C ({why}).", f"Pick {t['colonies']} colonies and sequence the whole plasmid."]


def mix(title: str, rows: list[tuple[str, float | None]], total: float, note: str = "") -> Table:
    """A reaction's table; the water is a blank while an amount is not known."""
    known = [v for _, v in rows]
    water = None if None in known else total - sum(known)
    text = note if water is None or water >= 0 else f"{note} The volumes exceed the reaction; concentrate the DNA.".strip()
    return Table(title, ["component", "µL"], [[n, number(v)] for n, v in [*rows, ("water", water)]] + [["total", number(total)]], text)


def _volume(ng: float, conc: float | None) -> float | None:
    return ng / conc if conc else None


def digestion(name: str, enzymes: list[str], conc: float | None, config: dict | None = None, dephosphorylate: bool = False) -> Table:
    d = bench_config(config)["digest"]
    more = [(d["phosphatase"], d["phosphatase_ul"])] if dephosphorylate else []
    return mix(f"Digestion of {name}", [(d["buffer"], d["buffer_ul"]), (f"{name} ({d['micrograms']:g} µg)", _volume(d["micrograms"] * 1000, conc)), *[(e, d["enzyme_ul"]) for e in dict.fromkeys(enzymes)], *more], d["total_ul"])


def ligation(backbone: tuple[str, int, float | None], insert: tuple[str, int, float | None] | None, config: dict | None = None) -> Table:
    """Backbone and insert: (name, bp, ng/µL); without an insert the backbone closes on itself."""
    g = bench_config(config)["ligation"]
    rows = [(backbone[0], _volume(g["backbone_fmol"] * backbone[1] * DALTONS_LIGATION / 1e6, backbone[2]))]
    if insert:
        rows.append((insert[0], _volume(g["backbone_fmol"] * g["insert_molar_excess"] * insert[1] * DALTONS_LIGATION / 1e6, insert[2])))
    return mix("Ligation", [*rows, (f"10x {g['enzyme']} buffer", g["buffer_ul"]), (g["enzyme"], g["enzyme_ul"])], g["total_ul"], f"{g['backbone_fmol']} fmol of backbone" + (f", {g['insert_molar_excess']}-fold insert." if insert else "; run a control without ligase."))


def assembly(backbone: tuple[str, int, float | None], insert: tuple[str, int, float | None], config: dict | None = None) -> Table:
    g = bench_config(config)["gibson"]
    fmol = g["backbone_ng"] * 1e6 / (backbone[1] * DALTONS)
    rows = [(g["master_mix"], g["total_ul"] * g["master_mix_fraction"]), (backbone[0], _volume(g["backbone_ng"], backbone[2])), (insert[0], _volume(fmol * g["insert_molar_excess"] * insert[1] * DALTONS / 1e6, insert[2]))]
    return mix("Assembly", rows, g["total_ul"], f"{number(fmol, 1)} fmol of backbone, {g['insert_molar_excess']}-fold insert; 50 °C for 30 min.")


def amplification(template: str, anneal_c: float | None, bp: int, repetitive: bool, config: dict | None = None) -> list[Table]:
    """The reaction and the cycler's program."""
    g = bench_config(config)["pcr"]
    per = g["seconds_per_kb_repetitive" if repetitive else "seconds_per_kb"]
    anneal = BLANK if anneal_c is None else f"{anneal_c:.0f}"
    steps = [["Initial denaturation", "95", 180, 1], ["Denaturation", "98", 20, g["cycles"]], ["Annealing", anneal, 15, g["cycles"]], ["Extension", "72", max(15, round(bp / 1000 * per)), g["cycles"]], ["Final extension", "72", 120, 1]]
    return [Table(f"PCR on {template}", ["component", "µL"], [[n, number(v)] for n, v in pcr_mix(config)]), Table("Cycler", ["step", "°C", "s", "cycles"], steps)]


def gel(bp: int, config: dict | None = None) -> Table:
    return Table(f"Gel for {bp:,} bp", ["component", "amount"], [list(r) for r in gel_recipe(bp, config)])


def _provenance(plan: dict, parent: dict, how: str) -> str:
    return f"Planned on {parent['name']} ({parent['length']:,} bp); product {len(plan['product']):,} bp, checked by {how}."


def excision_report(plan: dict, parent: dict, config: dict | None = None, figures=()) -> Report:
    """plan: a row of excision plans; parent: name, length and concentration of the start."""
    pair = plan["up"] if plan["up"] == plan["down"] else f"{plan['up']} + {plan['down']}"
    removed = plan["d_top"] - plan["u_top"]
    r = Report(f"Deletion from {parent['name']}", warnings=list(plan.get("warnings") or []), figures=list(figures))
    r.strategy = [f"Digest {parent['name']} with {pair} and close the backbone; {removed:,} bp leave.", f"Ends: {plan['strategy'].replace('_', ' ')}. Product {plan['product_bp']:,} bp."]
    if plan.get("product"):
        r.strategy.append(_provenance(plan, parent, "simulating the digest"))
    if caveat := two_band_caveat(removed, plan["product_bp"]):
        r.warnings.append(caveat)
    if plan.get("site_regenerated"):
        r.warnings.append("the junction is a site of an enzyme used, so undigested parent and product can't be told apart by it")
    r.materials.append(Table("DNA and enzymes", ["name", "what"], [[parent["name"], f"plasmid, {parent['length']:,} bp"], *[[n, "restriction enzyme"] for n in dict.fromkeys([plan["up"], plan["down"]])]]))
    r.tables = [digestion(parent["name"], [plan["up"], plan["down"]], parent.get("ng_per_ul"), config), gel(plan["product_bp"], config), ligation(("backbone", plan["product_bp"], None), None, config)]
    r.steps = [("Digest", ["Mix in the order of the table, incubate as the supplier says."]), ("Gel", [f"Cut out the {plan['product_bp']:,} bp band.", cleanup_note(config)]), ("Ligate", ["Close the backbone with ligase, at low DNA concentration."]), ("Transform", transformation(bool(plan.get("repetitive")), config))]
    return r


def pcr_report(plan: dict, parent: dict, config: dict | None = None, figures=()) -> Report:
    r = Report(f"Deletion from {parent['name']} by inverse PCR", warnings=list(plan.get("warnings") or []), figures=list(figures))
    r.strategy = [f"Amplify all of {parent['name']} but the target, {plan['amplicon_bp']:,} bp, and close it."]
    if plan.get("product"):
        r.strategy.append(_provenance(plan, parent, "its length"))
    r.materials.append(Table("Oligos", ["name", "sequence"], [["forward", (plan.get("f_tail") or "").lower() + plan["f_seq"]], ["reverse", (plan.get("r_tail") or "").lower() + plan["r_seq"]]]))
    r.tables = amplification(parent["name"], plan["anneal_c"], plan["amplicon_bp"], bool(plan.get("repetitive")), config) + [gel(plan["amplicon_bp"], config)]
    r.steps = [("PCR", [f"Anneal at {plan['anneal_c']:.0f} °C, extend {plan['extension_s']} s."]), ("Close", ["Phosphorylate, ligate and remove the template, or assemble by the tails."]), ("Transform", transformation(bool(plan.get("repetitive")), config))]
    return r


def insertion_report(plan: dict, vector: dict, insert: dict, config: dict | None = None, figures=()) -> Report:
    r = Report(f"Insertion of {insert['name']} into {vector['name']}", warnings=list(plan.get("warnings") or []), figures=list(figures))
    conc = vector.get("ng_per_ul")
    if plan["route"] == "restriction":
        n = len(plan["fragment"])
        r.strategy = [f"Open {vector['name']} with {plan['ue']} and {plan['de']}; release the fragment with {plan['ude']} and {plan['dde']}."]
        r.materials.append(Table("DNA and enzymes", ["name", "what"], [[vector["name"], "vector"], [insert["name"], "donor"], *[[e, "restriction enzyme"] for e in dict.fromkeys([plan["ue"], plan["de"], plan["ude"], plan["dde"]])]]))
        r.tables = [digestion(vector["name"], [plan["ue"], plan["de"]], conc, config, not plan["directional"]), digestion(insert["name"], [plan["ude"], plan["dde"]], insert.get("ng_per_ul"), config), gel(n, config), ligation(("vector, opened", len(plan["product"]) - n, None), ("fragment", n, None), config)]
        r.steps = [("Digest", ["Digest both, purify the bands.", cleanup_note(config)]), ("Ligate", ["Mix as in the table, with a control without the fragment."])]
    else:
        how = f"cut with {plan['ue']} and {plan['de']}" if plan["prep"] == "digest" else "amplified by inverse PCR"
        r.strategy = [f"Assemble {insert['name']} into {vector['name']}, {how}, by homology."]
        oligos = [[n, plan[k]] for n, k in (("vector forward", "vector_f"), ("vector reverse", "vector_r"), ("insert forward", "insert_f"), ("insert reverse", "insert_r")) if plan.get(k)]
        if oligos:
            r.materials.append(Table("Oligos", ["name", "sequence"], oligos))
        if plan.get("order"):
            r.materials.append(Table("Synthetic fragment", ["name", "length"], [[insert["name"], f"{len(plan['order']):,} bp"]]))
        put = plan["edit"][2]
        opened = len(plan["product"]) - put
        r.tables = [digestion(vector["name"], [plan["ue"], plan["de"]], conc, config)] if plan["prep"] == "digest" else amplification(vector["name"], None, opened, bool(plan.get("repetitive")), config)
        r.tables.append(assembly(("vector, opened", opened, None), (insert["name"], put + len(plan["up_arm"]) + len(plan["down_arm"]), None), config))
        r.steps = [("Open the vector", [f"{how[0].upper()}{how[1:]}; purify the band.", cleanup_note(config)]), ("Assemble", ["Mix as in the table."])]
    r.strategy.append(_provenance(plan, vector, "length and presence of the insert"))
    r.steps.append(("Transform", transformation(bool(plan.get("repetitive")), config)))
    return r


_CSS = "body{font:15px/1.5 sans-serif;max-width:60rem;margin:2rem auto;padding:0 1rem;color:#222}table{border-collapse:collapse;margin:.5rem 0}td,th{border:1px solid #bbb;padding:.2rem .6rem;text-align:left}figure{margin:1rem 0}.warn{border-left:4px solid #c60;padding-left:.6rem}input{width:5rem}"
_JS = """
document.querySelectorAll('form.dilution').forEach(f => f.addEventListener('input', () => {
  const stock = parseFloat(f.stock.value), target = parseFloat(f.dataset.target), least = parseFloat(f.dataset.least);
  const ladder = f.dataset.ladder.split(',').map(Number), out = f.querySelector('output');
  if (!(stock > 0) || !(target > 0)) { out.textContent = 'no reading yet'; return; }
  if (stock <= target) { out.textContent = 'use the stock as it is'; return; }
  const said = []; let source = stock;
  for (let n = 0; n < 4; n++) {
    const final = ladder.find(v => target * v / source >= least);
    if (final) { const take = target * final / source; said.push(take.toFixed(2) + ' µL in ' + final + ' µL'); out.textContent = said.join(', then '); return; }
    said.push(least + ' µL in ' + least * 100 + ' µL'); source /= 100;
  }
  out.textContent = 'out of range';
}));
document.querySelectorAll('form.mix').forEach(f => f.addEventListener('input', () => {
  let left = parseFloat(f.dataset.total) - parseFloat(f.dataset.fixed);
  f.querySelectorAll('label').forEach(row => {
    const conc = parseFloat(row.querySelector('input').value), take = parseFloat(row.dataset.ng) / conc;
    row.querySelector('output').textContent = conc > 0 ? take.toFixed(2) + ' µL' : 'no reading yet';
    left -= conc > 0 ? take : NaN;
  });
  f.querySelector('output.water').textContent = Number.isNaN(left) ? 'no reading yet' : left < 0 ? 'too much for the reaction' : left.toFixed(2) + ' µL water';
}));
"""


def _table(t: Table) -> str:
    head = "".join(f"<th>{escape(str(c))}</th>" for c in t.columns)
    body = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in row) + "</tr>" for row in t.rows)
    return f"<h3>{escape(t.title)}</h3><table><tr>{head}</tr>{body}</table>" + (f"<p>{escape(t.note)}</p>" if t.note else "")


def dilution_form(name: str, config: dict | None = None) -> str:
    p = bench_config(config)["pcr"]
    ladder = ",".join(str(v) for v in p["dilution_ladder_ul"])
    return f'<form class="dilution" data-target="{p["template_ng_per_ul"]}" data-least="{p["min_pipette_ul"]}" data-ladder="{ladder}"><label>{escape(name)}, ng/µL <input name="stock" inputmode="decimal"></label> <output>no reading yet</output></form>'


def mix_form(title: str, needed: dict[str, float], fixed_ul: float, total_ul: float) -> str:
    """A calculator of a reaction: what to take of DNA of which `needed` says the nanograms, and the water."""
    rows = "".join(f'<label data-ng="{ng:.6f}">{escape(n)} ({ng:,.1f} ng), ng/µL <input inputmode="decimal"> <output>no reading yet</output></label><br>' for n, ng in needed.items())
    return f'<form class="mix" data-total="{total_ul}" data-fixed="{fixed_ul}"><p>{escape(title)}</p>{rows}<output class="water">no reading yet</output></form>'


def calculators(plan: dict, parent: dict, config: dict | None = None) -> list[str]:
    """The forms that a plan's report offers: the template's dilution, and the reactions it takes."""
    c = bench_config(config)
    d, g, lig = c["digest"], c["gibson"], c["ligation"]
    digest = mix_form(f"Digestion of {parent['name']}", {parent["name"]: d["micrograms"] * 1000.0}, d["buffer_ul"] + 2 * d["enzyme_ul"], d["total_ul"])
    n = len(plan.get("product") or "")
    if plan["route"] == "pcr":
        return [dilution_form(parent["name"], config)]
    if plan["route"] == "gibson":
        put = plan["edit"][2]
        per = g["backbone_ng"] / max(n - put, 1) * g["insert_molar_excess"]
        insert = per * (put + len(plan["up_arm"]) + len(plan["down_arm"]))
        opened = digest if plan["prep"] == "digest" else dilution_form(parent["name"], config)
        return [opened, mix_form("Assembly", {"vector, opened": float(g["backbone_ng"]), plan["insert"]: insert}, g["total_ul"] * g["master_mix_fraction"], g["total_ul"])]
    needed = {"backbone": lig["backbone_fmol"] * (n - len(plan.get("fragment") or "")) * DALTONS_LIGATION / 1e6}
    if plan.get("fragment"):
        needed["fragment"] = lig["backbone_fmol"] * lig["insert_molar_excess"] * len(plan["fragment"]) * DALTONS_LIGATION / 1e6
    return [digest, mix_form("Ligation", needed, lig["buffer_ul"] + lig["enzyme_ul"], lig["total_ul"])]


def render(r: Report, forms: list[str] | None = None) -> str:
    e = escape
    parts = [f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{e(r.title)}</title><style>{_CSS}</style></head><body><h1>{e(r.title)}</h1><p>{e(r.author)} Generated {e(r.generated)}</p>']
    if r.aim:
        parts.append(f"<h2>Aim</h2><p>{e(r.aim)}</p>")
    parts += ["<h2>Strategy</h2>", *[f"<p>{e(x)}</p>" for x in r.strategy], *[f'<p class="warn">{e(x)}</p>' for x in r.warnings]]
    parts += [f"<figure>{svg}<figcaption>{e(caption)}</figcaption></figure>" for caption, svg in r.figures]
    parts += ["<h2>Materials</h2>" if r.materials else "", *map(_table, r.materials), *map(_table, r.tables), *(forms or [])]
    for i, (name, lines) in enumerate(r.steps, 1):
        parts.append(f"<h2>{i}. {e(name)}</h2><ol>{''.join(f'<li>{e(x)}</li>' for x in lines)}</ol>")
    return "".join(parts) + f"<script>{_JS}</script></body></html>"


def write_report(r: Report, path: str, forms: list[str] | None = None) -> Path:
    out = Path(path)
    out.write_text(render(r, forms), encoding="utf-8")
    return out


def protocol_text(r: Report) -> str:
    """The same as plain text."""
    lines = [r.title, "", *r.strategy, *[f"Note: {w}" for w in r.warnings], ""]
    for t in [*r.materials, *r.tables]:
        lines += [t.title, *["  " + "  ".join(map(str, row)) for row in t.rows], ""]
    for i, (name, steps) in enumerate(r.steps, 1):
        lines += [f"{i}. {name}", *[f"   - {s}" for s in steps]]
    return "\n".join(lines) + "\n"
