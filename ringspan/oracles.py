"""DuckDB SQL that gives the rows of the queries in `ringspan.queries`, written independently."""

from __future__ import annotations

from ringspan.functions.sequences import END_AT, END_GC, NEIGHBOURS
from ringspan.operators.enzymes import LETTERS, catalogue
from ringspan.operators.reagents import BENCH, pcr_mix
from ringspan.sources.conditions import rows as condition_rows

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_BASES = ("ACGT" * 7)[:26]


def _dna(x: str) -> str:
    return f"translate(regexp_replace(lower({x}), '[^a-z]', '', 'g'), '{_LETTERS}', '{_BASES}')"


def _rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def _values(rows, names) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


_ENZ = [(e["name"], e["site"], e["size"], e["top_off"], e["ovhg"], e["kind"], e["ovhg_seq"], e["canonical"]) for e in catalogue()]
ENZ = f"enz AS (SELECT * FROM {_values(_ENZ, ['name', 'site', 'size', 'top_off', 'ovhg', 'kind', 'ovhg_seq', 'canonical'])})"
COND = f"cond AS (SELECT * FROM {_values([tuple(r.values()) for r in condition_rows()], ['name', 'temp_c', 'minutes', 'bp_from_end', 'inactivation', 'star_h'])})"
SEQS = f"seqs AS (SELECT doc_id AS id, {_dna('text')} AS s FROM documents WHERE length({_dna('text')}) > 0)"
PROBES = f"probes AS (SELECT item_id AS query_id, {_dna('text')} AS q FROM benchmark WHERE length({_dna('text')}) > 0)"
_SHORT = "concat_ws('', c_mktsegment, translate(c_name, '0123456789', 'abcdefghij'))"
SHORT = f"shorts AS (SELECT c_custkey AS id, {_dna(_SHORT)} AS s FROM customer WHERE length({_dna(_SHORT)}) > 0)"
# the canonical form of longer circles: of the turns that start at the least 31 bases, the least
LONG = f"""strand AS (SELECT id, upper(s) AS t, length(s) AS n FROM seqs UNION ALL SELECT id, {_rc('upper(s)')}, length(s) FROM seqs),
turn AS (SELECT id, t, n, i, substr(ext, i, least(31, n)) AS w FROM (SELECT id, t, n, t || substr(t, 1, least(30, n)) AS ext, unnest(range(1, n + 1)) AS i FROM strand)),
least AS (SELECT id, min(w) AS w FROM turn GROUP BY id),
long AS (SELECT id, min(substr(t, i) || substr(t, 1, i - 1)) AS canonical FROM turn JOIN least USING (id, w) GROUP BY id),
prints AS (SELECT id, substr(sha256(canonical), 1, 16) AS fingerprint FROM long)"""
_TURNS = "list_min(list_transform(range(1, length({x}) + 1), lambda i: substr({x}, i) || substr({x}, 1, i - 1)))"
CANON = f"canon AS (SELECT id, least({_TURNS.format(x='s')}, {_TURNS.format(x=_rc('s'))}) AS canonical FROM shorts)"
_AT = "CAST(l_partkey * 37 % 5000 AS INTEGER)"
FEATS = f"feats AS (SELECT l_orderkey AS k, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS f, {_AT} AS s, {_AT} + CAST(l_quantity AS INTEGER) AS e, l_returnflag || l_linestatus AS label, CASE WHEN l_linenumber = 7 THEN 'primer_bind' ELSE 'misc_feature' END AS type FROM lineitem)"
WIDE = FEATS + ", wide AS (SELECT k, f, s, s + (e - s) * 20 AS e, label, type FROM feats)"
CROWD = "crowd AS (SELECT k, f, pos AS s, pos + CAST(q AS INTEGER) * CASE WHEN l_linenumber = 1 THEN 40 ELSE 1 END AS e, CASE WHEN k % 11 = 0 THEN 'copy' ELSE l_returnflag || l_linestatus END AS label FROM (SELECT *, l_suppkey AS k, l_quantity AS q, CAST((l_partkey * 37 + l_orderkey * 11) % 200000 AS INTEGER) AS pos, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS INTEGER) AS f FROM lineitem))"
PARTS = WIDE + """, pw AS (SELECT *, (e - s) // 5 AS w FROM wide),
parts AS (SELECT k, f, s, e, label, type, CAST(nth AS INTEGER) AS nth, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(d AS INTEGER) AS d FROM (
 SELECT *, 0 AS nth, s AS a, s + w AS b, 1 AS d FROM pw WHERE f % 3 = 0 UNION ALL SELECT *, 1, s + 2 * w, e, 1 FROM pw WHERE f % 3 = 0
 UNION ALL SELECT *, 0, s + 4 * w, e, -1 FROM pw WHERE f % 3 = 1 UNION ALL SELECT *, 1, s + 2 * w, s + 3 * w, -1 FROM pw WHERE f % 3 = 1 UNION ALL SELECT *, 2, s, s + w, -1 FROM pw WHERE f % 3 = 1
 UNION ALL SELECT *, 0, s, e, 1 FROM pw WHERE f % 3 = 2))"""
TARGETS = "targets AS (SELECT id, s, length(s) // 2 AS t_s, length(s) // 2 + 30 AS t_e FROM seqs WHERE length(s) >= 120)"
CLS = "cls AS (SELECT min(id) AS id, s FROM seqs GROUP BY s)"
KMERS = f"k AS (SELECT DISTINCT id, least(w, {_rc('w')}) AS km FROM (SELECT id, substr(ext, i, 31) AS w FROM (SELECT id, s || substr(s, 1, 30) AS ext, unnest(range(1, length(s) + 1)) AS i FROM cls WHERE length(s) >= 31)))"
REL = "n AS (SELECT id, count(*) AS n FROM k GROUP BY id), sh AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM k a JOIN k b ON a.km = b.km AND a.id < b.id GROUP BY 1, 2), rel AS (SELECT a, b, shared, shared / (x.n + y.n - shared) AS jaccard, shared / least(x.n, y.n) AS containment FROM sh JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE shared / least(x.n, y.n) >= 0.5), kinds AS (SELECT *, CASE WHEN jaccard >= 0.99 THEN 'identical' WHEN containment >= 0.98 THEN 'subset' WHEN jaccard >= 0.8 THEN 'variant' ELSE 'related' END AS kind FROM rel)"


def _masked(x: str, word: str) -> str:
    """x with N where the word has N."""
    parts, i = [], 0
    while i < len(word):
        k = i
        while k < len(word) and (word[k] == "N") == (word[i] == "N"):
            k += 1
        parts.append(f"'{'N' * (k - i)}'" if word[i] == "N" else f"substr({x}, {i + 1}, {k - i})")
        i = k
    return " || ".join(parts)


def _words() -> tuple[str, list[str]]:
    """The words of all sites on both strands, and a word for each pattern of N."""
    from itertools import product

    out, pair = set(), str.maketrans("ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN")
    for n, site, size, top, ovhg, *_ in _ENZ:
        back = site.translate(pair)[::-1]
        for x, off in {(site, top), (back, top if back == site else size - (top - ovhg))}:
            for w in map("".join, product(*["N" if c == "N" else LETTERS[c] for c in x])):
                out.add((n, off, ovhg, w, "".join("N" if c == "N" else "x" for c in w)))
    return f"words AS (SELECT * FROM {_values(sorted(out), ['name', 'off', 'ovhg', 'word', 'pattern'])})", sorted({w[4] for w in out})


_WORDS, _PATTERNS = _words()
CUTS = f"{_WORDS}, win AS ({' UNION ALL '.join(f"SELECT id, len, i, '{k}' AS pattern, {_masked(f'substr(ext, i, {len(k)})', k)} AS w FROM (SELECT id, length(s) AS len, s || substr(s, 1, {len(k) - 1}) AS ext, unnest(range(1, length(s) + 1)) AS i FROM seqs WHERE length(s) >= {len(k)})" for k in _PATTERNS)}), hit AS (SELECT DISTINCT id, name AS enzyme, CAST((i - 1 + off + len) % len AS INTEGER) AS top, CAST((i - 1 + off + len) % len - ovhg AS INTEGER) AS bottom FROM win JOIN words ON win.pattern = words.pattern AND w = word), cuts AS (SELECT *, CAST(count(*) OVER (PARTITION BY id, enzyme) AS INTEGER) AS n_cuts FROM hit)"
_STRAT = "CASE WHEN regexp_matches({a}.ovhg_seq || {b}.ovhg_seq, '[^ACGT]') THEN NULL WHEN {a}.name = {b}.name THEN 'same_enzyme' WHEN {a}.kind = 'blunt' AND {b}.kind = 'blunt' THEN 'blunt' WHEN {a}.kind <> 'blunt' AND {a}.kind = {b}.kind AND {a}.ovhg_seq = {b}.ovhg_seq THEN 'compatible_overhang' END"
GUARD = "guarded AS (SELECT id, 'left arm' AS label, t_s - 50 AS p_s, t_s - 40 AS p_e FROM targets UNION ALL SELECT id, 'right arm', t_e + 40, t_e + 50 FROM targets)"
PAIRS = f"""cut_at AS (SELECT c.id, c.top, c.n_cuts, t.t_s, t.t_e, e.* FROM cuts c JOIN targets t ON c.id = t.id JOIN enz e ON e.name = c.enzyme),
raw AS (SELECT u.id, u.t_s, u.t_e, u.name AS up, d.name AS down, u.top AS u_top, d.top AS d_top, u.canonical AS cu, d.canonical AS cd, {_STRAT.format(a='u', b='d')} AS strategy, CASE WHEN {_STRAT.format(a='u', b='d')} IS NULL THEN 'incompatible ends' END AS st
 FROM cut_at u JOIN cut_at d ON u.id = d.id WHERE u.n_cuts = 1 AND d.n_cuts = 1 AND u.top <= u.t_s AND d.top >= d.t_e
 UNION ALL SELECT id, t_s, t_e, name, name, min(top), max(top), canonical, canonical, 'same_enzyme', CASE WHEN NOT (min(top) <= t_s AND max(top) >= t_e) THEN 'enzyme cuts twice but not flanking the target' END FROM cut_at WHERE n_cuts = 2 AND NOT regexp_matches(ovhg_seq, '[^ACGT]') GROUP BY id, t_s, t_e, name, canonical),
hurt AS (SELECT r.id, up, down, u_top, d_top, arg_min(label, p_s) AS hurt FROM raw r JOIN guarded g ON g.id = r.id AND u_top < p_e AND p_s < d_top WHERE st IS NULL GROUP BY ALL),
pairs AS (SELECT r.*, coalesce(st, 'would damage ' || hurt) AS status, d_top - u_top - (t_e - t_s) AS collateral, CASE strategy WHEN 'same_enzyme' THEN 0 WHEN 'compatible_overhang' THEN 1 ELSE 2 END AS sr FROM raw r LEFT JOIN hurt h USING (id, up, down, u_top, d_top)),
dedup AS (SELECT *, row_number() OVER (PARTITION BY id, least(cu, cd), greatest(cu, cd), u_top, d_top ORDER BY sr, collateral, cu, cd, up, down) AS dup FROM pairs WHERE status IS NULL)"""
_NN = " ".join(f"WHEN '{k}' THEN {{{i}}}" for i, k in enumerate(NEIGHBOURS))


def _nn(which: int) -> str:
    return "CASE p " + " ".join(f"WHEN '{k}' THEN CAST({v[which]} AS DOUBLE)" for k, v in NEIGHBOURS.items()) + " END"


def _ends(which: int) -> str:
    one = lambda e: f"CASE WHEN {e} IN ('A', 'T') THEN CAST({END_AT[which]} AS DOUBLE) ELSE CAST({END_GC[which]} AS DOUBLE) END"
    return f"({one('left(seq, 1)')} + {one('right(seq, 1)')})"


PRIMERS = f"""grown AS (SELECT id, s, t_s, t_e, CAST(unnest(range(18, 33)) AS INTEGER) AS len FROM targets),
cand AS (SELECT id, 'forward' AS role, len, substr(s || s || s, length(s) + t_e + 1, len) AS seq FROM grown UNION ALL SELECT id, 'reverse', len, {_rc('substr(s || s || s, length(s) + t_s - len + 1, len)')} FROM grown),
nn AS (SELECT id, role, len, sum({_nn(0)}) AS h, sum({_nn(1)}) AS sv FROM (SELECT id, role, len, substr(seq, i, 2) AS p FROM (SELECT *, unnest(range(1, len)) AS i FROM cand)) GROUP BY ALL),
timed AS (SELECT c.*, 1000 * (h + {_ends(0)}) / (sv + {_ends(1)} + 0.368 * (len - 1) * ln(0.05) + 1.987 * ln(12.5e-9)) - 273.15 AS tm, 100.0 * length(regexp_replace(seq, '[^GC]', '', 'g')) / len AS gc FROM cand c JOIN nn USING (id, role, len)),
scored AS (SELECT *, abs(tm - 60) + CASE WHEN gc < 35 THEN 5 + 0.2 * (35 - gc) WHEN gc > 65 THEN 5 + 0.2 * (gc - 65) ELSE 0 END + CASE WHEN right(seq, 1) IN ('G', 'C') THEN 0 ELSE 2 END + CASE WHEN length(regexp_replace(right(seq, 5), '[^GC]', '', 'g')) > 3 THEN 2 ELSE 0 END + CASE WHEN regexp_matches(seq, 'AAAA|CCCC|GGGG|TTTT') THEN 2 ELSE 0 END
 + greatest(0, coalesce(list_max(list_filter(range(5, 13), lambda w: len(list_filter(range(1, len + 2 - w), lambda i: contains({_rc('seq')}, substr(seq, i, w)))) > 0)), 0) - 5) + CASE WHEN contains(substr(seq, 1, len - 5), {_rc('right(seq, 5)')}) THEN 3 ELSE 0 END AS penalty FROM timed),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9), f_len, r_len) AS rn FROM (SELECT f.id, f.len AS f_len, r.len AS r_len, f.seq AS f_seq, r.seq AS r_seq, f.tm AS f_tm, r.tm AS r_tm, f.penalty + r.penalty + 2 * abs(f.tm - r.tm) AS score FROM scored f JOIN scored r ON f.id = r.id AND f.role = 'forward' AND r.role = 'reverse'))"""
HITS = f"strands AS (SELECT query_id, q, 1 AS strand FROM probes UNION ALL SELECT query_id, {_rc('q')}, -1 FROM probes WHERE {_rc('q')} <> q), hits AS (SELECT query_id, id, CAST(unnest(list_filter(range(0, length(s)), lambda i: substr(ext, i + 1, length(q)) = q)) AS INTEGER) AS start, strand FROM (SELECT *, s || substr(s, 1, length(q) - 1) AS ext FROM strands JOIN seqs ON length(q) <= length(s)) WHERE contains(ext, q))"
REPEATS = "(SELECT {id}, sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c) AS rf FROM (SELECT {id}, w, count(*) AS c FROM (SELECT {id}, substr({s}, i, {w}) AS w FROM (SELECT {id}, {s}, unnest(range(1, length({s}) - {w} + 2)) AS i FROM {t} WHERE length({s}) >= {w})) GROUP BY ALL) GROUP BY {id})"
_HOMO = "coalesce(list_max(list_transform(regexp_extract_all({s}, 'A+|C+|G+|T+'), lambda x: length(x))), 0)"
_GC = "100.0 * length(regexp_replace({s}, '[^GCS]', '', 'g')) / length({s})"
_HE = "CASE WHEN abs({x} - trunc({x}) - 0.5) < 1e-9 THEN 2 * round({x} / 2) ELSE round({x}) END"
STOCK = "CASE WHEN {c} > 0 THEN {c} / 10 END"
VD = "vd AS (SELECT v.id AS id, v.s AS v, length(v.s) // 2 AS v_s, length(v.s) // 2 AS v_e, w.s AS d, length(w.s) // 2 AS d_s, length(w.s) // 2 + 30 AS d_e FROM seqs v JOIN seqs w ON w.id = v.id + 1 WHERE length(v.s) >= 120 AND length(w.s) >= 120)"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def _dilution(c: str) -> str:
    """Nested rules for a target of 1 ng/µL."""
    ladder = BENCH["pcr"]["dilution_ladder_ul"]
    fit = lambda n: "CASE " + " ".join(f"WHEN CAST({float(v)} AS DOUBLE) / ({c} / {100.0**n}) >= 1 THEN {float(v)}" for v in ladder) + " END"
    steps = " ".join(f"WHEN {fit(n)} IS NOT NULL THEN {n}" for n in range(4))
    final = " ".join(f"WHEN {fit(n)} IS NOT NULL THEN {fit(n)}" for n in range(4))
    ok = f"{c} > 1"
    return f"CASE WHEN {c} IS NULL THEN 'unknown' WHEN {c} <= 1 THEN 'neat' ELSE 'ok' END AS status, CASE WHEN {ok} THEN CASE {steps} END ELSE 0 END AS pre_steps, CASE WHEN {ok} THEN CASE {final} END END AS final_ul, {c} AS c"


def _stocked(rows) -> str:
    return f"stocked AS (SELECT DISTINCT s_suppkey, name FROM (SELECT s_suppkey, unnest([s_suppkey * 5 % {len(rows)}, s_suppkey * 11 % {len(rows)}, (s_suppkey * 17 + 3) % {len(rows)}]) AS i FROM supplier) JOIN (SELECT name, row_number() OVER (ORDER BY name) - 1 AS i FROM enz) USING (i))"


_LOOKUP = _with(ENZ, COND) + ", sold AS (SELECT site, top_off, ovhg, min(c.name) AS sold_as FROM enz JOIN cond c USING (name) GROUP BY 1, 2, 3) SELECT e.name AS enzyme, c.name AS sold_as, c.temp_c, c.minutes, c.bp_from_end, c.inactivation, c.star_h FROM enz e LEFT JOIN cond o ON o.name = e.name LEFT JOIN sold s ON s.site = e.site AND s.top_off = e.top_off AND s.ovhg = e.ovhg LEFT JOIN cond c ON c.name = coalesce(o.name, s.sold_as)"
SQL = {
    "seq_projections": _with(SEQS) + f"SELECT id, CAST(length(s) AS INTEGER) AS length, md5({_rc('s')}) AS rc_md5, round({_GC.format(s='s')}, 6) AS gc, CAST({_HOMO.format(s='s')} AS INTEGER) AS homopolymer, substr(s || s || s, length(s) - 2, 6) AS origin, md5(substr(s, 2) || substr(s, 1, 1)) AS turned_md5 FROM seqs",
    "rotation_fingerprint": _with(SHORT, CANON) + "SELECT id, canonical, substr(sha256(canonical), 1, 16) AS fingerprint FROM canon",
    "rotation_offsets": _with(SHORT) + "SELECT id, CAST(instr(s || s, t) - 1 AS INTEGER) AS \"offset\", true AS same_circle, CAST(NULL AS INTEGER) AS other_length FROM (SELECT id, s, substr(s, id % length(s) + 1) || substr(s, 1, id % length(s)) AS t FROM shorts)",
    "fingerprint_long": _with(SEQS, LONG) + "SELECT id, fingerprint, min(id) OVER (PARTITION BY fingerprint) AS class_id FROM prints",
    "streaming_ingest": _with(SEQS, LONG) + "SELECT id, CAST(length(s) AS INTEGER) AS length, fingerprint FROM seqs JOIN prints USING (id)",
    "dup_groups": _with(SEQS, LONG) + "SELECT fingerprint, min(id) AS class_id, count(*) AS n FROM prints GROUP BY 1 HAVING count(*) > 1",
    "short_dup_groups": _with(SHORT, CANON) + "SELECT substr(sha256(canonical), 1, 16) AS fingerprint, min(id) AS class_id, count(*) AS n FROM canon GROUP BY 1 HAVING count(*) > 1",
    "kmer_relationships": _with(SEQS, CLS, KMERS, REL) + "SELECT a, b, shared, round(jaccard, 6) AS jaccard, round(containment, 6) AS containment, kind FROM kinds",
    "lineage": _with(SEQS, CLS, KMERS, REL) + "SELECT CASE WHEN length(y.s) < length(x.s) THEN b ELSE a END AS smaller, CASE WHEN length(y.s) < length(x.s) THEN a ELSE b END AS larger, round(containment, 6) AS containment FROM kinds JOIN cls x ON x.id = a JOIN cls y ON y.id = b WHERE containment >= 0.98 AND jaccard < 0.99",
    "library_report": _with(SEQS, CLS, KMERS, REL, LONG) + "SELECT (SELECT count(*) FROM prints) AS n_circles, (SELECT count(DISTINCT fingerprint) FROM prints) AS n_distinct, (SELECT count(*) FROM (SELECT fingerprint FROM prints GROUP BY 1 HAVING count(*) > 1)) AS n_duplicate_groups, (SELECT count(*) FROM kinds WHERE kind <> 'related') AS n_near_pairs",
    "provenance_hits": _with(SEQS, PROBES, HITS) + "SELECT query_id, id, start, strand FROM hits",
    "complexity_metrics": _with(SEQS) + f"SELECT id, CAST(length(s) AS INTEGER) AS length, {_HE.format(x='(' + _GC.format(s='s') + ' * 10)')} / 10 AS gc, CAST({_HOMO.format(s='s')} AS INTEGER) AS homopolymer, round(coalesce(rf, 0.0), 6) AS repeat_fraction FROM seqs LEFT JOIN {REPEATS.format(id='id', s='s', w=20, t='seqs')} USING (id)",
    "insert_ladder": _with(SEQS, PROBES, HITS) + f""", don AS (SELECT query_id, count(DISTINCT id) AS n_donors, count(DISTINCT CASE WHEN strand = -1 THEN id END) AS flipped FROM hits GROUP BY 1),
 rep AS (SELECT DISTINCT query_id FROM (SELECT query_id, w FROM (SELECT query_id, q, substr(q, i, 41) AS w FROM (SELECT query_id, q, unnest(range(1, length(q) - 39)) AS i FROM probes WHERE length(q) >= 82)) GROUP BY query_id, w HAVING count(*) > 1))
 SELECT query_id, route, coalesce(n_donors, 0) AS n_donors, coalesce(flipped, 0) AS flipped, route = 'synthesize' OR route = 'order_plasmid' AS must_order FROM (SELECT query_id, n_donors, flipped, CASE WHEN n_donors > 0 THEN 'from_inventory' WHEN length(q) >= 125 AND length(q) <= 3000 AND gc >= 25 AND gc <= 75 AND {_HOMO.format(s='q')} <= 9 AND rep.query_id IS NULL AND round(coalesce(rf, 0), 3) <= 0.35 THEN 'synthesize' ELSE 'order_plasmid' END AS route FROM (SELECT *, round({_GC.format(s='q')}, 1) AS gc FROM probes) p LEFT JOIN don USING (query_id) LEFT JOIN rep USING (query_id) LEFT JOIN {REPEATS.format(id='query_id', s='q', w=20, t='probes')} USING (query_id))""",
    "backbone_ladder": "WITH ok AS (SELECT * FROM customer WHERE c_name NOT IN (SELECT c_name FROM customer WHERE c_acctbal > 2000)), c AS (SELECT c_nationkey AS goal, c_name AS c, row_number() OVER (PARTITION BY c_nationkey ORDER BY -c_acctbal, c_name) AS r FROM ok WHERE c_mktsegment <> 'BUILDING'), b AS (SELECT c_nationkey AS goal, c_name AS b, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey, c_name) AS r FROM ok WHERE c_mktsegment = 'BUILDING') SELECT n_nationkey AS goal, CASE WHEN c IS NOT NULL THEN 'from_construct' WHEN b IS NOT NULL THEN 'from_base_vector' ELSE 'order_backbone' END AS route, coalesce(c, b) AS label FROM nation LEFT JOIN (SELECT * FROM c WHERE r = 1) c ON c.goal = n_nationkey LEFT JOIN (SELECT * FROM b WHERE r = 1) b ON b.goal = n_nationkey",
    "tight_arc": _with(FEATS) + ", g AS (SELECT k, s, e, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM feats), w AS (SELECT k, s, b, row_number() OVER (PARTITION BY k ORDER BY s - b DESC, s) AS r FROM g WHERE b IS NOT NULL), x AS (SELECT k, min(s) AS lo, max(e) AS hi FROM feats GROUP BY k) SELECT x.k, CASE WHEN s - b > lo + 5000 - hi THEN s ELSE lo END AS arc_start, CASE WHEN s - b > lo + 5000 - hi THEN b + 5000 ELSE hi END AS arc_end FROM x LEFT JOIN w ON w.k = x.k AND w.r = 1",
    "feature_classes": _with(WIDE) + ", t AS (SELECT k, s AS t_s, e AS t_e FROM wide WHERE f = 1), c AS (SELECT w.*, CASE WHEN s >= t_s AND e <= t_e THEN 'removed' WHEN s <= t_s AND e >= t_e THEN 'umbrella' ELSE 'protected' END AS class FROM wide w JOIN t USING (k) WHERE type NOT IN ('primer_bind', 'primer', 'source')) SELECT k, f, class, CASE WHEN class = 'protected' THEN s - 10 ELSE s END AS p_s, CASE WHEN class = 'protected' THEN e + 10 ELSE e END AS p_e, class = 'removed' AND label LIKE '%N%' AS contradiction FROM c",
    "essential_hints": "SELECT p_partkey, regexp_matches(lower(p_name), 'ori|ampr|neor|kanr|puro|blast|bsd|hygro') AS essential, lower(p_type) LIKE '%steel%' OR lower(p_type) LIKE '%brass%' AS metal FROM part",
    "overlap_pairs": _with(WIDE) + "SELECT x.k, x.f AS a, y.f AS b FROM wide x JOIN wide y ON x.k = y.k AND x.f < y.f AND x.s < y.e AND y.s < x.e",
    "nested_pairs": _with(WIDE) + "SELECT x.k, x.f AS \"outer\", y.f AS \"inner\", x.label AS outer_label, y.label AS inner_label FROM wide x JOIN wide y ON x.k = y.k AND x.s <= y.s AND y.e <= x.e AND x.e - x.s > y.e - y.s",
    "repeat_arrays": _with(CROWD) + "SELECT k, f AS \"array\", label, copies FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY f) AS r FROM (SELECT x.k, x.f, count(*) AS copies, count(DISTINCT y.label) AS kinds, min(y.label) AS label FROM crowd x JOIN crowd y ON x.k = y.k AND x.s <= y.s AND y.e <= x.e AND x.e - x.s > y.e - y.s GROUP BY 1, 2) WHERE kinds = 1 AND copies >= 3) WHERE r = 1",
    "crowded_overlaps": _with(CROWD) + "SELECT x.k, x.f AS a, y.f AS b FROM crowd x JOIN crowd y ON x.k = y.k AND x.f < y.f AND x.s < y.e AND y.s < x.e",
    "feature_pruning": _with(WIDE) + ", a AS (SELECT *, label LIKE '%AF%' AS keep FROM wide WHERE type <> 'primer_bind' AND (e - s >= 60 OR label LIKE '%AF%')), b AS (SELECT * FROM a WHERE keep OR (SELECT count(DISTINCT y.label) FROM a y WHERE y.k = a.k AND a.s <= y.s AND y.e <= a.e AND a.e - a.s > y.e - y.s) < 2), c AS (SELECT * FROM b WHERE keep OR NOT EXISTS (SELECT 1 FROM b y WHERE y.k = b.k AND y.s <= b.s AND b.e <= y.e AND y.e - y.s > b.e - b.s)) SELECT k, f, s, e, label FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY keep DESC, e - s DESC, s, f) AS r FROM c) WHERE r <= 3",
    "feature_remap_insert": _with(FEATS) + ", m AS (SELECT k, f, type, e - s AS w, CASE WHEN s < 2500 THEN s ELSE s + 300 END AS ns, CASE WHEN e <= 2500 THEN e ELSE e + 300 END AS ne FROM feats) SELECT k, f, ns AS s, ne AS e, ne - ns <> w AS truncated FROM m WHERE ne > ns AND NOT (ne - ns <> w AND type = 'primer_bind')",
    "feature_remap_delete": _with(FEATS) + ", m AS (SELECT k, f, type, e - s AS w, CASE WHEN s < 1000 THEN s WHEN s >= 2000 THEN s - 1000 ELSE 1000 END AS ns, CASE WHEN e <= 1000 THEN e WHEN e >= 2000 THEN e - 1000 ELSE 1000 END AS ne FROM feats) SELECT k, f, ns AS s, ne AS e, ne - ns <> w AS truncated FROM m WHERE ne > ns AND NOT (ne - ns <> w AND type = 'primer_bind')",
    "feature_rotation": _with(FEATS) + "SELECT k, f, (s - 1234 + 5000) % 5000 AS turned_s, (s - 1234 + 5000) % 5000 + e - s AS turned_e, greatest(s - greatest(300, (e - s) // 4), 0) AS zoom_s, least(e + greatest(300, (e - s) // 4), 5000) AS zoom_e FROM feats",
    "named_spans": _with(WIDE) + "SELECT k, label, s, e FROM (SELECT *, row_number() OVER (PARTITION BY k, label ORDER BY e - s DESC, s) AS r FROM wide WHERE label LIKE '%A%') WHERE r = 1",
    "graft_features": _with(FEATS) + "SELECT k, f, CASE WHEN f > 2 THEN s + 100 ELSE s END AS s, CASE WHEN f > 2 THEN e + 100 ELSE e END AS e FROM feats",
    "cut_sites": _with(SEQS, CUTS) + "SELECT id, enzyme, top, bottom, n_cuts FROM cuts",
    "unique_cutters": _with(SEQS, CUTS) + "SELECT id, enzyme, top, nth, total FROM (SELECT id, enzyme, top, CAST(row_number() OVER (PARTITION BY id ORDER BY top, enzyme) AS INTEGER) AS nth, count(*) OVER (PARTITION BY id) AS total FROM cuts WHERE n_cuts = 1) WHERE nth <= 40",
    "ligation_pairs": _with(ENZ, _stocked(_ENZ)) + f"SELECT x.s_suppkey, a.name AS a, b.name AS b, {_STRAT.format(a='a', b='b')} AS strategy FROM stocked x JOIN stocked y USING (s_suppkey) JOIN enz a ON a.name = x.name JOIN enz b ON b.name = y.name WHERE {_STRAT.format(a='a', b='b')} IS NOT NULL",
    "enzyme_dimension": _with(ENZ, _stocked(_ENZ)) + "SELECT s_suppkey, enz.* FROM stocked JOIN enz USING (name)",
    "excision_best": _with(SEQS, CUTS, ENZ, TARGETS, GUARD, PAIRS) + "SELECT id, up, down, u_top, d_top, strategy, CAST(collateral AS INTEGER) AS collateral FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sr, collateral, cu, cd, up, down) AS r FROM dedup WHERE dup = 1) WHERE r = 1",
    "excision_reasons": _with(SEQS, CUTS, ENZ, TARGETS, GUARD, PAIRS) + "SELECT id, status AS reason, count(*) AS n FROM pairs WHERE status IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT id, 'duplicate of an equischizomer', count(*) FROM dedup WHERE dup > 1 GROUP BY 1 UNION ALL SELECT id, 'enzyme cuts more than twice', count(DISTINCT enzyme) FROM cuts JOIN targets USING (id) WHERE n_cuts > 2 GROUP BY 1 UNION ALL SELECT id, 'no unique site upstream of the target', 1 FROM targets t WHERE NOT EXISTS (SELECT 1 FROM cuts c WHERE c.id = t.id AND n_cuts = 1 AND top <= t_s) UNION ALL SELECT id, 'no unique site downstream of the target', 1 FROM targets t WHERE NOT EXISTS (SELECT 1 FROM cuts c WHERE c.id = t.id AND n_cuts = 1 AND top >= t_e)",
    "primer_candidates": _with(SEQS, TARGETS, PRIMERS) + "SELECT id, role, len, seq, round(tm, 4) AS tm, round(gc, 4) AS gc, round(penalty, 4) AS penalty FROM scored",
    "primer_pairs": _with(SEQS, TARGETS, PRIMERS) + "SELECT id, f_len, r_len, f_seq, r_seq, round(score, 4) AS score FROM best WHERE rn = 1",
    "pcr_deletions": _with(SEQS, TARGETS, PRIMERS) + f"""SELECT t.id, length(s) - 64 > 30 AS feasible, f_seq, r_seq, substr(s || s || s, length(s) + t_s - 9, 10) AS f_tail, {_rc("substr(s || s || s, length(s) + t_e + 1, 10)")} AS r_tail, CAST(length(s) - 30 + 20 AS INTEGER) AS amplicon_bp, CAST(greatest(15, {_HE.format(x='((length(s) - 10) / 1000 * 30)')}) AS INTEGER) AS extension_s, md5(substr(s, 1, t_s) || substr(s, t_e + 1)) AS product_md5,
 array_to_string(list_filter([CASE WHEN length(s) - 30 + 20 > 6000 THEN 'amplicon over 6 kb' END, CASE WHEN abs(f_tm - 60) > 3 THEN 'forward temperature off target' END, CASE WHEN abs(r_tm - 60) > 3 THEN 'reverse temperature off target' END, CASE WHEN abs(f_tm - r_tm) > 3 THEN 'temperatures differ' END], lambda x: x IS NOT NULL), ';') AS warnings FROM targets t LEFT JOIN (SELECT * FROM best WHERE rn = 1) b ON b.id = t.id""",
    "insertion_homology": _with(SEQS, VD) + f", a AS (SELECT id, v, d, substr(v || v || v, length(v) + v_s - 24, 25) AS up_arm, substr(v || v || v, length(v) + v_e + 1, 25) AS down_arm, substr(d, d_s + 1, 30) AS ins, v_s FROM vd) SELECT id, up_arm, down_arm, up_arm || ins || down_arm AS \"order\", md5(substr(v, 1, v_s) || ins || substr(v, v_s + 1)) AS product_md5, array_to_string(list_filter(['order under 125 bases', 'insert under 200 bases assembles poorly', CASE WHEN len(list_filter(range(1, length(v) + 1), lambda i: substr(v || substr(v, 1, 24), i, 25) = up_arm)) > 1 THEN 'upstream arm occurs twice in the vector' END, CASE WHEN len(list_filter(range(1, length(v) + 1), lambda i: substr(v || substr(v, 1, 24), i, 25) = down_arm)) > 1 THEN 'downstream arm occurs twice in the vector' END], lambda x: x IS NOT NULL), ';') AS warnings, true AS verified FROM a",
    "insertion_openings": _with(SEQS, CUTS, ENZ, VD) + ", c AS (SELECT id, enzyme, top, v_s, CASE WHEN enzyme IN ('XhoI', 'PaeR7I') THEN 9 ELSE 0 END AS sup FROM cuts JOIN vd USING (id) WHERE n_cuts = 1) SELECT id, ue, ut, de, dt FROM (SELECT u.id, u.enzyme AS ue, u.top AS ut, d.enzyme AS de, d.top AS dt, row_number() OVER (PARTITION BY u.id ORDER BY d.top - u.top, -(u.sup + d.sup), u.enzyme, d.enzyme) AS r FROM c u JOIN c d ON u.id = d.id WHERE u.top <= u.v_s AND d.top >= d.v_s AND d.top - u.top <= 200) WHERE r = 1",
    "ng_fmol": f"WITH p AS (SELECT p_partkey, p_size, p_size * 100 + 37 AS bp FROM part) SELECT p_partkey, round(100.0 * 1e6 / (bp * 650), 6) AS fmol, round(100.0 * 1e6 / (bp * 650) * 3 * bp * 650 / 1e6, 6) AS ng, round(15.0 * bp * 660 / 1e6, 6) AS ligation_ng, CAST(CASE WHEN bp < 500 THEN 1.5 WHEN bp < 1000 THEN 1.2 ELSE 1.0 END AS DOUBLE) AS gel, CAST(greatest(15, {_HE.format(x='(bp / 1000 * CASE WHEN p_size % 2 = 0 THEN 45 ELSE 30 END)')}) AS INTEGER) AS extension_s, greatest(bp, 600) >= 5 * least(bp, 600) AS caveat FROM p",
    "dilution_plans": f"WITH x AS (SELECT s_suppkey, {STOCK.format(c='s_acctbal')} AS c0 FROM supplier), y AS (SELECT s_suppkey, {_dilution('c0')} FROM x) SELECT s_suppkey, status, CAST(pre_steps AS INTEGER) AS pre_steps, round(CAST(final_ul AS DOUBLE), 4) AS final_ul, round(final_ul / (c / power(100.0, pre_steps)), 4) AS take_ul, round(final_ul - final_ul / (c / power(100.0, pre_steps)), 4) AS water_ul FROM y",
    "gibson_mixes": f"WITH x AS (SELECT c_custkey AS reaction, 5000 + c_custkey % 1000 AS b, {STOCK.format(c='c_acctbal')} AS c, 100 + c_custkey % 77 AS i FROM customer), y AS (SELECT *, 1e8 / (b * 650) AS fm FROM x), r AS (SELECT reaction, 0 AS nth, '{BENCH['gibson']['master_mix']}' AS component, CAST(NULL AS DOUBLE) AS ng, CAST(NULL AS DOUBLE) AS fmol, 5.0::DOUBLE AS ul FROM y UNION ALL SELECT reaction, 1, 'backbone', 100.0, fm, 100 / c FROM y UNION ALL SELECT reaction, 2, 'insert', fm * 3 * i * 650 / 1e6, fm * 3, fm * 3 * i * 650 / 1e6 / 10 FROM y), w AS (SELECT * FROM r UNION ALL SELECT reaction, 99, 'water', NULL, NULL, CASE WHEN count(ul) = 3 THEN 10 - sum(ul) END FROM r GROUP BY reaction) SELECT reaction, CAST(nth AS INTEGER) AS nth, component, round(ng, 6) AS ng, round(fmol, 6) AS fmol, round(ul, 6) AS ul FROM w",
    "ligation_mixes": f"WITH x AS (SELECT c_custkey AS reaction, 7000 + c_custkey % 1000 AS b, {STOCK.format(c='c_acctbal')} AS c FROM customer), r AS (SELECT reaction, 0 AS nth, 'backbone' AS component, CAST(15 AS DOUBLE) * b * 660 / 1e6 AS ng, CAST(15 AS DOUBLE) * b * 660 / 1e6 / c AS ul FROM x UNION ALL SELECT reaction, 1, 'insert', CAST(75 AS DOUBLE) * 300 * 660 / 1e6, CAST(75 AS DOUBLE) * 300 * 660 / 1e6 / 3.3 FROM x UNION ALL SELECT reaction, 2, '10x T4 DNA ligase buffer', NULL, 2 FROM x UNION ALL SELECT reaction, 3, 'T4 DNA ligase', NULL, 1 FROM x), w AS (SELECT * FROM r UNION ALL SELECT reaction, 99, 'water', NULL, CASE WHEN count(ul) = 4 THEN 20 - sum(ul) END FROM r GROUP BY reaction) SELECT reaction, CAST(nth AS INTEGER) AS nth, component, round(CAST(ng AS DOUBLE), 6) AS ng, round(CAST(ul AS DOUBLE), 6) AS ul FROM w",
    "conditions_lookup": _LOOKUP.replace("FROM enz e LEFT JOIN", "FROM stocked k JOIN enz e USING (name) LEFT JOIN").replace("SELECT e.name AS enzyme", "SELECT s_suppkey, e.name AS enzyme").replace(", sold AS", f", {_stocked(_ENZ)}, sold AS"),
    "genbank_round_trip": _with(SEQS) + "SELECT id, left(regexp_replace('d' || id || ' a/' || left(s, 20), '[^A-Za-z0-9_.-]', '_', 'g'), 16) AS name, CAST(length(s) AS INTEGER) AS length, md5(s) AS md5, true AS circular FROM seqs",
    "search_caps": "SELECT q, c_custkey, nth, total FROM (SELECT c_nationkey AS q, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS nth, count(*) OVER (PARTITION BY c_nationkey) AS total FROM customer) WHERE nth <= 12",
    "source_union_first_owner": "SELECT s_suppkey AS plasmid_id, s_name AS label, 0 AS source FROM supplier UNION ALL SELECT c_custkey, c_name, 1 FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)",
    "scan_dead_letter": f"WITH x AS (SELECT page_id, url, {_dna('html')} AS s FROM pages) SELECT page_id AS plasmid_id, CASE WHEN page_id % 3 = 0 AND s <> '' THEN CAST(length(s) AS INTEGER) END AS length, CASE WHEN page_id % 3 <> 0 THEN 'expected one record, found 0' WHEN s = '' THEN 'the record has no sequence' END AS error FROM x",
}
_DIG = f"dig AS (SELECT DISTINCT s_suppkey AS digest, name AS enzyme FROM (SELECT s_suppkey, unnest([s_suppkey % {len(_ENZ)}, s_suppkey * 7 % {len(_ENZ)}]) AS i FROM supplier) JOIN (SELECT name, row_number() OVER (ORDER BY name) - 1 AS i FROM enz) USING (i))"
_LOOK = "look AS (" + _LOOKUP.partition(", sold AS")[2].join(["WITH sold AS", ""]) + ")"
SQL["digest_conditions"] = _with(ENZ, COND, _DIG, _LOOK) + "SELECT digest, CAST(max(try_cast(minutes AS INTEGER)) AS INTEGER) AS minutes, CASE WHEN count(DISTINCT temp_c) = 1 THEN min(temp_c) END AS temp_c, array_to_string(list_sort(coalesce(list(DISTINCT temp_c) FILTER (temp_c IS NOT NULL), [])), ';') AS temps, array_to_string(list_sort(coalesce(list(DISTINCT inactivation) FILTER (inactivation IS NOT NULL AND NOT lower(inactivation) LIKE 'no%'), [])), ';') AS inactivations, array_to_string(list_sort(coalesce(list(DISTINCT sold_as) FILTER (lower(inactivation) LIKE 'no%'), [])), ';') AS no_heat_kill, min(try_cast(star_h AS DOUBLE)) AS star_limit_h, array_to_string(list_sort(coalesce(list(DISTINCT enzyme) FILTER (sold_as IS NULL), [])), ';') AS unknown FROM dig JOIN look USING (enzyme) GROUP BY digest"
_NAMES = "names AS (SELECT replace(c_name, '#', '') || '_' || lower(c_mktsegment) AS label FROM customer), asked AS (SELECT n_name AS asked FROM nation UNION SELECT c_name FROM customer UNION SELECT replace(c_name, '#', '') FROM customer UNION SELECT '0000' || r_regionkey FROM region)"
SQL["resolve_name"] = _with(_NAMES) + ", hit AS (SELECT asked, label, CASE WHEN l = q THEN 1 WHEN split_part(l, '_', 1) = q THEN 2 WHEN starts_with(l, q) THEN 3 WHEN contains(l, q) THEN 4 END AS tier FROM (SELECT asked, lower(trim(asked)) AS q, label, lower(trim(label)) AS l FROM asked, names)), t AS (SELECT asked, min(tier) AS tier FROM hit GROUP BY asked) SELECT t.asked, t.tier, count(h.label) AS n, CASE WHEN count(h.label) = 1 THEN min(h.label) END AS label FROM t LEFT JOIN hit h ON h.asked = t.asked AND h.tier = t.tier GROUP BY t.asked, t.tier"
SQL["target_resolution"] = _with(FEATS) + ", m AS (SELECT * FROM feats WHERE type <> 'primer_bind' AND (label LIKE '%A%' OR label LIKE '%NF%') AND k IN (SELECT o_orderkey FROM orders)), g AS (SELECT k, s, e, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM m), w AS (SELECT k, s, b, row_number() OVER (PARTITION BY k ORDER BY s - b DESC, s) AS r FROM g WHERE b IS NOT NULL), x AS (SELECT k, min(s) AS lo, max(e) AS hi, array_to_string(list_sort(list(DISTINCT label)), ';') AS labels FROM m GROUP BY k) SELECT x.k, CASE WHEN s - b > lo + 5000 - hi THEN s ELSE lo END AS t_s, CASE WHEN s - b > lo + 5000 - hi THEN b + 5000 ELSE hi END AS t_e, labels FROM x LEFT JOIN w ON w.k = x.k AND w.r = 1"
SQL["thermocycler_steps"] = f"WITH p AS (SELECT p_partkey AS id, 50 + p_size / 4 AS c, p_size * 200 + 13 AS bp, p_size % 2 = 0 AS rep FROM part) SELECT id, CAST(nth AS INTEGER) AS nth, step, CAST(celsius AS DOUBLE) AS celsius, CAST(seconds AS INTEGER) AS seconds, CAST(cycles AS INTEGER) AS cycles FROM (SELECT id, 0 AS nth, 'Initial denaturation' AS step, 95.0 AS celsius, 180 AS seconds, 1 AS cycles FROM p UNION ALL SELECT id, 1, 'Denaturation', 98, 20, 30 FROM p UNION ALL SELECT id, 2, 'Annealing', {_HE.format(x='c')}, 15, 30 FROM p UNION ALL SELECT id, 3, 'Extension', 72, greatest(15, {_HE.format(x='(bp / 1000 * CASE WHEN rep THEN 45 ELSE 30 END)')}), 30 FROM p UNION ALL SELECT id, 4, 'Final extension', 72, 120, 1 FROM p)"
SQL["water_balances"] = "WITH u AS (SELECT l_orderkey, sum(CASE WHEN l_discount > 0 THEN l_discount * 10 END) AS used, count(CASE WHEN l_discount > 0 THEN 1 END) = count(*) AS whole FROM lineitem GROUP BY 1) SELECT o_orderkey AS reaction, round(CASE WHEN used IS NULL AND whole IS NULL THEN 2.0 WHEN whole THEN 2.0 - used END, 6) AS water FROM orders LEFT JOIN u ON l_orderkey = o_orderkey"
SQL["site_counts"] = _with(SEQS, CUTS) + "SELECT DISTINCT id, enzyme AS name, n_cuts AS n FROM cuts"
_ROUTES = f"""fl AS (SELECT * FROM (SELECT c.id, 'up' AS side, enzyme, top, row_number() OVER (PARTITION BY c.id ORDER BY v_s - top, enzyme) AS nth FROM cuts c JOIN vd ON c.id = vd.id WHERE n_cuts = 1 AND top <= v_s UNION ALL SELECT c.id, 'down', enzyme, top, row_number() OVER (PARTITION BY c.id ORDER BY top - v_e, enzyme) FROM cuts c JOIN vd ON c.id = vd.id WHERE n_cuts = 1 AND top >= v_e) WHERE nth <= 30),
dc AS (SELECT vd.id, enzyme, top, n_cuts, d_s, d_e FROM cuts c JOIN vd ON c.id = vd.id + 1),
opt AS (SELECT * FROM (SELECT f.id, side, f.enzyme AS ve, f.top AS vt, d.enzyme, d.top, row_number() OVER (PARTITION BY f.id, side, f.enzyme, f.top ORDER BY d.enzyme <> f.enzyme, d.n_cuts, CASE WHEN side = 'up' THEN d_s - d.top ELSE d.top - d_e END, d.enzyme, d.top) AS opt FROM fl f JOIN enz a ON a.name = f.enzyme JOIN dc d ON d.id = f.id JOIN enz b ON b.name = d.enzyme AND a.kind = b.kind AND a.ovhg_seq = b.ovhg_seq AND NOT regexp_matches(a.ovhg_seq, '[^ACGT]') WHERE (side = 'up' AND d.top <= d_s) OR (side = 'down' AND d.top >= d_e)) WHERE opt <= 6),
pr AS (SELECT u.id, u.enzyme AS ue, u.top AS ut, d.enzyme AS de, d.top AS dt FROM fl u JOIN fl d ON u.id = d.id AND u.side = 'up' AND d.side = 'down' AND u.enzyme <> d.enzyme),
met AS (SELECT pr.*, x.enzyme AS ude, x.top AS udt, x.opt AS uo, y.enzyme AS dde, y.top AS ddt, y.opt AS yo FROM pr JOIN opt x ON x.id = pr.id AND x.side = 'up' AND x.ve = ue AND x.vt = ut JOIN opt y ON y.id = pr.id AND y.side = 'down' AND y.ve = de AND y.vt = dt WHERE x.top < y.top),
fit AS (SELECT *, row_number() OVER (PARTITION BY id, ue, ut, de, dt ORDER BY uo, yo) AS r FROM met m WHERE NOT EXISTS (SELECT 1 FROM dc c WHERE c.id = m.id AND c.enzyme IN (ude, dde) AND c.top > udt AND c.top < ddt))"""
# every unique cut and every donor cut for it; a cut whose enzyme cuts again before the fragment ends is in no pair
_WHOLE = _ROUTES.replace(" WHERE nth <= 30", "").replace(" WHERE opt <= 6", "").replace("n_cuts, d_s, d_e FROM cuts c", "n_cuts, d_s, d_e, coalesce(lead(top) OVER w >= d_e, true) AS ahead, coalesce(lag(top) OVER w <= d_s, true) AS behind FROM cuts c").replace("ON c.id = vd.id + 1)", "ON c.id = vd.id + 1 WINDOW w AS (PARTITION BY vd.id, enzyme ORDER BY top))").replace("d.enzyme, d.top, row_number()", "d.enzyme, d.top, d.ahead, d.behind, row_number()").replace("x.vt = ut JOIN", "x.vt = ut AND x.ahead JOIN").replace("y.vt = dt WHERE", "y.vt = dt AND y.behind WHERE")
SQL["insertion_reasons"] = _with(SEQS, CUTS, ENZ, VD, _WHOLE) + "SELECT id, CASE WHEN EXISTS (SELECT 1 FROM opt x WHERE x.id = pr.id AND x.side = 'up' AND x.ve = ue AND x.vt = ut) AND EXISTS (SELECT 1 FROM opt y WHERE y.id = pr.id AND y.side = 'down' AND y.ve = de AND y.vt = dt) THEN 'every candidate enzyme cuts inside the insert fragment' ELSE 'donor lacks a compatible flanking site' END AS reason, count(*) AS n FROM pr WHERE (id, ue, ut, de, dt) NOT IN (SELECT (id, ue, ut, de, dt) FROM fit) GROUP BY 1, 2"
SQL["insertion_routes"] = _with(SEQS, CUTS, ENZ, VD, _WHOLE) + f""", sc AS (SELECT f.id, ue, ut, de, dt, ude, udt, dde, ddt, {_STRAT.format(a='a', b='b')} IS NULL AS directional, ue = ude AND de = dde AS same_enzymes, dt - ut - (v_e - v_s) AS v_extra, ddt - udt - (d_e - d_s) AS d_extra, CASE WHEN ue IN ('XhoI', 'PaeR7I') THEN 9 ELSE 0 END + CASE WHEN de IN ('XhoI', 'PaeR7I') THEN 9 ELSE 0 END AS sup, a.canonical AS cu, b.canonical AS cd, length(v) - (dt - ut) + ddt - udt AS bp FROM fit f JOIN enz a ON a.name = ue JOIN enz b ON b.name = de JOIN vd ON vd.id = f.id WHERE r = 1)
SELECT id, ue, ut, de, dt, ude, udt, dde, ddt, directional, same_enzymes, CAST(v_extra AS INTEGER) AS v_extra, CAST(d_extra AS INTEGER) AS d_extra, true AS verified, CAST(bp AS INTEGER) AS product_bp FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY directional DESC, same_enzymes DESC, v_extra, d_extra, sup DESC, cu, cd, ue, de) AS q FROM sc) WHERE q = 1"""
# the single strand that enzyme e leaves where its top cut is t
_LETTERS_AT = "substr({s} || {s} || {s}, length({s}) + {t} - greatest({e}.ovhg, 0) + 1, abs({e}.ovhg))"
_APART = "dt - b.ovhg > ut - a.ovhg AND ut + length(v) - a.ovhg > dt - b.ovhg AND ut + length(v) > dt"
_LIGATES = ("{v} = {w} AND {x} = {y} AND " + _APART + " AND ddt - db.ovhg > udt - da.ovhg").format(v=_LETTERS_AT.format(s="v", t="ut", e="a"), w=_LETTERS_AT.format(s="d", t="udt", e="da"), x=_LETTERS_AT.format(s="v", t="dt", e="b"), y=_LETTERS_AT.format(s="d", t="ddt", e="db"))
SQL["insertion_routes"] = SQL["insertion_routes"].replace("AS bp FROM fit f", f"AS bp, {_LIGATES} AS verified FROM fit f").replace("JOIN enz b ON b.name = de JOIN vd", "JOIN enz b ON b.name = de JOIN enz da ON da.name = ude JOIN enz db ON db.name = dde JOIN vd").replace("true AS verified", "verified")
_AROUND = "substr(s || s || s, length(s) + {t} - 19, 40)"
_PATTERN = lambda x: "".join(f"[{LETTERS[c]}]" for c in x)
_RES = f"res AS (SELECT * FROM {_values([(n, size, _PATTERN(site) + '|' + _PATTERN(site.translate(str.maketrans('ACGTRYSWKMBDHVN', 'TGCAYRSWMKVHDBN'))[::-1])) for n, site, size, *_ in _ENZ], ['name', 'size', 'pattern'])})"
_WHY = SQL["excision_reasons"].partition(PAIRS)[2]
SQL["excision_plans"] = _with(SEQS, CUTS, ENZ, TARGETS, GUARD, PAIRS, _RES) + f""", why AS ({_WHY}), said AS (SELECT id, '{{' || string_agg('"' || reason || '":' || n, ',' ORDER BY reason) || '}}' AS reasons FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, reason) AS r FROM why) WHERE r <= 5 GROUP BY id),
ranks AS (SELECT d.*, s, t.t_s AS at_s, row_number() OVER (PARTITION BY d.id ORDER BY sr, collateral, cu, cd, up, down) AS rk FROM dedup d JOIN targets t USING (id) WHERE dup = 1),
prod AS (SELECT *, substr(s, 1, u_top) || substr(s, d_top + 1) AS product FROM ranks WHERE rk <= 25),
good AS (SELECT prod.*, row_number() OVER (PARTITION BY id ORDER BY rk) AS q FROM prod JOIN enz eu ON eu.name = up JOIN enz ed ON ed.name = down WHERE {_LETTERS_AT.format(s='s', t='u_top', e='eu')} = {_LETTERS_AT.format(s='s', t='d_top', e='ed')} AND NOT contains(substr(s, u_top + 1, d_top - u_top), substr(s, at_s - 49, 10)) AND (length(product) < 40 OR (NOT contains(product || product, {_AROUND.format(t='u_top')}) AND NOT contains(product || product, {_AROUND.format(t='d_top')}))))
SELECT t.id, g.up IS NOT NULL AS feasible, g.up, g.down, g.u_top, g.d_top, g.strategy, substr(g.s || g.s, length(g.s) + u_top - 5, 6) || substr(g.s || g.s, d_top + 1, 6) AS junction, CASE WHEN g.up IS NOT NULL THEN EXISTS (SELECT 1 FROM res r WHERE r.name IN (g.up, g.down) AND regexp_matches(product || substr(product, 1, r.size - 1), r.pattern) AND length(product) >= r.size) END AS site_regenerated, CAST(length(product) AS INTEGER) AS product_bp, reasons FROM targets t LEFT JOIN (SELECT * FROM good WHERE q = 1) g ON g.id = t.id LEFT JOIN said ON said.id = t.id"""

# a repeat is as long as what two neighbours among the sorted suffixes have in common, found bit by bit
_STEPS = [128, 64, 32, 16, 8, 4, 2, 1]
_COMMON = "pre"
for _k in _STEPS:
    _COMMON = f"(SELECT *, CASE WHEN left(a, m{_k * 2 if _k < 128 else ''} + {_k}) = left(b, m{_k * 2 if _k < 128 else ''} + {_k}) THEN m{_k * 2 if _k < 128 else ''} + {_k} ELSE m{_k * 2 if _k < 128 else ''} END AS m{_k} FROM {_COMMON})"
_P = {"too short": "length < 125", "too long": "length > 3000", "GC out of range": "gc < 25 OR gc > 75", "homopolymer": "homopolymer > 9", "repeat": "longest_repeat > 40", "repeat fraction": "repeat_fraction > 0.35"}
_PEN = {"too short": 0.5, "too long": 0.5, "GC out of range": 0.3, "homopolymer": 0.3, "repeat": 0.5, "repeat fraction": 0.4}
SQL["complexity_report"] = _with(SEQS).rstrip() + f""", suf AS (SELECT id, n, substr(s, i, 200) AS a FROM (SELECT id, s, length(s) AS n, unnest(range(1, length(s) + 1)) AS i FROM seqs)),
pre AS (SELECT id, n, a, coalesce(lag(a) OVER (PARTITION BY id ORDER BY a), '') AS b, 0 AS m FROM suf),
rep AS (SELECT id, least(max(m1), any_value(n) // 2, 200) AS longest_repeat FROM {_COMMON} GROUP BY id),
x AS (SELECT id, CAST(length(s) AS INTEGER) AS length, {_HE.format(x='(' + _GC.format(s='s') + ' * 10)')} / 10 AS gc, CAST({_HOMO.format(s='s')} AS INTEGER) AS homopolymer, CAST(longest_repeat AS INTEGER) AS longest_repeat, {_HE.format(x='(coalesce(rf, 0.0) * 1000)')} / 1000 AS repeat_fraction FROM seqs JOIN rep USING (id) LEFT JOIN {REPEATS.format(id='id', s='s', w=20, t='seqs')} USING (id)),
y AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {v} THEN '{k}' END" for k, v in _P.items())}], lambda r: r IS NOT NULL) AS rs, round(least(1.0, {' + '.join(f"CASE WHEN {v} THEN {_PEN[k]} ELSE 0 END" for k, v in _P.items())}), 6) AS score FROM x)
SELECT id, length, gc, homopolymer, longest_repeat, repeat_fraction, array_to_string(rs, ';') AS reasons, CAST(score AS DOUBLE) AS score, len(rs) = 0 AS synthesizable FROM y"""
SQL["feature_labels"] = "SELECT p_partkey, trim(coalesce(CASE WHEN p_size % 7 = 0 THEN p_partkey::VARCHAR END, CASE WHEN p_size % 5 = 0 THEN p_name END, CASE WHEN p_size % 3 = 0 THEN p_type END, CASE WHEN p_size % 2 = 0 THEN p_brand END, 'misc_feature')) AS label FROM part"
SQL["inserts_normalised"] = f"WITH b AS (SELECT item_id, text, {_dna('text')} AS s FROM benchmark), p AS (SELECT item_id, 'text' AS kind, upper(regexp_replace(trim(text), '[ \\n\\r\\t]', '', 'g')) AS c FROM b UNION ALL SELECT item_id, 'bases', substr(s, 1, 70) || 'NRYK' FROM b) SELECT item_id, kind, CASE WHEN regexp_full_match(c, '[ACGTRYSWKMBDHVN]+') THEN c END AS \"insert\" FROM p"
SQL["spans_inside"] = _with(FEATS) + "SELECT k, f, s - 1000 AS s, e - 1000 AS e FROM feats WHERE s >= 1000 AND e <= 2500"
SQL["cut_footprints"] = _with(SEQS, CUTS) + 'SELECT enzyme, count(*) AS n, CAST(sum(abs(top - bottom)) AS BIGINT) AS bases, min(least(top, bottom)) AS "first", max(greatest(top, bottom)) AS "last" FROM cuts GROUP BY enzyme'
SQL["enzyme_descriptions"] = f"WITH enz AS (SELECT * FROM {_values([(e['name'], e['site'], e['kind'], e['ovhg_seq'], e['supplier_count']) for e in catalogue('All')], ['name', 'site', 'kind', 'ovhg_seq', 'supplier_count'])}), {_stocked(catalogue('All'))} SELECT s_suppkey, name, name || ' ' || site || ' (' || CASE WHEN kind = 'blunt' THEN 'blunt' ELSE kind || chr(39) || ' ' || ovhg_seq END || ')' AS described, name NOT IN ('AhaIII', 'AsuII', 'HgiAI', 'MstI') AS sold, NOT regexp_matches(ovhg_seq, '[^ACGT]') AS end_known, CAST(supplier_count AS INTEGER) AS supplier_count FROM stocked JOIN enz USING (name)"
SQL["directory_scan"] = f"SELECT n_nationkey, CASE WHEN n_nationkey <> 7 THEN n_name END AS name, CASE WHEN n_nationkey <> 7 THEN CAST(length({_dna("n_name || repeat('base', n_nationkey)")}) AS INTEGER) END AS length, n_nationkey <> 7 AS readable FROM nation"
SQL["callable_source"] = "SELECT r_name AS plasmid_id, CASE WHEN NOT starts_with(r_name, 'EU') THEN CAST(length(r_name) * 5 + 3 AS INTEGER) END AS bytes, starts_with(r_name, 'EU') AS failed FROM region"
SQL["source_coercion"] = f"SELECT r_name AS plasmid_id, CAST(4 * (r_regionkey + 1) AS INTEGER) AS length FROM region UNION ALL SELECT n_name, CAST(length({_dna('n_name')}) AS INTEGER) FROM nation WHERE n_nationkey >= 3 UNION ALL SELECT 'extra', 2"
SQL["record_labels"] = "WITH s AS (SELECT DISTINCT replace(replace(s_name, 'Supplier#0000', 'Customer'), '#', '') AS name, CAST(s_suppkey % 7 AS INTEGER) AS length FROM supplier), c AS (SELECT replace(c_name, '#0000', '') AS label, c_custkey % 7 AS n FROM customer) SELECT name, length, min(label) AS label FROM s LEFT JOIN c ON n = length AND starts_with(label, name) GROUP BY ALL"
SQL["library_lines"] = "SELECT c_name AS label, c_name || '  ' || (c_custkey * 3 + 100) || ' bp' || CASE WHEN c_name = 'Customer#000000007' THEN '  [base vector]' ELSE '' END || CASE WHEN c_name IN ('Customer#000000007', 'Customer#000000009') THEN '  [unavailable]' ELSE '' END AS line FROM customer"
SQL["primer_notes"] = _with(SEQS, TARGETS, PRIMERS) + f""", n AS (SELECT b.id, f_seq, right(f_seq, 15) AS tip, s || substr(s, 1, 14) AS ext, length(s) AS m FROM best b JOIN seqs USING (id) WHERE rn = 1),
at AS (SELECT id, f_seq, len(list_filter(range(1, m + 1), lambda i: substr(ext, i, 15) = tip)) + CASE WHEN {_rc('tip')} <> tip THEN len(list_filter(range(1, m + 1), lambda i: substr(ext, i, 15) = {_rc('tip')})) ELSE 0 END AS places FROM n)
SELECT id, array_to_string(list_filter([CASE WHEN places > 1 THEN '3'' end anneals at more than one place' END, CASE WHEN right(f_seq, 1) NOT IN ('G', 'C') THEN 'no G or C at the 3'' end' END, CASE WHEN regexp_matches(f_seq, 'AAAA|CCCC|GGGG|TTTT') THEN 'run of four or more equal bases' END, CASE WHEN contains(substr(f_seq, 1, length(f_seq) - 5), {_rc('right(f_seq, 5)')}) THEN '3'' end may pair with the primer itself' END], lambda x: x IS NOT NULL), ';') AS notes FROM at""".replace("at AS (", "hits AS (").replace("FROM at", "FROM hits")
_D = BENCH["digest"]
SQL["digestion_mixes"] = f"WITH x AS (SELECT s_suppkey AS reaction, {STOCK.format(c='s_acctbal')} AS c FROM supplier), r AS (SELECT reaction, 0 AS nth, '{_D['buffer']}' AS component, CAST(NULL AS DOUBLE) AS ng, CAST({_D['buffer_ul']} AS DOUBLE) AS ul FROM x UNION ALL SELECT reaction, 1, 'DNA', {_D['micrograms']} * 1000.0, {_D['micrograms']} * 1000.0 / c FROM x UNION ALL SELECT reaction, 2, 'enzyme 1', NULL, {_D['enzyme_ul']} FROM x UNION ALL SELECT reaction, 3, 'enzyme 2', NULL, {_D['enzyme_ul']} FROM x UNION ALL SELECT reaction, 4, '{_D['phosphatase']}', NULL, {_D['phosphatase_ul']} FROM x), w AS (SELECT * FROM r UNION ALL SELECT reaction, 99, 'water', NULL, CASE WHEN count(ul) = 5 THEN {_D['total_ul']} - sum(ul) END FROM r GROUP BY reaction) SELECT reaction, CAST(nth AS INTEGER) AS nth, component, round(ng, 6) AS ng, round(CAST(ul AS DOUBLE), 6) AS ul FROM w"
SQL["digest_notes"] = SQL["digest_conditions"].replace(" SELECT digest, CAST(max", ", cond_of AS (SELECT digest, CAST(max", 1) + ") SELECT digest, CASE WHEN minutes IS NOT NULL AND temp_c IS NOT NULL THEN 'Incubate at ' || temp_c || ' °C for ' || minutes || ' min.' ELSE 'Enzymes differ in temperature or are not in the table: digest one after the other.' END || CASE WHEN star_limit_h IS NOT NULL THEN ' Stop within ' || regexp_replace(CAST(star_limit_h AS VARCHAR), '\\.0$', '') || ' h.' ELSE '' END || CASE WHEN no_heat_kill <> '' THEN ' Heat does not stop ' || replace(no_heat_kill, ';', ', ') || '; purify.' ELSE '' END || CASE WHEN unknown <> '' THEN ' Look up ' || replace(unknown, ';', ', ') || '.' ELSE '' END AS note FROM cond_of"
SQL["bench_forms"] = f"WITH p AS (SELECT p_partkey AS id, CASE WHEN p_size % 11 > 0 THEN p_size * 37 END AS bp, p_size % 2 = 0 AS rep FROM part), q AS (SELECT *, CAST(CASE WHEN bp < 500 THEN 1.5 WHEN bp < 1000 THEN 1.2 ELSE 1.0 END AS DOUBLE) AS g FROM p) SELECT id, g AS gel_percent, round(g / 2, 6) AS agarose_g, CASE WHEN rep THEN {BENCH['growth_temp_c_repetitive']} ELSE {BENCH['growth_temp_c']} END AS growth_c, CAST(greatest(15, {_HE.format(x='(bp / 1000 * CASE WHEN rep THEN 45 ELSE 30 END)')}) AS INTEGER) AS extension_s, coalesce(CASE WHEN bp >= 1000 THEN (bp // 1000) || ',' || lpad(CAST(bp % 1000 AS VARCHAR), 3, '0') ELSE CAST(bp AS VARCHAR) END, '____') AS amplicon FROM q"
SQL["pcr_reactions"] = "SELECT p_partkey AS id, CAST(nth AS INTEGER) AS nth, component, CAST(ul AS DOUBLE) AS ul FROM part CROSS JOIN " + _values([(i, n, float(u)) for i, (n, u) in enumerate(pcr_mix())], ["nth", "component", "ul"])
SQL["mix_specs"] = SQL["gibson_mixes"].replace("5000 + c_custkey % 1000 AS b", "5000 AS b").replace("round(fmol, 6) AS fmol, ", "")
SQL["gibson_mixes_many"] = f"WITH b AS (SELECT o_orderkey AS reaction, 1e8 / ((5000 + o_orderkey % 1000) * 650) AS fm, o_totalprice / 1000 AS c FROM orders), i AS (SELECT l_orderkey AS reaction, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n, CAST(l_quantity * 20 AS INTEGER) AS bp, CASE WHEN l_discount > 0 THEN l_discount * 300 END AS c FROM lineitem), r AS (SELECT reaction, 0 AS nth, '{BENCH['gibson']['master_mix']}' AS component, CAST(NULL AS DOUBLE) AS ng, CAST(NULL AS DOUBLE) AS fmol, 5.0::DOUBLE AS ul FROM b UNION ALL SELECT reaction, 1, 'backbone', 100.0, fm, 100 / nullif(c, 0) FROM b UNION ALL SELECT reaction, n + 1, 'insert ' || n, fm * 3 * bp * 650 / 1e6, fm * 3, fm * 3 * bp * 650 / 1e6 / i.c FROM i JOIN b USING (reaction)), w AS (SELECT * FROM r UNION ALL SELECT reaction, 99, 'water', NULL, NULL, CASE WHEN count(ul) = count(*) THEN 10 - sum(ul) END FROM r GROUP BY reaction) SELECT reaction, CAST(nth AS INTEGER) AS nth, component, round(ng, 6) AS ng, round(fmol, 6) AS fmol, round(ul, 6) AS ul FROM w"
SQL["product_comparison"] = _with(SHORT) + f", c AS (SELECT id, s, translate(left(s, 1), 'ACGT', 'CGTA') || substr(s, 2) AS o FROM shorts) SELECT id, true AS turned, true AS turned_over, false AS longer, contains(s || s, o) OR contains(s || s, {_rc('o')}) AS changed FROM c"
_ARMS = "arms AS (SELECT id, v_s - 60 AS p_s, v_s - 50 AS p_e FROM vd UNION ALL SELECT id, v_e + 50, v_e + 60 FROM vd)"
SQL["parts_remap"] = _with(PARTS) + """, m AS (SELECT *, CASE WHEN a < 1000 THEN a WHEN a >= 2000 THEN a - 850 ELSE 1000 END AS na, CASE WHEN b <= 1000 THEN b WHEN b >= 2000 THEN b - 850 ELSE 1000 END AS nb FROM parts),
l AS (SELECT *, bool_or(nb - na <> b - a) OVER (PARTITION BY k, f) AS tr, min(na) OVER (PARTITION BY k, f) AS ns, max(nb) OVER (PARTITION BY k, f) AS ne FROM m WHERE nb > na)
SELECT k, f, ns AS s, ne AS e, tr AS truncated, CASE WHEN tr THEN 'truncated by edit' END AS note, CAST(row_number() OVER (PARTITION BY k, f ORDER BY nth) - 1 AS INTEGER) AS nth, na AS start, nb AS "end", d AS strand FROM l WHERE NOT (tr AND type = 'primer_bind')"""
_TURNED = "SELECT k, f, (s - 1234 + 5000) % 5000 AS s, (s - 1234 + 5000) % 5000 + e - s AS e, nth, (a - 1234 + 5000) % 5000 AS a, (a - 1234 + 5000) % 5000 + b - a AS b, d FROM parts"
SQL["parts_rotation"] = _with(PARTS) + f""", t AS ({_TURNED}), sp AS (SELECT k, f, s, e, nth, 0 AS sub, a, b, d FROM t WHERE b <= 5000 UNION ALL SELECT k, f, s, e, nth, CASE WHEN d < 0 THEN 1 ELSE 0 END, a, 5000, d FROM t WHERE b > 5000 UNION ALL SELECT k, f, s, e, nth, CASE WHEN d < 0 THEN 0 ELSE 1 END, 0, b - 5000, d FROM t WHERE b > 5000)
SELECT k, f, s, e, CAST(row_number() OVER (PARTITION BY k, f ORDER BY nth, sub) - 1 AS INTEGER) AS nth, a AS start, b AS "end", d AS strand FROM sp"""
SQL["parts_graft"] = _with(PARTS) + 'SELECT k, f, CASE WHEN f > 2 THEN 10100 - e ELSE s END AS s, CASE WHEN f > 2 THEN 10100 - s ELSE e END AS e, nth, CASE WHEN f > 2 THEN 10100 - b ELSE a END AS start, CASE WHEN f > 2 THEN 10100 - a ELSE b END AS "end", CASE WHEN f > 2 THEN -d ELSE d END AS strand FROM parts'
SQL["genbank_features"] = _with(SEQS, PARTS) + """, x AS (SELECT k, f, any_value(type) AS type, any_value(label) AS label, min(a) AS a, max(b) AS b, string_agg(a || ':' || b || ':' || d, ',' ORDER BY nth) AS parts FROM parts GROUP BY 1, 2)
SELECT id, CAST(length(s) AS INTEGER) AS length, CASE WHEN f IS NULL THEN NULL ELSE CAST(row_number() OVER (PARTITION BY id ORDER BY f) - 1 AS INTEGER) END AS nth, type, label, a AS start, b AS "end", parts FROM seqs LEFT JOIN x ON k = id"""
_DIGEST = ", ".join(f"'{e}'" for e in ("BamHI", "KpnI", "EcoRV", "BsaI", "HaeIII", "BssSI"))
_X4 = "substr(s || s || s || s, length(s) + {a} + 1, {n})"
_END = "CASE WHEN {o} < 0 THEN '5:' WHEN {o} > 0 THEN '3:' ELSE 'blunt:' END || " + _X4.format(a="{t} - greatest({o}, 0)", n="abs({o})")


def _fragments(cuts: str, key: str) -> str:
    """Fragments out of distinct rows (key, s, top, ov): each cut and the next, the last one and the first a turn later."""
    w = f"(PARTITION BY {key} ORDER BY top, ov)"
    nxt = f"SELECT *, row_number() OVER {w} - 1 AS frag, count(*) OVER (PARTITION BY {key}) AS n_frags, coalesce(lead(top) OVER {w}, first_value(top) OVER {w} + length(s)) AS stop, coalesce(lead(ov) OVER {w}, first_value(ov) OVER {w}) AS ov2 FROM ({cuts})"
    return f"SELECT *, top AS start, {_END.format(t='top', o='ov')} AS \"left\", {_END.format(t='stop', o='ov2')} AS \"right\", stop <= top OR stop - ov2 <= top - ov AS interferes, {_X4.format(a='top', n='stop - top')} AS bases, {_X4.format(a='top - ov', n='stop - ov2 - top + ov')} AS under FROM ({nxt})"


_FRAG_CUTS = "SELECT DISTINCT id, s, top, top - bottom AS ov FROM cuts JOIN seqs USING (id) WHERE enzyme IN (" + _DIGEST + ")"
SQL["digest_products"] = _with(SEQS, CUTS) + f"SELECT id, CAST(frag AS INTEGER) AS frag, CAST(n_frags AS INTEGER) AS n_frags, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, \"left\", \"right\", interferes, \"left\" = \"right\" AND NOT interferes AS closes, CASE WHEN \"left\" = \"right\" AND NOT interferes THEN md5(bases) END AS product_md5 FROM ({_fragments(_FRAG_CUTS, 'id')})"
_BEST = SQL["insertion_routes"].partition(", sc AS")[2]
_TURN = "split_part({e}, ':', 1) || ':' || " + _rc("split_part({e}, ':', 2)")
_DONOR_CUTS = "SELECT DISTINCT rt.id, vd.d AS s, c.top, c.top - c.bottom AS ov FROM rt JOIN vd ON vd.id = rt.id JOIN cuts c ON c.id = rt.id + 1 AND c.enzyme IN (ude, dde)"
_OPENED = "SELECT rt.*, substr(s || s, dt + 1, ut - dt + length(s)) AS b_top, " + _END.format(t="dt", o="(SELECT ovhg FROM enz WHERE name = de)") + ' AS b_left, ' + _END.format(t="ut", o="(SELECT ovhg FROM enz WHERE name = ue)") + " AS b_right FROM (SELECT rt.*, v, v AS s FROM rt JOIN vd USING (id)) rt JOIN enz a ON a.name = ue JOIN enz b ON b.name = de WHERE " + _APART
SQL["ligation_products"] = _with(SEQS, CUTS, ENZ, VD, _ROUTES).rstrip() + ", sc AS" + _BEST.partition("\nSELECT")[0] + ", rt AS (SELECT" + _BEST.partition("\nSELECT")[2] + f"), fr AS ({_fragments(_DONOR_CUTS, 'id')}), ways AS (SELECT id, frag, start, false AS flip, \"left\", \"right\", bases FROM fr WHERE NOT interferes UNION ALL SELECT id, frag, start, true, {_TURN.format(e=chr(34) + 'right' + chr(34))}, {_TURN.format(e=chr(34) + 'left' + chr(34))}, {_rc('under')} FROM fr WHERE NOT interferes), op AS ({_OPENED}) SELECT id, CAST(frag AS INTEGER) AS frag, flip, start = udt AS wanted, CAST(length(b_top || bases) AS INTEGER) AS product_bp, md5(b_top || bases) AS product_md5 FROM op JOIN ways USING (id) WHERE b_right = \"left\" AND \"right\" = b_left"
_MID = "length(s) // 2"
SQL["assemblies"] = _with(SEQS, TARGETS).replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""", own AS (SELECT id AS reaction, 0 AS piece, substr(s, {_MID} + 1) || substr(s, 1, {_MID}) AS own FROM targets UNION ALL SELECT id - k, k, substr(s, {_MID} + 1, 60) FROM targets, (VALUES (1), (2), (3)) AS v(k) WHERE k <= 2 OR (id - k) % 2 <> 0),
pieces AS (SELECT reaction, piece, CASE WHEN piece = 0 THEN own ELSE coalesce(right(lag(own) OVER w, 25), NULL) || own || CASE WHEN lead(piece) OVER w IS NULL THEN left(first_value(own) OVER w, 25) ELSE '' END END AS t FROM own WINDOW w AS (PARTITION BY reaction ORDER BY piece)),
ways AS (SELECT reaction, piece, false AS flip, t FROM pieces UNION ALL SELECT reaction, piece, true, {_rc('t')} FROM pieces WHERE piece <> 0),
edge AS (SELECT a.reaction, a.piece AS a, a.flip AS af, b.piece AS b, b.flip AS bf, list_max(list_filter(range(20, 61), lambda k: k < length(a.t) AND k <= length(b.t) AND right(a.t, k) = left(b.t, k))) AS over FROM ways a JOIN ways b ON a.reaction = b.reaction AND (a.piece <> b.piece OR a.piece = 0)),
sizes AS (SELECT reaction, count(*) AS n_pieces, bool_or(piece = 0) AS opened FROM pieces GROUP BY 1),
path AS (SELECT reaction, 0 AS a, false AS af, [0] AS used, '0' AS route, t AS grown, false AS done FROM pieces WHERE piece = 0
 UNION ALL SELECT p.reaction, e.b, e.bf, list_append(p.used, e.b), CASE WHEN e.b = 0 THEN p.route ELSE p.route || ',' || CASE WHEN e.bf THEN '-' ELSE '' END || e.b END, CASE WHEN e.b = 0 THEN left(p.grown, length(p.grown) - e.over) ELSE left(p.grown, length(p.grown) - e.over) || w.t END, e.b = 0 FROM path p JOIN edge e ON e.reaction = p.reaction AND e.a = p.a AND e.af = p.af JOIN ways w ON w.reaction = p.reaction AND w.piece = e.b AND w.flip = e.bf WHERE NOT p.done AND e.over IS NOT NULL AND (e.b = 0 OR NOT list_contains(p.used, e.b))),
tally AS (SELECT reaction, count(*) FILTER (len(used) - 1 = n_pieces) AS n_products, count(*) FILTER (len(used) - 1 < n_pieces) AS n_partial, min(route) FILTER (len(used) - 1 = n_pieces) AS route, min(grown) FILTER (len(used) - 1 = n_pieces) AS product FROM path JOIN sizes USING (reaction) WHERE done GROUP BY 1)
SELECT reaction, n_pieces, coalesce(n_products, 0) AS n_products, coalesce(n_partial, 0) AS n_partial, CASE WHEN n_products = 1 THEN route END AS route, CASE WHEN n_products = 1 THEN CAST(length(product) AS INTEGER) END AS product_bp, CASE WHEN n_products = 1 THEN md5(product) END AS product_md5, CASE WHEN NOT opened THEN 'no backbone' WHEN coalesce(n_products, 0) = 0 THEN 'no closed product holds every piece' WHEN n_products > 1 THEN n_products || ' closed products hold every piece' END AS reason FROM sizes LEFT JOIN tally USING (reaction)"""
_KEPT = _ROUTES.replace("AND u.enzyme <> d.enzyme)", "AND u.enzyme <> d.enzyme WHERE NOT EXISTS (SELECT 1 FROM arms a WHERE a.id = u.id AND u.top < a.p_e AND a.p_s < d.top))")
SQL["insertion_protected"] = SQL["insertion_routes"].replace(_WHOLE, _ARMS + ", " + _KEPT).replace(", CAST(v_extra AS INTEGER) AS v_extra, CAST(d_extra AS INTEGER) AS d_extra, verified, CAST(bp AS INTEGER) AS product_bp", "").replace("directional, same_enzymes FROM", "directional FROM")
SQL["insertion_openings_protected"] = SQL["insertion_openings"].replace(", c AS (SELECT id, enzyme", f", {_ARMS}, c AS (SELECT id, enzyme").replace("AND d.top - u.top <= 200)", "AND d.top - u.top <= 200 AND NOT EXISTS (SELECT 1 FROM arms a WHERE a.id = u.id AND u.top < a.p_e AND a.p_s < d.top))")
SQL["insertion_preps"] = "WITH op AS (" + SQL["insertion_openings_protected"].replace("<= 200", "<= 80") + f"), {SEQS}, {VD}, x AS (SELECT vd.*, ut IS NOT NULL AS cut, coalesce(ut, v_s) AS o_s, coalesce(dt, v_e) AS o_e, substr(d, d_s + 1, 30) AS ins FROM vd LEFT JOIN op USING (id)) SELECT id, CASE WHEN cut THEN 'digest' ELSE 'pcr' END AS prep, CAST(o_s AS INTEGER) AS o_s, CAST(o_e AS INTEGER) AS o_e, substr(v || v || v, length(v) + o_s - 24, 25) AS up_arm, substr(v || v || v, length(v) + o_e + 1, 25) AS down_arm, CAST(80 AS INTEGER) AS order_bp, md5(substr(v, 1, o_s) || ins || substr(v, o_e + 1)) AS product_md5, true AS verified, NOT cut AS has_primers FROM x"
SQL["deletion_routes"] = f"WITH dig AS ({SQL['excision_plans']}), amp AS ({SQL['pcr_deletions']}), {SEQS} SELECT dig.id, CASE WHEN dig.feasible THEN 'restriction' WHEN amp.feasible THEN 'pcr' END AS route, CASE WHEN dig.feasible THEN up END AS up, CASE WHEN dig.feasible THEN down END AS down, CASE WHEN NOT dig.feasible AND amp.feasible THEN f_seq END AS f_seq, CASE WHEN NOT dig.feasible AND amp.feasible THEN r_seq END AS r_seq, CASE WHEN dig.feasible THEN product_bp WHEN amp.feasible THEN CAST(length(s) - 30 AS INTEGER) END AS product_bp, CASE WHEN dig.feasible THEN md5(substr(s, 1, u_top) || substr(s, d_top + 1)) WHEN amp.feasible THEN product_md5 END AS product_md5 FROM dig LEFT JOIN amp ON amp.id = dig.id JOIN seqs ON seqs.id = dig.id"
SQL["digest_probes"] = f"WITH dig AS ({SQL['excision_plans']}), amp AS ({SQL['pcr_deletions']}) SELECT dig.id, 'a digest with ' || up || ' and ' || down || ' would do, at ' || (d_top - u_top - 30) || ' further bases' AS said FROM dig JOIN amp ON amp.id = dig.id WHERE dig.feasible AND amp.feasible"
