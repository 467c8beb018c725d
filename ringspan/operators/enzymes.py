"""The enzyme dimension, cut sites on circles, ligation of ends and supplier conditions.

The dimension is some two hundred rows of public knowledge; joins against it are left to Spark, which
knows its size. Sites are expanded to their words, but for N, which a mask leaves out. Windows are coded
as integers, one vectorised pass per site length; a circle is searched for all enzymes in one place, so
cuts are counted there and nothing but cuts leaves the scan, without a shuffle.

Ends whose bases depend on what lies beside the site (type IIS enzymes and sites with ambiguous letters
in the overhang) are not taken to ligate with anything, their own kind included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringspan.functions import kernels
from ringspan.functions.sequences import circular_slice
from ringspan.session import local_table

# Recognition sites; ^ marks the cut of the top strand, _ that of the bottom strand,
# one mark alone a blunt cut; (a/b) the places of both cuts behind the site; ? an unknown cut.
SITES = """
AarI CACCTGC(4/8)
AatII G_ACGT^C
Acc65I G^GTAC_C
AccI GT^MK_AC
AciI C^CG_C
AclI AA^CG_TT
AcuI CTGAAG(16/14)
AfeI AGC^GCT
AgeI A^CCGG_T
AhdI GACNN_N^NNGTC
AluI AG^CT
AlwI GGATC(4/5)
AlwNI CAG_NNN^CTG
ApaI G_GGCC^C
ApaLI G^TGCA_C
ApeKI G^CWG_C
ApoI R^AATT_Y
AscI GG^CGCG_CC
AseI AT^TA_AT
AsiSI GCG_AT^CGC
AvaI C^YCGR_G
AvaII G^GWC_C
AvrII C^CTAG_G
BamHI G^GATC_C
BanI G^GYRC_C
BanII G_RGCY^C
BbsI GAAGAC(2/6)
BbvI GCAGC(8/12)
BclI T^GATC_A
BcoDI GTCTC(1/5)
BfaI C^TA_G
BfuAI ACCTGC(4/8)
BglI GCCN_NNN^NGGC
BglII A^GATC_T
BlpI GC^TNA_GC
BmtI G_CTAG^C
BpiI GAAGAC(2/6)
BpmI CTGGAG(16/14)
BsaAI YAC^GTR
BsaBI GATNN^NNATC
BsaHI GR^CG_YC
BsaI GGTCTC(1/5)
BsaWI W^CCGG_W
BseRI GAGGAG(10/8)
BsgI GTGCAG(16/14)
BsiEI CG_RY^CG
BsiHKAI G_WGCW^C
BsiWI C^GTAC_G
BsmAI GTCTC(1/5)
BsmBI CGTCTC(1/5)
BsmI GAATGC(1/-1)
BsoBI C^YCGR_G
BspEI T^CCGG_A
BspHI T^CATG_A
BspMI ACCTGC(4/8)
BspQI GCTCTTC(1/4)
BsrBI CCG^CTC
BsrDI GCAATG(2/0)
BsrFI R^CCGG_Y
BsrGI T^GTAC_A
BsrI ACTGG(1/-1)
BssHII G^CGCG_C
BssSI C^ACGA_G
BstAPI GCAN_NNN^NTGC
BstBI TT^CG_AA
BstEII G^GTNAC_C
BstNI CC^W_GG
BstUI CG^CG
BstXI CCAN_NNNN^NTGG
BstYI R^GATC_Y
BstZ17I GTA^TAC
Bsu15I AT^CG_AT
Bsu36I CC^TNA_GG
BtrI CAC^GTC
BtsI GCAGTG(2/0)
ClaI AT^CG_AT
Csp6I G^TA_C
CviAII C^AT_G
DdeI C^TNA_G
DpnII ^GATC_
DraI TTT^AAA
DraIII CAC_NNN^GTG
DrdI GACNN_NN^NNGTC
EaeI Y^GGCC_R
EagI C^GGCC_G
EarI CTCTTC(1/4)
Ecl136II GAG^CTC
Eco31I GGTCTC(1/5)
Eco32I GAT^ATC
Eco47III AGC^GCT
Eco53kI GAG^CTC
EcoNI CCTNN^N_NNAGG
EcoRI G^AATT_C
EcoRII ^CCWGG_
EcoRV GAT^ATC
Esp3I CGTCTC(1/5)
FatI ^CATG_
Fnu4HI GC^N_GC
FokI GGATG(9/13)
FseI GG_CCGG^CC
FspI TGC^GCA
HaeII R_GCGC^Y
HaeIII GG^CC
HhaI G_CG^C
HinP1I G^CG_C
HincII GTY^RAC
HindIII A^AGCT_T
HinfI G^ANT_C
HpaI GTT^AAC
HpaII C^CG_G
HphI GGTGA(8/7)
HpyCH4IV A^CG_T
HpyCH4V TG^CA
KasI G^GCGC_C
KpnI G_GTAC^C
Kpn2I T^CCGG_A
MboI ^GATC_
MboII GAAGA(8/7)
MfeI C^AATT_G
MluI A^CGCG_T
MlyI GAGTC(5/5)
MreI CG^CCGG_CG
MscI TGG^CCA
MseI T^TA_A
MslI CAYNN^NNRTG
MspA1I CMG^CKG
MspI C^CG_G
MunI C^AATT_G
MvaI CC^W_GG
NaeI GCC^GGC
NarI GG^CG_CC
NciI CC^S_GG
NcoI C^CATG_G
NdeI CA^TA_TG
NgoMIV G^CCGG_C
NheI G^CTAG_C
NlaIII _CATG^
NotI GC^GGCC_GC
NruI TCG^CGA
NsiI A_TGCA^T
NspI R_CATG^Y
PacI TTA_AT^TAA
PaeR7I C^TCGA_G
PaqCI CACCTGC(4/8)
PciI A^CATG_T
PflMI CCAN_NNN^NTGG
PleI GAGTC(4/5)
PmeI GTTT^AAAC
PmlI CAC^GTG
PpuMI RG^GWC_CY
PshAI GACNN^NNGTC
PsiI TTA^TAA
PspOMI G^GGCC_C
PspXI VC^TCGA_GB
PstI C_TGCA^G
PvuI CG_AT^CG
PvuII CAG^CTG
RsaI GT^AC
RsrII CG^GWC_CG
SacI G_AGCT^C
SalI G^TCGA_C
SapI GCTCTTC(1/4)
Sau3AI ^GATC_
Sau96I G^GNC_C
SbfI CC_TGCA^GG
ScaI AGT^ACT
ScrFI CC^N_GG
SexAI A^CCWGG_T
SfaNI GCATC(5/9)
SfcI C^TRYA_G
SfiI GGCCN_NNN^NGGCC
SfoI GGC^GCC
SgrAI CR^CCGG_YG
SmaI CCC^GGG
SnaBI TAC^GTA
SpeI A^CTAG_T
SphI G_CATG^C
SrfI GCCC^GGGC
SspI AAT^ATT
StuI AGG^CCT
StyI C^CWWG_G
SwaI ATTT^AAAT
TaqI T^CG_A
TfiI G^AWT_C
TseI G^CWG_C
Tsp509I ^AATT_
Tth111I GACN^N_NGTC
Van91I CCAN_NNN^NTGG
VspI AT^TA_AT
XbaI T^CTAG_A
XhoI C^TCGA_G
XmaI C^CCGG_G
XmaJI C^CTAG_G
XmnI GAANN^NNTTC
ZraI GAC^GTC
"""
# Enzymes that are described but not sold, the last two with no known cut.
NOT_SOLD = """
AhaIII TTT^AAA
AsuII TT^CG_AA
HgiAI G_WGCW^C
MstI TGC^GCA
HgiEII ACCNNNNNNGGT?
SnaI GTATAC?
"""
# The bases that an ambiguous letter stands for; vendors' preferred names first.
LETTERS = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
PREFERRED = ("MfeI", "XhoI", "ClaI", "AseI", "SacI", "EcoRV", "SapI", "BsmAI", "MspI")
SUPPLIERS = {"XhoI": 9, "PaeR7I": 1}
SAME, STICKY, BLUNT = "same_enzyme", "compatible_overhang", "blunt"
RANK = {SAME: 0, STICKY: 1, BLUNT: 2}


def parse_site(text: str) -> dict | None:
    """(site, size, top_off, ovhg, kind, ovhg_seq) of a marked site; None if its cut is unknown. ovhg is the
    top cut less the bottom one: negative for a 5' overhang. Bases beside the site are N."""
    if text.endswith("?"):
        return None
    if m := re.fullmatch(r"([A-Z]+)\((-?\d+)/(-?\d+)\)", text):
        site = m[1]
        top, bottom = (len(site) + int(x) for x in m.groups()[1:])
    else:
        site = text.replace("^", "").replace("_", "")
        top = text.replace("_", "").index("^")
        bottom = text.replace("^", "").index("_") if "_" in text else top
    lo, hi = sorted((top, bottom))
    return {"site": site, "size": len(site), "top_off": top, "ovhg": top - bottom, "kind": "blunt" if top == bottom else "5" if top < bottom else "3", "ovhg_seq": (site + "N" * 40)[lo:hi]}


def catalogue(pool="CommOnly") -> list[dict]:
    """The enzymes of a pool ("CommOnly": those sold, "All", or a list of names) with the canonical name of
    those that cut alike. Enzymes whose cut is unknown are in no pool; an unknown name is an error."""
    lines = [(*line.split(), sold) for text, sold in ((SITES, True), (NOT_SOLD, False)) for line in text.strip().splitlines()]
    rows = sorted(({"name": n, "sold": sold, **made} for n, site, sold in lines if (made := parse_site(site))), key=lambda r: r["name"])
    alike: dict[tuple, list[dict]] = {}
    for r in rows:
        alike.setdefault((r["site"], r["top_off"], r["ovhg"]), []).append(r)
    rank = lambda r: (PREFERRED.index(r["name"]) if r["name"] in PREFERRED else len(PREFERRED), not r["sold"], -SUPPLIERS.get(r["name"], 0), r["name"])
    for r in rows:
        r["canonical"] = min(alike[r["site"], r["top_off"], r["ovhg"]], key=rank)["name"]
        r["supplier_count"] = SUPPLIERS.get(r["canonical"])
        r["end"] = None if re.search("[^ACGT]", r["ovhg_seq"]) else f"{r['kind']}:{r['ovhg_seq']}"
    if pool == "All":
        return rows
    if pool == "CommOnly":
        return [r for r in rows if r["sold"]]
    if isinstance(pool, str):
        raise ValueError(f"unknown enzyme pool {pool!r}: use 'All', 'CommOnly' or a list of names")
    wanted, named = set(pool), {n for n, *_ in lines}
    if wanted - named:
        raise ValueError(f"unknown enzymes: {', '.join(sorted(wanted - named))}")
    return [r for r in rows if r["name"] in wanted]


_SCHEMA = "name string, site string, size int, top_off int, ovhg int, kind string, ovhg_seq string, canonical string, supplier_count int, end string, sold boolean"


def enzymes(spark: SparkSession, pool="CommOnly") -> DataFrame:
    """The dimension; `end` is what compatible ends have in common, null where it is not known. A local
    relation, whose size the planner knows: joins with it need no shuffle."""
    return local_table(spark, catalogue(pool), _SCHEMA)


def site_words(pool="CommOnly") -> list[tuple[str, int, int, str]]:
    """(name, off, ovhg, word): each word of each site, on either strand, with N left in; off is the
    top cut counted from the word's start on the forward strand."""
    out = set()
    for r in catalogue(pool):
        back = kernels.reverse_complement(r["site"])
        # the site on the other strand: its bottom cut is on ours
        places = [(r["site"], r["top_off"])] + ([(back, r["size"] - (r["top_off"] - r["ovhg"]))] if back != r["site"] else [])
        for site, off in places:
            out |= {(r["name"], off, r["ovhg"], "".join(w)) for w in product(*["N" if c == "N" else LETTERS[c] for c in site])}
    return sorted(out)


class Finder:
    """All cuts of a pool on a circle. `names` and `info` (catalogue rows) are by the number of the enzyme, which follows the
    order of names."""

    def __init__(self, pool):
        words = site_words(pool)
        self.names = sorted({w[0] for w in words})
        rows = {r["name"]: r for r in catalogue(pool)}
        self.info = [rows[n] for n in self.names]
        #: by enzyme: the number of its end, -1 where that is not known; the rank of its canonical name; its suppliers, 0 if not known
        ends = sorted({r["end"] for r in self.info if r["end"]})
        self.ends = np.array([ends.index(r["end"]) if r["end"] else -1 for r in self.info], dtype=np.int64)
        order = sorted({r["canonical"] for r in self.info})
        self.canonical = np.array([order.index(r["canonical"]) for r in self.info], dtype=np.int64)
        self.suppliers = np.array([r["supplier_count"] or 0 for r in self.info], dtype=np.int64)
        nth = {n: i for i, n in enumerate(self.names)}
        self.ovhg = np.zeros(len(self.names), dtype=np.int64)
        found: dict[tuple[int, int], list] = {}
        for name, off, ovhg, word in words:
            self.ovhg[nth[name]] = ovhg
            mask = kernels.word_code("".join("A" if c == "N" else "T" for c in word))
            found.setdefault((len(word), mask), []).append((kernels.word_code(word.replace("N", "A")), nth[name], off))
        self.tables = []
        for (size, mask), rows in sorted(found.items()):
            rows = np.array(sorted(rows), dtype=np.int64)
            codes, first, n = np.unique(rows[:, 0], return_index=True, return_counts=True)
            # the number of each word by its code, where the codes are not too many
            place = np.full(4**size, -1, dtype=np.int16) if size <= 8 else None
            if place is not None:
                place[codes] = np.arange(len(codes))
            free = mask == 4**size - 1
            self.tables.append((size, None if free else mask, codes, place, first, n, rows[:, 1], rows[:, 2]))
        self.sizes = sorted({t[0] for t in self.tables})
        self._by_eights([(word, nth[name], off) for name, off, _, word in words])

    def _by_eights(self, words: list[tuple[str, int, int]]) -> None:
        """The words that each window of eight bases may begin, all in one table: words of eight at most are told by it, of longer
        ones the last eight bases are looked at as well."""
        size = np.array([len(w) for w, _, _ in words], dtype=np.int64)
        self.longest = max([8, *size.tolist()])
        self.by_eights = self.longest <= 16
        if not self.by_eights:
            return
        self.enzyme, self.off = (np.array([w[k] for w in words], dtype=np.int64) for k in (1, 2))
        self.back = np.where(size > 8, size - 8, 0)
        tails = [w[-8:] if len(w) > 8 else "N" * 8 for w, _, _ in words]
        self.tail = np.array([kernels.word_code(t.replace("N", "A")) for t in tails], dtype=np.uint16)
        self.told = np.array([kernels.word_code("".join("A" if c == "N" else "T" for c in t)) for t in tails], dtype=np.uint16)
        code, row = [], []
        for i, (w, _, _) in enumerate(words):
            at = np.zeros(1, dtype=np.int64)
            for c in (w + "N" * 8)[:8]:
                at = (at[:, None] * 4 + (np.arange(4) if c == "N" else "ACGT".index(c))).ravel()
            code.append(at)
            row.append(np.full(len(at), i))
        code, row = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (code, row))
        self.row = row[np.argsort(code, kind="stable")]
        self.many = np.bincount(code, minlength=4**8).astype(np.uint16)
        self.first = np.cumsum(self.many, dtype=np.int64) - self.many

    def cuts(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(enzyme, top, how often the enzyme cuts), by enzyme and place."""
        n = len(text)
        if not self.by_eights or n < 64 or (code := kernels.eights(text, self.longest)) is None:
            return self._cuts_by_size(text)
        hit = np.flatnonzero(self.many[code[:n]])
        seen = code[hit]
        many = self.many[seen].astype(np.int64)
        row = self.row[np.repeat(self.first[seen] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        at = np.repeat(hit, many)
        back = self.back[row]
        far = np.flatnonzero(back)
        wrong = far[(code[at[far] + back[far]] & self.told[row[far]]) != self.tail[row[far]]]
        if len(wrong):
            keep = np.ones(len(row), dtype=bool)
            keep[wrong] = False
            row, at = row[keep], at[keep]
        at = at + self.off[row]
        at[at >= n] -= n
        at[at < 0] += n
        bits = n.bit_length()
        key = np.sort(self.enzyme[row] << bits | at)
        if len(key):
            key = key[np.append(True, key[1:] != key[:-1])]
        enzyme = key >> bits
        return enzyme, key & ((1 << bits) - 1), np.bincount(enzyme, minlength=1)[enzyme] if len(key) else key

    def _cuts_by_size(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same by a pass for each size of word; for short circles and other letters."""
        keys, length, coded = [], max(len(text), 1), dict(kernels.codes_of(text, self.sizes))
        for size, mask, codes, place, first, n, enzyme, off in self.tables:
            if size not in coded:
                continue
            at = coded[size]
            seen = at if mask is None else np.where(at >= 0, at & mask, -1)
            if place is not None:
                k = np.where(seen >= 0, place[seen], -1)
                hit = np.flatnonzero(k >= 0)
                k = k[hit]
            else:
                found = [np.flatnonzero(seen == c) for c in codes.tolist()]
                hit, k = np.concatenate(found), np.repeat(np.arange(len(codes)), [len(f) for f in found])
            if not len(hit):
                continue
            many = n[k]
            row = np.repeat(first[k], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            keys.append(enzyme[row] * length + (np.repeat(hit, many) + off[row]) % length)
        key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.int64)
        enzyme = key // length
        return enzyme, key % length, np.bincount(enzyme, minlength=1)[enzyme] if len(key) else key


class Search:
    """The cuts of a few enzymes of a pool, named for each circle: only their sites are looked for. What `Finder` finds, for these."""

    def __init__(self, pool):
        self.over: dict[str, int] = {}
        self.places: dict[str, list[tuple[int, int, str | re.Pattern]]] = {}
        for r in catalogue(pool):
            self.over[r["name"]] = r["ovhg"]
            back = kernels.reverse_complement(r["site"])
            for site, off in [(r["site"], r["top_off"])] + ([(back, r["size"] - (r["top_off"] - r["ovhg"]))] if back != r["site"] else []):
                word = site if set(site) <= set("ACGT") else re.compile("(?=" + "".join(f"[{LETTERS[c]}]" for c in site) + ")")
                self.places.setdefault(r["name"], []).append((len(site), off, word))

    def _hits(self, text: str, name: str):
        for size, off, word in self.places.get(name, ()):
            ring = text + text[: size - 1]
            if len(text) < size:
                continue
            if isinstance(word, str):
                at = ring.find(word)
                while at >= 0:
                    yield at + off
                    at = ring.find(word, at + 1)
            else:
                yield from (m.start() + off for m in word.finditer(ring))

    def cuts(self, text: str, names) -> list[tuple[int, int]]:
        """(top, over): the distinct cuts of the named enzymes, by place; over is the top cut less the bottom one."""
        return sorted({(at % len(text), self.over[n]) for n in set(names) for at in self._hits(text, n)})

    def any(self, text: str, names) -> bool:
        """Whether one of the named enzymes cuts."""
        return any(True for n in set(names) for _ in self._hits(text, n))


def cut_sites(seqs: DataFrame, pool="CommOnly", id_col: str = "id", seq_col: str = "s", once: bool = False) -> DataFrame:
    """(id, enzyme, top, bottom, n_cuts): every cut on the circle of every row, or (once) those of enzymes that cut it once: others do not
    leave the scan. Enzymes without cuts have no rows."""
    src = seqs.select(F.col(id_col).alias("id"), F.col(seq_col).alias("s"))
    pool = pool if isinstance(pool, str) else sorted(pool)
    catalogue(pool)

    def run(batches):
        find = Finder(pool)
        names = pa.array(find.names, pa.string())

        def batch(ids, rows):
            n = [len(e) for e, _, _ in rows]
            enzyme, top, many = (np.concatenate(x) for x in zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(n)), n))), names.take(pa.array(enzyme)), pa.array(top.astype(np.int32)), pa.array((top - find.ovhg[enzyme]).astype(np.int32)), pa.array(many.astype(np.int32))], names=["id", "enzyme", "top", "bottom", "n_cuts"])

        for b in batches:
            rows, start, held = [], 0, 0
            for s in b.column(1):
                found = find.cuts(s.as_py() or "")
                rows.append(tuple(x[found[2] == 1] for x in found) if once else found)
                held += len(rows[-1][0])
                if held > 200_000:
                    yield batch(b.column(0).slice(start, len(rows)), rows)
                    rows, start, held = [], start + len(rows), 0
            if rows:
                yield batch(b.column(0).slice(start, len(rows)), rows)

    return src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, enzyme string, top int, bottom int, n_cuts int")


def still_cut(plans: DataFrame, product: str, names: list[str], pool="CommOnly") -> DataFrame:
    """plans with `site_regenerated`: whether one of the enzymes in some columns still cuts the product. A plan
    of an enzyme outside the pool is judged by the others. Only the sites of the plan's own enzymes are looked for."""
    pool = pool if isinstance(pool, str) else sorted(pool)
    catalogue(pool)

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        find = Search(pool)
        for products, named in batches:
            yield pd.Series([find.any(s or "", n) for s, n in zip(products, named, strict=True)], dtype=bool)

    return plans.withColumn("site_regenerated", F.pandas_udf(run, "boolean")(F.col(product), F.array(*names)))


def footprint(top, bottom) -> tuple[Column, Column]:
    """The single-stranded stretch that a cut leaves."""
    return F.least(top, bottom), F.greatest(top, bottom)


def strategy(a: str, b: str) -> Column:
    """How the ends of two joined dimension rows (aliases a and b) ligate; null if they don't, or if an
    end is not known."""
    c = lambda t, n: F.col(f"{t}.{n}")
    return F.when(c(a, "end") == c(b, "end"), F.when(c(a, "name") == c(b, "name"), SAME).when(c(a, "kind") == "blunt", BLUNT).otherwise(STICKY))


def strategy_rank(s) -> Column:
    return F.when(s == SAME, 0).when(s == STICKY, 1).when(s == BLUNT, 2)


def ligation_pairs(spark: SparkSession, pool="CommOnly") -> DataFrame:
    """(a, b, strategy): the ordered pairs of enzymes whose ends ligate."""
    e = enzymes(spark, pool)
    pairs = e.alias("a").join(e.alias("b"), F.col("a.end") == F.col("b.end"))
    return pairs.select(F.col("a.name").alias("a"), F.col("b.name").alias("b"), strategy("a", "b").alias("strategy"))


def unique_cutters(cuts: DataFrame, most: int = 40) -> DataFrame:
    """(id, enzyme, top, nth, total): the enzymes that cut a circle once, by place, the first `most`."""
    once = cuts.where("n_cuts = 1")
    totals = once.groupBy("id").agg(F.count(F.lit(1)).alias("total"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("top", "enzyme"))
    return once.withColumn("nth", nth).where(F.col("nth") <= most).join(totals, "id").select("id", "enzyme", "top", "nth", "total")


def _by_circle(seqs: DataFrame, pool, made, names: list[str], kinds: str) -> DataFrame:
    """(id, ...): what made(cuts) gives for each circle (id, s) as arrays, the first the numbers of enzymes."""
    src = seqs.select("id", "s")
    pool = pool if isinstance(pool, str) else sorted(pool)
    catalogue(pool)

    def run(batches):
        find = Finder(pool)
        called = pa.array(find.names, pa.string())
        for b in batches:
            rows = [made(find.cuts(s.as_py() or "")) for s in b.column(1)]
            if rows:
                of = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
                enzyme, *others = (np.concatenate(x) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), called.take(pa.array(enzyme)), *map(pa.array, others)], names=["id", *names])

    return src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, {kinds}")


def single_cutters(seqs: DataFrame, most: int = 40, pool="CommOnly") -> DataFrame:
    """What `unique_cutters` gives for the cuts of each circle (id, s), found and numbered where the circle is."""

    def made(cuts):
        enzyme, top, _ = (x[cuts[2] == 1] for x in cuts)
        at = np.lexsort((enzyme, top))[:most]
        return enzyme[at], top[at].astype(np.int32), np.arange(1, len(at) + 1, dtype=np.int32), np.full(len(at), len(enzyme), dtype=np.int64)

    return _by_circle(seqs, pool, made, ["enzyme", "top", "nth", "total"], "enzyme string, top int, nth int, total long")


def site_counts(seqs: DataFrame, pool="CommOnly") -> DataFrame:
    """(id, name, n): how often each enzyme cuts each circle (id, s), counted where the circle is; none that does not cut."""

    def made(cuts):
        enzyme, n = np.unique(cuts[0], return_counts=True)
        return enzyme, n.astype(np.int32)

    return _by_circle(seqs, pool, made, ["name", "n"], "name string, n int")


def describe(name, site, kind, ovhg_seq) -> Column:
    return F.format_string("%s %s (%s)", name, site, F.when(kind == "blunt", "blunt").otherwise(F.concat(kind, F.lit("' "), ovhg_seq)))


def junction(s, top, context: int = 6) -> Column:
    """The bases on either side of a cut of a circle, upper case."""
    return F.upper(circular_slice(s, F.col(top) - context, F.col(top) + context))


def conditions_lookup(names: DataFrame, conditions: DataFrame, dimension: DataFrame) -> DataFrame:
    """(enzyme, sold_as, ...): supplier conditions of each enzyme by its own name, else those of the
    first other enzyme with the same site and cut; nulls where there are none. names: (enzyme)."""
    cols = [c for c in conditions.columns if c != "name"]
    key = ["site", "top_off", "ovhg"]
    mine = dimension.select("name", *key)
    sold = mine.join(conditions, "name").groupBy(*key).agg(F.min(F.struct("name", *cols)).alias("alike"))
    known = mine.join(sold, key).select(F.col("name").alias("enzyme"), "alike")
    own = conditions.select(F.col("name").alias("enzyme"), F.struct("name", *cols).alias("own"))
    both = names.join(own, "enzyme", "left").join(known, "enzyme", "left").withColumn("row", F.coalesce("own", "alike"))
    return both.select("enzyme", F.col("row.name").alias("sold_as"), *[F.col(f"row.{c}").alias(c) for c in cols])
