"""Statistics against counting, and the verdicts."""

import math
import random
import re
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from ringspan.llm import outliers as O
from tests.llm.cases import ODD


def slow(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if c[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(x in O.SYMBOLS for x in t), dup, len(covered)


def test_statistics(spark, odd):
    rng = random.Random(2)
    extra = [(100 + i, "".join(rng.choices("ab# \n\t&", k=rng.randint(0, 120)))) for i in range(60)]
    df = odd.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    texts = {r[0]: r[1] for r in [(x[0], x[1]) for x in ODD] + extra}
    for r in O.statistics(df).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == slow(texts[r["doc_id"]]), r["doc_id"]


def corpus(spark, n=400, bad=20):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijkl", k=rng.randint(2, 9))) for _ in range(3000)]
    rows = []
    for i in range(n):
        w = rng.choices(words, k=rng.randint(60, 400))
        if i < bad:
            w = [x + "###" for x in w]
        rows.append((i, " ".join(w), "en" if i % 2 else None, "s" if i % 5 else "t"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_outliers_go_and_clean_rows_stay(spark):
    rows = O.judge(O.statistics(corpus(spark)).drop("text")).collect()
    assert {r["doc_id"] for r in rows if not r["kept"]} == set(range(20)) and not any(r["base_failed"] for r in rows)


def test_order_and_partitions_do_not_matter(spark):
    df = O.statistics(corpus(spark, 3000, 60)).drop("text").persist()
    a = {r["doc_id"]: (r["kept"], r["distance2"]) for r in O.judge(df).collect()}
    assert a == {r["doc_id"]: (r["kept"], r["distance2"]) for r in O.judge(df.repartition(7, F.rand(1))).collect()}
    df.unpersist()


def test_odd_rows(spark, odd):
    rows = O.judge(O.statistics(odd)).collect()
    assert len(rows) == odd.count()
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] in (3, 4, 5, 6, 10))
    assert next(r for r in rows if r["doc_id"] == 1)["kept"]


def test_empty_table(spark, none):
    assert O.judge(O.statistics(none)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = O.statistics(corpus(spark, 5, 0))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_few_symbols_are_outliers_where_others_have_none(spark):
    """A '#' after every third word is some seven in a hundred characters."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijkl", k=rng.randint(2, 9))) for _ in range(3000)]
    rows = []
    for i in range(300):
        w = rng.choices(words, k=rng.randint(100, 400))
        rows.append((i, " ".join(x + "#" * (i < 15 and k % 3 == 0) for k, x in enumerate(w)), "en", "s"))
    got = O.judge(O.statistics(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))).collect()
    assert {r["doc_id"] for r in got if not r["kept"]} == set(range(15))


def slow_judge(rows, core=0.75, steps=40, cutoff=28.47, min_group=60):
    """doc_id -> (distance2, kept) from (doc_id, lang, source, counts), with numpy and plain loops."""
    base = {r[0]: r[3][0] < 50 or 100 * r[3][4] > 50 * r[3][0] for r in rows}

    def x_of(c):
        n, chars, sym, dup, rep = c
        x = [math.log(max(chars, 1) / max(n, 1)), math.log1p(100 * sym / max(chars, 1)), math.log1p(100 * dup / max(n, 1)), math.log1p(100 * rep / max(n, 1))]
        return [math.floor(v * 4096 + 0.5) / 4096 for v in x]

    fit = [r for r in rows if not base[r[0]]]
    size = Counter((r[1], r[2]) for r in fit)
    group = lambda r: (r[1], r[2]) if size[r[1], r[2]] >= min_group else None
    half = lambda v: math.exp(np.median([math.floor(math.log(max(x, 1)) * 4096 + 0.5) for x in v]) / 4096)
    words, chars = half([r[3][0] for r in fit]), half([r[3][1] for r in fit])
    least = np.array([chars**-0.5, math.log1p(100 / chars), math.log1p(100 / words), math.log1p(600 / words)])

    def with_floor(c):
        c = c.copy()
        np.fill_diagonal(c, np.maximum(np.diag(c), least**2))
        return c

    def d2(x, m, c):
        low = np.linalg.cholesky(c)
        return (np.linalg.solve(low, (x - m).T) ** 2).sum(axis=0)

    rank = lambda d: np.floor(np.log2(d + 2.0**-20) * 64 + 0.5)
    out = {}
    for g in {group(r) for r in fit}:
        x = np.array([x_of(r[3]) for r in fit if group(r) == g])
        q = np.percentile(x, [25, 50, 75], axis=0)
        best = None
        for m, c in ((q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2)), (x.mean(axis=0), np.diag(x.var(axis=0)))):
            own = (np.diag(c) >= least**2).sum()
            c = with_floor(c)
            for _ in range(steps):
                k = rank(d2(x, m, c))
                inner = x[k <= np.percentile(k, core * 100)]
                m, c = inner.mean(axis=0), np.cov(inner.T, bias=True)
                own, c = (np.diag(c) >= least**2).sum(), with_floor(c)
            det = np.linalg.slogdet(c)[1]
            if best is None or det < best[0] - 1e-9:
                best = det, m, c, own
        _, m, c, own = best
        scale = 2 ** (np.median(rank(d2(x, m, c))) / 64) / (0.4549, 1.3863, 2.3660, 3.3567)[own - 1] if own else 1.0
        for r in rows:
            if group(r) == g:
                d = d2(np.array([x_of(r[3])]), m, c)[0] / scale
                out[r[0]] = d, not base[r[0]] and d <= cutoff
    return out


def test_verdicts_are_those_of_plain_estimates(spark):
    rng = random.Random(17)
    rows = []
    for i in range(900):
        n = int(math.exp(rng.gauss(5.5, 0.8))) + 45
        junk = rng.random() < 0.1
        counts = [n, int(n * rng.gauss(5, 0.3 + junk)), int(n * rng.random() * (0.3 if junk else 0.02)), int(rng.random() * (9 if junk else 1.4)), min(n, int(rng.expovariate(0.2)))]
        rows.append((i, rng.choice(["en", "en", "de", None]), rng.choice(["a", "b"]) if i % 40 else "rare", counts))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    df = spark.createDataFrame([(i, x, y, *c) for i, x, y, c in rows], "doc_id long, lang string, source string, " + ", ".join(f"{k} long" for k in names))
    want = slow_judge(rows)
    got = {r["doc_id"]: r for r in O.judge(df, most_steps=40).collect()}
    assert len(got) == len(rows) and 20 < sum(not k for _, k in want.values()) < 300
    for i, (d, kept) in want.items():
        assert math.isclose(got[i]["distance2"], d, rel_tol=1e-3, abs_tol=1e-6), i
        assert got[i]["kept"] == kept, i


def test_base_counts_of_the_query(spark, tmp_path):
    from ringspan.llm.queries import op10_quality_outliers

    spark.createDataFrame([(r[0], r[1], r[2], r[3]) for r in ODD], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in op10_quality_outliers(spark, str(tmp_path)).collect())
    want = sorted((str(r[0]), *(c := slow(r[1])), c[0] < 50 or 100 * c[4] > 50 * c[0]) for r in ODD)
    assert got == want


def test_other_columns_stay(spark, odd):
    more = odd.withColumns({c: F.lit(7) for c in ("row", "own", "g", "q0", "d", "m0", "det", "kept", "counts")})
    got = O.judge(O.statistics(more))
    assert set(more.columns) < set(got.columns) and got.select("own", "g", "q0", "row", "_lang").where("own = 7 and g = 7 and q0 = 7 and row = 7").count() == odd.count()
    assert dict(got.dtypes)["kept"] == "boolean"
