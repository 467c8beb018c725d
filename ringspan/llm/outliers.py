"""Quality rules with robust multivariate outliers, in DataFrame and SQL functions only.

`statistics` counts words, characters, symbols, repeated lines and repeated three-word windows of
each whole text. `judge` applies two fixed rules, then fits a minimum-covariance-determinant
estimate of transformed statistics per language and source and rejects texts by Mahalanobis
distance. From two starts (median and quartiles; mean and variance) concentration steps keep the
three quarters of a group nearest to its centre and estimate again, until no determinant falls any
more; the start that ends with the lesser one wins. Squared distances are divided by their median over
that of a chi-squared distribution with as many degrees of freedom as statistics vary by themselves in
the group; `cutoff` is a quantile of the chi-squared distribution with four.

Most texts have no symbol and no repeat, so the nearest three quarters may not vary at all in those
shares. A deviation is therefore never under the noise of the count itself: what one event (a symbol, a
repeated line, a window found twice) makes in a text of the median size of the whole table, and for
the word length the square root of its characters. Distances
come from a Cholesky factor written out as column expressions.

Transformed statistics are whole multiples of 1/4096 and distances are ranked in steps of about one in a
hundred, so sums and quantiles are exact and no verdict depends on the order in which rows are merged.

Scale: one narrow pass over the texts; every later step reads a few numbers per row. Quantiles (over
bounded numbers of steps), means and covariances are pre-aggregated where the rows lie, so a hot source
costs no more than others. Groups under `min_group` rows are too small for an estimate of their own and
share one.

Cases: a null text has no words and fails the base rule; null languages and sources are groups of
their own; equal rows count each; groups without spread are carried by the noise of counts; an empty table
gives no rows; other columns stay, whatever their names, but those named like an output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringspan.llm._shared import SPACE, cut, fresh

#: The symbols that are counted.
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\f\r"
#: Steps of a transformed statistic in one unit, and of a distance in one doubling.
STEPS, RANKS = 4096, 64
#: Words that the smallest repeat covers: a window of three, twice.
_WINDOW_TWICE = 6
#: The medians of the chi-squared distributions with one to four degrees of freedom.
_CHI_MEDIANS = (0.4549, 1.3863, 2.3660, 3.3567)
_P = range(4)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """How many words lie in three-word windows that the text has twice or more."""

    def of(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.struct(F.xxhash64(h[i], h[i + 1], h[i + 2]).alias("h"), i.alias("i")))

        def marked(s: Column) -> Column:
            same = lambda x, k: ((k > 0) & (s[k - 1]["h"] == x["h"])) | ((k < F.size(s) - 1) & (s[k + 1]["h"] == x["h"]))
            places = F.transform(F.filter(s, same), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
            return F.size(F.array_distinct(F.flatten(places)))

        return F.when(F.size(h) < 4, F.lit(0)).otherwise(_let(F.sort_array(windows), marked))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), of)


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _BLANKS, "")) > 0)
    per_words = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated_words(w).cast("long").alias("r")))
    (own,) = fresh(docs, "counts")
    held = docs.withColumns({own: per_words, "word_chars": F.length(F.translate(text, _BLANKS, "")).cast("long"), "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"), "n_dup_lines": _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))})
    return held.withColumns({"n_words": F.col(f"{own}.n"), "n_repeat_words": F.col(f"{own}.r")}).drop(own)


def _steps(x: Column) -> Column:
    """x as a whole number of steps."""
    return F.round(x * STEPS).cast("long")


def _share(a: Column, b: Column) -> Column:
    return F.log1p(100.0 * a / F.greatest(b, F.lit(1)))


def _transformed() -> list[Column]:
    chars, words = F.col("word_chars"), F.col("n_words")
    return [F.log(F.greatest(chars, F.lit(1)) / F.greatest(words, F.lit(1))), _share(F.col("n_symbols"), chars), _share(F.col("n_dup_lines"), words), _share(F.col("n_repeat_words"), words)]


def _least(fit: DataFrame) -> list[float]:
    """The deviations that none is under, by statistic, from the median sizes of the rows (steps of the
    logarithms s0 of words and s1 of characters)."""
    import math

    words, chars = (math.exp((x or 0.0) / STEPS) for x in fit.agg(F.percentile("s0", 0.5), F.percentile("s1", 0.5)).first())
    return [chars**-0.5, math.log1p(100 / chars), math.log1p(100 / words), math.log1p(100 * _WINDOW_TWICE / words)]


def _moments(rows: DataFrame, *by: str, diagonal: bool = False) -> DataFrame:
    """Means m and covariances c of the statistics of each group, from exact sums of whole steps."""
    pairs = [(i, j) for i in _P for j in range(i + 1) if i == j or not diagonal]
    total = lambda x: F.sum(x.cast("decimal(20,0)")).cast("double")
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[total(F.col(f"q{i}")).alias(f"t{i}") for i in _P], *[total(F.col(f"q{i}") * F.col(f"q{j}")).alias(f"t{i}{j}") for i, j in pairs])
    mean = lambda i: F.col(f"t{i}") / F.col("n")
    cov = [((F.col(f"t{i}{j}") / F.col("n") - mean(i) * mean(j)) / STEPS**2).alias(f"c{i}{j}") for i, j in pairs]
    zero = [F.lit(0.0).alias(f"c{i}{j}") for i in _P for j in range(i)] if diagonal else []
    return sums.select(*by, *[(mean(i) / STEPS).alias(f"m{i}") for i in _P], *cov, *zero)


def _factored(est: DataFrame, least: list[float]) -> DataFrame:
    """est (means m, covariances c) with the Cholesky factor l of the covariance whose variances are
    those of `least` deviations at least, the logarithm of its determinant, and how many variances
    are their own."""
    est = est.withColumn("df", sum((F.col(f"c{i}{i}") >= least[i] ** 2).cast("int") for i in _P))
    for i in _P:
        for j in range(i + 1):
            rest = F.greatest(F.col(f"c{i}{i}"), F.lit(least[i] ** 2)) if i == j else F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            est = est.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    return est.withColumn("det", sum((F.log(F.col(f"l{i}{i}")) for i in _P), F.lit(0.0))).drop(*[f"c{i}{j}" for i in _P for j in range(i + 1)])


def _distance(rows: DataFrame, est: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the squared Mahalanobis distance d to their group's estimate."""
    df = rows.join(est, "g", how)
    for i in _P:
        rest = F.col(f"q{i}") / STEPS - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"y{k}")
        df = df.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    df = df.withColumn("d", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in _P), F.lit(0.0)))
    return df.drop(*[f"y{i}" for i in _P], *[f"m{i}" for i in _P], *[f"l{i}{j}" for i in _P for j in range(i + 1)])


def _rank() -> Column:
    """A distance as a whole number of ranks."""
    return F.round(F.log2(F.col("d") + F.lit(2.0**-20)) * RANKS).cast("long")


def estimates(slim: DataFrame, least: list[float], core: float, most_steps: int) -> DataFrame:
    """(g, df, means m, factor l, scale) of each group of slim (g, q0..q3)."""
    quartiles = slim.groupBy("g").agg(*[F.percentile(f"q{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"p{i}") for i in _P])
    zero = [F.lit(0.0).alias(f"c{i}{j}") for i in _P for j in range(i)]
    robust = quartiles.select("g", F.lit(0).alias("start"), *[(F.col(f"p{i}")[1] / STEPS).alias(f"m{i}") for i in _P], *[F.pow((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / (1.349 * STEPS), 2).alias(f"c{i}{i}") for i in _P], *zero)
    plain = _moments(slim, "g", diagonal=True).withColumn("start", F.lit(1))
    est = cut(_factored(robust.unionByName(plain), least), "estimate")
    for step in range(most_steps):
        near = _distance(slim, est.drop("det", "df")).withColumn("rank", _rank())
        limit = cut(near.groupBy("g", "start").agg(F.percentile("rank", core).alias("limit")), "limits")
        new = cut(_factored(_moments(near.join(limit, ["g", "start"]).where("rank <= limit"), "g", "start"), least), "estimate")
        fell = new.join(est.select("g", "start", F.col("det").alias("was")), ["g", "start"]).where("det < was - 1e-6")
        est = new
        if step and fell.isEmpty():
            break
    rest = [c for c in est.columns if c not in ("g", "start", "det")]
    best = cut(est.groupBy("g").agg(F.min(F.struct("det", "start", *rest)).alias("e")).select("g", *[F.col(f"e.{c}") for c in rest]), "best")
    spread = _distance(slim, best.drop("df")).groupBy("g").agg(F.percentile(_rank(), 0.5).alias("median"))
    expected = F.element_at(F.array(*[F.lit(x) for x in _CHI_MEDIANS]), F.greatest("df", F.lit(1)))
    scale = F.when(F.col("df") > 0, F.pow(F.lit(2.0), F.col("median") / RANKS) / expected).otherwise(1.0)
    return cut(best.join(spread, "g").withColumn("scale", scale).drop("median"), "estimates")


def judge(stats: DataFrame, lang_col: str = "lang", source_col: str = "source", core: float = 0.75, most_steps: int = 12, cutoff: float = 28.47, min_group: int = 60) -> DataFrame:
    """stats with base_failed, distance2 and kept. cutoff: the largest squared distance that is kept (a
    chi-squared value with four degrees of freedom passes 28.47 once in a hundred thousand)."""
    outputs = ("base_failed", "distance2", "kept")
    kept = [F.col(f"`{c}`") for c in stats.columns if c.lower() not in outputs]
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    named = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0001"))
    sizes = [_steps(F.log(F.greatest(F.col(c), F.lit(1)))).alias(f"s{i}") for i, c in enumerate(("n_words", "word_chars"))]
    rows = cut(stats.select(F.struct(*kept).alias("row"), base.alias("base_failed"), F.concat_ws("\u0002", named(lang_col), named(source_col)).alias("own"), *[_steps(x).alias(f"q{i}") for i, x in enumerate(_transformed())], *sizes), "stats")
    fit = rows.where(~F.col("base_failed"))
    groups = cut(fit.groupBy("own").count().where(F.col("count") >= min_group).select("own", F.col("own").alias("g")), "groups")
    grouped = rows.join(groups, "own", "left").withColumn("g", F.coalesce("g", F.lit(""))).drop("own")
    slim = grouped.where(~F.col("base_failed")).select("g", *[f"q{i}" for i in _P])
    judged = _distance(grouped, estimates(slim, _least(fit), core, most_steps).drop("df"), "left").withColumn("distance2", F.col("d") / F.col("scale"))
    verdict = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= cutoff, F.lit(True))
    return judged.select("row.*", "base_failed", "distance2", verdict.alias("kept"))
