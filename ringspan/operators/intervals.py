"""Annotation intervals on circles: arcs, classes, overlap, nesting, edits and pruning.

Tables hold (k, s, e, ...): a circle's key, a 0-based start and an exclusive end. A feature whose location is compound
has `parts` as well, an array of (start, end, strand) in the order of reading; s and e are then the least start and the
largest end, and edits, grafts and rotations move every part.

Joins of features with features meet in tiles: a feature lies in one or two tiles about as long as itself, and looks for
longer ones in each coarser size, so pairs are found where they overlap and not by comparing all features of a circle.
Circles of few features are one tile. Each pair is found once, in the tile where the later of the two begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Annotation types that are bookkeeping, and words that mark essential elements.
BOOKKEEPING = ("primer_bind", "primer", "source")
ESSENTIAL = ("ori", "ampr", "neor", "kanr", "puro", "blast", "bsd", "hygro")


def functional(feats: DataFrame, type_col: str = "type") -> DataFrame:
    return feats.where(~F.coalesce(F.col(type_col), F.lit("")).isin(*BOOKKEEPING))


def label_matches(label, names: list[str]) -> Column:
    """Whether a label holds one of the names, letter case aside."""
    return F.coalesce(F.exists(F.array(*[F.lit(n.lower()) for n in names]) if names else F.array().cast("array<string>"), lambda n: F.contains(F.lower(label), n)), F.lit(False))


def looks_essential(label) -> Column:
    return F.coalesce(F.lower(label).rlike("|".join(ESSENTIAL)), F.lit(False))


def overlaps(a_s, a_e, b_s, b_e) -> Column:
    return (a_s < b_e) & (b_s < a_e)


def contains(o_s, o_e, i_s, i_e) -> Column:
    """Strictly: the outer one is longer."""
    return (o_s <= i_s) & (i_e <= o_e) & (o_e - o_s > i_e - i_s)


def tight_arc(feats: DataFrame, length) -> DataFrame:
    """(k, arc_start, arc_end): the shortest arc that covers all intervals of a circle, the
    complement of the widest gap. The gap before an interval is from the largest end so far, so
    nested intervals do no harm; ties go to the first gap, the one across the origin last."""
    by = Window.partitionBy("k").orderBy("s", "e")
    before = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = feats.select("k", "s", "e", (length if isinstance(length, Column) else F.lit(length)).alias("n")).withColumns({"before": before, "nth": F.row_number().over(by)})
    bounds = rows.groupBy("k").agg(F.min("s").alias("lo"), F.max("e").alias("hi"), F.max("n").alias("n"), F.max(F.when(F.col("before").isNotNull(), F.struct((F.col("s") - F.col("before")).alias("gap"), (-F.col("nth")).alias("r"), F.col("s").alias("to"), F.col("before").alias("of")))).alias("w"))
    outside = F.col("lo") + F.col("n") - F.col("hi")
    inner = F.coalesce(F.col("w.gap"), F.lit(-1)) > outside
    return bounds.select("k", F.when(inner, F.col("w.to")).otherwise(F.col("lo")).alias("arc_start"), F.when(inner, F.col("w.of") + F.col("n")).otherwise(F.col("hi")).alias("arc_end"))


def classify(feats: DataFrame, targets: DataFrame, protect: list[str] | None = None, margin: int = 0) -> DataFrame:
    """feats with their class against the target (k, t_s, t_e) of their circle: removed (inside it),
    umbrella (containing it), else protected, its bounds widened by a margin. `contradiction` marks
    what is to be removed and protected at once. An insertion interrupts only what it is inside of."""
    f = functional(feats).join(targets, "k")
    inside = (F.col("s") >= F.col("t_s")) & (F.col("e") <= F.col("t_e"))
    point = F.col("t_s") == F.col("t_e")
    around = F.when(point, (F.col("s") < F.col("t_s")) & (F.col("e") > F.col("t_e"))).otherwise((F.col("s") <= F.col("t_s")) & (F.col("e") >= F.col("t_e")))
    cls = F.when(inside, "removed").when(around, "umbrella").otherwise("protected")
    f = f.withColumn("class", cls)
    wide = F.when(F.col("class") == "protected", margin).otherwise(0)
    return f.withColumns({"p_s": F.col("s") - wide, "p_e": F.col("e") + wide, "contradiction": (F.col("class") == "removed") & label_matches(F.col("label"), protect or [])})


#: Features of a circle up to which all of them are one tile.
ONE_TILE = 32


def _tiles(s, e, width):
    """The tiles that an interval touches, its end included."""
    return F.sequence(F.floor(s / width), F.floor(F.greatest(s, e) / width))


def _meeting(feats: DataFrame, cols: list[str]) -> DataFrame:
    """Pairs (x, y) of structs of features (k, s, e, ...) of one circle that share a tile in which the later of the two begins, y of
    a tile size no finer than x's: once each, and a feature with itself. Pairs that touch are among them."""
    length = F.greatest(F.col("e") - F.col("s"), F.lit(1))
    size = feats.groupBy("k").agg(F.count(F.lit(1)).alias("_n"), F.max(length).alias("_w")).where(F.col("_n") > ONE_TILE).select("k", F.ceil(F.log2("_w")).cast("int").alias("_top"))
    f = feats.join(size, "k", "left").select("k", F.struct("s", "e", *cols).alias("f"), "_top", F.when(F.col("_top").isNotNull(), F.ceil(F.log2(length)).cast("int")).otherwise(-1).alias("level")).where("f.s is not null and f.e is not null")
    width = lambda level: F.pow(F.lit(2.0), level)
    one = F.array(F.lit(0).cast("long"))
    home = f.select("k", F.col("f").alias("y"), F.col("level").alias("tier"), F.explode(F.when(F.col("level") >= 0, _tiles(F.col("f.s"), F.col("f.e"), width(F.col("level")))).otherwise(one)).alias("tile"))
    ask = f.select("k", F.col("f").alias("x"), F.col("level").alias("own"), F.explode(F.when(F.col("level") >= 0, F.sequence("level", "_top")).otherwise(F.array(F.lit(-1)))).alias("tier"))
    ask = ask.select("k", "x", "own", "tier", F.explode(F.when(F.col("tier") >= 0, _tiles(F.col("x.s"), F.col("x.e"), width(F.col("tier")))).otherwise(one)).alias("tile"))
    met = ask.join(home, ["k", "tier", "tile"])
    return met.where((F.col("tier") < 0) | (F.col("tile") == F.floor(F.greatest("x.s", "y.s") / width(F.col("tier"))))).select("k", "x", "y", (F.col("own") == F.col("tier")).alias("alike"))


def overlapping_pairs(feats: DataFrame, id_col: str = "f") -> DataFrame:
    """(k, a, b): pairs of features of one circle that overlap."""
    x, y = F.col(f"x.{id_col}"), F.col(f"y.{id_col}")
    met = _meeting(feats, [id_col]).where(overlaps(F.col("x.s"), F.col("x.e"), F.col("y.s"), F.col("y.e")) & ((~F.col("alike") & (x != y)) | (x < y)))
    return met.select("k", F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def nested_pairs(feats: DataFrame, id_col: str = "f") -> DataFrame:
    """(k, outer, inner, outer_label, inner_label): strict containments."""
    met = _meeting(feats, [id_col, "label"]).where(contains(F.col("y.s"), F.col("y.e"), F.col("x.s"), F.col("x.e")))
    return met.select("k", F.col(f"y.{id_col}").alias("outer"), F.col(f"x.{id_col}").alias("inner"), F.col("y.label").alias("outer_label"), F.col("x.label").alias("inner_label"))


def inside_span(feats: DataFrame, start, end) -> DataFrame:
    """The features that lie in a span, counted from its start."""
    return feats.where((F.col("s") >= start) & (F.col("e") <= end)).withColumns({"s": F.col("s") - start, "e": F.col("e") - start})


def repeat_arrays(feats: DataFrame, least: int = 3, id_col: str = "f") -> DataFrame:
    """(k, array, label, copies): the first feature of each circle that holds at least three strict
    sub-features which all share one label."""
    n = nested_pairs(feats, id_col).groupBy("k", "outer").agg(F.count(F.lit(1)).alias("copies"), F.count_distinct("inner_label").alias("labels"), F.min("inner_label").alias("label"))
    found = n.where((F.col("copies") >= least) & (F.col("labels") == 1))
    nth = F.row_number().over(Window.partitionBy("k").orderBy("outer"))
    return found.withColumn("r", nth).where("r = 1").select("k", F.col("outer").alias("array"), "label", "copies")


def named_spans(feats: DataFrame, names: list[str]) -> DataFrame:
    """(k, label, s, e): the longest feature of each label that matches a name."""
    hit = feats.where(label_matches(F.col("label"), names))
    nth = F.row_number().over(Window.partitionBy("k", "label").orderBy(F.desc(F.col("e") - F.col("s")), "s"))
    return hit.withColumn("r", nth).where("r = 1").select("k", "label", "s", "e")


def _clamped(s, e, start, end, put_length) -> tuple[Column, Column]:
    """Where a span lies after an edit of [start, end) to put_length bases."""
    delta = put_length - (end - start)
    return F.when(s < start, s).when(s >= end, s + delta).otherwise(start), F.when(e <= start, e).when(e >= end, e + delta).otherwise(start)


def remap(feats: DataFrame, start, end, put_length, note: str = "truncated by edit") -> DataFrame:
    """Features after an edit of [start, end) to put_length bases: starts inside the edit move to its
    start, ends inside it likewise; what is left empty goes; `truncated` marks a changed length. A
    feature that ends at a pure insertion stays, one that starts there moves on.

    With `parts` each part moves by itself; empty ones go, and a feature is truncated if a part that stays is. With `qualifiers`
    a truncated feature gets the note."""
    if "parts" in feats.columns:
        moved = F.transform("parts", lambda p: F.struct(*(c.cast("int").alias(n) for c, n in zip(_clamped(p["start"], p["end"], start, end, put_length), ("start", "end"), strict=True)), p["strand"].alias("strand"), (p["end"] - p["start"]).alias("was")))
        f = feats.withColumn("_moved", F.filter(moved, lambda p: p["end"] > p["start"])).where(F.size("_moved") > 0)
        f = f.withColumns({"truncated": F.exists("_moved", lambda p: p["end"] - p["start"] != p["was"]), "parts": F.transform("_moved", lambda p: F.struct(p["start"], p["end"], p["strand"]))}).drop("_moved")
        f = located(f)
    else:
        s, e = _clamped(F.col("s"), F.col("e"), start, end, put_length)
        f = feats.withColumns({"ns": s, "ne": e, "len": F.col("e") - F.col("s")}).where(F.col("ne") > F.col("ns"))
        f = f.withColumn("truncated", (F.col("ne") - F.col("ns")) != F.col("len")).drop("s", "e", "len").withColumnsRenamed({"ns": "s", "ne": "e"})
    if "type" in feats.columns:
        f = f.where(~(F.col("truncated") & F.coalesce(F.col("type"), F.lit("")).isin(*BOOKKEEPING)))
    if "qualifiers" in feats.columns:
        none = F.array().cast("array<string>")
        said = F.concat(F.coalesce(F.col("qualifiers")["note"], none), F.array(F.lit(note)))
        kept = F.map_filter(F.coalesce("qualifiers", F.create_map().cast("map<string,array<string>>")), lambda k, _: k != "note")
        f = f.withColumn("qualifiers", F.when(F.col("truncated"), F.map_concat(kept, F.create_map(F.lit("note"), said))).otherwise(F.col("qualifiers")))
    return f


def located(feats: DataFrame) -> DataFrame:
    """feats with s and e after their parts."""
    return feats.withColumns({"s": F.array_min(F.transform("parts", lambda p: p["start"])), "e": F.array_max(F.transform("parts", lambda p: p["end"]))})


def remap_parts(parts: Column, start: Column, end: Column, put_length: Column) -> Column:
    """The same for an array of parts (start, end, strand) of one feature."""
    moved = lambda p: _clamped(p["start"], p["end"], start, end, put_length)
    return F.filter(F.transform(parts, lambda p: F.struct(moved(p)[0].cast("int").alias("start"), moved(p)[1].cast("int").alias("end"), p["strand"].alias("strand"))), lambda p: p["end"] > p["start"])


def rotate_parts(parts: Column, k: Column, length: Column) -> Column:
    """Parts after the origin moved to k. A part that runs across the new origin becomes two, in the order of reading; two
    that were parted by the old origin alone become one again."""
    at = lambda p: F.pmod(p["start"] - k, length).cast("int")
    part = lambda s, e, strand: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), strand.alias("strand"))
    zero = F.lit(0)

    def split(p):
        s, e = at(p), at(p) + (p["end"] - p["start"])
        right, left = part(s, length, p["strand"]), part(zero, e - length, p["strand"])
        return F.when(e <= length, F.array(part(s, e, p["strand"]))).otherwise(F.when(p["strand"] < 0, F.array(left, right)).otherwise(F.array(right, left)))

    seam = F.pmod(-k, length)

    def join(done, p):
        last = F.element_at(done, -1)
        ahead = (p["strand"] >= 0) & (last["end"] == p["start"]) & (p["start"] == seam)
        back = (p["strand"] < 0) & (last["start"] == p["end"]) & (p["end"] == seam)
        meets = (F.size(done) > 0) & (last["strand"] == p["strand"]) & (ahead | back)
        one = part(F.least(last["start"], p["start"]), F.greatest(last["end"], p["end"]), p["strand"])
        return F.when(F.coalesce(meets, F.lit(False)), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(one))).otherwise(F.concat(done, F.array(p)))

    kind = "array<struct<start:int,end:int,strand:int>>"
    return F.aggregate(F.flatten(F.transform(parts, split)), F.array().cast(kind), join)


def rotate(feats: DataFrame, k, length) -> DataFrame:
    """Features after the origin moved to k. s and e keep the width (e may pass the length); parts are split where they
    run across the origin."""
    s, e = rotate_span(F.col("s"), F.col("e"), k, length)
    f = feats.withColumns({"_s": s.cast("int"), "_e": e.cast("int")}).drop("s", "e").withColumnsRenamed({"_s": "s", "_e": "e"})
    return f.withColumn("parts", rotate_parts(F.col("parts"), k, length)) if "parts" in feats.columns else f


def turn_over(feats: DataFrame, length) -> DataFrame:
    """Features of a stretch of a length read on its other strand."""
    f = feats.withColumns({"_s": length - F.col("e"), "_e": length - F.col("s")}).drop("s", "e").withColumnsRenamed({"_s": "s", "_e": "e"})
    if "parts" not in feats.columns:
        return f
    return f.withColumn("parts", F.transform("parts", lambda p: F.struct((length - p["end"]).cast("int").alias("start"), (length - p["start"]).cast("int").alias("end"), (-p["strand"]).alias("strand"))))


def graft(feats: DataFrame, donor: DataFrame, offset) -> DataFrame:
    """feats and the donor's features, shifted with all their parts."""
    moved = donor.withColumns({"s": F.col("s") + offset, "e": F.col("e") + offset})
    if "parts" in donor.columns:
        moved = moved.withColumn("parts", F.transform("parts", lambda p: F.struct((p["start"] + offset).cast("int").alias("start"), (p["end"] + offset).cast("int").alias("end"), p["strand"].alias("strand"))))
    return feats.unionByName(moved)


def rotate_span(s, e, k, length) -> tuple[Column, Column]:
    """A span after the origin moved to k; its width stays."""
    at = F.pmod(s - k, length)
    return at, at + (e - s)


def zoom(s, e, length) -> tuple[Column, Column]:
    """The window of a close-up: a quarter of the width to either side, 300 at least, clamped."""
    pad = F.greatest(F.lit(300), F.floor((e - s) / 4)).cast("int")
    return F.greatest(s - pad, F.lit(0)), F.least(e + pad, length)


def prune(feats: DataFrame, min_bp: int = 60, protect: list[str] | None = None, limit: int = 14, id_col: str = "f") -> DataFrame:
    """The features worth drawing: no bookkeeping, none under min_bp, no umbrella over differently
    named ones, no member of an array whose frame is drawn, nothing nested in what is left; the
    largest `limit` of each circle. Protected labels stay."""
    keep = label_matches(F.col("label"), protect or [])
    f = functional(feats).where((F.col("e") - F.col("s") >= min_bp) | keep)
    kinds = nested_pairs(f, id_col).groupBy("k", "outer").agg(F.count_distinct("inner_label").alias("kinds"))
    f = f.join(kinds.select("k", F.col("outer").alias(id_col), "kinds"), ["k", id_col], "left").where(keep | (F.coalesce("kinds", F.lit(0)) < 2)).drop("kinds")
    inner = nested_pairs(f, id_col).select("k", F.col("inner").alias(id_col)).distinct().withColumn("nested", F.lit(True))
    f = f.join(inner, ["k", id_col], "left").where(keep | F.col("nested").isNull()).drop("nested")
    nth = F.row_number().over(Window.partitionBy("k").orderBy(F.desc(keep), F.desc(F.col("e") - F.col("s")), "s", id_col))
    return f.withColumn("r", nth).where(F.col("r") <= limit).drop("r")


def resolve_targets(feats: DataFrame, lengths: DataFrame, names: list[str]) -> DataFrame:
    """(k, t_s, t_e, labels): the tight arc over the features that match a name, per circle; an end
    past the length wraps the origin. feats: (k, s, e, label, type); lengths: (k, n). Circles without
    a match have no row."""
    hit = functional(feats).where(label_matches(F.col("label"), names)).join(lengths, "k")
    labels = hit.groupBy("k").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    return tight_arc(hit, F.col("n")).join(labels, "k").select("k", F.col("arc_start").alias("t_s"), F.col("arc_end").alias("t_e"), "labels")


def centred(circles: DataFrame) -> DataFrame:
    """circles (s, t_s, t_e) whose target wraps the origin, turned so that it stands in the middle;
    `turned` is the place that the origin moved to, 0 where nothing moved."""
    n, w = F.length("s"), F.col("t_e") - F.col("t_s")
    k = F.when(F.col("t_e") > n, F.pmod(F.col("t_s") - F.floor((n - w) / 2), n)).otherwise(0).cast("int")
    c = circles.withColumn("turned", k)
    at = F.pmod(F.col("t_s") - F.col("turned"), n).cast("int")
    c = c.withColumns({"_at": at, "_w": w.cast("int"), "s": F.concat(F.substr("s", F.col("turned") + 1), F.substr("s", F.lit(1), F.col("turned")))})
    return c.drop("t_s", "t_e").withColumns({"t_s": F.col("_at"), "t_e": F.col("_at") + F.col("_w")}).drop("_at", "_w")
