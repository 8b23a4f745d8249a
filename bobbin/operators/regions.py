"""Regions of rasters: contrast, classes, tonal parts, outlines, colours that only edges have."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import delta_e76
from .colour import REGION, lab, tonal_span, triple
from .pixels import shifted

BOX = [(j, i) for j in (-1, 0, 1) for i in (-1, 0, 1)]
#: Least tone span and area of a region to split, tone a part, most parts.
TONE, TONE_PIXELS, TONE_PART, MOST_PARTS = 18.0, 150, 9.0, 4
#: Share of edge pixels of a phantom, where it lies between its ends, and how near their line.
EDGE_SHARE, BETWEEN, OFF_LINE = 0.9, (0.15, 0.85), 6.0


def subject_contrast(px: DataFrame, background: Column, least: int = 50, from_alpha: Column | None = None) -> DataFrame:
    """Per image the 90th percentile of |L* - the background's median L*| over the other pixels; null without a background, with one that
    alpha gave, or with fewer than `least` pixels on either side."""
    p = lab(px).withColumn("bg", background).withColumn("cut", F.lit(False) if from_alpha is None else from_alpha)
    side = p.groupBy("image_id").agg(F.percentile(F.when(F.col("bg"), F.col("L")), 0.5).alias("mid"), F.count_if(F.col("bg")).alias("nb"), F.count_if(~F.col("bg")).alias("nf"), F.max("cut").alias("cut"))
    off = p.where(~F.col("bg")).join(side, "image_id").groupBy("image_id").agg(F.percentile(F.abs(F.col("L") - F.col("mid")), 0.9).alias("p90"))
    known = ~F.col("cut") & (F.col("nb") >= least) & (F.col("nf") >= least)
    return side.join(off, "image_id", "left").select("image_id", F.when(known, F.col("p90")).alias("contrast"))


def photo_rules(signals: DataFrame, least_px: float = 10, least_contrast: float = 10, least_width_mm: float = 101.6) -> DataFrame:
    """Findings of photos (image_id, photo, px_per_mm, contrast, face, width_mm): coarse pixels, a subject like its background, a face too small."""
    hits = [("coarse", "warn", F.col("px_per_mm") < least_px, F.col("px_per_mm")), ("contrast", "warn", F.col("contrast") < least_contrast, F.col("contrast")), ("face_small", "block", F.col("face") & (F.col("width_mm") <= least_width_mm), F.col("width_mm"))]
    found = F.array(*[F.when(when, F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"), m.cast("double").alias("metric"))) for c, s, when, m in hits])
    return signals.where("photo").select("image_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("image_id", "f.*")


def override_rules(decided: DataFrame, warnings: DataFrame) -> DataFrame:
    """Images whose forced class isn't the detected one, and upstream warnings (image_id, code, count) summed by code."""
    forced = decided.where(F.col("forced").isNotNull() & (F.col("forced") != F.col("class"))).select("image_id", F.concat(F.lit("override:"), "forced").alias("code"), F.lit(1).cast("long").alias("count"))
    return forced.unionByName(warnings.groupBy("image_id", "code").agg(F.sum("count").cast("long").alias("count")))


def region_classes(px: DataFrame, masks: dict[str, Column | None], majority: float = 0.5) -> DataFrame:
    """Class of each region by its pixels: the first of eyes, skin that holds the majority, else background or subject; null if no mask of that
    kind exists (None, or null for all of the image)."""
    of = {k: m if m is not None else F.lit(None).cast("boolean") for k, m in masks.items()}
    g = px.groupBy(*REGION).agg(*[F.avg(of[k].cast("int")).alias(k) for k in ("eyes", "skin", "background")])
    has = lambda k: F.round(k, 9) >= majority
    kind = F.when(has("eyes"), "eyes").when(has("skin"), "skin").when(has("background"), "background").when(F.col("background").isNotNull(), "subject")
    return g.select(*REGION, kind.alias("class"))


def split_tonal(px: DataFrame, tone: float = TONE, least: int = TONE_PIXELS, part: float = TONE_PART) -> DataFrame:
    """Pixels of large regions with much tone, each with a part from 0: bands of equal counts by lightness, 2 to MOST_PARTS of them. Parts aren't cleaned."""
    p = lab(px.where("a > 127"))
    fractions = (1 / 4, 1 / 3, 1 / 2, 2 / 3, 3 / 4)
    cut = p.groupBy(*REGION).agg(F.percentile("L", F.array(*[F.lit(f) for f in fractions])).alias("q"))
    # the aggregate keeps the long expression of a span from being written out at each use
    spans = tonal_span(px).groupBy(*REGION).agg(F.max("n").alias("n"), F.max("span").alias("span"))
    span = spans.where((F.col("n") >= least) & (F.round("span", 6) >= tone)).select(*REGION, F.least(F.greatest(F.floor(F.round(F.col("span") / part, 6) + 0.5), F.lit(2)), F.lit(MOST_PARTS)).alias("parts"))
    met = p.hint("merge").join(span.hint("merge").join(cut, list(REGION)), list(REGION))
    above = lambda i: (F.round("L", 9) >= F.round(F.col("q")[i], 9)).cast("int")
    band = F.when(F.col("parts") == 2, above(2)).when(F.col("parts") == 3, above(1) + above(3)).otherwise(above(0) + above(2) + above(4))
    return met.select(*REGION, "y", "x", "parts", band.alias("part"))


def outline(cells: DataFrame) -> DataFrame:
    """Cells (image_id, y, x) of a set that have a neighbour, of eight, outside it."""
    own = cells.select("image_id", "y", "x").distinct()
    inner = shifted(own, BOX).groupBy("image_id", "y", "x").count().where("count = 9")
    return own.hint("merge").join(inner, ["image_id", "y", "x"], "left_anti")


def to_outline(source: DataFrame, target: DataFrame, frame: DataFrame) -> DataFrame:
    """Distance of each source cell to the nearest target cell of its image (no row where that has none).

    In two passes: windows down each column of the frame (the box from 0 to the largest y and x) give the nearest target there, then each row's columns are
    compared with the cell, so a task holds one row of an image and no pairs of cells are made."""
    w = Window.partitionBy("image_id", "x").orderBy("y")
    size = frame.groupBy("image_id").agg(F.max("y").alias("h"), F.max("x").alias("w"))
    box = size.select("image_id", F.explode(F.sequence(F.lit(0), "h")).alias("y"), "w").select("image_id", "y", F.explode(F.sequence(F.lit(0), "w")).alias("x"))
    f = box.hint("merge").join(target.withColumn("t", F.col("y")), ["image_id", "y", "x"], "left")
    up = F.col("y") - F.last("t", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    down = F.first("t", True).over(w.rowsBetween(0, Window.unboundedFollowing)) - F.col("y")
    rows = f.withColumn("g", F.least(up, down)).where("g is not null").groupBy("image_id", "y").agg(F.collect_list(F.struct("x", "g")).alias("row"))
    d = F.array_min(F.transform("row", lambda c: (c["x"] - F.col("x")) * (c["x"] - F.col("x")) + c["g"] * c["g"]))
    return source.hint("merge").join(rows, ["image_id", "y"]).select("image_id", "y", "x", F.sqrt(d.cast("double")).alias("d"))


def boundary_distance(a: DataFrame, b: DataFrame, frame: DataFrame) -> DataFrame:
    """Symmetric Hausdorff and mean distance of two sets' outlines in each image; null where a side is empty."""
    p, q = outline(a), outline(b)
    both = to_outline(p, q, frame).unionByName(to_outline(q, p, frame)).groupBy("image_id").agg(F.max("d").alias("hausdorff"), F.avg("d").alias("mean"))
    return frame.select("image_id").distinct().join(both, "image_id", "left")


def phantom_colours(px: DataFrame, share: float = EDGE_SHARE, off_line: float = OFF_LINE) -> DataFrame:
    """Labels of each image and where they go: one that is nearly all edge, and whose mean colour lies between those of two others, goes to the
    nearest label that stays (lowest on ties); the rest stay. A palette has tens of labels, so an image's triples are few."""
    seen = px.where("a > 127")
    right, down = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    beside = lambda w, f, at, k: F.coalesce((f(at).over(w) == F.col(at) + k) & (f("label").over(w) != F.col("label")), F.lit(False))
    edge = reduce(lambda p, q: p | q, [beside(right, F.lead, "x", 1), beside(right, F.lag, "x", -1), beside(down, F.lead, "y", 1), beside(down, F.lag, "y", -1)])
    g = lab(seen.withColumn("edge", edge)).groupBy("image_id", "label").agg(F.round(F.avg(F.col("edge").cast("int")), 9).alias("edges"), *[F.avg(c).alias(c) for c in "LAB"])
    end = lambda n: g.select("image_id", F.col("label").alias(f"{n}_label"), *[F.col(c).alias(f"{n}{c}") for c in "LAB"])
    t = g.where(F.col("edges") >= share).join(end("p"), "image_id").where("p_label <> label").join(end("q"), "image_id").where("q_label <> label and p_label < q_label")
    dot = lambda u, v: sum((u(c) * v(c) for c in "LAB"), F.lit(0.0))
    ab, aj = (lambda c: F.col(f"q{c}") - F.col(f"p{c}")), (lambda c: F.col(c) - F.col(f"p{c}"))
    t = t.withColumn("l2", dot(ab, ab)).where("l2 > 0").withColumn("t", dot(aj, ab) / F.col("l2"))
    off = F.sqrt(sum((F.pow(aj(c) - F.col("t") * ab(c), 2) for c in "LAB"), F.lit(0.0)))
    blend = (F.round("t", 6) > BETWEEN[0]) & (F.round("t", 6) < BETWEEN[1]) & (F.round(off, 6) < off_line)
    gone = t.where(blend).select("image_id", "label").distinct()
    kept = g.hint("merge").join(gone, ["image_id", "label"], "left_anti").select("image_id", F.col("label").alias("to"), *[F.col(c).alias(f"k{c}") for c in "LAB"])
    near = g.hint("merge").join(gone, ["image_id", "label"], "left_semi").join(kept, "image_id").groupBy("image_id", "label").agg(F.min(F.struct(F.round(delta_e76(triple(""), triple("k")), 6).alias("d"), "to")).alias("m"))
    return g.select("image_id", "label").hint("merge").join(near, ["image_id", "label"], "left").select("image_id", "label", F.coalesce("m.to", "label").alias("to_label"))


def gate_attribution(rejected: DataFrame) -> DataFrame:
    """Per reason (shape rows: reason, cells, margin): shapes, cells, their share, and the median and 90th percentile of the margin."""
    g = rejected.groupBy("reason").agg(F.count("*").alias("shapes"), F.sum("cells").cast("long").alias("cells"), F.percentile("margin", 0.5).alias("median"), F.percentile("margin", 0.9).alias("p90"))
    # a row a reason by now
    return g.withColumn("share", F.col("cells") / F.sum("cells").over(Window.partitionBy(F.lit(1))))


def straddle_patterns(shapes: DataFrame) -> DataFrame:
    """Shapes and cells by pattern with their share, and the totals under a null pattern."""
    g = shapes.rollup("pattern").agg(F.count("*").alias("shapes"), F.sum("cells").cast("long").alias("cells"))
    return g.withColumn("share", F.col("cells") * 2 / F.sum("cells").over(Window.partitionBy(F.lit(1))))
