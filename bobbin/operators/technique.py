"""Techniques inside runs: ties, phases, densities, underlay, small lettering. Every row belongs to a design."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions.columns import distance, floor_near, kth
from .stream import HOP_U, break_kinds, classify_runs, reversals, runs, segments

#: Fixed values of the phase rules: half window, shares of reversals, lengths in units.
WINDOW, LOCK_U, LOCK_SHARE, ZIGZAG_SHARE, ZIGZAG_U, COLUMN_U, RUN_SHARE, PHASE_LEAST = 4, 5.5, 0.3, 0.6, 6.0, 14.0, 0.35, 5

#: Runs of a block whose boxes meet in one row.
CHUNK_RUNS = 256


def of_run():
    return Window.partitionBy("design_id", "run").orderBy("seq")


def strip_ties(df: DataFrame, hop_u: int = HOP_U) -> DataFrame:
    """Stitches of runs without the lock bounces at either end.

    A bounce is four points of which those two apart are equal; it goes while five points or more are left, first at the start,
    then at the end. Points are taken in fours from an end: the bounces that go are those before the first four that is none."""
    ahead = lambda c, k: F.lead(c, k).over(of_run()) == F.col(c)
    r = runs(df, hop_u).withColumn("i", F.row_number().over(of_run()) - 1).withColumn("n", F.count("*").over(Window.partitionBy("design_id", "run")))
    r = r.withColumn("pair", F.coalesce(ahead("x_u", 2) & ahead("y_u", 2), F.lit(False)))
    whole = Window.partitionBy("design_id", "run")
    four = lambda at: F.floor(at / 4)
    # a start's four is no bounce if either of its first two points differs from the one two on, or too few points are left
    good = F.col("pair") & (F.col("n") - four(F.col("i")) * 4 >= 5)
    r = r.withColumn("head", F.coalesce(F.min(F.when((F.col("i") % 4 < 2) & ~good, four(F.col("i")))).over(whole), F.ceil(F.col("n") / 4)) * 4)
    r = r.where(F.col("i") >= F.col("head")).withColumn("j", F.col("n") - 1 - F.col("i")).withColumn("m", F.col("n") - F.col("head"))
    behind = F.coalesce((F.lag("x_u", 2).over(of_run()) == F.col("x_u")) & (F.lag("y_u", 2).over(of_run()) == F.col("y_u")), F.lit(False))
    r = r.withColumn("back", behind)
    good = F.col("back") & (F.col("m") - four(F.col("j")) * 4 >= 5)
    r = r.withColumn("tail", F.coalesce(F.min(F.when((F.col("j") % 4 < 2) & ~good, four(F.col("j")))).over(whole), F.ceil(F.col("m") / 4)) * 4)
    return r.where(F.col("j") >= F.col("tail")).select("design_id", "run", "seq", "x_u", "y_u")


def densify(df: DataFrame, step_u: float, hop_u: int = HOP_U) -> DataFrame:
    """Points of every segment from its start (left out) to its end, none further apart than the step."""
    s = segments(df, hop_u).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("len") / step_u).cast("int")))
    at = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * F.col("part") / F.col("parts")
    return s.withColumn("part", F.explode(F.sequence(F.lit(1), "parts"))).select("design_id", "run", "seq", "part", at("x0", "x1").alias("x"), at("y0", "y1").alias("y"))


def phase_labels(df: DataFrame, hop_u: int = HOP_U) -> DataFrame:
    """A label for each segment from the nine around it: lock L, zigzag Z, satin column S, running R, other O.

    Zigzag and column differ in the median distance of points two apart; runs of fewer than six points are O."""
    w, two = of_run().rowsBetween(-WINDOW, WINDOW), F.col("two")
    r = reversals(df, hop_u=hop_u)
    r = r.withColumn("two", distance(F.lead("x1").over(of_run()) - F.col("x0"), F.lead("y1").over(of_run()) - F.col("y0")))
    r = r.withColumn("med", kth(F.collect_list("len").over(w), 0.5)).withColumn("rev", F.avg(F.col("reversal").cast("int")).over(w))
    r = r.withColumn("twos", F.collect_list(two).over(w)).withColumn("n", F.count("*").over(Window.partitionBy("design_id", "run")))
    step = F.when(F.size("twos") > 0, kth(F.col("twos"), 0.5)).otherwise(0.0)
    label = F.when(F.col("n") < 5, "O").when((F.col("med") <= LOCK_U) & (F.col("rev") >= LOCK_SHARE), "L")
    label = label.when((F.col("rev") >= ZIGZAG_SHARE) & (F.col("med") >= ZIGZAG_U), F.when(step > COLUMN_U, "Z").otherwise("S"))
    return r.select("design_id", "block", "run", "seq", "len", label.when(F.col("rev") <= RUN_SHARE, "R").otherwise("O").alias("label"))


def phase_steps(df: DataFrame, least: int = PHASE_LEAST, hop_u: int = HOP_U) -> DataFrame:
    """Labelled segments with their phase: equal labels in a row; one of fewer than `least` segments joins the phase before it."""
    labels = phase_labels(df, hop_u).withColumn("turn", F.coalesce((F.lag("label").over(of_run()) != F.col("label")).cast("int"), F.lit(1)))
    labels = labels.withColumn("stretch", F.sum("turn").over(of_run()))
    sized = labels.withColumn("c", F.count("*").over(Window.partitionBy("design_id", "run", "stretch")))
    opens = (F.col("turn") == 1) & ((F.col("c") >= least) | (F.col("stretch") == 1))
    return sized.withColumn("phase", F.sum(opens.cast("int")).over(of_run()) - 1)


def phases(df: DataFrame, least: int = PHASE_LEAST, hop_u: int = HOP_U) -> DataFrame:
    """Phases of each run with the label of their first segment."""
    return phase_steps(df, least, hop_u).groupBy("design_id", "block", "run", "phase").agg(F.min_by("label", "seq").alias("label"), F.count("*").alias("steps"), kth(F.collect_list("len"), 0.5).alias("median_len"))


def of_kind(df: DataFrame, kind: str, hop_u: int = HOP_U) -> DataFrame:
    return classify_runs(df, hop_u=hop_u).where(F.col("kind") == kind).select("design_id", "run")


def row_advance(df: DataFrame, least: int = 30, straight: float = 0.6, hop_u: int = HOP_U) -> DataFrame:
    """Each design's fill row advance: the median part, across its run's axis, of steps over 45 degrees off that axis.

    Runs without one axis (concentration below `straight`) don't count; null under `least` such steps. With the best concentration."""
    s = segments(df, hop_u).where("len > 0").hint("merge").join(of_kind(df, "fill", hop_u), ["design_id", "run"], "left_semi")
    s = s.withColumn("dx", (F.col("x1") - F.col("x0")).cast("double")).withColumn("dy", (F.col("y1") - F.col("y0")).cast("double")).withColumn("th", F.atan2("dy", "dx"))
    w = Window.partitionBy("design_id", "run")
    s = s.withColumn("sn", F.sum(F.sin(F.col("th") * 2) * F.col("len")).over(w)).withColumn("cs", F.sum(F.cos(F.col("th") * 2) * F.col("len")).over(w))
    s = s.withColumn("conc", distance(F.col("sn"), F.col("cs")) / F.sum("len").over(w)).withColumn("axis", F.atan2("sn", "cs") / 2)
    along, across = F.abs(F.col("dx") * F.cos("axis") + F.col("dy") * F.sin("axis")), F.abs(F.col("dy") * F.cos("axis") - F.col("dx") * F.sin("axis"))
    step = F.when((F.round("conc", 6) >= straight) & (F.round(along / F.col("len"), 6) < round(0.5**0.5, 6)) & (across > 1e-6), across)
    g = s.groupBy("design_id").agg(F.collect_list(step).alias("steps"), F.max("conc").alias("concentration"))
    return g.select("design_id", F.size("steps").cast("long").alias("n"), F.when(F.size("steps") >= least, kth(F.col("steps"), 0.5)).alias("advance"), "concentration")


def satin_advance(df: DataFrame, least: int = 30, hop_u: int = HOP_U) -> DataFrame:
    """Each design's median distance of points two apart in satin runs; null under `least`."""
    r = runs(df, hop_u).hint("merge").join(of_kind(df, "satin", hop_u), ["design_id", "run"], "left_semi")
    two = distance(F.lead("x_u", 2).over(of_run()) - F.col("x_u"), F.lead("y_u", 2).over(of_run()) - F.col("y_u"))
    g = r.withColumn("two", two).groupBy("design_id").agg(F.collect_list("two").alias("twos"))
    return g.select("design_id", F.size("twos").cast("long").alias("n"), F.when(F.size("twos") >= least, kth(F.col("twos"), 0.5)).alias("advance"))


def small_lettering(df: DataFrame, column_u: float = 10, extent_u: float = 40, hop_u: int = HOP_U) -> DataFrame:
    """Satin runs (a run is a shape here) of each design: how many there are, and how many are too narrow or too small to read."""
    s = segments(df, hop_u).hint("merge").join(of_kind(df, "satin", hop_u), ["design_id", "run"], "left_semi")
    span = lambda c: F.greatest(F.max(f"{c}0"), F.max(f"{c}1")) - F.least(F.min(f"{c}0"), F.min(f"{c}1"))
    each = s.groupBy("design_id", "run").agg(kth(F.collect_list("len"), 0.5).alias("column"), F.greatest(span("x"), span("y")).alias("extent"))
    small = (F.col("column") < column_u) | (F.col("extent") < extent_u)
    return each.groupBy("design_id").agg(F.sum(small.cast("long")).alias("small"), F.count("*").alias("total"), F.min("column").alias("narrowest"))


def short_satin(df: DataFrame, long_u: float = 121, short_u: float = 10, least: int = 30, hop_u: int = HOP_U) -> DataFrame:
    """Steps over `long_u`, the longest, and the share of satin steps under `short_u` (null under `least` of these)."""
    s = segments(df, 1 << 30).groupBy("design_id").agg(F.sum((F.col("len") > long_u).cast("long")).alias("too_long"), F.max("len").alias("longest"))
    satin = segments(df, hop_u).hint("merge").join(of_kind(df, "satin", hop_u), ["design_id", "run"], "left_semi").groupBy("design_id").agg(F.count("*").alias("satin_steps"), F.avg((F.col("len") < short_u).cast("int")).alias("share"))
    return s.join(satin, "design_id", "left").select("design_id", "too_long", "longest", F.coalesce("satin_steps", F.lit(0).cast("long")).alias("satin_steps"), F.when(F.col("satin_steps") >= least, F.col("share")).alias("short_share"))


def line_cells(s: DataFrame, cell_u: float) -> DataFrame:
    """Sample points of segments from end to end, max(2, floor(len / cell) + 1) each, with their cells; `part` is one point's share."""
    n = F.greatest(F.lit(2), F.floor(F.col("len") / cell_u).cast("int") + 1)
    e = s.withColumn("pts", n).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("pts") - 1)))
    at = lambda a, b: floor_near((F.col(a) + (F.col(b) - F.col(a)) * F.col("t") / (F.col("pts") - 1)) / cell_u)
    return e.withColumn("cx", at("x0", "x1")).withColumn("cy", at("y0", "y1")).withColumn("part", F.lit(1.0) / F.col("pts"))


def underlay_points(df: DataFrame, cell_u: float, gap: int, short_u: float, long_u: float) -> DataFrame:
    """Points of sewn steps with `hit`: whether they lie where its own block sews last, over `gap` steps later."""
    s = segments(df, 1 << 30).where((F.col("len") > 0) & (F.col("len") <= long_u)).withColumn("idx", F.row_number().over(Window.partitionBy("design_id").orderBy("seq")))
    pts = line_cells(s, cell_u)
    # windows of cells lie where windows of designs do: no point is shuffled
    cell = Window.partitionBy("design_id", "cx", "cy")
    pts = pts.withColumns({"last": F.max("idx").over(cell), "last_block": F.max_by("block", "idx").over(cell)})
    hit = (F.col("last") > F.col("idx") + gap) & (F.col("last_block") == F.col("block"))
    return pts.withColumn("hit", hit.cast("int")).where(F.col("len") >= short_u)


def underlay_share(df: DataFrame, cell_u: float = 4, gap: int = 15, covered: float = 0.6, short_u: float = 5, long_u: float = 121) -> DataFrame:
    """Millimetres of underlay and of all sewing: a step is underlay if `covered` of its points lie where its own block sews last, over `gap` steps later."""
    sewn = underlay_points(df, cell_u, gap, short_u, long_u).groupBy("design_id", "idx", "len").agg(F.avg("hit").alias("share"))
    return sewn.groupBy("design_id").agg((F.sum(F.when(F.round("share", 9) >= covered, F.col("len")).otherwise(0.0)) * 0.1).alias("underlay_mm"), (F.sum("len") * 0.1).alias("sewn_mm"))


def underlay_cells(df: DataFrame, cell_u: float = 4, gap: int = 15, covered: float = 0.6, short_u: float = 5, long_u: float = 121) -> DataFrame:
    """Cells (design_id, cx, cy) under steps that are underlay."""
    pts = underlay_points(df, cell_u, gap, short_u, long_u).withColumn("share", F.avg("hit").over(Window.partitionBy("design_id", "idx")))
    return pts.where(F.round("share", 9) >= covered).select("design_id", "cx", "cy").distinct()


def exposed_drag(df: DataFrame, hidden: DataFrame, cell_u: float, walk_u: float = 20) -> DataFrame:
    """Millimetres of untrimmed thread on cells that are not `hidden` (design_id, cx, cy), how many steps walk on bare ground, and the worst."""
    pts = line_cells(segments(df, 1 << 30).where("len > 0"), cell_u)
    bare = pts.hint("merge").join(hidden.select("design_id", "cx", "cy").distinct().withColumn("hid", F.lit(1)), ["design_id", "cx", "cy"], "left")
    each = bare.groupBy("design_id", "seq", "len").agg(F.avg(F.col("hid").isNull().cast("int")).alias("f"))
    walk = (F.round("f", 9) > 0.5) & (F.col("len") >= walk_u)
    return each.groupBy("design_id").agg((F.sum(F.col("f") * F.col("len")) * 0.1).alias("drag_mm"), F.sum(walk.cast("long")).alias("walks"), (F.max(F.col("f") * F.col("len")) * 0.1).alias("worst_mm"))


def trim_attribution(df: DataFrame, k: int = 8, hop_u: int = HOP_U) -> DataFrame:
    """The k blocks of a design that open most runs by a trim: runs, trims, share of the design's trims, and runs by kind."""
    b = runs(df, hop_u).groupBy("design_id", "run").agg(F.min("block").alias("block"))
    kinds = break_kinds(df, hop_u).hint("merge").join(b, ["design_id", "run"])
    each = kinds.groupBy("design_id", "block").agg(F.count("*").alias("runs"), *[F.sum((F.col("break_kind") == x).cast("long")).alias(n) for x, n in (("trim", "trims"), ("jump", "jumps"), ("hop", "hops"))])
    total = F.sum("trims").over(Window.partitionBy("design_id"))
    ranked = each.withColumn("share", F.when(total > 0, F.col("trims") / total)).withColumn("place", F.row_number().over(Window.partitionBy("design_id").orderBy(F.desc("trims"), "block")))
    return ranked.where(F.col("place") <= k)


def box_pairs(boxes: DataFrame, cell_u: int) -> DataFrame:
    """Pairs (u < v) of boxes (grp, node, x0, y0, x1, y1) of one group that overlap; they meet in grid cells that both touch."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell_u), F.floor(F.col(b) / cell_u))
    cut = boxes.withColumn("gx", F.explode(span("x0", "x1"))).withColumn("gy", F.explode(span("y0", "y1")))
    p, q = cut.alias("p"), cut.alias("q")
    meets = (F.col("p.x1") >= F.col("q.x0")) & (F.col("q.x1") >= F.col("p.x0")) & (F.col("p.y1") >= F.col("q.y0")) & (F.col("q.y1") >= F.col("p.y0"))
    same = (F.col("p.grp") == F.col("q.grp")) & (F.col("p.gx") == F.col("q.gx")) & (F.col("p.gy") == F.col("q.gy")) & (F.col("p.node") < F.col("q.node"))
    return p.hint("merge").join(q, same & meets).select(F.col("p.node").alias("u"), F.col("q.node").alias("v")).distinct()


def chunk_elements(at: pd.Series) -> pd.Series:
    """For lists of boxes (run, x0, y0, x1, y1, flat, runs in order): the first run of those that overlap, directly or through others."""
    found = []
    for flat in at:
        run, x0, y0, x1, y1 = np.asarray(flat, dtype=np.float64).reshape(-1, 5).T
        root = np.arange(len(run))
        met = (x1[:, None] >= x0) & (x1 >= x0[:, None]) & (y1[:, None] >= y0) & (y1 >= y0[:, None])
        while True:
            # the least root beside each box, then the roots' own roots
            low = np.where(met, root, len(run)).min(axis=1, initial=len(run))
            new = root.copy()
            np.minimum.at(new, root, low)
            new = np.minimum(new, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        found.append(run[root].astype(np.int64))
    return pd.Series(found, dtype=object)


def elements(df: DataFrame, pad_u: int = 3, cell_u: int = 400, hop_u: int = HOP_U) -> DataFrame:
    """design_id, run, element (the first run of it): runs of one block whose padded boxes overlap, directly or through others.

    CHUNK_RUNS runs of a block meet in one row, so a design of no more makes no pairs and needs no round of the graph. In larger blocks boxes of
    different chunks meet in grid cells, and what they join goes through the graph."""
    from .graph import checkpointed, components

    ends = [(f(c) + d * pad_u).cast("double").alias(n) for n, f, c, d in (("x0", F.min, "x_u", -1), ("y0", F.min, "y_u", -1), ("x1", F.max, "x_u", 1), ("y1", F.max, "y_u", 1))]
    b = runs(df, hop_u).groupBy("design_id", "run").agg(F.min("block").alias("block"), *ends)
    chunk = F.floor(F.col("run") / CHUNK_RUNS).cast("long").alias("chunk")
    rows = b.groupBy("design_id", "block", chunk).agg(F.array_sort(F.collect_list(F.struct("run", "x0", "y0", "x1", "y1"))).alias("boxes"))
    flat = F.flatten(F.transform("boxes", lambda e: F.array(*[e[c].cast("double") for c in ("run", "x0", "y0", "x1", "y1")])))
    found = F.pandas_udf(chunk_elements, S.ArrayType(S.LongType()))
    cut = checkpointed(rows.withColumn("root", found(flat)))
    each = cut.select("design_id", "block", "chunk", F.explode(F.arrays_zip("boxes", "root")).alias("e")).select("design_id", "block", "chunk", "e.boxes.*", F.col("e.root").alias("root"))
    run_type = b.schema["run"].dataType
    if cut.where("chunk > 0").isEmpty():
        return each.select("design_id", "run", F.col("root").cast(run_type).alias("element"))
    several = Window.partitionBy("design_id", "block")
    boxes = each.withColumn("__n", F.max("chunk").over(several) - F.min("chunk").over(several)).where(F.col("__n") > 0).drop("__n")
    boxes = boxes.withColumn("grp", F.struct("design_id", "block")).withColumn("node", F.struct("chunk", F.struct("design_id", F.col("root").alias("run")).alias("at")))
    links = box_pairs(boxes, cell_u).where("u.chunk <> v.chunk").select(F.least("u.at", "v.at").alias("u"), F.greatest("u.at", "v.at").alias("v")).distinct()
    links = checkpointed(links)
    joined = components(links.select(F.explode(F.array("u", "v")).alias("node")), links)
    tops = joined.select("node.design_id", F.col("node.run").alias("root"), F.col("root.run").alias("top"))
    met = each.hint("merge").join(tops, ["design_id", "root"], "left")
    return met.select("design_id", "run", F.coalesce("top", "root").cast(run_type).alias("element"))


def recipes(df: DataFrame, hop_u: int = HOP_U) -> DataFrame:
    """Each element's techniques in sewing order, equal ones in a row once, joined by dots."""
    p = phases(df, hop_u=hop_u).hint("merge").join(elements(df, hop_u=hop_u), ["design_id", "run"])
    labels = F.transform(F.array_sort(F.collect_list(F.struct("run", "phase", "label"))), lambda x: x["label"])
    g = p.groupBy("design_id", "element").agg(labels.alias("labels"))
    return g.select("design_id", "element", F.array_join(F.filter("labels", lambda x, i: (i == 0) | (x != F.element_at("labels", F.when(i == 0, 1).otherwise(i)))), ".").alias("recipe"))


def recipe_census(df: DataFrame, k: int = 18, hop_u: int = HOP_U) -> DataFrame:
    return recipes(df, hop_u).groupBy("recipe").agg(F.count("*").alias("elements")).orderBy(F.desc("elements"), "recipe").limit(k)


def lost_and_gained(a: DataFrame, b: DataFrame, hop_u: int = HOP_U) -> DataFrame:
    """Runs (by bounds and number of points) that only one version has."""
    key = lambda d: runs(d, hop_u).groupBy("design_id", "run").agg(F.min("x_u").alias("x0"), F.min("y_u").alias("y0"), F.max("x_u").alias("x1"), F.max("y_u").alias("y1"), F.count("*").alias("n")).drop("run").distinct()
    ka, kb = key(a), key(b)
    on = ["design_id", "x0", "y0", "x1", "y1", "n"]
    return ka.hint("merge").join(kb, on, "left_anti").withColumn("side", F.lit("lost")).unionByName(kb.hint("merge").join(ka, on, "left_anti").withColumn("side", F.lit("gained")))


def worksheet(df: DataFrame, threads: DataFrame, many: int = 25_000, hop_u: int = HOP_U) -> DataFrame:
    """What a machine operator is told of each design: size in mm and inch, counts, threads in order with their names, stabiliser."""
    from .measures import plan_stats

    s = plan_stats(df)
    blocks_ = segments(df, hop_u).groupBy("design_id", "block").agg((F.sum("len") * 0.1).alias("mm"))
    n = threads.select("place", "name")
    listed = blocks_.join(F.broadcast(n), F.pmod(F.col("block"), F.lit(_size(threads))) == F.col("place"), "left")
    seq = listed.groupBy("design_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", F.coalesce("name", F.lit("?")).alias("name")))), lambda x: x["name"]), " > ").alias("threads"))
    size = lambda c, k: F.round(F.col(c) * k, 2)
    stab = F.when(F.col("stitches") > many, "heavy").otherwise("standard")
    return s.join(seq, "design_id", "left").select("design_id", size("width_u", 0.1).alias("width_mm"), size("height_u", 0.1).alias("height_mm"), size("width_u", 0.1 / 25.4).alias("width_in"), size("height_u", 0.1 / 25.4).alias("height_in"), "stitches", "color_changes", "trims", "threads", stab.alias("stabiliser"))


def _size(lookup: DataFrame, most: int = 1_000) -> int:
    """Rows of a small lookup table; an error beyond `most`."""
    n = lookup.limit(most + 1).count()
    if not 0 < n <= most:
        raise ValueError(f"expected 1 to {most} threads")
    return n


def concentration(angle: Column, weight: Column) -> Column:
    """How much of a length-weighted axial mean is left: 1 for one axis, 0 for all directions."""
    return distance(F.sum(F.sin(angle * 2) * weight), F.sum(F.cos(angle * 2) * weight)) / F.sum(weight)
