"""Measures of stitch tables: one or two aggregates each, keyed by design, block, run or cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import axial_mean, distance, kth
from .stream import HOP_U, break_kinds, classify_runs, cut_gaps, design, reversals, runs, sample_segments, segments, so_far

#: Thread drawn per length of seam.
THREAD_FACTOR = 1.35


def _n(cond) -> F.Column:
    return F.sum(cond.cast("int")).cast("long")


def plan_stats(df: DataFrame) -> DataFrame:
    prev = F.lag("cmd").over(design())
    lone = (F.col("cmd") == "jump") & (prev.isNull() | (prev != "trim"))
    s = F.col("cmd") == "stitch"
    g = df.withColumn("__lone", lone).groupBy("design_id").agg(_n(s).alias("stitches"), _n(F.col("cmd") == "color").alias("color_changes"), _n(F.col("cmd") == "trim").alias("trims"), _n(F.col("__lone")).alias("jumps"), *[f(F.when(s, F.col(c))).alias(f"{k}_{c[0]}") for c in ("x_u", "y_u") for k, f in (("min", F.min), ("max", F.max))])
    return g.withColumn("width_u", F.col("max_x") - F.col("min_x")).withColumn("height_u", F.col("max_y") - F.col("min_y"))


def thread_length(df: DataFrame, hop_u: int = HOP_U) -> DataFrame:
    """Millimetres of thread by block, with the design's total in the row of a null block."""
    r = segments(df, hop_u).rollup("design_id", "block").agg(F.sum("len").alias("units"))
    return r.where("design_id is not null").select("design_id", "block", (F.col("units") * 0.1 * THREAD_FACTOR).alias("thread_mm"))


def record_kinds(df: DataFrame) -> DataFrame:
    return df.groupBy("design_id").pivot("cmd", ["stitch", "jump", "trim", "color"]).count().na.fill(0)


def bbox(df: DataFrame) -> DataFrame:
    """Bounding box without colour and end rows; zeros where nothing is left."""
    ok = ~F.col("cmd").isin("color", "end")
    return df.groupBy("design_id").agg(*[F.coalesce(f(F.when(ok, F.col(c))), F.lit(0)).alias(f"{k}_{c[0]}") for c in ("x_u", "y_u") for k, f in (("min", F.min), ("max", F.max))])


def block_summary(df: DataFrame, hop_u: int = HOP_U) -> DataFrame:
    s = segments(df, hop_u).groupBy("design_id", "block").agg(F.count("*").alias("steps"), F.countDistinct("run").alias("runs"), *[kth(F.collect_list("len"), q).alias(f"p{int(q * 100)}") for q in (0.1, 0.5, 0.9)], (F.sum("len") * 0.1).alias("mm"), *[F.min(F.least(f"{c}0", f"{c}1")).alias(f"min_{c}") for c in "xy"], *[F.max(F.greatest(f"{c}0", f"{c}1")).alias(f"max_{c}") for c in "xy"])
    return s


def break_histogram(df: DataFrame, hop_u: int = HOP_U) -> DataFrame:
    return break_kinds(df, hop_u).groupBy("design_id").pivot("break_kind", ["start", "trim", "color", "jump", "hop"]).count().na.fill(0)


def trims_per_1000(df: DataFrame, least: int = 30, hop_u: int = HOP_U) -> DataFrame:
    """Trimmed runs per 1000 stitches, one fewer when the first run is trimmed; null below `least` stitches."""
    k = break_kinds(df, hop_u).groupBy("design_id").agg(_n(F.col("break_kind") == "trim").alias("trims"), F.max((F.col("break_kind").isin("trim") & (F.col("run") == 0)).cast("int")).alias("first"))
    n = df.where("cmd = 'stitch'").groupBy("design_id").agg(F.count("*").alias("stitches"))
    rate = F.when(F.col("stitches") >= least, (F.coalesce("trims", F.lit(0)) - F.coalesce("first", F.lit(0))) * 1000.0 / F.col("stitches"))
    return n.join(k, "design_id", "left").select("design_id", "stitches", rate.alias("trims_per_1000"))


def same_hole_rate(df: DataFrame, least: int = 30) -> DataFrame:
    """Places struck twice or more, over all penetrations; null below `least`."""
    holes = df.where("cmd = 'stitch'").groupBy("design_id", "x_u", "y_u").agg(F.count("*").alias("n"))
    g = holes.groupBy("design_id").agg(_n(F.col("n") >= 2).alias("shared"), F.sum("n").cast("long").alias("n"))
    return g.select("design_id", "n", F.when(F.col("n") >= least, F.col("shared") / F.col("n")).alias("same_hole_rate"))


def dominant_angle(df: DataFrame, hop_u: int = HOP_U) -> DataFrame:
    """Length-weighted axial mean direction of each run and its concentration R."""
    s = segments(df, hop_u).where("len > 0")
    a = F.atan2((F.col("y1") - F.col("y0")).cast("double"), (F.col("x1") - F.col("x0")).cast("double"))
    r = distance(F.sum(F.sin(a * 2) * F.col("len")), F.sum(F.cos(a * 2) * F.col("len"))) / F.sum("len")
    return s.groupBy("design_id", "run").agg(axial_mean(a, F.col("len")).alias("angle"), r.alias("concentration"), F.count("*").alias("n"))


def cell_map(df: DataFrame, cell_u: float = 20, least_u: float = 20, hop_u: int = HOP_U) -> DataFrame:
    """Per cell (by a segment's middle): thread, median length, reversal share, direction with its concentration, and stitch type."""
    s = reversals(df, -0.866, hop_u)
    th = F.atan2((F.col("y1") - F.col("y0")).cast("double"), (F.col("x1") - F.col("x0")).cast("double"))
    kept = distance(F.sum(F.sin(th * 2) * F.col("len")), F.sum(F.cos(th * 2) * F.col("len"))) / F.sum("len")
    cell = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2 / cell_u)
    g = s.groupBy("design_id", cell("x0", "x1").alias("ci"), cell("y0", "y1").alias("cj")).agg(F.sum("len").alias("tot"), kth(F.collect_list("len"), 0.5).alias("med"), F.avg(F.col("reversal").cast("int")).alias("rev"), axial_mean(th, F.col("len")).alias("angle"), F.when(F.sum("len") > 0, kept).alias("concentration"))
    kind = F.when(F.col("rev") >= 0.5, "satin").when(F.col("med") <= 25, "run").otherwise("fill")
    return g.where(F.col("tot") >= least_u).withColumn("typ", kind)


def rail_advance(df: DataFrame, hop_u: int = HOP_U, least: int = 1) -> DataFrame:
    """Median distance of stitches two apart in each run."""
    w = Window.partitionBy("design_id", "run").orderBy("seq")
    p = runs(df, hop_u).withColumn("x2", F.lead("x_u", 2).over(w)).withColumn("y2", F.lead("y_u", 2).over(w)).where("x2 is not null")
    return p.groupBy("design_id", "run").agg(F.count("*").alias("n"), kth(F.collect_list(distance(F.col("x2") - F.col("x_u"), F.col("y2") - F.col("y_u"))), 0.5).alias("advance")).where(F.col("n") >= least)


def satin_stats(df: DataFrame, hop_u: int = HOP_U) -> DataFrame:
    """Width (step length) median and maximum, and density (two apart) median, by run."""
    width = segments(df, hop_u).groupBy("design_id", "run").agg(kth(F.collect_list("len"), 0.5).alias("width"), F.max("len").alias("widest"))
    return width.hint("merge").join(rail_advance(df, hop_u).select("design_id", "run", F.col("advance").alias("density")), ["design_id", "run"], "left")


def class_census(df: DataFrame, hop_u: int = HOP_U) -> DataFrame:
    """Step lengths by run class over the corpus."""
    s = segments(df, hop_u).hint("merge").join(classify_runs(df, hop_u=hop_u).select("design_id", "run", "kind"), ["design_id", "run"])
    # ranks by counting equal lengths first: no class's rows meet in one task
    by_len = s.groupBy("kind", F.round("len", 4).alias("len")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("kind").orderBy("len")
    cum = by_len.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("kind")))
    pick = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("n") * q), F.col("len")))
    return cum.groupBy("kind").agg(F.max("n").alias("n"), pick(0.5).alias("median"), pick(0.9).alias("p90"), F.max("len").alias("most"))


def stitch_length_check(df: DataFrame, longest_u: float = 60, short_u: float = 10, hop_u: int = 1 << 30) -> DataFrame:
    return segments(df, hop_u).groupBy("design_id").agg(_n(F.col("len") > longest_u).alias("too_long"), F.max("len").alias("longest"), F.avg((F.col("len") < short_u).cast("int")).alias("short_share"), F.count("*").alias("n"))


def audit_stats(df: DataFrame, short_u: float = 8, hop_u: int = HOP_U) -> DataFrame:
    """Per design: trims, jumps, shortest cut gap, travel, short steps of fills, and the widest advance (two points apart) of satin.

    All windows and both groupings are by the design first: one shuffle of the stitches."""
    down = F.col("cmd") == "stitch"
    prev = lambda c: F.lag(c).over(design())
    m = df.withColumns({"prev": prev("cmd"), "far": distance(F.col("x_u") - prev("x_u"), F.col("y_u") - prev("y_u"))})
    opens = down & (F.col("prev").isNull() | (F.col("prev") != "stitch") | (F.col("far") >= hop_u))
    m = m.withColumn("run", F.sum(opens.cast("int")).over(so_far()) - 1).withColumn("down", down)
    # a run here holds its stitches and the commands that follow it, which open the next one
    w = Window.partitionBy("design_id", "run", "down").orderBy("seq")
    at = lambda f, c, k=1: F.when(F.col("down"), f(c, k).over(w))
    s = m.withColumns({"dx": F.col("x_u") - at(F.lag, "x_u"), "dy": F.col("y_u") - at(F.lag, "y_u"), "two": distance(at(F.lead, "x_u", 2) - F.col("x_u"), at(F.lead, "y_u", 2) - F.col("y_u"))}).withColumn("len", distance(F.col("dx"), F.col("dy")))
    size = F.col("len") * at(F.lag, "len")
    s = s.withColumn("back", F.when(size > 0, (F.col("dx") * at(F.lag, "dx") + F.col("dy") * at(F.lag, "dy")) / size < -0.2))
    end = lambda f, c: f(F.when(F.col("down"), F.col(c)), F.when(F.col("down"), F.col("seq")))
    g = s.groupBy("design_id", "run").agg(_n(F.col("cmd") == "trim").alias("trims"), _n(F.col("cmd") == "jump").alias("jumps"), _n(F.col("cmd").isin("trim", "color")).alias("cuts"), end(F.min_by, "x_u").alias("x0"), end(F.min_by, "y_u").alias("y0"), end(F.max_by, "x_u").alias("x1"), end(F.max_by, "y_u").alias("y1"),
                                          F.count("len").alias("n"), F.when(F.count("len") > 0, kth(F.collect_list("len"), 0.5)).alias("median"), F.count(F.when(F.col("back"), 1)).alias("back"), F.count(F.when(F.col("len") < short_u, 1)).alias("short"), F.max("two").alias("two"))
    of = Window.partitionBy("design_id").orderBy("run")
    share = F.try_divide("back", "n")
    lock = (F.col("n") <= 5) & (F.col("median") <= 10)
    satin = (F.col("n") > 0) & ~lock & (share >= 0.6)
    fill = (F.col("n") > 5) & ~lock & ~satin & ~((share <= 0.2) & (F.col("median") <= 40))
    gap = distance(F.col("x0") - F.lag("x1").over(of), F.col("y0") - F.lag("y1").over(of))
    r = g.withColumns({"gap": F.when(F.col("run") >= 0, gap), "cut": F.lag("cuts").over(of) > 0, "satin": satin, "fill": fill})
    return r.groupBy("design_id").agg(F.sum("trims").alias("trims"), F.sum("jumps").alias("jumps"), F.min(F.when(F.col("cut"), F.col("gap"))).alias("shortest_cut"), F.sum("gap").alias("travel"), F.sum(F.when(F.col("fill"), F.col("short")).otherwise(0)).alias("short_fill_steps"), F.max(F.when(F.col("satin"), F.col("two"))).alias("satin_gap"))


def distance_bands(df: DataFrame, hop_u: int = HOP_U) -> DataFrame:
    """Gaps between runs by length band and whether they were cut, with margins (null)."""
    mm = F.col("gap") * 0.1
    band = F.when(mm < 3, "[0,3)").when(mm < 6, "[3,6)").when(mm < 11.8, "[6,11.8)").otherwise("[11.8,)")
    return cut_gaps(df, hop_u).select("cut", band.alias("band")).cube("cut", "band").agg(F.count("*").alias("n"))


def pass_count_grid(df: DataFrame, chunk: int = 16, cell_u: float = 10, hop_u: int = HOP_U) -> DataFrame:
    """Per cell, how many stretches of `chunk` stitches cross it."""
    s = sample_segments(df, 5, hop_u)
    order = segments(df, hop_u).withColumn("chunk", F.floor((F.row_number().over(design()) - 1) / chunk)).select("design_id", "seq", "chunk")
    cells = s.hint("merge").join(order, ["design_id", "seq"]).select("design_id", F.floor(F.col("x") / cell_u).alias("cx"), F.floor(F.col("y") / cell_u).alias("cy"), "chunk").distinct()
    return cells.groupBy("design_id", "cx", "cy").agg(F.count("*").alias("passes"))


def type_chance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Agreement expected by chance of two cell maps' types."""
    share = lambda d, n: d.groupBy("design_id", "typ").agg(F.count("*").alias("c")).withColumn(n, F.col("c") / F.sum("c").over(Window.partitionBy("design_id"))).drop("c")
    return share(a, "pa").hint("merge").join(share(b, "pb"), ["design_id", "typ"]).groupBy("design_id").agg(F.sum(F.col("pa") * F.col("pb")).alias("chance"))


def mask_iou(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("ci", "cj")) -> DataFrame:
    """Overlap of two cell sets: IoU, recall of a, precision of b, cells missing and spilled."""
    left = a.select("design_id", *keys).distinct().withColumn("in_a", F.lit(1))
    right = b.select("design_id", *keys).distinct().withColumn("in_b", F.lit(1))
    j = left.hint("merge").join(right, ["design_id", *keys], "full_outer")
    both, na, nb = _n(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()), _n(F.col("in_a").isNotNull()), _n(F.col("in_b").isNotNull())
    return j.groupBy("design_id").agg((both / F.count("*")).alias("iou"), (both / na).alias("recall"), (both / nb).alias("precision"), (na - both).alias("missing"), (nb - both).alias("overspill"))


def type_confusion(a: DataFrame, b: DataFrame) -> DataFrame:
    j = a.select("design_id", "ci", "cj", F.col("typ").alias("pt")).hint("merge").join(b.select("design_id", "ci", "cj", F.col("typ").alias("ot")), ["design_id", "ci", "cj"])
    return j.groupBy("pt", "ot").agg(F.count("*").alias("cells"))


def paired_means(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """Means of a metric before and after, over the designs that both have."""
    j = a.select("design_id", F.col(metric).alias("before")).join(b.select("design_id", F.col(metric).alias("after")), "design_id").where("before is not null and after is not null")
    return j.agg(F.count("*").alias("designs"), F.avg("before").alias("before"), F.avg("after").alias("after"))
