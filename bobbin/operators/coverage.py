"""Thread laid on fabric: ribbons in cells, stacked patches, bare patches of claimed artwork, thread in a window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import distance, floor_near
from .graph import checkpointed
from .pixels import pixel_components, shifted
from .stream import HOP_U, segments
from .technique import of_run, strip_ties

#: A thread's width and a cell in units of 0.1 mm, and the share and depth of turns that make a column.
THREAD_U, CELL_U, COLUMN_SHARE, COLUMN_COS = 4.0, 10.0, 0.75, -0.5
#: Coverage that counts, that is too much and far too much, and the least patch in square millimetres.
BARE, WARN, BLOCK, PATCH_MM2, BARE_PATCH_MM2 = 0.25, 2.5, 3.5, 25.0, 5.0


def cell_of(c, size: float):
    """The cell of a coordinate; noise in the last digits doesn't move a point over an edge."""
    return floor_near(c / size)


def untied_segments(df: DataFrame, hop_u: int = HOP_U) -> DataFrame:
    """Steps of runs without their ties, with weight: half for a run whose steps mostly turn back (a column lays two legs an advance)."""
    w, lag = of_run(), lambda c: F.lag(c).over(of_run())
    s = strip_ties(df, hop_u).withColumn("x0", lag("x_u")).withColumn("y0", lag("y_u")).withColumn("n", F.count("*").over(Window.partitionBy("design_id", "run")))
    s = s.withColumns({"dx": F.col("x_u") - F.col("x0"), "dy": F.col("y_u") - F.col("y0")}).withColumn("len", distance(F.col("dx"), F.col("dy")))
    size = F.col("len") * F.lag("len").over(w)
    s = s.withColumn("cos", F.when(size > 0, (F.col("dx") * F.lag("dx").over(w) + F.col("dy") * F.lag("dy").over(w)) / size))
    whole = Window.partitionBy("design_id", "run")
    turns, back = F.count("cos").over(whole), F.count(F.when(F.col("cos") < COLUMN_COS, 1)).over(whole)
    column = (F.col("n") >= 4) & (turns >= 3) & (back >= turns * COLUMN_SHARE)
    return s.withColumn("weight", F.when(column, 0.5).otherwise(1.0)).where("len > 0").select("design_id", "run", "seq", "x0", "y0", "dx", "dy", "len", "weight")


def ribbon_grid(df: DataFrame, cell_u: float = CELL_U, step_u: float = 1.0, width_u: float = THREAD_U, hop_u: int = HOP_U) -> DataFrame:
    """design_id, cx, cy, units: area of thread in a cell over the cell's area.

    A step is sampled in the middle of equal parts no longer than `step_u`; half of a part's area falls a quarter of the width to
    either side. Cells count from the origin of the coordinates. Split satin is not told from plain satin."""
    s = untied_segments(df, hop_u).withColumn("n", F.greatest(F.lit(1), F.ceil(F.round(F.col("len") / step_u, 9)).cast("int")))
    s = s.withColumns({"i": F.explode(F.sequence(F.lit(0), F.col("n") - 1)), "off": F.lit(width_u / 4)})
    t = (F.col("i") + 0.5) / F.col("n")
    x, y = F.col("x0") + F.col("dx") * t, F.col("y0") + F.col("dy") * t
    side = lambda k: F.struct(cell_of(x - F.col("dy") / F.col("len") * F.col("off") * k, cell_u).alias("cx"), cell_of(y + F.col("dx") / F.col("len") * F.col("off") * k, cell_u).alias("cy"))
    area = F.col("len") / F.col("n") * width_u * F.col("weight") / 2
    p = s.select("design_id", area.alias("area"), F.explode(F.array(side(-1), side(1))).alias("c"))
    return p.groupBy("design_id", "c.cx", "c.cy").agg((F.sum("area") / (cell_u * cell_u)).alias("units"))


def patches(cells: DataFrame, keys: list[str], least: int) -> DataFrame:
    """keys, patch (its first cell), cells: 8-connected patches of the cells (cx, cy) under equal keys that have at least `least`."""
    px = cells.select(F.struct(*keys).alias("image_id"), F.col("cy").alias("y"), F.col("cx").alias("x"), F.lit(0).alias("label"))
    g = pixel_components(px).groupBy("image_id", "root_y", "root_x").agg(F.count("*").alias("cells")).where(F.col("cells") >= least)
    return g.select(*[F.col(f"image_id.{k}").alias(k) for k in keys], F.struct("root_y", "root_x").alias("patch"), "cells")


def stacking(grid: DataFrame, warn: float = WARN, block: float = BLOCK, cell_u: float = CELL_U, patch_mm2: float = PATCH_MM2) -> DataFrame:
    """Per design: median, 95th percentile (interpolated) and maximum of covered cells, their area, and the area of large patches over either limit."""
    mm2 = (cell_u / 10) ** 2
    grid = checkpointed(grid)
    g = grid.where(F.round("units", 6) >= BARE).groupBy("design_id").agg(F.percentile("units", 0.5).alias("p50"), F.percentile("units", 0.95).alias("p95"), F.max("units").alias("most"), (F.count("*") * F.lit(mm2)).alias("area_mm2"))
    limits = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.lit(v).alias("at")) for n, v in (("warn", warn), ("block", block))]))
    over = grid.withColumn("l", limits).where(F.round("units", 6) >= F.col("l.at")).select("design_id", "cx", "cy", F.col("l.level").alias("level"))
    area = patches(over, ["design_id", "level"], -int(-patch_mm2 // mm2)).groupBy("design_id").pivot("level", ["warn", "block"]).agg(F.sum("cells") * F.lit(mm2))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(f"over_{c}_mm2")
    return g.join(area, "design_id", "left").select("design_id", "p50", "p95", "most", "area_mm2", zero("warn"), zero("block"))


def bare_cells(wanted: DataFrame, grid: DataFrame, least: float = BARE) -> DataFrame:
    """Wanted cells (design_id, cx, cy and more) on which less than `least` thread lies."""
    laid = grid.where(F.round("units", 6) >= least).select("design_id", "cx", "cy")
    return wanted.hint("merge").join(laid, ["design_id", "cx", "cy"], "left_anti")


def claimed_cells(boxes: DataFrame, cell_u: int = 10) -> DataFrame:
    """Cells whose middle lies in a shape's box (half sizes w_u, h_u): design_id, cx, cy, shape_id of the smallest box there, lowest id on ties."""
    first = lambda c, h: F.ceil((F.col(c) - F.col(h)) / cell_u - 0.5)
    last = lambda c, h: F.floor((F.col(c) + F.col(h)) / cell_u - 0.5)
    some = (first("cx_u", "w_u") <= last("cx_u", "w_u")) & (first("cy_u", "h_u") <= last("cy_u", "h_u"))
    own = F.struct((F.col("w_u") * F.col("h_u")).alias("size"), "shape_id").alias("own")
    c = boxes.where(some).select("design_id", own, F.explode(F.sequence(first("cx_u", "w_u"), last("cx_u", "w_u"))).alias("cx"), F.sequence(first("cy_u", "h_u"), last("cy_u", "h_u")).alias("ys"))
    return c.select("design_id", "own", "cx", F.explode("ys").alias("cy")).groupBy("design_id", "cx", "cy").agg(F.min("own").alias("own")).select("design_id", "cx", "cy", "own.shape_id")


def uncovered(wanted: DataFrame, grid: DataFrame, cell_u: float = CELL_U, patch_mm2: float = BARE_PATCH_MM2) -> DataFrame:
    """Per shape: bare patches of at least `patch_mm2`, their area and the largest one."""
    mm2 = (cell_u / 10) ** 2
    p = patches(bare_cells(wanted, grid), ["design_id", "shape_id"], -int(-patch_mm2 // mm2))
    return p.groupBy("design_id", "shape_id").agg(F.count("*").alias("patches"), (F.sum("cells") * F.lit(mm2)).alias("area_mm2"), (F.max("cells") * F.lit(mm2)).alias("largest_mm2"))


def thread_density(df: DataFrame, cell_u: float = CELL_U, reach: int = 1, step_u: float = 5, hop_u: int = HOP_U) -> DataFrame:
    """Millimetres of thread a square millimetre in the square window of `reach` cells round each cell that the window's thread touches."""
    from .stream import sample_segments

    per = sample_segments(df, step_u, hop_u).groupBy("design_id", cell_of(F.col("x"), cell_u).alias("x"), cell_of(F.col("y"), cell_u).alias("y")).agg((F.sum("weight") * 0.1).alias("mm"))
    box = [(j, i) for j in range(-reach, reach + 1) for i in range(-reach, reach + 1)]
    area = (cell_u / 10) ** 2 * len(box)
    return shifted(per, box).groupBy("design_id", F.col("x").alias("cx"), F.col("y").alias("cy")).agg((F.sum("mm") / area).alias("density"))


def opaque(cells: DataFrame, reach: int, least: float = 0.55) -> DataFrame:
    """Places (image_id, y, x, share) of which at least that share of the square window of `reach` cells is in the set."""
    box = [(j, i) for j in range(-reach, reach + 1) for i in range(-reach, reach + 1)]
    g = shifted(cells.select("image_id", "y", "x").distinct(), box).groupBy("image_id", "y", "x").agg((F.count("*") / len(box)).alias("share"))
    return g.where(F.col("share") >= least)


def box_cover(df: DataFrame, cell_u: float = CELL_U, hop_u: int = HOP_U) -> DataFrame:
    """Cells that each block's steps touch, with the last block to sew on each (the colour that shows)."""
    from .technique import line_cells

    pts = line_cells(segments(df, hop_u).where("len > 0"), cell_u)
    return pts.groupBy("design_id", "cx", "cy").agg(F.max_by("block", "seq").alias("block"))


def colour_surface(a: DataFrame, b: DataFrame, least: int = 15) -> tuple[DataFrame, DataFrame]:
    """Agreement of two designs' showing blocks on cells that both cover, and the recall of each of `a`'s blocks of at least `least` cells."""
    keys = ["design_id", "cx", "cy"]
    both = a.select(*keys, F.col("block").alias("pro")).hint("merge").join(b.select(*keys, F.col("block").alias("ours")), keys, "left")
    met = F.col("ours").isNotNull()
    agree = both.where(met).groupBy("design_id").agg(F.count("*").alias("cells"), F.avg((F.col("pro") == F.col("ours")).cast("int")).alias("agreement"))
    each = both.groupBy("design_id", F.col("pro").alias("block")).agg(F.count("*").alias("cells"), F.avg(F.coalesce(F.col("pro") == F.col("ours"), F.lit(False)).cast("int")).alias("recall"))
    return agree, each.where(F.col("cells") >= least)


def best_shift(a: DataFrame, b: DataFrame, reach: int = 2) -> DataFrame:
    """Per design the shift (dx, dy cells, at most `reach` each way) of b's cells with the best overlap with a's, the shortest on ties, then by (dx, dy).

    All shifts of the square are tried in one join; a hill climb need not find the best of them."""
    keys = ["design_id", "cx", "cy"]
    moves = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]))
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    moved = right.withColumn("m", moves).select("design_id", "m", (F.col("cx") + F.col("m.dx")).alias("cx"), (F.col("cy") + F.col("m.dy")).alias("cy"))
    hits = moved.hint("merge").join(left.withColumn("hit", F.lit(1)), keys, "left").groupBy("design_id", "m").agg(F.count("hit").alias("both"), F.count("*").alias("nb"))
    n = left.groupBy("design_id").agg(F.count("*").alias("na"))
    iou = F.round(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), 9)
    rank = F.struct((-iou).alias("worse"), (F.col("m.dx") * F.col("m.dx") + F.col("m.dy") * F.col("m.dy")).alias("far"), F.col("m.dx").alias("dx"), F.col("m.dy").alias("dy"))
    return hits.join(n, "design_id").groupBy("design_id").agg(F.min(rank).alias("r")).select("design_id", "r.dx", "r.dy", (-F.col("r.worse")).alias("iou"))
