"""Links between shapes: how much of the thread that leads from one to another lies on bare fabric."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .coverage import THREAD_U, cell_of
from .linkcells import cover_rows

#: Fixed value: the pitch, in units, at which links are sampled and cover is laid out in cells.
LINK_CELL_U = 2.0


def _samples(steps: DataFrame, cell_u: float) -> DataFrame:
    """The middles of equal parts, no longer than a cell, of steps (x0, y0, x1, y1, len): i, part (a part's length), cx, cy."""
    s = steps.withColumn("n", F.greatest(F.lit(1), F.ceil(F.round(F.col("len") / cell_u, 9)).cast("int")))
    s = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda a, b: cell_of(F.col(a) + (F.col(b) - F.col(a)) * (F.col("i") + 0.5) / F.col("n"), cell_u)
    return s.withColumns({"cx": at("x0", "x1"), "cy": at("y0", "y1"), "part": F.col("len") / F.col("n")})


def link_cover(steps: DataFrame, cell_u: float = LINK_CELL_U, thread_u: float = THREAD_U) -> DataFrame:
    """Per design with links: segments, thread_mm, uncovered_mm, and max_mm: the longest stretch that lies bare without a break. `steps` has
    design_id, block, seq, x0, y0, x1, y1, len and transport.

    Thread covers the disc of half its width round its samples. A link is covered by other thread of its own block or of any block sewn
    later, so a cell needs only the last block that lays thread on it. A stretch goes on from one step into the next of its block where that
    begins at its end; many links of short stitches are one line on the fabric. A design's cells lie in one task: no sample is shuffled or written."""
    reach = max(1, round(thread_u / 2 / cell_u))
    number = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "len")]
    s = steps.select("design_id", F.col("block").cast("long").alias("block"), F.col("seq").cast("long").alias("seq"), *number, "transport")
    out = f"design_id {s.schema['design_id'].dataType.simpleString()}, segments long, thread_mm double, uncovered_mm double, max_mm double"
    return s.where("design_id is not null").groupBy("design_id").applyInArrow(lambda key, t: cover_rows(key, t, cell_u, reach), out)


def link_rule(cover: DataFrame, limit_mm: float) -> DataFrame:
    """Designs whose longest bare stretch of a link is over the fabric's limit for loose thread; none if the limit isn't positive."""
    over = F.round("max_mm", 6) > limit_mm
    return cover.where(over if limit_mm > 0 else F.lit(False)).select("design_id", F.lit("link_uncovered").alias("code"), F.lit("block").alias("severity"), "max_mm", F.lit(limit_mm).alias("limit_mm"), "uncovered_mm", "thread_mm")


def link_exposure(steps: DataFrame, run: str = "run", cell_u: float = 1.0, thread_u: float = THREAD_U) -> DataFrame:
    """Per transport run: mm of its thread further than half a thread from every other, whatever its block, and the worst distance up to the reach.

    Steps of other thread meet the samples in cells that their boxes, widened by the reach, touch; so the nearest within the reach is exact, and
    a sample without one within it counts as that far."""
    reach = thread_u * 2
    size = thread_u * 8
    s = _samples(steps.where("transport"), cell_u).withColumns({c: F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * (F.col("i") + 0.5) / F.col("n") for c in "xy"})
    s = s.select("design_id", run, "seq", "i", "part", "x", "y", cell_of(F.col("x"), size).alias("gx"), cell_of(F.col("y"), size).alias("gy"))
    span = lambda c: F.sequence(cell_of(F.least(f"{c}0", f"{c}1") - reach, size), cell_of(F.greatest(f"{c}0", f"{c}1") + reach, size))
    laid = steps.where("not transport").withColumn("gx", F.explode(span("x"))).withColumn("gy", F.explode(span("y"))).select("design_id", "gx", "gy", "x0", "y0", "x1", "y1")
    met = s.hint("merge").join(laid, ["design_id", "gx", "gy"], "left")
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    along = F.when(dx * dx + dy * dy > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy) / (dx * dx + dy * dy)))).otherwise(0.0)
    away = F.sqrt(F.pow(F.col("x") - F.col("x0") - along * dx, 2) + F.pow(F.col("y") - F.col("y0") - along * dy, 2))
    near = met.groupBy("design_id", run, "seq", "i", "part").agg(F.least(F.coalesce(F.min(away), F.lit(reach)), F.lit(reach)).alias("d"))
    bare = F.round("d", 6) > thread_u / 2
    g = near.groupBy("design_id", run).agg((F.sum("part") * 0.1).alias("thread_mm"), (F.sum(F.when(bare, F.col("part")).otherwise(0.0)) * 0.1).alias("bare_mm"), (F.max("d") * 0.1).alias("worst_mm"))
    return g.withColumn("exposed", F.col("bare_mm") > 0)
