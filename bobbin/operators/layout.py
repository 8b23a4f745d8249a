"""Designs placed in a hoop, runs dealt to shades, walks between content."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import distance, rounded
from .coverage import cell_of, thread_density
from .stream import HOP_U, segments
from .technique import of_run

#: Exact cosines and sines of quarter turns; the least jump in units.
QUARTERS = {0: (1.0, 0.0), 90: (0.0, 1.0), 180: (-1.0, 0.0), 270: (0.0, -1.0)}
TINY_U = 5.0


def place_design(df: DataFrame, turn: float = 0, width_mm: float | None = None, hoop_mm: tuple[float, float] = (100, 100), offset_mm: tuple[float, float] = (0, 0)) -> DataFrame:
    """Every design turned about its middle, centred on its stitches' box, scaled to a width (1 mm to the hoop's, its height within the
    hoop's too), moved, rounded half up; an `end` row at the offset follows. `turn` is in degrees."""
    cos, sin = QUARTERS.get(turn % 360) or (math.cos(math.radians(turn)), math.sin(math.radians(turn)))
    whole = Window.partitionBy("design_id")
    t = df.withColumns({"tx": F.col("x_u") * F.lit(cos) - F.col("y_u") * F.lit(sin), "ty": F.col("x_u") * F.lit(sin) + F.col("y_u") * F.lit(cos)})
    t = t.withColumns({c: rounded(c, 6) for c in ("tx", "ty")})
    down = lambda c: F.when(F.col("cmd") == "stitch", F.col(c))
    t = t.withColumns({f"{k}_{c}": f(down(c)).over(whole) for k, f in (("lo", F.min), ("hi", F.max)) for c in ("tx", "ty")})
    wide, high = (F.greatest(F.lit(0.1), (F.col(f"hi_{c}") - F.col(f"lo_{c}")) / 10) for c in ("tx", "ty"))
    target = F.least(F.greatest(wide if width_mm is None else F.lit(float(width_mm)), F.lit(1.0)), F.lit(float(hoop_mm[0])))
    scale = F.when(high * (target / wide) > hoop_mm[1], F.lit(float(hoop_mm[1])) / high).otherwise(target / wide)
    off = [math.floor(o * 10 + 0.5) for o in offset_mm]
    t = t.withColumn("scale", scale).withColumns({f"at_{c}": (F.col(c) - (F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2) * F.col("scale") for c in ("tx", "ty")})
    at = lambda c, o: (F.floor(rounded(f"at_{c}", 6) + 0.5) + o).cast("long")
    moved = t.select("design_id", "seq", "cmd", at("tx", off[0]).alias("x_u"), at("ty", off[1]).alias("y_u"))
    ends = df.groupBy("design_id").agg((F.max("seq") + 1).alias("seq")).select("design_id", "seq", F.lit("end").alias("cmd"), F.lit(off[0]).cast("long").alias("x_u"), F.lit(off[1]).cast("long").alias("y_u"))
    return moved.unionByName(ends)


def shade_blocks(ordered: DataFrame, shades: DataFrame, trim_u: float = 30) -> DataFrame:
    """Runs (design_id, run, shade or null, base, x0, y0, x1, y1, jump, trim) dealt to one block a shade, dark to light.

    `shades` has shade and light. A null shade is the base thread. A run that comes back to a shade jumps and is trimmed by its distance
    from that shade's run before; each block's first run always is."""
    r = ordered.withColumn("key", F.coalesce("shade", "base"))
    flat, own = Window.partitionBy("design_id").orderBy("run"), Window.partitionBy("design_id", "key").orderBy("run")
    gap = distance(F.col("x0") - F.lag("x1").over(own), F.col("y0") - F.lag("y1").over(own))
    back = F.lag("key").over(flat) != F.col("key")
    r = r.withColumns({"first": F.row_number().over(own) == 1, "back": F.coalesce(back, F.lit(False)), "gap": gap})
    jump = F.when(F.col("first"), True).when(F.col("back"), F.col("gap") >= TINY_U).otherwise(F.col("jump"))
    trim = F.when(F.col("first"), True).when(F.col("back"), (F.col("gap") >= TINY_U) & (F.col("gap") > trim_u)).otherwise(F.col("trim"))
    lit = r.join(shades.select(F.col("shade").alias("key"), "light"), "key", "left")
    block = F.dense_rank().over(Window.partitionBy("design_id").orderBy("light", "key")) - 1
    return lit.select("design_id", block.alias("block"), "run", F.col("key").alias("shade"), jump.alias("jump"), trim.alias("trim"))


def travel_chains(df: DataFrame, support: float = 1.0, most: int = 8, most_u: float = 120, hop_u: int = HOP_U) -> DataFrame:
    """Maximal stretches of steps whose middle lies on little thread (under `support` mm a square mm), and whether one is a walk: short in
    steps and length, with supported steps of its run on a side."""
    mid = lambda a, b: cell_of((F.col(a) + F.col(b)) / 2, 10)
    s = segments(df, hop_u).withColumns({"cx": mid("x0", "x1"), "cy": mid("y0", "y1")})
    s = s.hint("merge").join(thread_density(df, hop_u=hop_u), ["design_id", "cx", "cy"], "left")
    whole = Window.partitionBy("design_id", "run")
    s = s.withColumn("bare", F.round(F.coalesce("density", F.lit(0.0)), 6) < support).withColumn("n", F.count("*").over(whole))
    g = F.row_number().over(of_run()) - F.row_number().over(Window.partitionBy("design_id", "run", "bare").orderBy("seq"))
    c = s.withColumn("g", g).where("bare").groupBy("design_id", "run", "g").agg(F.min("seq").alias("first"), F.count("*").alias("steps"), F.sum("len").alias("len"), F.max("n").alias("n"))
    walk = (F.col("steps") < F.col("n")) & (F.col("steps") <= most) & (F.round("len", 6) <= most_u)
    return c.select("design_id", "run", "first", "steps", (F.col("len") * 0.1).alias("mm"), walk.alias("travel"))


def transport(runs: DataFrame) -> DataFrame:
    """Runs (design_id, block, run, shape, travel) with the shapes of the content before and after in their block, and whether a walk
    leads from one shape's content to another's (or from or to none)."""
    w = Window.partitionBy("design_id", "block").orderBy("run")
    content = F.when(~F.col("travel"), F.col("shape"))
    before = F.last(content, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(content, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    r = runs.withColumns({"before": before, "after": after})
    inner = F.coalesce((F.col("before") == F.col("after")) & (F.col("shape") == F.col("before")), F.lit(False))
    return r.select("design_id", "block", "run", "before", "after", (F.col("travel") & ~inner).alias("transport"))


def cross_validate(expected: DataFrame, decoded: DataFrame) -> DataFrame:
    """How well two point lists (design_id, pos, x_u, y_u) agree under the best of the eight turns and flips with the rounded mean offset:
    the transform (least rms, first on ties), rms and worst error over the positions that both have, and how many those are."""
    j = expected.hint("merge").join(decoded.select("design_id", "pos", F.col("x_u").alias("dx"), F.col("y_u").alias("dy")), ["design_id", "pos"])
    forms = [(a, b, c, d) for a, b, c, d in ((1, 0, 0, 1), (0, -1, 1, 0), (-1, 0, 0, -1), (0, 1, -1, 0), (-1, 0, 0, 1), (1, 0, 0, -1), (0, 1, 1, 0), (0, -1, -1, 0))]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("form"), (F.col("dx") * a + F.col("dy") * b).alias("u"), (F.col("dx") * c + F.col("dy") * d).alias("v")) for i, (a, b, c, d) in enumerate(forms)]))
    t = j.withColumn("t", each).select("design_id", "t.form", (F.col("x_u") - F.col("t.u")).alias("ex"), (F.col("y_u") - F.col("t.v")).alias("ey"))
    mean = t.groupBy("design_id", "form").agg(F.floor(F.avg("ex") + 0.5).alias("ox"), F.floor(F.avg("ey") + 0.5).alias("oy"))
    e = t.hint("merge").join(mean, ["design_id", "form"]).withColumn("e2", F.pow(F.col("ex") - F.col("ox"), 2) + F.pow(F.col("ey") - F.col("oy"), 2))
    g = e.groupBy("design_id", "form").agg(F.round(F.sqrt(F.avg("e2")), 6).alias("rms"), F.round(F.sqrt(F.max("e2")), 6).alias("worst"), F.count("*").alias("compared"))
    return g.groupBy("design_id").agg(F.min(F.struct("rms", "form", "worst", "compared")).alias("m")).select("design_id", "m.form", "m.rms", "m.worst", "m.compared")
