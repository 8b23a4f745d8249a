"""Corners of spines: where the middle line of a column turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import distance

#: The least turn in degrees, and the least width (in units) that sets how far apart the points compared lie.
TURN, WIDTH_U = 30.0, 5.0
#: Corners kept in one list before another is begun, so that none is copied on for each corner.
CHUNK = 128


def corner_turns(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, i, k, turn of the points of spines (keys, i from 0, x, y, width) that turn by TURN degrees or more over k points to either side.

    k is the width over the median step (at index floor(n / 2)), 1 at least; spines of fewer than five or of 2k points or less have none."""
    line, whole = Window.partitionBy(*keys).orderBy("i"), Window.partitionBy(*keys)
    p = points.withColumn("n", F.count("*").over(whole)).withColumn("step", distance(F.lead("x").over(line) - F.col("x"), F.lead("y").over(line) - F.col("y")))
    # the median by ranks; a spine of n points has n - 1 steps, and the null one comes last
    ranked = p.withColumn("rank", F.row_number().over(whole.orderBy(F.col("step").asc_nulls_last())) - 1)
    median = F.max(F.when(F.col("rank") == F.floor((F.col("n") - 1) / 2), F.col("step"))).over(whole)
    ranked = ranked.withColumn("median", median).where((F.col("n") >= 5) & (F.col("median") > 0))
    k = F.greatest(F.lit(1), F.bround(F.round(F.greatest(F.col("width"), F.lit(WIDTH_U)) / F.col("median"), 9)).cast("int"))
    sized = ranked.withColumn("k", k).where(F.col("n") > 2 * F.col("k")).select(*keys, "i", "k", "x", "y")
    at = lambda shift, tag: sized.select(*keys, (F.col("i") + shift).alias("i"), F.col("x").alias(f"x{tag}"), F.col("y").alias(f"y{tag}"))
    met = sized.hint("merge").join(at(F.col("k"), "a"), [*keys, "i"]).hint("merge").join(at(-F.col("k"), "c"), [*keys, "i"])
    way = lambda x0, y0, x1, y1: F.atan2((F.col(y1) - F.col(y0)).cast("double"), (F.col(x1) - F.col(x0)).cast("double"))
    turn = F.degrees(way("x", "y", "xc", "yc") - way("xa", "ya", "x", "y"))
    turned = met.select(*keys, "i", "k", F.round(F.abs(F.pmod(turn + 180, F.lit(360.0)) - 180), 6).alias("turn"))
    return turned.where(F.col("turn") >= TURN)


def spine_corners(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, i, turn: corners in order along each spine; one within 2k points of the corner kept before it is none. One ordered pass per spine."""
    hits = corner_turns(points, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "turn", "k"))).alias("hits"))
    head = F.slice("hits", 1, 1)
    start = F.struct(head.alias("chunk"), F.slice(F.array(head), 2, 1).alias("full"))

    def step(acc, hit):
        last = F.element_at(acc["chunk"], -1)
        whole = F.size(acc["chunk"]) >= CHUNK
        chunk = F.when(whole, F.array(hit)).otherwise(F.concat(acc["chunk"], F.array(hit)))
        full = F.when(whole, F.concat(acc["full"], F.array(acc["chunk"]))).otherwise(acc["full"])
        return F.when(hit["i"] - last["i"] > 2 * hit["k"], F.struct(chunk.alias("chunk"), full.alias("full"))).otherwise(acc)

    kept = F.aggregate(F.slice("hits", 2, F.size("hits")), start, step, lambda acc: F.concat(F.flatten(acc["full"]), acc["chunk"]))
    return hits.select(*keys, F.explode(kept).alias("c")).select(*keys, "c.i", "c.turn")
