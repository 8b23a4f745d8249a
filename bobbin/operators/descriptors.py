"""Clusters of letter-like shapes, and log-polar descriptors of outlines compared by chi-square."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions.columns import distance
from ..sources.shared import dealt
from .graph import checkpointed, components
from .outlines import alike_rows, polar_rows

#: Least ratio of heights and strokes, reach in heights of the taller one, least members of a cluster.
SIMILAR, REACH, MEMBERS = 0.5, 3.0, 3
#: Fixed value: the distance up to which shapes are alike.
ALIKE = 0.25

#: Points of a design's block that meet in one task.
PART_POINTS = 1_024


def linked_shapes(shapes: DataFrame) -> DataFrame:
    """Links (design_id, u < v) of shapes (design_id, shape_id, cx, cy, height, stroke) of like height and stroke that are near enough.

    Heights of linked shapes differ by two at most, so their octaves are equal or neighbours. A shape meets those of its own octave and of the one
    below on a grid of the octave's greatest reach: linked centres lie in neighbouring cells. The taller of a pair looks for the other, once."""
    ok = shapes.where((F.col("height") > 0) & (F.col("stroke") > 0))
    octave = F.floor(F.log2("height")).cast("int")
    s = ok.select("design_id", "shape_id", "cx", "cy", "height", "stroke", octave.alias("own"))
    cell = lambda c, level: F.floor(F.col(c) / (F.pow(F.lit(2.0), F.col(level) + 1) * REACH)).cast("long")
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    taller = s.withColumn("level", F.col("own")).withColumn("m", near)
    taller = taller.select(F.struct(*s.columns).alias("p"), "design_id", "level", (cell("cx", "level") + F.col("m.i")).alias("gx"), (cell("cy", "level") + F.col("m.j")).alias("gy"))
    lower = s.withColumn("level", F.explode(F.array("own", F.col("own") + 1)))
    lower = lower.select(F.struct(*s.columns).alias("q"), "design_id", "level", cell("cx", "level").alias("gx"), cell("cy", "level").alias("gy"))
    alike = lambda c: F.least(f"p.{c}", f"q.{c}") / F.greatest(f"p.{c}", f"q.{c}") >= SIMILAR
    away = distance(F.col("p.cx") - F.col("q.cx"), F.col("p.cy") - F.col("q.cy"))
    once = (F.col("p.height") > F.col("q.height")) | ((F.col("p.height") == F.col("q.height")) & (F.col("p.shape_id") < F.col("q.shape_id")))
    met = taller.hint("merge").join(lower, ["design_id", "level", "gx", "gy"]).where(once & alike("height") & alike("stroke") & (F.round(away, 9) <= F.col("p.height") * REACH))
    return met.select("design_id", F.least("p.shape_id", "q.shape_id").alias("u"), F.greatest("p.shape_id", "q.shape_id").alias("v"))


def text_clusters(shapes: DataFrame, members: int = MEMBERS) -> DataFrame:
    """design_id, shape_id, cluster (its least shape), members, stroke (median, at index floor(n / 2)) of shapes in clusters of enough members."""
    links = checkpointed(linked_shapes(shapes))
    node = lambda c: F.struct("design_id", F.col(c).alias("shape_id"))
    links = links.select(node("u").alias("u"), node("v").alias("v"))
    found = components(links.select(F.explode(F.array("u", "v")).alias("node")), links)
    placed = found.select("node.design_id", "node.shape_id", F.col("root.shape_id").alias("cluster")).hint("merge").join(shapes.select("design_id", "shape_id", "stroke"), ["design_id", "shape_id"])
    # the median by ranks, so that no cluster becomes one array
    w = Window.partitionBy("design_id", "cluster")
    ranked = placed.withColumn("members", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy("stroke", "shape_id")) - 1)
    middle = F.max(F.when(F.col("k") == F.floor(F.col("members") / 2), F.col("stroke"))).over(w)
    return ranked.withColumn("stroke", middle).where(F.col("members") >= members).select("design_id", "shape_id", "cluster", "members", "stroke")


def log_polar(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, vertex, bin (radius * ANGLES + angle), n: where a shape's other points lie from each of its points.

    Distances are divided by the shape's mean distance; those beyond the edges count in the first or last bin. Pairs are those inside one
    shape, whose number of points its outline sampling bounds; a task makes them in blocks of a bounded number."""
    kinds = points.schema
    out = S.StructType([S.StructField(c, kinds[c].dataType) for c in (*keys, "vertex")] + [S.StructField("bin", S.IntegerType()), S.StructField("n", S.LongType())])
    xy = [F.col(c).cast("double").alias(c) for c in ("x", "y")]
    rows = dealt(points, *keys).select(*keys, "vertex", *xy).dropna(subset=[*keys, "vertex"])
    return rows.sortWithinPartitions(*keys, "vertex").mapInArrow(partial(polar_rows, keys=keys), out)


def shape_distances(points: DataFrame, block: Column | None = None, limit: float = ALIKE) -> DataFrame:
    """design_id, u < v, distance of the shapes of one design whose outlines are alike: the mean of every point's chi-square to its best
    counterpart, from both sides the greater. A best counterpart may serve twice (an optimal pairing serves each once), so this is never more than
    the distance by pairing.

    All shapes of a design meet; only a caller whose alike shapes are known to share something names it as `block`, an expression on points'
    columns. Points lie by design and block, where a task makes the shapes' histograms and meets them; neither histograms nor pairs of points are
    shuffled. A block of over PART_POINTS points is cut into parts, each two of which are dealt as a key of their own: all its pairs of shapes, in
    tasks of bounded size."""
    key, level = ["design_id", "block"], ["p", "q", "part"]
    named = points.withColumn("block", F.lit(0) if block is None else block).select(*key, "shape_id", "vertex", "x", "y").dropna(subset=[*key, "shape_id", "vertex"])
    size = named.groupBy(*key).count().agg(F.sum("count").alias("rows"), F.max("count").alias("most")).first()
    at = dealt(named, *key, rows=size["rows"] or 0)
    if (size["most"] or 0) <= PART_POINTS:
        at = at.withColumns({c: F.lit(0).cast("long") for c in level})
    else:
        # a rank counts the points of the shapes before, so no shape is cut
        part = F.floor((F.rank().over(Window.partitionBy(*key).orderBy("shape_id")) - 1) / PART_POINTS)
        at = at.withColumn("part", part).withColumn("last", F.max("part").over(Window.partitionBy(*key)))
        at = at.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
        at = dealt(at.withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")}).drop("last", "other"), *key, "p", "q")
    xy = [F.col(c).cast("double").alias(c) for c in ("x", "y")]
    rows = at.select(*key, *level, "shape_id", "vertex", *xy).sortWithinPartitions(*key, "p", "q", "shape_id", "vertex")
    ids = rows.schema["shape_id"].dataType
    out = S.StructType([rows.schema["design_id"], S.StructField("u", ids), S.StructField("v", ids), S.StructField("distance", S.DoubleType())])
    return rows.mapInArrow(partial(alike_rows, limit=limit), out).where(F.round("distance", 9) <= limit)
