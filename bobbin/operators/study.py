"""Studies and sheets of a corpus: one row a design or variant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import kth
from .compare import mitre_pairs, trims_and_stitches
from .measures import satin_stats
from .stream import HOP_U, classify_runs, runs, tail_locks
from .technique import of_kind


def by(*order: str):
    """An order over a small lookup table as a whole."""
    return Window.partitionBy(F.lit(0)).orderBy(*order)


def satin_mitres(df: DataFrame, reach_u: int = 20, hop_u: int = HOP_U) -> DataFrame:
    """Satin runs that end nearer than the reach to the start of another satin run of their design."""
    r = runs(df, hop_u).hint("merge").join(of_kind(df, "satin", hop_u), ["design_id", "run"], "left_semi")
    return mitre_pairs(r, reach_u, of_runs=True)


def corpus_study(df: DataFrame, hop_u: int = HOP_U) -> DataFrame:
    """Stitches, runs, blocks, trims per 1000, runs by class, satin widths and locked ends of each design."""
    n = lambda c: F.sum((F.col("cmd") == c).cast("long"))
    base = df.groupBy("design_id").agg(n("stitch").alias("stitches"), n("trim").alias("trims"), (n("color") + 1).alias("blocks"))
    classes = classify_runs(df, hop_u=hop_u)
    kinds = classes.groupBy("design_id").agg(*[F.sum((F.col("kind") == k).cast("long")).alias(k) for k in ("satin", "fill", "run", "lock")])
    count = runs(df, hop_u).groupBy("design_id").agg(F.countDistinct("run").alias("runs"))
    satin = satin_stats(df, hop_u).hint("merge").join(classes.where("kind = 'satin'").select("design_id", "run"), ["design_id", "run"], "left_semi")
    widths = satin.groupBy("design_id").agg(kth(F.collect_list("width"), 0.5).alias("med"), F.max("width").alias("widest"))
    locks = tail_locks(df, hop_u=hop_u).groupBy("design_id").agg(F.sum(F.col("locked").cast("long")).alias("locked"))
    out = base
    for part in (count, kinds, widths, locks):
        out = out.join(part, "design_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("design_id", "stitches", "runs", "blocks", (F.col("trims") * 1000.0 / F.col("stitches")).alias("trims_per_1000"), *[zero(k) for k in ("satin", "fill", "run", "lock")], F.col("med").alias("width"), "widest", zero("locked"))


def acceptance_sheet(shapes: DataFrame, stitches: DataFrame, variant: str = "layer") -> DataFrame:
    """Shapes, distinct threads of those that are sewn, unsewn shapes, and the design's stitches and trims, of each variant."""
    g = shapes.groupBy("design_id", F.col(variant).alias("variant")).agg(F.count("*").alias("shapes"), F.countDistinct(F.when(F.col("stitched"), F.col("thread_idx"))).alias("threads"), F.sum((~F.col("stitched")).cast("long")).alias("warnings"))
    return g.join(trims_and_stitches(stitches).select("design_id", "stitches", "trims"), "design_id", "left")


def variant_sheet(shapes: DataFrame, stitches: DataFrame, variants: DataFrame) -> DataFrame:
    """The acceptance counts of every design for every variant (a small lookup table)."""
    from .catalogue import fixture_matrix

    g = shapes.groupBy("design_id").agg(F.count("*").alias("shapes"), F.countDistinct(F.when(F.col("stitched"), F.col("thread_idx"))).alias("threads"))
    return fixture_matrix(g, variants).join(trims_and_stitches(stitches).select("design_id", "stitches", "trims"), "design_id", "left")


def top_far_points(points: DataFrame, k: int, apart_u: float) -> DataFrame:
    """The k farthest points (d > 0) of each design, each more than `apart_u` from those before it, with their place; the first by seq on ties.

    A round is one aggregate, and its winners thin out what is left."""
    left, out = points.where("d > 0"), None
    for place in range(1, k + 1):
        best = left.groupBy("design_id").agg(F.min(F.struct((-F.col("d")).alias("o"), "seq", "x_u", "y_u", "d")).alias("m")).select("design_id", "m.seq", "m.x_u", "m.y_u", "m.d")
        out = best.withColumn("place", F.lit(place)) if out is None else out.unionByName(best.withColumn("place", F.lit(place)))
        near = best.select("design_id", F.col("x_u").alias("bx"), F.col("y_u").alias("by"))
        far = (F.col("x_u") - F.col("bx")) * (F.col("x_u") - F.col("bx")) + (F.col("y_u") - F.col("by")) * (F.col("y_u") - F.col("by")) > apart_u * apart_u
        left = left.join(near, "design_id").where(far).drop("bx", "by")
    return out
