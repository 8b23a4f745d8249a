"""Before and after, joins of sides, sequences of several designs, small classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import distance
from ..sources.shared import dealt
from .stream import blocks, runs

#: Fixed value: stitches that a cut is worth.
TRIM_STITCHES = 25


def trims_and_stitches(df: DataFrame) -> DataFrame:
    return df.groupBy("design_id").agg(F.count_if(F.col("cmd") == "trim").alias("trims"), F.count_if(F.col("cmd") == "stitch").alias("stitches"))


def exchange_rate(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per design in both: cuts saved, stitches added, stitches a cut, score (below 0 is a gain) and whether it got worse. Unchanged designs go."""
    b = trims_and_stitches(before).withColumnsRenamed({"trims": "b_trims", "stitches": "b_stitches"})
    d = b.join(trims_and_stitches(after), "design_id").select("design_id", (F.col("b_trims") - F.col("trims")).alias("d_trims"), (F.col("stitches") - F.col("b_stitches")).alias("d_stitches"))
    score = F.col("d_stitches") - F.col("d_trims") * TRIM_STITCHES
    return d.where("d_trims <> 0 or d_stitches <> 0").select("*", F.when(F.col("d_trims") > 0, F.col("d_stitches") / F.col("d_trims")).alias("rate"), score.alias("score"), (score > 0).alias("worse"))


def exchange_totals(rates: DataFrame) -> DataFrame:
    """Totals over exchange_rate(): designs, cuts saved, stitches added, stitches a cut, score and how many designs got worse."""
    g = rates.agg(F.count("*").alias("designs"), F.sum("d_trims").alias("d_trims"), F.sum("d_stitches").alias("d_stitches"), F.sum("score").alias("score"), F.count_if("worse").alias("worse"))
    return g.withColumn("rate", F.when(F.col("d_trims") > 0, F.col("d_stitches") / F.col("d_trims")))


def worst(df: DataFrame, by: str, k: int) -> DataFrame:
    """The k designs that lose most, lowest id first on ties."""
    return df.orderBy(F.col(by).desc(), "design_id").limit(k)


def combine_designs(df: DataFrame, group: str) -> DataFrame:
    """group, pos, cmd, x_u, y_u: the designs of a group in order, a trim and a colour change at the last point between two. `end` rows go
    where a group has several designs."""
    w = Window.partitionBy(group)
    many = F.min("design_id").over(w) != F.max("design_id").over(w)
    rows = dealt(df, group).withColumn("__many", many).where(~F.col("__many") | (F.col("cmd") != "end"))
    order = w.orderBy("design_id", "seq")
    prev = lambda c: F.lag(c).over(order)
    starts = prev("design_id").isNotNull() & (prev("design_id") != F.col("design_id"))
    own = F.struct(F.lit(2).alias("k"), "cmd", "x_u", "y_u")
    cut = lambda k, name: F.struct(F.lit(k).alias("k"), F.lit(name).alias("cmd"), F.col("__px").alias("x_u"), F.col("__py").alias("y_u"))
    seen = rows.withColumns({"__px": prev("x_u"), "__py": prev("y_u"), "__starts": starts})
    out = seen.select(group, "design_id", "seq", F.explode(F.when(F.col("__starts"), F.array(cut(0, "trim"), cut(1, "color"), own)).otherwise(F.array(own))).alias("r"))
    return out.select(group, (F.row_number().over(w.orderBy("design_id", "seq", "r.k")) - 1).alias("pos"), "r.cmd", "r.x_u", "r.y_u")


def command_phrases(df: DataFrame) -> DataFrame:
    """Per block its commands in order, equal neighbours once, joined by dots. Neighbours are dropped before rows are gathered."""
    w = Window.partitionBy("design_id", "block").orderBy("seq")
    turns = blocks(df).withColumn("__same", F.coalesce(F.lag("cmd").over(w) == F.col("cmd"), F.lit(False))).where("not __same")
    return turns.groupBy("design_id", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "cmd"))), lambda e: e["cmd"]), ".").alias("phrase"))


def mitre_pairs(df: DataFrame, reach_u: int = 20, of_runs: bool = False) -> DataFrame:
    """Runs that end nearer than the reach to the start of another run of their design. Starts are met by grid cell.

    With `of_runs`, `df` has runs already."""
    ends = (df if of_runs else runs(df)).groupBy("design_id", "run").agg(*[f(c, "seq").alias(f"{n}_{c}") for n, f in (("first", F.min_by), ("last", F.max_by)) for c in ("x_u", "y_u")])
    cell = lambda c: F.floor(F.col(c) / reach_u)
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    starts = ends.select("design_id", F.col("run").alias("other"), F.col("first_x_u").alias("sx"), F.col("first_y_u").alias("sy"), F.explode(offsets).alias("o")).withColumns({"cx": cell("sx") + F.col("o.i"), "cy": cell("sy") + F.col("o.j")})
    e = ends.withColumns({"cx": cell("last_x_u"), "cy": cell("last_y_u")}).alias("e")
    near = distance(F.col("e.last_x_u") - F.col("s.sx"), F.col("e.last_y_u") - F.col("s.sy")) < reach_u
    meets = [F.col(f"e.{c}") == F.col(f"s.{c}") for c in ("design_id", "cx", "cy")]
    return e.hint("merge").join(starts.alias("s"), meets[0] & meets[1] & meets[2] & (F.col("e.run") != F.col("s.other")) & near, "left_semi").select("design_id", "run")


def dedupe_ring(vertices: DataFrame) -> DataFrame:
    """Ring vertices without repeats of the one before and without a closing repeat of the first."""
    w = Window.partitionBy("design_id", "shape_id").orderBy("vertex")
    whole = Window.partitionBy("design_id", "shape_id")
    same = (F.lag("x_u").over(w) == F.col("x_u")) & (F.lag("y_u").over(w) == F.col("y_u"))
    kept = vertices.withColumn("__same", F.coalesce(same, F.lit(False))).where("not __same").drop("__same")
    at = F.struct("vertex", "x_u", "y_u")
    ends = kept.withColumns({"__f": F.min(at).over(whole), "__l": F.max(at).over(whole)})
    closing = (F.col("vertex") == F.col("__l.vertex")) & (F.col("vertex") != F.col("__f.vertex")) & (F.col("x_u") == F.col("__f.x_u")) & (F.col("y_u") == F.col("__f.y_u"))
    return ends.where(~closing).drop("__f", "__l")


def cells_of_shapes(vertices: DataFrame, cell_u: int = 20) -> DataFrame:
    """Grid cells whose centre lies in the shape, by the parity of edges that a ray to the right crosses."""
    w, whole = Window.partitionBy("design_id", "shape_id").orderBy("vertex"), Window.partitionBy("design_id", "shape_id")
    first = lambda c: F.min_by(c, "vertex").over(whole)
    edges = vertices.select("*", F.coalesce(F.lead("x_u").over(w), first("x_u")).alias("x1"), F.coalesce(F.lead("y_u").over(w), first("y_u")).alias("y1"))
    span = lambda c: F.sequence(F.floor(F.col(f"lo_{c}") / cell_u), F.floor(F.col(f"hi_{c}") / cell_u))
    shapes = edges.groupBy("design_id", "shape_id").agg(F.collect_list(F.struct("x_u", "y_u", "x1", "y1")).alias("edges"), *[f(c).alias(f"{n}_{c[0]}") for n, f in (("lo", F.min), ("hi", F.max)) for c in ("x_u", "y_u")])
    cells = shapes.withColumn("cy", F.explode(span("y"))).withColumn("cx", F.explode(span("x")))
    px, py = (F.col("cx") + 0.5) * cell_u, (F.col("cy") + 0.5) * cell_u
    crosses = lambda e: ((e["y_u"] > py) != (e["y1"] > py)) & (px < e["x_u"] + (e["x1"] - e["x_u"]) * (py - e["y_u"]) / F.when(e["y1"] != e["y_u"], e["y1"] - e["y_u"]))
    return cells.where(F.size(F.filter("edges", lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1).select("design_id", "shape_id", "cy", "cx")


def stroke_stats(widths: DataFrame) -> DataFrame:
    """Mean and variation (population deviation over mean) of a shape's widths."""
    return widths.groupBy("design_id", "shape_id").agg(F.avg("width").alias("mean"), (F.stddev_pop("width") / F.avg("width")).alias("cv"))


def text_candidates(shapes: DataFrame, most_cv: float = 0.32, aspect: tuple[float, float] = (0.05, 1.4)) -> DataFrame:
    """Shapes with even strokes and a letter's aspect; `shapes` has cv, w_u and h_u."""
    return shapes.where((F.col("cv") <= most_cv) & (F.col("w_u") / F.col("h_u")).between(*aspect))


def confusion(df: DataFrame, truth: Column, arms: dict[str, Column]) -> DataFrame:
    """Per arm (a classifier's verdict): true and false positives and negatives."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("arm"), said.alias("said")) for name, said in arms.items()]))
    n = lambda t, s: F.count_if((F.col("truth") == t) & (F.col("e.said") == s))
    return df.select(truth.alias("truth"), each.alias("e")).groupBy("e.arm").agg(n(True, True).alias("tp"), n(False, True).alias("fp"), n(False, False).alias("tn"), n(True, False).alias("fn"))


def tier_matrix(df: DataFrame, truth: str, said: str, tiers: tuple[str, ...]) -> DataFrame:
    """Rows of each true tier by the tier said, a column each."""
    return df.groupBy(truth).pivot(said, list(tiers)).count().na.fill(0)


def run_key(fixture: Column, width_mm: Column, garment: Column) -> Column:
    """`fixture @ Wmm/garment`, the width without trailing zeros."""
    return F.concat(fixture, F.lit(" @ "), F.regexp_replace(F.format_string("%.4f", width_mm), r"\.?0+$", ""), F.lit("mm/"), garment)


PHOTO = ("photo_subject", "photo_scene")


def photo_class(forced: Column, decided: Column) -> Column:
    """Whether a design counts as a photo: a forced photo class wins, else the published verdict."""
    return F.coalesce(forced.isin(*PHOTO), F.lit(False)) | F.coalesce(decided.isin(*PHOTO), F.lit(False))


def route(kind: Column, technique: Column, split: Column) -> tuple[Column, Column]:
    """Whether tone is split (photo classes, or on request) and the technique: only a photo subject without an explicit choice changes."""
    explicit = F.lower(F.coalesce(technique, F.lit("tatami"))) != "tatami"
    return F.coalesce(split, F.lit(False)) | kind.isin(*PHOTO), F.when(~explicit & (kind == "photo_subject"), "streamline").otherwise(technique)


