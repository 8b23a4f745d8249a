"""Quality rules over stitch tables: findings, score and grade of every design."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import distance, kth
from ..operators import coverage as V
from ..operators import technique as T
from ..operators.stream import HOP_U, design, so_far


@dataclass(frozen=True)
class Limits:
    """Thresholds; lengths in units of 0.1 mm."""

    longest_u: float = 121
    too_many_long: int = 0
    shortest_u: float = 10
    short_share: float = 0.25
    satin_steps: int = 30
    column_u: float = 10
    extent_u: float = 40
    small_shapes: int = 0
    fill_u: float = 4.0
    satin_u: float = 4.0
    density: float = 1.5
    samples: int = 30
    trims_per_1000: float = 4.1
    least_stitches: int = 30
    stops: int = 10
    many_stitches: int = 25_000
    same_hole: float = 0.25
    stacked: float = V.WARN
    overstacked: float = V.BLOCK
    patch_mm2: float = V.PATCH_MM2


#: Points off by severity, and least scores of grades.
POINTS = {"warn": 12, "block": 30}
GRADES = (("A", 90), ("B", 75), ("C", 60), ("D", 40))

#: Rules added by callers: name -> function of DataFrame of stitches to findings (design_id, code, severity, metric).
RULES: dict[str, Callable[[DataFrame, Limits], DataFrame]] = {}


def rule(name: str):
    """Register a rule that qc_report() then runs with the built-in ones."""
    def add(f):
        RULES[name] = f
        return f

    return add


def facts(st: DataFrame, limits: Limits = Limits(), hop_u: int = HOP_U) -> DataFrame:
    """One row a design with all that the built-in rules weigh.

    Windows and both groupings are by the design first, so the whole of it needs one shuffle of the stitches."""
    w, at = T.of_run(), Window.partitionBy("design_id", "x_u", "y_u")
    marked = st.withColumn("prev", F.lag("cmd").over(design()))
    far = distance(F.col("x_u") - F.lag("x_u").over(design()), F.col("y_u") - F.lag("y_u").over(design()))
    marked = marked.withColumns({"move": F.when((F.col("cmd") == "stitch") & (F.col("prev") == "stitch"), far), "down": F.col("cmd") == "stitch"})
    opens = F.col("down") & (F.col("move").isNull() | (F.col("move") >= hop_u))
    # commands other than stitches are a run of their own, -1, that has counts only
    marked = marked.withColumn("run", F.when(F.col("down"), F.sum(opens.cast("int")).over(so_far()) - 1).otherwise(-1))
    hole = F.when(F.col("down"), F.row_number().over(at.orderBy(F.desc("down"), "seq")))
    struck = F.when(F.col("down"), F.count(F.when(F.col("down"), 1)).over(at))
    s = marked.withColumns({"shared": F.when((struck >= 2) & (hole == 1), 1), "dx": F.when(F.col("down"), F.col("x_u") - F.lag("x_u").over(w)), "dy": F.when(F.col("down"), F.col("y_u") - F.lag("y_u").over(w))})
    s = s.withColumn("len", distance(F.col("dx"), F.col("dy")))
    size = F.col("len") * F.lag("len").over(w)
    s = s.withColumn("turns", F.when(size > 0, (F.col("dx") * F.lag("dx").over(w) + F.col("dy") * F.lag("dy").over(w)) / size < -0.2))
    span = lambda c: F.max(F.when(F.col("len").isNotNull(), F.greatest(c, F.col(c) - F.col("d" + c[0])))) - F.min(F.when(F.col("len").isNotNull(), F.least(c, F.col(c) - F.col("d" + c[0]))))
    n = lambda c: F.count(F.when(c, 1))
    runs = s.groupBy("design_id", "run").agg(*[n(F.col("cmd") == c).alias(c) for c in ("stitch", "trim", "color")], F.count("shared").alias("shared"), n(F.col("move") > limits.longest_u).alias("too_long"), F.max("move").alias("longest"),
                                             F.count("len").alias("steps"), F.when(F.count("len") > 0, kth(F.collect_list("len"), 0.5)).alias("median"), n(F.col("turns")).alias("back"), n(F.col("len") < limits.shortest_u).alias("short"), F.greatest(span("x_u"), span("y_u")).alias("extent"))
    lock = (F.col("steps") <= 5) & (F.col("median") <= 10)
    satin = (F.col("steps") > 0) & ~lock & (F.try_divide("back", "steps") >= 0.6)
    small = satin & ((F.col("median") < limits.column_u) | (F.col("extent") < limits.extent_u))
    in_satin = lambda c: F.sum(F.when(satin, F.col(c)).otherwise(0))
    return runs.groupBy("design_id").agg(*[F.sum(c).alias(c) for c in ("stitch", "trim", "color", "shared", "too_long")], F.max("longest").alias("longest"), in_satin("steps").alias("satin_steps"), in_satin("short").alias("short"), n(satin).alias("total"), n(small).alias("small"))


def _rules(limits: Limits) -> dict[str, list[tuple]]:
    """Built-in rules over the facts: code, severity, when, metric."""
    c, enough = F.col, F.col("stitch") >= limits.least_stitches
    share, trims, holes = F.try_divide("short", "satin_steps"), F.try_divide(c("trim") * 1000.0, c("stitch")), F.try_divide("shared", "stitch")
    return {
        "stitch_length": [("too_long", "block", c("too_long") > limits.too_many_long, c("longest")), ("too_short", "warn", (c("satin_steps") >= limits.satin_steps) & (share > limits.short_share), share)],
        "lettering": [("lettering_small", "warn", c("small") > limits.small_shapes, c("small"))],
        "counts": [("trims", "warn", enough & (trims > limits.trims_per_1000), trims), ("stops", "warn", c("color") > limits.stops, c("color")), ("stabiliser", "info", c("stitch") > limits.many_stitches, c("stitch"))],
        "same_hole": [("same_hole", "info", enough & (holes > limits.same_hole), holes)],
    }


def built_in(measured: DataFrame, limits: Limits = Limits(), *names: str) -> DataFrame:
    """Findings of the built-in rules (all, or those named) over facts; `total` is the number of satin shapes."""
    rules = _rules(limits)
    found = [F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), metric.cast("double").alias("metric"))) for name in names or rules for code, severity, when, metric in rules[name]]
    f = measured.select("design_id", "total", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f"))
    return f.select("design_id", "f.code", "f.severity", "f.metric", "total")


def stitch_length_rules(st: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Steps that are too long; satin of which too large a share is short."""
    return built_in(facts(st, limits), limits, "stitch_length").drop("total")


def lettering_rule(st: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Satin shapes too narrow or too small to read, with how many there are in all."""
    return built_in(facts(st, limits), limits, "lettering")


def density_rule(st: DataFrame, fabrics: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Fill and satin whose measured advance over the target lies outside 1 / density to density.

    `fabrics` has design_id and density_adjust, by which the targets are scaled."""
    fill = T.row_advance(st, limits.samples).select("design_id", F.lit("fill").alias("part"), (F.col("advance") / limits.fill_u).alias("ratio"))
    satin = T.satin_advance(st, limits.samples).select("design_id", F.lit("satin").alias("part"), (F.col("advance") / limits.satin_u).alias("ratio"))
    m = fill.union(satin).where("ratio is not null").join(fabrics, "design_id").withColumn("ratio", F.col("ratio") / F.col("density_adjust"))
    out = m.where((F.round("ratio", 6) > limits.density) | (F.round("ratio", 6) < round(1 / limits.density, 6)))
    code = F.concat("part", F.when(F.col("ratio") > 1, "_open").otherwise("_dense"))
    return out.select("design_id", code.alias("code"), F.lit("warn").alias("severity"), F.col("ratio").alias("metric"))


def stacking_rule(st: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Large patches that carry too many layers of thread; only the worse of the two limits is reported."""
    m = V.stacking(V.ribbon_grid(st), limits.stacked, limits.overstacked, patch_mm2=limits.patch_mm2)
    bad = F.col("over_block_mm2") > 0
    found = m.where(bad | (F.col("over_warn_mm2") > 0))
    return found.select("design_id", F.lit("stacked").alias("code"), F.when(bad, "block").otherwise("warn").alias("severity"), F.when(bad, F.col("over_block_mm2")).otherwise(F.col("over_warn_mm2")).alias("metric"))


def findings(st: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """All findings: those of the built-in rules in one pass, and those of the rules that callers registered."""
    own = built_in(facts(st, limits), limits).drop("total")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f(st, limits) for f in RULES.values()], own)


def score(found: DataFrame, designs: DataFrame) -> DataFrame:
    """Findings, score and grade of each design; designs without findings score 100."""
    each = designs.select("design_id").distinct().join(found.groupBy("design_id").agg(F.collect_list("severity").alias("severities")), "design_id", "left")
    return graded(each)


def graded(each: DataFrame) -> DataFrame:
    """Score and grade from a design's list of severities (null: none)."""
    n = lambda s: F.size(F.filter("severities", lambda x: x == s))
    off = sum((F.when(F.col("severities").isNull(), 0).otherwise(n(s)) * p for s, p in POINTS.items()), F.lit(0))
    out = each.select("design_id", F.when(F.col("severities").isNull(), 0).otherwise(F.size("severities")).cast("long").alias("findings"), F.greatest(F.lit(0), 100 - off).cast("long").alias("score"))
    grade = F.lit("F")
    for name, least in reversed(GRADES):
        grade = F.when(F.col("score") >= least, name).otherwise(grade)
    return out.withColumn("grade", grade)


def qc_report(st: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Findings, score and grade of every design: a second pass over the stitches only if callers registered rules."""
    if RULES:
        return score(findings(st, limits), st)
    measured = facts(st, limits)
    hits = [F.when(F.coalesce(when, F.lit(False)), F.lit(severity)) for rules in _rules(limits).values() for _, severity, when, _ in rules]
    return graded(measured.select("design_id", F.filter(F.array(*hits), lambda x: x.isNotNull()).alias("severities")))
