"""What a corpus of designs is made of: rows of fills, underlay by column width, lengths by technique; bare stretches of rings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import distance, kth
from .stream import HOP_U, segments
from .technique import elements, of_kind, of_run, phase_steps, phases, recipe_census

#: Units of a step that tells a direction, of the gaps that count as rows, rows and offsets that a stagger is read from, least steps of a column.
LONG_U, GAPS_U, ROWS, OFFSETS, COLUMN_STEPS = 10, (0.5, 30), 24, 12, 8


def fill_stats(df: DataFrame, hop_u: int = HOP_U) -> DataFrame:
    """Fill runs of three rows or more: direction in steps of 5 degrees, rows, median gap of rows and step, stagger in hundredths of a step.

    The direction is that of most long steps, the lower one on ties (180 is 0). A row ends where a long step goes the other way
    along it; the point there belongs to both. The gap is null where no two rows are GAPS_U apart. The stagger tells for the first
    ROWS rows how far each one's middle point is moved on from that of the row before, as a part of the median step."""
    of = Window.partitionBy("design_id", "run")
    s = segments(df, hop_u).hint("merge").join(of_kind(df, "fill", hop_u), ["design_id", "run"], "left_semi")
    long = F.col("len") > LONG_U
    turn = F.pmod(F.degrees(F.atan2((F.col("y1") - F.col("y0")).cast("double"), (F.col("x1") - F.col("x0")).cast("double"))), F.lit(180.0))
    s = s.withColumn("bin", F.when(long, F.pmod(F.round(turn / 5) * 5, F.lit(180.0)).cast("int")))
    top = s.where("bin is not null").groupBy("design_id", "run", "bin").count().groupBy("design_id", "run").agg(F.max_by("bin", F.struct("count", -F.col("bin"))).alias("angle"))
    s = s.hint("merge").join(top, ["design_id", "run"]).withColumn("c", F.cos(F.radians("angle"))).withColumn("n", F.sin(F.radians("angle")))
    along = lambda k: F.round(F.col(f"x{k}") * F.col("c") + F.col(f"y{k}") * F.col("n"), 6)
    off = lambda k: F.col(f"y{k}") * F.col("c") - F.col(f"x{k}") * F.col("n")
    s = s.withColumns({"t0": along(0), "t1": along(1), "o0": off(0), "o1": off(1)})
    s = s.withColumn("way", F.when(long & (F.col("t1") != F.col("t0")), F.signum(F.col("t1") - F.col("t0"))))
    before = F.last("way", ignorenulls=True).over(of_run().rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("row", F.sum(F.coalesce((F.col("way") != before).cast("int"), F.lit(0))).over(of_run()))
    rows = s.groupBy("design_id", "run", "row").agg(
        F.first("angle").alias("angle"), F.min("seq").alias("seq"), (F.count("*") + 1).alias("points"), (F.sum("o1") + F.min_by("o0", "seq")).alias("off"),
        kth(F.concat(F.collect_list("t1"), F.array(F.min_by("t0", "seq"))), 0.5).alias("mid"), F.collect_list(F.when(F.col("len") > LONG_U, F.col("len"))).alias("lens"))
    by_row = of.orderBy("row")
    gap = F.abs(F.col("off") / F.col("points") - F.lag(F.col("off") / F.col("points")).over(by_row))
    rows = rows.withColumn("gap", gap)
    mid = F.when((F.col("row") < ROWS) & (F.col("points") > 2), F.struct("row", "mid"))
    within = F.when((F.col("gap") > GAPS_U[0]) & (F.col("gap") < GAPS_U[1]), F.round("gap", 6))
    g = rows.groupBy("design_id", "run").agg(F.first("angle").alias("angle"), F.count("*").alias("rows"), F.collect_list(within).alias("gaps"), kth(F.flatten(F.collect_list("lens")), 0.5).alias("step"), F.array_sort(F.collect_list(mid)).alias("mids"))
    # a run with a direction has a long step
    phase = F.transform("mids", lambda m: F.round(F.pmod(m["mid"], F.round("step", 6)) / F.round("step", 6) * 100).cast("int"))
    g = g.where("rows >= 3").withColumn("phase", phase)
    moved = F.zip_with(F.slice("phase", 2, OFFSETS), F.slice("phase", 1, OFFSETS), lambda b, a: F.pmod(b - a, F.lit(100)))
    return g.select("design_id", "run", "angle", "rows", F.when(F.size("gaps") > 0, kth(F.col("gaps"), 0.5)).alias("row_gap"), F.col("step").alias("step"), F.filter(moved, lambda v: v.isNotNull()).alias("stagger"))


def ranks(rows: DataFrame, key: str, value: str, qs: dict[str, float]) -> DataFrame:
    """n, the elements at the given shares of the order and the largest, by key. Equal values are counted first: no key's rows meet in one task."""
    by = rows.groupBy(key, F.round(value, 4).alias("v")).agg(F.count("*").alias("c"))
    cum = by.withColumn("upto", F.sum("c").over(Window.partitionBy(key).orderBy("v"))).withColumn("n", F.sum("c").over(Window.partitionBy(key)))
    pick = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("n") * F.lit(q)), F.col("v")))
    return cum.groupBy(key).agg(F.max("n").alias("n"), *[pick(q).alias(k) for k, q in qs.items()], F.max("v").alias("most"))


def underlay_by_width(df: DataFrame, hop_u: int = HOP_U) -> DataFrame:
    """Widths of columns over zigzag and over none: the width of an element is that of its last column of COLUMN_STEPS steps or more."""
    p = phases(df, hop_u=hop_u).hint("merge").join(elements(df, hop_u=hop_u), ["design_id", "run"])
    column = (F.col("label") == "S") & (F.col("steps") >= COLUMN_STEPS)
    each = p.groupBy("design_id", "element").agg(F.max(F.when(column, F.struct("run", "phase", "median_len"))).alias("s"), F.max((F.col("label") == "Z").cast("int")).alias("z"))
    e = each.where("s is not null").select(F.when(F.col("z") == 1, "with zigzag").otherwise("no zigzag").alias("under"), F.col("s.median_len").alias("width"))
    return ranks(e, "under", "width", {"p10": 0.1, "median": 0.5, "p90": 0.9})


def technique_lengths(df: DataFrame, least_u: float = 0.3, hop_u: int = HOP_U) -> DataFrame:
    """Lengths of steps by the technique of their phase."""
    first = F.first("label").over(Window.partitionBy("design_id", "run", "phase").orderBy("seq"))
    s = phase_steps(df, hop_u=hop_u).withColumn("technique", first).where(F.col("len") > least_u)
    return ranks(s, "technique", "len", {"median": 0.5, "p90": 0.9})


def corpus_census(df: DataFrame, k: int = 18, hop_u: int = HOP_U) -> DataFrame:
    """section, name, n, p10, median, p90, most: the k commonest recipes, columns by what lies under them, lengths by technique."""
    none = F.lit(None).cast("double")
    row = lambda d, section, name, n, **has: d.select(F.lit(section).alias("section"), F.col(name).alias("name"), F.col(n).alias("n"), *[has.get(c, none).alias(c) for c in ("p10", "median", "p90", "most")])
    c = F.col
    a = row(recipe_census(df, k, hop_u), "recipe", "recipe", "elements")
    b = row(underlay_by_width(df, hop_u), "underlay", "under", "n", p10=c("p10"), median=c("median"), p90=c("p90"), most=c("most"))
    return a.unionByName(b).unionByName(row(technique_lengths(df, hop_u=hop_u), "length", "technique", "n", median=c("median"), p90=c("p90"), most=c("most")))


def bare_arcs(rings: DataFrame, keys: list[str]) -> DataFrame:
    """Longest stretches of bare places along closed rings (keys, i, x, y, bare): keys, arc, places, length from its first to its last place.

    The last place of a ring is next to its first, so a stretch across that seam is one; a ring that is bare all round is one arc
    from its first to its last place. Arcs are numbered from 1, the one across the seam last."""
    of, by = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("i")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    around = lambda f, c, end: F.coalesce(f(c).over(by), end(c).over(whole))
    r = rings.withColumn("bare", F.coalesce("bare", F.lit(False))).withColumns({"__p": around(F.lag, "bare", F.last), "__n": around(F.lead, "bare", F.first), "__x": around(F.lead, "x", F.first), "__y": around(F.lead, "y", F.first), "__last": F.lead("i").over(by).isNull()})
    r = r.withColumn("__o", (F.col("bare") & ~F.col("__p")).cast("int")).withColumn("__k", F.sum("__o").over(by)).withColumn("__t", F.sum("__o").over(of))
    arc = F.when(F.col("__t") == 0, 1).when(F.col("__k") == 0, F.col("__t")).otherwise(F.col("__k"))
    # the step from a place to the next counts if both are of the arc, but not the one that would close a wholly bare ring
    step = F.when(F.col("__n") & ~(F.col("__last") & (F.col("__t") == 0)), distance(F.col("__x") - F.col("x"), F.col("__y") - F.col("y"))).otherwise(0.0)
    return r.where("bare").withColumn("arc", arc.cast("long")).withColumn("__s", step).groupBy(*keys, "arc").agg(F.count("*").alias("places"), F.sum("__s").alias("length"))
