"""How near designs come to the ones they follow: registration by hill climb, the parts of the score, the score.

Both sides are stitch tables of the same design_id. Designs that only one side has get no row. A design without thread on
either side has an overlap of 0 and stays where it is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import chance_correct
from . import climbs as C
from . import measures as M
from . import technique as T
from .climbs import MOVES as MOVES
from .colour import nearest_other_colour
from .drag import drag_rows
from .grounds import ground_rows
from .stream import HOP_U, segments

#: Weights of the parts, chance of a direction, limits of colours and underlay, trims that cost nothing.
WEIGHTS = {"coverage": 20, "direction": 20, "sttype": 20, "density": 15, "underlay": 10, "travel": 15}
DIRECTION_CHANCE, COLOUR_MM2, COLOUR_SHARE, NO_UNDERLAY, ECONOMY_EPS, TRIM_FLOOR, LONG_U = 0.5, 15.0, 0.03, 0.01, 0.02, 8, 121


def solid(cells: DataFrame, keys: list[str], window: int, least: float) -> DataFrame:
    """Places (keys, cx, cy) whose square window of `window` cells is full to `least`; the cells themselves where `window` is 0.

    Keys stay columns, so the nine copies of a cell are not shuffled where cells lie by design already."""
    if not window:
        return cells.select(*keys, "cx", "cy").distinct()
    box = range(-window, window + 1)
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in box for j in box]))
    around = cells.select(*keys, "cx", "cy").distinct().withColumn("m", near).select(*keys, (F.col("cx") + F.col("m.i")).alias("cx"), (F.col("cy") + F.col("m.j")).alias("cy"))
    full = around.groupBy(*keys, "cx", "cy").agg((F.count("*") / len(box) ** 2).alias("share"))
    return full.where(F.col("share") >= least).drop("share")


def _by_design(run: Callable, pro: DataFrame, ours: DataFrame, columns: str, window: int, least: float, hop_u: int) -> DataFrame:
    """What `run` of climbs makes of both sides' steps of each design. Steps lie by design already, so they are not shuffled again."""
    steps = lambda d: segments(d, hop_u).select("design_id", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "len")]).dropna()
    left, right = steps(pro), steps(ours)
    work = lambda key, p, o: run(key, p, o, window, least)
    return left.groupBy("design_id").cogroup(right.groupBy("design_id")).applyInArrow(work, f"design_id {left.schema['design_id'].dataType.simpleString()}, {columns}")


def first_round(pro: DataFrame, ours: DataFrame, window: int = 1, least: float = 0.55, hop_u: int = HOP_U) -> DataFrame:
    """The overlap of every seed and of its eight moves by the widest step."""
    return _by_design(C.tried, pro, ours, "seed int, move int, sx long, sy long, iou double", window, least, hop_u)


def register(pro: DataFrame, ours: DataFrame, window: int = 1, least: float = 0.55, hop_u: int = HOP_U) -> DataFrame:
    """design_id, dx_u, dy_u, iou: the shift of `ours` onto `pro` that the climbs from both seeds reach, the first seed's on ties.

    A design's steps of both sides meet in one task, which holds its masks and climbs to the end; nothing is written between rounds. Hill
    climbs find a peak, which need not be the highest."""
    return _by_design(C.climbed, pro, ours, "dx_u double, dy_u double, iou double", window, least, hop_u)


def moved(df: DataFrame, shift: DataFrame) -> DataFrame:
    """Stitches shifted by their design's (dx_u, dy_u); where there is none they stay."""
    by = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0.0))).alias(c)
    return df.join(shift.select("design_id", "dx_u", "dy_u"), "design_id", "left").select("design_id", "seq", "cmd", by("x_u", "dx_u"), by("y_u", "dy_u"))


def thread_cells(df: DataFrame, cell_u: float, hop_u: int = HOP_U) -> DataFrame:
    """Cells of each block's steps; steps longer than a machine sews are moves."""
    s = segments(df, hop_u).where((F.col("len") > 0) & (F.col("len") <= LONG_U))
    return T.line_cells(s, cell_u).select("design_id", "block", "cx", "cy").distinct()


def colour_groups(colours: DataFrame) -> DataFrame:
    """Blocks (design_id, block, r, g, b) with grp: the first block of their colour."""
    return colours.withColumn("grp", F.min("block").over(Window.partitionBy("design_id", "r", "g", "b")))


def coverage(pro: DataFrame, ours: DataFrame, pro_colours: DataFrame, our_colours: DataFrame, cell_u: float, window: int, least: float, hop_u: int = HOP_U) -> DataFrame:
    """Per design: iou, recall, precision of the solid ground, agreement of the colours that show, the worst recall of a colour, and solid cells of each side.

    Our colours count as the nearest of the other side's; the colour whose first block comes last shows. Colours of under
    COLOUR_MM2 or COLOUR_SHARE of the ground don't count for the worst; without any the recall stands in. A design's cells of both sides
    meet in one task, so none is shuffled."""
    theirs = colour_groups(pro_colours)
    mine = colour_groups(our_colours)
    near = nearest_other_colour(mine.select("design_id", "grp", "r", "g", "b").distinct(), theirs.select("design_id", "grp", "r", "g", "b").distinct())
    mine = mine.select("design_id", "block", "grp").hint("merge").join(near.select("design_id", "grp", "other"), ["design_id", "grp"]).select("design_id", "block", F.col("other").alias("grp"))

    def steps(side: DataFrame, groups: DataFrame) -> DataFrame:
        # a design's groups come to its steps as one map, so no step is shuffled
        ranked = groups.withColumn("rank", F.min("block").over(Window.partitionBy("design_id", "grp")))
        told = ranked.groupBy("design_id").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct(F.col("block").cast("long"), F.struct(F.col("grp").cast("long").alias("grp"), F.col("rank").cast("long").alias("rank")))))).alias("told"))
        s = segments(side, hop_u).where((F.col("len") > 0) & (F.col("len") <= LONG_U)).hint("merge").join(told, "design_id", "left")
        s = s.withColumn("own", F.try_element_at("told", F.col("block").cast("long")))
        return s.select("design_id", F.col("own.grp").alias("grp"), F.col("own.rank").alias("rank"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "len")]).dropna(subset=["design_id", "x0", "y0", "x1", "y1"])

    left, right = steps(pro, theirs.select("design_id", "block", "grp")), steps(ours, mine)
    out = f"design_id {left.schema['design_id'].dataType.simpleString()}, iou double, recall double, precision double, agreement double, worst double, solid_pro long, solid_ours long"
    work = lambda key, p, o: ground_rows(key, p, o, cell_u, window, least, COLOUR_MM2, COLOUR_SHARE)
    return left.groupBy("design_id").cogroup(right.groupBy("design_id")).applyInArrow(work, out)


def cells_alike(pro: DataFrame, ours: DataFrame, cell_u: float, ratio: int, window: int, least: float, hop_u: int = HOP_U) -> DataFrame:
    """Per design over the squares of `ratio` cells of which both sides fill half: agreement of directions and of stitch types, and the types' chance."""
    keys = ["design_id", "ci", "cj"]
    s = solid(thread_cells(pro, cell_u, hop_u), ["design_id"], window, least).hint("merge").join(solid(thread_cells(ours, cell_u, hop_u), ["design_id"], window, least), ["design_id", "cx", "cy"])
    square = lambda c: F.floor(F.col(c) / ratio).cast("long")
    shared = s.groupBy("design_id", square("cx").alias("ci"), square("cy").alias("cj")).count().where(F.col("count") * 2 >= ratio * ratio).drop("count")
    # a cell whose directions cancel out has a type but no direction
    angle = F.when(F.col("concentration") > 1e-6, F.col("angle")).alias("angle")
    of = lambda d: M.cell_map(d, cell_u * ratio, hop_u=hop_u).select(*keys, angle, "typ")
    j = shared.hint("merge").join(of(pro).withColumnsRenamed({"angle": "pa", "typ": "pt"}), keys).hint("merge").join(of(ours).withColumnsRenamed({"angle": "oa", "typ": "ot"}), keys)
    apart = F.abs(F.col("pa") - F.col("oa"))
    apart = F.least(apart, F.lit(180.0) - apart)
    types = sorted(("run", "satin", "fill"))
    share = lambda side, t: F.avg((F.col(side) == t).cast("int"))
    chance = sum((share("pt", t) * share("ot", t) for t in types), F.lit(0.0))
    return j.groupBy("design_id").agg(F.avg(F.lit(1.0) - apart / 90).alias("direction_raw"), F.avg((F.col("pt") == F.col("ot")).cast("int")).alias("sttype_raw"), chance.alias("chance"), F.count("*").alias("shared"))


def underlay_alike(pro: DataFrame, ours: DataFrame, cell_u: float, square: int, **rule: float) -> DataFrame:
    """Per design how alike the shares of underlay are, and the overlap of the squares of `square` cells in which it lies."""
    share = lambda d, n: T.underlay_share(d, cell_u, **rule).select("design_id", F.coalesce(F.try_divide("underlay_mm", "sewn_mm"), F.lit(0.0)).alias(n))
    at = lambda c: F.floor(F.col(c) / square).cast("long").alias(c)
    place = lambda d: T.underlay_cells(d, cell_u, **rule).select("design_id", at("cx"), at("cy")).distinct()
    laid = M.mask_iou(place(pro), place(ours), ("cx", "cy")).select("design_id", "iou")
    j = share(pro, "pf").join(share(ours, "of"), "design_id").join(laid, "design_id", "left")
    r = (F.col("of") + ECONOMY_EPS) / (F.col("pf") + ECONOMY_EPS)
    none = (F.col("pf") < NO_UNDERLAY) & (F.col("of") < NO_UNDERLAY)
    return j.select("design_id", F.least(r, 1 / r).alias("economy"), F.when(none | F.col("iou").isNull(), 1.0).otherwise(F.col("iou")).alias("composition"))


def drag(df: DataFrame, cell_u: float, radius: int, hop_u: int = HOP_U) -> DataFrame:
    """design_id, drag_mm: exposed drag over ground whose gaps are closed and lone lines opened away (discs of `radius`). A design's points and
    cells lie in one task, so none is shuffled."""
    s = segments(df, 1 << 30).select("design_id", "seq", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "len")]).dropna()
    return s.groupBy("design_id").applyInArrow(lambda key, t: drag_rows(key, t, cell_u, radius, hop_u), f"design_id {s.schema['design_id'].dataType.simpleString()}, drag_mm double")


def travel(pro: DataFrame, ours: DataFrame, cell_u: float, radius: int, hop_u: int = HOP_U) -> DataFrame:
    """Per design: our exposed drag beyond theirs against a fifth of the width of both (at least 10 mm), and the economy of trims."""
    dragged = lambda d, n: drag(d, cell_u, radius, hop_u).withColumnRenamed("drag_mm", n)
    trims = lambda d, n: d.groupBy("design_id").agg(F.count(F.when(F.col("cmd") == "trim", 1)).alias(n), F.min(F.when(F.col("cmd") == "stitch", F.col("x_u"))).alias(f"{n}0"), F.max(F.when(F.col("cmd") == "stitch", F.col("x_u"))).alias(f"{n}1"))
    j = trims(pro, "pt").join(trims(ours, "ot"), "design_id").join(dragged(pro, "pd"), "design_id", "left").join(dragged(ours, "od"), "design_id", "left")
    wide = F.greatest((F.greatest("pt1", "ot1") - F.least("pt0", "ot0")) * 0.1, F.lit(10.0))
    excess = F.greatest(F.coalesce("od", F.lit(0.0)) - F.coalesce("pd", F.lit(0.0)), F.lit(0.0))
    economy = F.least(F.lit(1.0), (F.col("pt") + TRIM_FLOOR) / (F.col("ot") + TRIM_FLOOR))
    return j.select("design_id", (F.lit(1.0) / (excess / (wide * 0.2) + 1)).alias("drag_score"), economy.alias("trim_economy"))


def parity_score(pro: DataFrame, ours: DataFrame, pro_colours: DataFrame, our_colours: DataFrame, cell_u: float = 5.0, ratio: int = 4, window: int = 1, least: float = 0.55, underlay: tuple[float, int] = (4.0, 5), drag: tuple[float, int] = (5.0, 1), rule: dict | None = None, hop_u: int = HOP_U) -> DataFrame:
    """The parts of the score (0 to 1 each) and the score (0 to 100) of `ours`, moved by register() beforehand, against `pro`.

    Directions and types are corrected for chance; `score_raw` is without that. Without shared ground both are 0."""
    cov = coverage(pro, ours, pro_colours, our_colours, cell_u, window, least, hop_u)
    alike = cells_alike(pro, ours, cell_u, ratio, window, least, hop_u)
    length = lambda d, n: segments(d, hop_u).groupBy("design_id").agg((F.sum(F.when(F.col("len") <= LONG_U, F.col("len")).otherwise(0.0)) * 0.1).alias(n))
    j = cov.join(length(pro, "pl"), "design_id").join(length(ours, "ol"), "design_id").join(alike, "design_id", "left")
    j = j.join(underlay_alike(pro, ours, *underlay, **(rule or {})), "design_id", "left").join(travel(pro, ours, *drag, hop_u), "design_id", "left")
    px = (cell_u * 0.1) ** 2
    dense = lambda mm, n: F.col(mm) / F.greatest(F.col(n) * px, F.lit(1.0))
    r = F.try_divide(dense("ol", "solid_ours"), dense("pl", "solid_pro"))
    raw = {k: F.coalesce(f"{k}_raw", F.lit(0.0)) for k in ("direction", "sttype")}
    parts = {
        "coverage": F.col("iou") * 0.5 + F.col("agreement") * 0.3 + F.col("worst") * 0.2,
        "direction": F.when(F.col("shared") > 0, chance_correct(raw["direction"], F.lit(DIRECTION_CHANCE))).otherwise(0.0),
        "sttype": F.when(F.col("shared") > 0, chance_correct(raw["sttype"], F.col("chance"))).otherwise(0.0),
        "density": F.when(r > 0, F.least(r, 1 / r)).otherwise(0.0),
        "underlay": F.coalesce(F.col("economy") * 0.5 + F.col("composition") * 0.5, F.lit(1.0)),
        "travel": F.col("drag_score") * 0.75 + F.col("trim_economy") * 0.25,
    }
    j = j.withColumns(parts).withColumns({f"{k}_raw": v for k, v in raw.items()})
    total = lambda f: sum((F.col(f(k)) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return j.select("design_id", *WEIGHTS, "direction_raw", "sttype_raw", total(lambda k: k).alias("score"), total(lambda k: f"{k}_raw" if k in raw else k).alias("score_raw"))
