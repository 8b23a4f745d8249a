"""Regions across edits: identity, order, geometry, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import distance
from .graph import checkpointed


def polygon_measures(vertices: DataFrame) -> DataFrame:
    """Shoelace area (signed and not), perimeter, bounding box, vertex mean, centroid, axis (degrees; none if all directions are alike) and width 2A/P of closed rings."""
    keys = ["design_id", "shape_id"]
    w = Window.partitionBy(*keys).orderBy("vertex")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    e = vertices.withColumn("nx", nxt("x_u")).withColumn("ny", nxt("y_u"))
    cross = F.sum(F.col("x_u") * F.col("ny") - F.col("nx") * F.col("y_u")) / 2
    part = F.col("x_u") * F.col("ny") - F.col("nx") * F.col("y_u")
    moment = lambda c, n: F.sum((F.col(c) + F.col(n)) * part) / 6
    lean, stretch = F.round(F.covar_pop("x_u", "y_u") * 2, 6), F.round(F.var_pop("x_u") - F.var_pop("y_u"), 6)
    axis = F.when((lean != 0) | (stretch != 0), F.pmod(F.degrees(F.atan2(lean, stretch)) / 2, F.lit(180.0)))
    g = e.groupBy(*keys).agg(moment("x_u", "nx").alias("__mx"), moment("y_u", "ny").alias("__my"), F.round(axis, 4).alias("axis"), cross.alias("signed_area"), F.abs(cross).alias("area"), F.sum(distance(F.col("nx") - F.col("x_u"), F.col("ny") - F.col("y_u"))).alias("perimeter"), F.min("x_u").alias("min_x"), F.max("x_u").alias("max_x"), F.min("y_u").alias("min_y"), F.max("y_u").alias("max_y"), F.avg("x_u").alias("mid_x"), F.avg("y_u").alias("mid_y"))
    at = lambda c: F.when(F.col("area") > 0, F.col(c) / F.col("signed_area"))
    width = F.when(F.col("perimeter") > 0, F.col("area") * 2 / F.col("perimeter"))
    return g.withColumns({"centroid_x": at("__mx"), "centroid_y": at("__my"), "width": width}).drop("__mx", "__my")


def drop_nested(boxes: DataFrame) -> DataFrame:
    """Boxes that no strictly larger box of the same design contains."""
    edge = lambda p: (F.col(f"{p}cx_u") - F.col(f"{p}w_u"), F.col(f"{p}cx_u") + F.col(f"{p}w_u"), F.col(f"{p}cy_u") - F.col(f"{p}h_u"), F.col(f"{p}cy_u") + F.col(f"{p}h_u"))
    b = boxes.select(*[F.col(c).alias(f"o_{c}") for c in ("design_id", "shape_id", "cx_u", "cy_u", "w_u", "h_u")])
    # a container covers the inner box's centre cell: equi-join on the cells of the larger box
    cell = 100
    cells = lambda lo, hi: F.sequence(F.floor(lo / cell), F.floor(hi / cell))
    l2, r2, t2, b2 = edge("o_")
    big = b.withColumn("gx", F.explode(cells(l2, r2))).withColumn("gy", F.explode(cells(t2, b2)))
    small = boxes.withColumn("gx", F.floor(F.col("cx_u") / cell)).withColumn("gy", F.floor(F.col("cy_u") / cell))
    l1, r1, t1, b1 = edge("")
    inside = (F.col("o_shape_id") != F.col("shape_id")) & (F.col("o_w_u") * F.col("o_h_u") > F.col("w_u") * F.col("h_u")) & (l2 <= l1) & (r2 >= r1) & (t2 <= t1) & (b2 >= b1)
    return small.hint("merge").join(big, (F.col("design_id") == F.col("o_design_id")) & (small["gx"] == big["gx"]) & (small["gy"] == big["gy"]) & inside, "left_anti").drop("gx", "gy")


def shape_candidates(prev: DataFrame, cur: DataFrame, tolerance_u: int = 25) -> DataFrame:
    """Pairs of one design and thread within the tolerance, with squared distance, by a grid of that size."""
    grid = lambda c: F.floor(F.col(c) / tolerance_u)
    p = prev.select("design_id", "thread_idx", F.col("shape_id").alias("prev_id"), F.col("cx_u").alias("px"), F.col("cy_u").alias("py"), grid("cx_u").alias("gx"), grid("cy_u").alias("gy"))
    near = lambda c: F.explode(F.array(*[grid(c) + k for k in (-1, 0, 1)]))
    c = cur.select("design_id", "thread_idx", F.col("shape_id").alias("cur_id"), "cx_u", "cy_u", near("cx_u").alias("gx"), "layer").withColumn("gy", near("cy_u"))
    d2 = (F.col("cx_u") - F.col("px")) * (F.col("cx_u") - F.col("px")) + (F.col("cy_u") - F.col("py")) * (F.col("cy_u") - F.col("py"))
    return p.hint("merge").join(c, ["design_id", "thread_idx", "gx", "gy"]).withColumn("d2", d2).where(F.col("d2") <= tolerance_u * tolerance_u).select("design_id", "prev_id", "cur_id", "d2")


def mutual_best(pairs: DataFrame) -> DataFrame:
    """Pairs that are each other's nearest, by (d2, prev, cur): one round of greedy matching."""
    best = lambda key: F.row_number().over(Window.partitionBy("design_id", key).orderBy("d2", "prev_id", "cur_id"))
    return pairs.withColumn("__p", best("prev_id")).withColumn("__c", best("cur_id")).where("__p = 1 and __c = 1").drop("__p", "__c")


def match_shape_ids(prev: DataFrame, cur: DataFrame, tolerance_u: int = 25) -> DataFrame:
    """Greedy one-to-one matches, closest first. Rounds of mutual bests equal it, since the order is total.

    Pairs are written to a checkpoint each round; rounds end when no pair is left.
    """
    pairs, found = shape_candidates(prev, cur, tolerance_u), None
    pairs = checkpointed(pairs)
    while not pairs.isEmpty():
        got = checkpointed(mutual_best(pairs))
        found = got if found is None else found.unionByName(got)
        pairs = checkpointed(pairs.hint("merge").join(got.select("design_id", "prev_id"), ["design_id", "prev_id"], "left_anti").hint("merge").join(got.select("design_id", "cur_id"), ["design_id", "cur_id"], "left_anti"))
    return pairs if found is None else found


def sew_index(shapes: DataFrame) -> DataFrame:
    """Order of first appearance of each stitched shape in its design."""
    s = shapes.where("stitched").groupBy("design_id", "shape_id").agg(F.min(F.struct("layer", "shape_id")).alias("o"))
    return s.withColumn("sew_index", F.row_number().over(Window.partitionBy("design_id").orderBy("o")) - 1).drop("o")


def sort_key_layers(shapes: DataFrame) -> DataFrame:
    """Place of each shape by (layer, sew index, id), shapes never sewn last in their layer."""
    j = shapes.hint("merge").join(sew_index(shapes), ["design_id", "shape_id"], "left")
    w = Window.partitionBy("design_id").orderBy("layer", F.asc_nulls_last("sew_index"), "shape_id")
    return j.select("design_id", "shape_id", "layer", "sew_index", F.row_number().over(w).alias("place"))


def shape_ids(shapes: DataFrame, bucket_u: int = 5) -> DataFrame:
    """Content key of each shape (hash of its 0.5 mm centroid bucket and thread); repeats get -2, -3, ... by (thread, x, y, id)."""
    base = F.substring(F.sha2(F.concat_ws(":", F.floor(F.col("cx_u") / bucket_u), F.floor(F.col("cy_u") / bucket_u), "thread_idx"), 256), 1, 10)
    n = F.row_number().over(Window.partitionBy("design_id", "__b").orderBy("thread_idx", "cx_u", "cy_u", "shape_id"))
    return shapes.withColumn("__b", base).withColumn("__n", n).select("design_id", "shape_id", F.when(F.col("__n") == 1, F.col("__b")).otherwise(F.concat_ws("-", "__b", "__n")).alias("key"))


def compact_layers(shapes: DataFrame) -> DataFrame:
    """Layers in use renumbered from 0 without gaps."""
    return shapes.withColumn("compact", F.dense_rank().over(Window.partitionBy("design_id").orderBy("layer")) - 1).select("design_id", "shape_id", "layer", "compact")


def layer_order(shapes: DataFrame) -> DataFrame:
    """Layers of a design: background first and details last, then dark before light, larger first on ties, then the old order.

    `shapes` has enclosed and tier. A layer is background if all its stitched shapes (all shapes if none is) are enclosed, detail if all
    are runs or satin."""
    light = F.floor(F.sum(F.col("r") * 2126 + F.col("g") * 7152 + F.col("b") * 722) / F.count("*"))  # mean luma in ten-thousandths
    voting = shapes.withColumn("__votes", F.max("stitched").over(Window.partitionBy("design_id", "layer"))).where(F.col("stitched") | ~F.col("__votes"))
    depth = F.when(F.bool_and("enclosed"), 0).when(F.bool_and(F.lower("tier").isin("run", "satin")), 2).otherwise(1)
    g = voting.groupBy("design_id", "layer").agg(depth.alias("depth"), light.alias("light"), F.sum(F.col("w_u") * F.col("h_u")).cast("long").alias("area"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("design_id").orderBy("depth", "light", F.desc("area"), "layer")))


def effective_order(shapes: DataFrame) -> DataFrame:
    """Order of each shape: its override, else the stored one, else its sew index, else last (1e9), with its place by (order, id)."""
    j = shapes.hint("merge").join(sew_index(shapes), ["design_id", "shape_id"], "left")
    o = j.withColumn("order", F.coalesce(F.col("override"), F.col("stored"), F.col("sew_index"), F.lit(10**9)).cast("long"))
    return o.select("design_id", "shape_id", "order", F.row_number().over(Window.partitionBy("design_id").orderBy("order", "shape_id")).alias("place"))


def carry_meta(cur: DataFrame, prev: DataFrame, matches: DataFrame, names: list[str]) -> DataFrame:
    """Shapes with the named columns; where one is null, that of the shape matched before (design_id, prev_id, cur_id)."""
    old = prev.select("design_id", F.col("shape_id").alias("prev_id"), *[F.col(n).alias(f"__{n}") for n in names])
    m = matches.select("design_id", "prev_id", F.col("cur_id").alias("shape_id")).hint("merge").join(old, ["design_id", "prev_id"])
    return cur.hint("merge").join(m, ["design_id", "shape_id"], "left").select("design_id", "shape_id", "prev_id", *[F.coalesce(n, f"__{n}").alias(n) for n in names])


def color_blocks(shapes: DataFrame) -> DataFrame:
    """Stitched shapes grouped by layer: sew index range and the first one's colour."""
    j = shapes.hint("merge").join(sew_index(shapes), ["design_id", "shape_id"])
    return j.groupBy("design_id", "layer").agg(F.min("sew_index").alias("first"), F.max("sew_index").alias("last"), F.count("*").alias("shapes"), F.min_by("r", "sew_index").alias("r"), F.min_by("g", "sew_index").alias("g"), F.min_by("b", "sew_index").alias("b"))


def apply_edits(shapes: DataFrame, deleted: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shapes without the deleted ones and with overridden threads; and ids of either table that no shape has."""
    keys = ["design_id", "shape_id"]
    kept = shapes.hint("merge").join(deleted.select(*keys), keys, "left_anti").hint("merge").join(overrides.select(*keys, F.col("thread_idx").alias("__t")), keys, "left")
    edited = kept.select("design_id", "shape_id", F.coalesce("__t", "thread_idx").alias("thread_idx"), F.col("__t").isNotNull().alias("edited"))
    unknown = deleted.select(*keys).unionByName(overrides.select(*keys)).distinct().hint("merge").join(shapes.select(*keys), keys, "left_anti")
    return edited, unknown


def added_threads(overrides: DataFrame, used: DataFrame) -> DataFrame:
    """Threads that recolouring brings to a design: those of its overrides that none of its shapes has, numbered after its own in order."""
    new = overrides.select("design_id", "thread_idx").distinct().hint("merge").join(used.select("design_id", "thread_idx").distinct(), ["design_id", "thread_idx"], "left_anti")
    n = used.groupBy("design_id").agg(F.countDistinct("thread_idx").alias("n"))
    return new.join(n, "design_id").select("design_id", "thread_idx", (F.col("n") + F.row_number().over(Window.partitionBy("design_id").orderBy("thread_idx")) - 1).alias("place"))


def merge_shapes(shapes: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups (design_id, group, shape_id) of at least two shapes of one thread: merged key, members, primary and area."""
    j = groups.hint("merge").join(shapes, ["design_id", "shape_id"]).withColumn("area", (F.col("w_u") * F.col("h_u")).cast("long") * 4)
    g = j.groupBy("design_id", "group", "thread_idx").agg(F.array_sort(F.collect_set("shape_id")).alias("ids"), F.sum("area").alias("area"), F.max(F.struct("area", -F.col("shape_id"))).alias("big")).where(F.size("ids") >= 2)
    return g.select("design_id", "group", "thread_idx", F.substring(F.sha2(F.array_join("ids", ","), 256), 1, 12).alias("key"), F.size("ids").cast("long").alias("members"), (-F.col("big")["col2"]).alias("primary_id"), "area")


def unsewn_summary(shapes: DataFrame) -> DataFrame:
    """Shapes of each design that are planned and not sewn: how many, their ids, threads, areas, and how many by reason.

    A shape that is `enclosed` stays bare for that, any other by an override."""
    a = (F.col("w_u") * F.col("h_u") * 4).cast("long")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("shape_id")), lambda x: x.cast("string")), ",")
    return shapes.where("not stitched").groupBy("design_id").agg(F.count("*").alias("shapes"), ids.alias("ids"), F.countDistinct("thread_idx").alias("threads"), F.sum(a).alias("area"), F.max(a).alias("largest"), F.count_if("enclosed").alias("by_enclosure"), F.count_if(~F.col("enclosed")).alias("by_override"))


#: Tiers, least first.
TIERS = ("run", "satin", "fill")


def sew_facts(parts: DataFrame) -> DataFrame:
    """Every shape of `parts` (design_id, shape_id, layer, stitched, tier: a row a sewn part) with its sew index, block and highest tier;
    all null when it is never sewn. A block is a layer in use, from 0."""
    rank = sum((F.when(F.col("tier") == t, i).otherwise(0) for i, t in enumerate(TIERS, 1)), F.lit(0))
    sewn = parts.where("stitched").groupBy("design_id", "shape_id").agg(F.max(rank).alias("rank"), F.min("layer").alias("first_layer"))
    sewn = sewn.withColumn("block", F.dense_rank().over(Window.partitionBy("design_id").orderBy("first_layer")) - 1)
    tier = F.when(F.col("rank") > 0, F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.col("rank").cast("int")))
    facts = sewn.hint("merge").join(sew_index(parts), ["design_id", "shape_id"]).select("design_id", "shape_id", "sew_index", "block", tier.alias("tier"))
    return parts.groupBy("design_id", "shape_id").agg(F.min("layer").alias("layer")).hint("merge").join(facts, ["design_id", "shape_id"], "left")


def group_key(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    """One order-free key for each group's set of items."""
    return df.groupBy(*keys).agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_set(F.col(item).cast("string"))), ","), 256), 1, 16).alias("key"))
