"""Colours of regions against spools and of palettes against each other. Keys are images or designs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import delta_e76, delta_e2000, rgb_to_lab
from .lloyd import centre_rows

#: Least pixels and most samples of a region, and the findings' limits.
REGION_PIXELS, REGION_SAMPLES, WARN, BLOCK = 50, 4096, 5.0, 10.0
#: Percentiles of lightness that stand for a region's dark and light, and least pixels.
DARK, LIGHT, TONAL_PIXELS = 0.05, 0.95, 24
REGION = ("image_id", "label")


def lab(df: DataFrame, prefix: str = "", of: str = "") -> DataFrame:
    """`df` with L, A and B (prefixed) of its r, g and b (prefixed by `of`)."""
    return df.withColumns({f"{prefix}{n}": c for n, c in zip("LAB", rgb_to_lab(*[F.col(f"{of}{c}") for c in "rgb"]), strict=True)})


def triple(prefix: str) -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}{c}") for c in "LAB")


def evenly(df: DataFrame, keys: tuple[str, ...], order: list[str], most: int) -> DataFrame:
    """At most `most` rows of each group, evenly spaced in its order: a row stays where floor(i * m / n) moves on."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("__n", F.count("*").over(w)).withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1)
    m = F.least(F.col("__n"), F.lit(most))
    step = lambda i: F.floor(i * m / F.col("__n"))
    return d.where((F.col("__i") == 0) | (step(F.col("__i")) != step(F.col("__i") - 1))).drop("__n", "__i")


def region_colour_error(px: DataFrame, spools: DataFrame, least: int = REGION_PIXELS, most: int = REGION_SAMPLES) -> DataFrame:
    """Median CIEDE2000 of each region's opaque pixels to its spool, and the median of each channel; regions of `least` pixels or more.

    `spools` has image_id, label, thread_idx and the thread's r, g, b as tr, tg, tb."""
    inside = px.where("a > 127").withColumn("__n", F.count("*").over(Window.partitionBy(*REGION))).where(F.col("__n") >= least)
    some = evenly(inside, REGION, ["y", "x"], most)
    met = lab(lab(some.hint("merge").join(spools, list(REGION)), "own_"), "spool_", "t")
    each = met.withColumn("de", delta_e2000(triple("own_"), triple("spool_")))
    return each.groupBy(*REGION, "thread_idx").agg(F.count("*").alias("samples"), F.percentile("de", 0.5).alias("delta_e"), *[F.percentile(c, 0.5).alias(f"median_{c}") for c in "rgb"])


def thread_match_rule(errors: DataFrame, warn: float = WARN, block: float = BLOCK) -> DataFrame:
    """One finding for each image and thread whose worst region lies over the limit; its regions in order of label."""
    over = errors.where(F.round("delta_e", 6) > warn)
    g = over.groupBy("image_id", "thread_idx").agg(F.max("delta_e").alias("delta_e"), F.max_by("label", F.struct(F.round("delta_e", 6), -F.col("label"))).alias("worst"), F.array_join(F.transform(F.array_sort(F.collect_list("label")), lambda x: x.cast("string")), ",").alias("regions"))
    return g.withColumn("severity", F.when(F.round("delta_e", 6) > block, "block").otherwise("warn"))


def tonal_span(px: DataFrame, low: float = DARK, high: float = LIGHT, least: int = TONAL_PIXELS) -> DataFrame:
    """CIEDE2000 between the mean colours of each region's darkest and lightest band; 0 with fewer than `least` pixels."""
    p = lab(px.where("a > 127"))
    cut = p.groupBy(*REGION).agg(F.count("*").alias("n"), F.percentile("L", low).alias("lo"), F.percentile("L", high).alias("hi"))
    band = p.hint("merge").join(cut, list(REGION))
    mean = lambda cond, n: [F.avg(F.when(cond, F.col(c))).alias(f"{n}{c}") for c in "LAB"]
    g = band.groupBy(*REGION).agg(F.max("n").alias("n"), *mean(F.round("L", 9) <= F.round("lo", 9), "d"), *mean(F.round("L", 9) >= F.round("hi", 9), "l"))
    return g.select(*REGION, "n", F.when(F.col("n") >= least, delta_e2000(triple("d"), triple("l"))).otherwise(0.0).alias("span"))


def merge_similar_colours(colors: DataFrame, tol: float = 6.0) -> DataFrame:
    """grp, id, root and rank: colours (grp, id, r, g, b, weight) linked by a CIE76 distance of `tol` or less, groups by weight, then lowest id.

    Colours of a group meet in cells of `tol` in Lab, so only near ones are compared."""
    from .graph import components

    c = lab(colors)
    cells = [F.floor(F.col(x) / tol) for x in "LAB"]
    near = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("ijk", (i, j, k), strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    p = c.select("grp", F.col("id").alias("u"), *[F.col(x).alias(f"u{x}") for x in "LAB"], *[e.alias(f"c{x}") for x, e in zip("LAB", cells, strict=True)])
    q = c.select("grp", F.col("id").alias("v"), *[F.col(x).alias(f"v{x}") for x in "LAB"], *[e.alias(f"o{x}") for x, e in zip("LAB", cells, strict=True)], F.explode(near).alias("o"))
    q = q.select("grp", "v", "vL", "vA", "vB", *[(F.col(f"o{x}") + F.col(f"o.{n}")).alias(f"c{x}") for x, n in zip("LAB", "ijk", strict=True)])
    links = p.hint("merge").join(q, ["grp", "cL", "cA", "cB"]).where((F.col("u") < F.col("v")) & (F.round(delta_e76(triple("u"), triple("v")), 6) <= tol))
    node = lambda x: F.struct("grp", F.col(x).alias("id"))
    roots = components(c.select(node("id").alias("node")), links.select(node("u").alias("u"), node("v").alias("v")))
    out = roots.select("node.grp", "node.id", F.col("root.id").alias("root")).hint("merge").join(colors.select("grp", "id", "weight"), ["grp", "id"])
    sums = out.groupBy("grp", "root").agg(F.sum("weight").alias("total"))
    ranks = sums.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("total"), "root")))
    return out.hint("merge").join(ranks, ["grp", "root"]).select("grp", "id", "root", F.col("rank").cast("long").alias("rank"), "total")


def nearest_other_colour(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """For each colour group of our side (design_id, grp, r, g, b) the other side's nearest by squared RGB distance, the first on ties."""
    o = theirs.select("design_id", F.col("grp").alias("other"), *[F.col(c).alias(f"o{c}") for c in "rgb"])
    d2 = sum(((F.col(c) - F.col(f"o{c}")) * (F.col(c) - F.col(f"o{c}")) for c in "rgb"), F.lit(0))
    return ours.hint("merge").join(o, "design_id").groupBy("design_id", "grp").agg(F.min(F.struct(d2.alias("d2"), "other")).alias("m")).select("design_id", "grp", "m.other", "m.d2")


def merge_nearest_pair(palette: DataFrame, reach: float = 16.0) -> DataFrame:
    """One round over palettes (image_id, id, r, g, b, weight): the closest pair under `reach` RGB units becomes one weighted colour."""
    q = palette.select("image_id", F.col("id").alias("jd"), *[F.col(c).alias(f"j{c}") for c in "rgb"], F.col("weight").alias("jw"))
    d2 = sum(((F.col(c) - F.col(f"j{c}")) * (F.col(c) - F.col(f"j{c}")) for c in "rgb"), F.lit(0))
    pairs = palette.hint("merge").join(q, "image_id").where(F.col("id") < F.col("jd")).withColumn("d2", d2).where(F.col("d2") < reach * reach)
    best = pairs.groupBy("image_id").agg(F.min(F.struct("d2", "id", "jd", "jr", "jg", "jb", "jw")).alias("m")).select("image_id", F.col("m.id").alias("keep"), F.col("m.jd").alias("gone"), *[F.col(f"m.j{c}") for c in "rgb"], F.col("m.jw").alias("jw"))
    met = palette.join(best, "image_id", "left").where(F.col("gone").isNull() | (F.col("id") != F.col("gone")))
    hit = F.coalesce(F.col("id") == F.col("keep"), F.lit(False))
    mixed = lambda c: F.when(hit, F.floor((F.col(c) * F.col("weight") + F.col(f"j{c}") * F.col("jw")) / F.greatest(F.lit(1), F.col("weight") + F.col("jw")) + 0.5)).otherwise(F.col(c)).cast("long").alias(c)
    return met.select("image_id", "id", *[mixed(c) for c in "rgb"], F.when(hit, F.col("weight") + F.col("jw")).otherwise(F.col("weight")).alias("weight"))


def merge_near_colours(palette: DataFrame, reach: float = 16.0) -> DataFrame:
    """Rounds of merge_nearest_pair() over all images until none has a pair under `reach`; a palette of n takes n - 1 at most."""
    from .graph import checkpointed

    now = checkpointed(palette)
    n = now.count()
    while True:
        now = checkpointed(merge_nearest_pair(now, reach))
        left = now.count()
        if left == n:
            return now
        n = left


def kmeans_seeds(colors: DataFrame, k: int) -> DataFrame:
    """k colours of each image, evenly spaced in the order of lightness: image_id, centre, L, A, B."""
    w = Window.partitionBy("image_id")
    c = colors.withColumn("i", F.row_number().over(w.orderBy("L", "A", "B")) - 1).withColumn("n", F.count("*").over(w))
    at = c.withColumn("centre", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where(F.col("i") == F.floor((F.col("centre") * 2 + 1) * F.col("n") / (2 * k)))
    return at.select("image_id", "centre", "L", "A", "B")


def kmeans_round(colors: DataFrame, centres: DataFrame) -> DataFrame:
    """Centres after one round: every colour (image_id, L, A, B, weight) goes to its nearest centre, the lowest on ties, and centres become weighted means.

    An image's centres (k of them) meet its colours as one array, so a colour stays one row."""
    c = centres.groupBy("image_id").agg(F.collect_list(F.struct("centre", "L", "A", "B")).alias("centres"))
    away = lambda m: F.struct(F.round(delta_e76(triple(""), tuple(m[x] for x in "LAB")), 6).alias("d"), m["centre"].alias("centre"))
    near = colors.hint("merge").join(c, "image_id").withColumn("centre", F.array_min(F.transform("centres", away)).getField("centre"))
    mean = lambda x: (F.sum(F.col(x) * F.col("weight")) / F.sum("weight")).alias(x)
    return near.groupBy("image_id", "centre").agg(*[mean(x) for x in "LAB"], F.sum("weight").alias("weight"))


def kmeans_centres(colors: DataFrame, k: int, rounds: int | None = None) -> DataFrame:
    """image_id, centre, L, A, B, weight: Lloyd's rounds over each image until no centre of it moves by 1e-6, or `rounds` of them where a caller wants fewer.

    An image's colours, which its distinct r, g, b bound, are worked out once and meet in one task, which makes all its rounds."""
    kind = colors.schema["image_id"].dataType.simpleString()
    known = colors.select("image_id", *[F.col(x).cast("double").alias(x) for x in "LAB"], F.col("weight").cast("long").alias("weight"))
    return known.groupBy("image_id").applyInArrow(lambda key, c: centre_rows(key, c, k, rounds), f"image_id {kind}, centre int, L double, A double, B double, weight long")


def split_widest_box(boxes: DataFrame, number: Column | int) -> DataFrame:
    """One step of median cut: of each image's boxes (image_id, box, r, g, b, weight: a row a colour) the one of the widest channel is split at its
    median colour along that channel (r before g before b on ties, the lowest box on ties); its upper half becomes box `number`."""
    span = [(F.max(c) - F.min(c)).alias(f"s{c}") for c in "rgb"]
    g = boxes.groupBy("image_id", "box").agg(*span, F.count("*").alias("n")).where("n > 1")
    wide = F.greatest("sr", "sg", "sb")
    axis = F.when(F.col("sr") == wide, "r").when(F.col("sg") == wide, "g").otherwise("b")
    pick = g.groupBy("image_id").agg(F.max(F.struct(wide.alias("w"), (-F.col("box")).alias("o"), axis.alias("axis"))).alias("m")).where("m.w > 0").select("image_id", (-F.col("m.o")).alias("cut"), "m.axis")
    b = boxes.join(pick, "image_id", "left")
    along = F.when(F.col("axis") == "r", F.col("r")).when(F.col("axis") == "g", F.col("g")).otherwise(F.col("b"))
    w = Window.partitionBy("image_id", "box")
    ranked = b.withColumn("k", F.row_number().over(w.orderBy(along, "r", "g", "b")) - 1).withColumn("n", F.count("*").over(w))
    upper = (F.col("box") == F.col("cut")) & (F.col("k") >= F.floor(F.col("n") / 2))
    return ranked.select("image_id", F.when(F.coalesce(upper, F.lit(False)), F.lit(number) if isinstance(number, int) else number).otherwise(F.col("box")).cast("int").alias("box"), "r", "g", "b", "weight")


def median_cut(colors: DataFrame, n: int) -> DataFrame:
    """Palettes of up to n boxes of each image: image_id, box and its weighted mean colour. Lineage is cut after each split."""
    from .graph import checkpointed

    boxes = checkpointed(colors.withColumn("box", F.lit(0)))
    for k in range(1, n):
        boxes = checkpointed(split_widest_box(boxes, k))
    mean = lambda c: F.floor(F.sum(F.col(c) * F.col("weight")) / F.sum("weight") + 0.5).cast("int").alias(c)
    return boxes.groupBy("image_id", "box").agg(*[mean(c) for c in "rgb"], F.sum("weight").alias("weight"))
