"""Rasters as tables, one row a pixel: image_id, y, x, r, g, b, a, label.

Neighbours come from windows along rows and columns or from shifted copies, so one layout by image serves a whole
step. Components are found by squares of pixels and a graph of what meets across them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import delta_e76, rgb_to_lab
from .tiles import tiled_components

#: Alpha up to which a pixel is background.
CLEAR = 127


def of_image():
    return Window.partitionBy("image_id")


def lab(r: str = "r", g: str = "g", b: str = "b") -> tuple[Column, ...]:
    return rgb_to_lab(F.col(r), F.col(g), F.col(b))


def knockout(px: DataFrame, tol: int = 24) -> DataFrame:
    """Near-white pixels and those near the top left one become transparent."""
    corner = lambda c: F.max(F.when((F.col("y") == 0) & (F.col("x") == 0), F.col(c))).over(of_image())
    marked = px.select("*", *[corner(c).alias(f"__{c}") for c in "rgb"])
    white = reduce(lambda p, q: p & q, [F.col(c) >= 255 - tol for c in "rgb"])
    near = reduce(lambda p, q: p & q, [F.abs(F.col(c) - F.col(f"__{c}")) <= tol for c in "rgb"])
    return marked.withColumn("a", F.when(white | near, 0).otherwise(F.col("a"))).drop("__r", "__g", "__b")


def colour_shares(px: DataFrame, size: int) -> DataFrame:
    """Share of an image's opaque pixels for each palette index below `size`; 0 where unused or nothing is opaque."""
    seen = F.col("a") > CLEAR
    counted = px.groupBy("image_id").agg(F.count_if(seen).alias("n"), *[F.count_if(seen & (F.col("label") == k)).alias(f"n{k}") for k in range(size)])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.col(f"n{k}").alias("m")) for k in range(size)]))
    return counted.select("image_id", "n", each.alias("e")).select("image_id", "e.label", F.when(F.col("n") > 0, F.col("e.m") / F.col("n")).otherwise(0.0).alias("share"))


def alpha_softness(px: DataFrame, low: int = 8, high: int = 247, channel: str = "a") -> DataFrame:
    """Share of pixels with alpha strictly between the bounds."""
    return px.groupBy("image_id").agg(F.avg(((F.col(channel) > low) & (F.col(channel) < high)).cast("int")).alias("softness"))


def with_frame(px: DataFrame) -> DataFrame:
    """Height and width of the image as h, w."""
    return px.select("*", (F.max("y").over(of_image()) + 1).alias("h"), (F.max("x").over(of_image()) + 1).alias("w"))


def on_ring(width: int) -> Column:
    """Whether a pixel with h and w lies within `width` of the border."""
    return (F.col("y") < width) | (F.col("y") >= F.col("h") - width) | (F.col("x") < width) | (F.col("x") >= F.col("w") - width)


def _bin() -> Column:
    """16-level bin of each channel, as one key."""
    return sum((F.floor(F.col(c) / 16) * k for c, k in zip("rgb", (65536, 256, 1), strict=True)), F.lit(0))


def dominant_border_colour(px: DataFrame, width: int = 2) -> DataFrame:
    """The border ring's most frequent bin, lowest key on ties, and the mean colour of its pixels."""
    binned = with_frame(px).where(on_ring(width)).groupBy("image_id", _bin().alias("key")).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "rgb"])
    return binned.groupBy("image_id").agg(F.max(F.struct("n", (-F.col("key")).alias("k"), "r", "g", "b")).alias("m")).select("image_id", (-F.col("m.k")).alias("key"), "m.n", *[F.col(f"m.{c}").alias(f"border_{c}") for c in "rgb"])


def border_agreement(px: DataFrame, tol: float, width: int = 2, corner: int = 8) -> DataFrame:
    """How far the modal border colour holds: its share of the ring, the largest other bin's share, corners it owns."""
    modal = dominant_border_colour(px, width).drop("n", "key")
    near = with_frame(px).join(modal, "image_id").withColumn("close", delta_e76(lab(), lab("border_r", "border_g", "border_b")) <= tol)
    k = F.least(F.lit(corner), F.col("h"), F.col("w"))
    left, right, top, low = F.col("x") < k, F.col("x") >= F.col("w") - k, F.col("y") < k, F.col("y") >= F.col("h") - k
    patches = [top & left, top & right, low & left, low & right]
    held = lambda p: F.coalesce((F.avg(F.when(p, F.col("close").cast("int"))) > 0.5).cast("int"), F.lit(0))
    ring = on_ring(width)
    whole = near.groupBy("image_id").agg(F.avg(F.when(ring, F.col("close").cast("int"))).alias("agreement"), F.count_if(ring).alias("n"), sum((held(p) for p in patches), F.lit(0)).alias("corners"))
    rest = near.where(ring & ~F.col("close")).groupBy("image_id", _bin().alias("key")).agg(F.count("*").alias("m")).groupBy("image_id").agg(F.max("m").alias("m"))
    return whole.join(rest, "image_id", "left").select("image_id", "agreement", (F.coalesce("m", F.lit(0)) / F.col("n")).alias("rival"), "corners")


def boundary_contrast(px: DataFrame) -> DataFrame:
    """Per pair of labels: sum and number of Lab distances over 4-neighbour pixels on either side; clear pixels are left out."""
    L, A, B = lab()
    seen = px.where(F.col("a") > CLEAR).select("image_id", "y", "x", "label", F.struct(L.alias("L"), A.alias("A"), B.alias("B")).alias("c"))
    right, down = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    nxt = lambda w, at: F.when(F.lead(at).over(w) == F.col(at) + 1, F.struct(F.lead("label").over(w).alias("label"), F.lead("c").over(w).alias("c")))
    both = seen.select("image_id", "label", "c", F.array(nxt(right, "x"), nxt(down, "y")).alias("next"))
    pairs = both.select("image_id", "label", "c", F.explode("next").alias("o")).where("o.label <> label")
    d = delta_e76(tuple(F.col(f"c.{v}") for v in "LAB"), tuple(F.col(f"o.c.{v}") for v in "LAB"))
    return pairs.groupBy("image_id", F.least("label", "o.label").alias("a_label"), F.greatest("label", "o.label").alias("b_label")).agg(F.sum(d).alias("bsum"), F.count("*").alias("blen"))


def disc(radius: int) -> list[tuple[int, int]]:
    reach = range(-radius, radius + 1)
    return [(j, i) for j in reach for i in reach if i * i + j * j <= radius * radius]


def shifted(cells: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """A copy of each row at every offset."""
    moves = F.explode(F.array(*[F.struct(F.lit(j).alias("dy"), F.lit(i).alias("dx")) for j, i in offsets]))
    return cells.withColumn("__m", moves).withColumns({"y": F.col("y") + F.col("__m.dy"), "x": F.col("x") + F.col("__m.dx")}).drop("__m")


def dilate(cells: DataFrame, radius: int) -> DataFrame:
    """Cells within the disc of a cell of the set (image_id, y, x)."""
    return shifted(cells.select("image_id", "y", "x"), disc(radius)).distinct()


def erode(cells: DataFrame, radius: int) -> DataFrame:
    """Cells whose whole disc lies in the set."""
    d = disc(radius)
    return shifted(cells.select("image_id", "y", "x").distinct(), d).groupBy("image_id", "y", "x").count().where(F.col("count") == len(d)).drop("count")


def close_cells(cells: DataFrame, radius: int) -> DataFrame:
    return erode(dilate(cells, radius), radius)


def open_cells(cells: DataFrame, radius: int) -> DataFrame:
    return dilate(erode(cells, radius), radius)


def solid_cells(cells: DataFrame, size: int = 2) -> DataFrame:
    """Squares of `size` of which at least half is in the set."""
    return cells.groupBy("image_id", F.floor(F.col("y") / size).alias("cy"), F.floor(F.col("x") / size).alias("cx")).agg((F.count("*") / (size * size)).alias("covered")).where("covered >= 0.5")


def votes(px: DataFrame) -> DataFrame:
    """Per opaque pixel the labels of its 3x3 window: y, x, label, most (highest count), ties (labels that have it), mode (lowest such)."""
    seen = px.where(F.col("a") > CLEAR).select("image_id", "y", "x", "label")
    around = shifted(seen.select("image_id", "y", "x", F.col("label").alias("v")), [(j, i) for j in (-1, 0, 1) for i in (-1, 0, 1)])
    counts = around.hint("merge").join(seen.select("image_id", "y", "x", F.col("label").alias("centre")), ["image_id", "y", "x"]).groupBy("image_id", "y", "x", "centre", "v").agg(F.count("*").alias("n"))
    top = counts.groupBy("image_id", "y", "x", "centre").agg(F.max("n").alias("most"), F.collect_list(F.struct("n", "v")).alias("all"))
    best = F.filter("all", lambda e: e["n"] == F.col("most"))
    return top.select("image_id", "y", "x", F.col("centre").alias("label"), "most", F.size(best).alias("ties"), F.array_min(F.transform(best, lambda e: e["v"])).alias("mode"))


def mode_filter(px: DataFrame) -> DataFrame:
    """Each opaque pixel's label becomes its window's majority; a tie keeps the centre."""
    return votes(px).select("image_id", "y", "x", F.when(F.col("ties") > 1, F.col("label")).otherwise(F.col("mode")).alias("label"))


def unique_colour_mass(px: DataFrame) -> DataFrame:
    """Share of opaque pixels whose label isn't their window's mode (lowest label on ties)."""
    return votes(px).groupBy("image_id").agg(F.avg((F.col("mode") != F.col("label")).cast("int")).alias("mass"))


def pixel_components(px: DataFrame, eight: bool = True) -> DataFrame:
    """Pixels with root, the first (y, x) of their equal-label component; 8- or 4-connected."""
    return tiled_components(px, eight)


def component_sizes(px: DataFrame, eight: bool = True) -> DataFrame:
    return pixel_components(px, eight).groupBy("image_id", "label", "root_y", "root_x").agg(F.count("*").alias("pixels"))


def despeckle(px: DataFrame, least: int, eight: bool = True) -> DataFrame:
    """Pixels of components of at least `least` pixels."""
    size = F.count("*").over(Window.partitionBy("image_id", "root_y", "root_x"))
    return pixel_components(px, eight).withColumn("__n", size).where(F.col("__n") >= least).drop("__n")


def border_connected(mask: DataFrame, frame: DataFrame, eight: bool = True) -> DataFrame:
    """Pixels of a mask with `outside`: their component touches the border of the image, whose h and w `frame` has."""
    parts = pixel_components(mask, eight).join(frame, "image_id")
    touch = F.max(on_ring(1)).over(Window.partitionBy("image_id", "root_y", "root_x"))
    return parts.withColumn("outside", touch).drop("h", "w")


def palette_of(px: DataFrame) -> DataFrame:
    """Rounded mean colour and pixels of each label that is in use."""
    return px.where(F.col("a") > CLEAR).groupBy("image_id", "label").agg(F.count("*").alias("pixels"), *[F.floor(F.avg(c) + 0.5).alias(c) for c in "rgb"])


def merge_palette(palette: DataFrame, merged: list[int]) -> DataFrame:
    """Listed entries become the lowest of them with their pixel-weighted mean; labels are numbered anew."""
    target = F.when(F.col("label").isin(merged), F.lit(min(merged))).otherwise(F.col("label"))
    n = F.sum("pixels")
    mean = lambda c: F.floor(F.when(n > 0, F.sum(F.col(c) * F.col("pixels")) / n).otherwise(F.avg(c)) + 0.5).alias(c)
    made = palette.groupBy("image_id", target.alias("__t")).agg(n.alias("pixels"), *[mean(c) for c in "rgb"])
    return made.withColumn("label", F.row_number().over(of_image().orderBy("__t")) - 1).drop("__t")


def cap_colours(palette: DataFrame, most: int) -> DataFrame:
    """The `most` largest labels stay; each other goes to the nearest of them in RGB, lowest label on ties."""
    ranked = palette.withColumn("__n", F.row_number().over(of_image().orderBy(F.col("pixels").desc(), "label")))
    kept = ranked.where(F.col("__n") <= most).select("image_id", F.struct("label", "r", "g", "b").alias("k"))
    d2 = sum(((F.col(c) - F.col(f"k.{c}")) * (F.col(c) - F.col(f"k.{c}")) for c in "rgb"), F.lit(0))
    near = ranked.join(kept, "image_id").groupBy("image_id", "label", "pixels", "__n").agg(F.min(F.struct(d2.alias("d2"), F.col("k.label").alias("to"))).alias("m"))
    return near.select("image_id", "label", "pixels", F.when(F.col("__n") <= most, F.col("label")).otherwise(F.col("m.to")).alias("to_label"))


def cap_warnings(palette: DataFrame, most: int) -> DataFrame:
    """Images with more colours than spools: colours, how many stay, and the share of pixels whose colour changes."""
    ranked = palette.withColumn("__n", F.row_number().over(of_image().orderBy(F.col("pixels").desc(), "label")))
    g = ranked.groupBy("image_id").agg(F.count("*").alias("colours"), (F.sum(F.when(F.col("__n") > most, F.col("pixels")).otherwise(0)) / F.sum("pixels")).alias("changed"))
    return g.where(F.col("colours") > most).select("image_id", "colours", F.lit(most).cast("long").alias("kept"), "changed")


#: Thresholds and margins of the four-way decision.
PHOTO, PHOTO_MARGIN = 0.28, 0.08
GRADIENT, GRADIENT_MARGIN = 0.0015, 0.0008
SUBJECT, SUBJECT_MARGIN = 8.0, 3.0
FLOOR = 0.55
CLASSES = ("flat", "gradient", "photo_subject", "photo_scene")


def decide(signals: DataFrame, photo: Column | float = PHOTO) -> DataFrame:
    """Class and confidence from ucm (unique colour mass) and grad (smoothness); a doubtful class other than flat becomes flat."""
    photo = photo if isinstance(photo, Column) else F.lit(photo)
    sure = lambda v, t, m: F.least(F.lit(1.0), F.abs(v - t) * 0.5 / m + 0.5)
    is_photo = F.col("ucm") >= photo
    second = F.when(is_photo, sure(F.col("grad"), SUBJECT, SUBJECT_MARGIN)).otherwise(sure(F.col("grad"), GRADIENT, GRADIENT_MARGIN))
    raw = F.when(is_photo, F.when(F.col("grad") >= SUBJECT, "photo_subject").otherwise("photo_scene")).otherwise(F.when(F.col("grad") >= GRADIENT, "gradient").otherwise("flat"))
    first = signals.withColumns({"__raw": raw, "confidence": F.least(sure(F.col("ucm"), photo, PHOTO_MARGIN), second)})
    doubtful = (F.col("__raw") != "flat") & (F.col("confidence") < FLOOR)
    return first.withColumns({"class": F.when(doubtful, "flat").otherwise(F.col("__raw")), "uncertain": doubtful}).drop("__raw")


def sweep_ranges(signals: DataFrame, multipliers: list[float]) -> DataFrame:
    """Stretches of multipliers of the photo threshold, in order, that turn an image to one and the same other class."""
    base = decide(signals).select("*", F.col("class").alias("base")).drop("class", "confidence", "uncertain")
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("m")) for i, m in enumerate(multipliers)]))
    swept = decide(base.withColumn("__s", steps), F.col("__s.m") * PHOTO).select("image_id", "base", "class", "__s.i", "__s.m")
    w, by_class = of_image().orderBy("i"), Window.partitionBy("image_id", "class").orderBy("i")
    runs = swept.withColumn("__g", F.row_number().over(w) - F.row_number().over(by_class)).where("class <> base")
    return runs.groupBy("image_id", "base", "class", "__g").agg(F.min("m").alias("from_m"), F.max("m").alias("to_m"), F.count("*").alias("steps")).drop("__g")
