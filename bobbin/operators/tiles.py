"""Components of pixels by squares: each square's own components in one pass, and a graph of what meets across squares.

An image no larger than a square needs no round of the graph. A square has at most SIDE * SIDE pixels, whatever the image's size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import checkpointed, components

#: Side of a square in pixels.
SIDE = 32


def square_roots(at: pd.Series, eight: bool) -> pd.Series:
    """For squares given by their sorted places (y * SIDE + x) of one label: for each place the first of its component."""
    sizes = at.map(len).to_numpy()
    if not sizes.sum():
        return at
    place = np.concatenate(at.to_numpy()).astype(np.int64)
    key = np.repeat(np.arange(len(at), dtype=np.int64) * SIDE * SIDE, sizes) + place
    y, x = np.divmod(place, SIDE)
    ends = []
    for j, i in [(0, 1), (1, 0), *([(1, -1), (1, 1)] if eight else [])]:
        u = np.flatnonzero((y + j < SIDE) & (x + i >= 0) & (x + i < SIDE))
        v = np.minimum(np.searchsorted(key, key[u] + j * SIDE + i), len(key) - 1)
        met = key[v] == key[u] + j * SIDE + i
        ends.append((u[met], v[met]))
    u, v = (np.concatenate(side) for side in zip(*ends, strict=True))
    root = np.arange(len(key))
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return pd.Series(np.split(place[root].astype(np.int32), np.cumsum(sizes)[:-1]), dtype=object)
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def tiled_components(px: DataFrame, eight: bool = True) -> DataFrame:
    """Pixels with root, the first (y, x) of their equal-label component; 8- or 4-connected. A pixel without a label is one of its own."""
    whole = {c: px.schema[c].dataType for c in ("y", "x")}
    row, col = (F.floor(F.col(c) / SIDE).cast("long") for c in ("y", "x"))
    place = (F.pmod(F.col("y"), F.lit(SIDE)) * SIDE + F.pmod(F.col("x"), F.lit(SIDE))).cast("int")
    alone = F.when(F.col("label").isNull(), place)
    found = F.pandas_udf(lambda at: square_roots(at, eight), T.ArrayType(T.IntegerType()))
    squares = px.groupBy("image_id", row.alias("ty"), col.alias("tx"), "label", alone.alias("alone")).agg(F.array_sort(F.collect_set(place)).alias("at"))
    squares = checkpointed(squares.withColumn("root", found("at")))
    cells = squares.select("image_id", "ty", "tx", "label", F.explode(F.arrays_zip("at", "root")).alias("c"))
    down = lambda k: F.col("ty") * SIDE + F.floor(F.col(f"c.{k}") / SIDE)
    along = lambda k: F.col("tx") * SIDE + F.col(f"c.{k}") % SIDE
    cells = cells.select("image_id", down("at").alias("y"), along("at").alias("x"), "label", down("root").alias("root_y"), along("root").alias("root_x"))
    links = checkpointed(_across(cells.where("label is not null"), eight))
    if not links.isEmpty():
        roots = components(links.select(F.explode(F.array("u", "v")).alias("node")), links)
        roots = roots.select(F.col("node.image_id").alias("image_id"), F.col("node.y").alias("root_y"), F.col("node.x").alias("root_x"), F.col("root.y").alias("__y"), F.col("root.x").alias("__x"))
        met = cells.hint("merge").join(roots, ["image_id", "root_y", "root_x"], "left")
        cells = met.withColumns({f"root_{c}": F.coalesce(f"__{c}", f"root_{c}") for c in "yx"})
    return cells.select("image_id", *[F.col(c).cast(whole[c]).alias(c) for c in "yx"], "label", *[F.col(f"root_{c}").cast(whole[c]).alias(f"root_{c}") for c in "yx"])


def _across(cells: DataFrame, eight: bool) -> DataFrame:
    """u and v: first pixels of square components of one label that are neighbours across the squares' edges."""
    node = F.struct("image_id", F.col("root_y").alias("y"), F.col("root_x").alias("x"))
    near = F.explode(F.array(*[F.lit(k) for k in ((-1, 0, 1) if eight else (0,))]))
    sides = []
    for over, other in (("y", "x"), ("x", "y")):
        at = F.pmod(F.col(over), F.lit(SIDE))
        low = cells.where(at == SIDE - 1).select("image_id", "label", (F.col(over) + 1).alias("p"), F.col(other).alias("q"), near.alias("k"), node.alias("u")).withColumn("q", F.col("q") + F.col("k")).drop("k")
        high = cells.where(at == 0).select("image_id", "label", F.col(over).alias("p"), F.col(other).alias("q"), node.alias("v"))
        sides.append(low.hint("merge").join(high, ["image_id", "label", "p", "q"]).select("u", "v"))
    return sides[0].union(sides[1]).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
