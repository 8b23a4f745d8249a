"""Graphs of regions: merging neighbours of like colour, and absorbing regions too small to sew.

Merging contracts a graph of regions round by round, absorption takes it by squares. Nodes and edges carry what a merged region
needs (sums of colours, sizes, lengths of shared boundaries), so no round reads a pixel. Keys are (image_id, id), so the regions of one large image stay spread over tasks.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Iterable
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import rounded, with_delta_e2000
from .graph import checkpointed
from .pixels import CLEAR, lab
from .tiles import SIDE

#: The colour difference up to which neighbours merge, and what is left of it beside a face, between regions of very
#: different size, and across a hard boundary; the ratio, Lab step, shares and sizes from which these hold.
MERGE, FACE_FACTOR, RATIO_FACTOR, HARD_FACTOR = 26.0, 5.0 / 26.0, 0.6, 13.0 / 26.0
RATIO, HARD_LAB, LEAST_PX, LEAST_SHARE = 18.0, 6.0, 1000, 0.09


def region_graph(px: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (image_id, id, l, a, b: sums of Lab, n pixels) and edges (image_id, u < v, bsum, blen: sum and number of Lab steps across
    4-neighbour pixels on either side) of opaque pixels with a region id."""
    L, A, B = lab()
    seen = px.where(F.col("a") > CLEAR).select("image_id", "y", "x", "id", F.struct(L.alias("l"), A.alias("a"), B.alias("b")).alias("c"))
    nodes = seen.groupBy("image_id", "id").agg(*[F.sum(f"c.{k}").alias(k) for k in "lab"], F.count("*").alias("n"))
    right, down = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    nxt = lambda w, at: F.when(F.lead(at).over(w) == F.col(at) + 1, F.struct(F.lead("id").over(w).alias("id"), F.lead("c").over(w).alias("c")))
    both = seen.select("image_id", "id", "c", F.array(nxt(right, "x"), nxt(down, "y")).alias("next"))
    pairs = both.select("image_id", "id", "c", F.explode("next").alias("o")).where("o.id <> id")
    step = F.sqrt(sum(((F.col(f"c.{k}") - F.col(f"o.c.{k}")) ** 2 for k in "lab"), F.lit(0.0)))
    return nodes, pairs.groupBy("image_id", F.least("id", "o.id").alias("u"), F.greatest("id", "o.id").alias("v")).agg(F.sum(step).alias("bsum"), F.count("*").alias("blen"))


def edge_weights(nodes: DataFrame, edges: DataFrame, least_px: int = LEAST_PX) -> DataFrame:
    """Edges with weight: CIEDE2000 of the regions' mean colours, raised where the merge needs more likeness.

    `nodes` may have face (whether a region touches one) and fg (its pixels that count as foreground; n where missing)."""
    n = nodes.withColumns({"fg": F.col("fg") if "fg" in nodes.columns else F.col("n"), "face": F.col("face") if "face" in nodes.columns else F.lit(False)})
    mean = F.struct(*[(F.col(k) / F.col("n")).alias(k) for k in "lab"], "fg", "face")
    of = lambda end: n.select("image_id", F.col("id").alias(end), mean.alias(f"of_{end}"))
    total = n.groupBy("image_id").agg(F.sum("fg").alias("total"))
    e = edges.hint("merge").join(of("u"), ["image_id", "u"]).hint("merge").join(of("v"), ["image_id", "v"]).join(total, "image_id")
    small, big = F.least("of_u.fg", "of_v.fg"), F.greatest("of_u.fg", "of_v.fg")
    hard = (F.col("blen") > 0) & (F.col("bsum") / F.col("blen") >= HARD_LAB) & (small >= least_px) & (small >= F.col("total") * LEAST_SHARE)
    uneven = (small > 0) & (small >= least_px) & (big / small >= RATIO)
    factor = F.when(F.col("of_u.face") | F.col("of_v.face"), FACE_FACTOR).otherwise(1.0) * F.when(uneven, RATIO_FACTOR).otherwise(1.0) * F.when(hard, HARD_FACTOR).otherwise(1.0)
    e = with_delta_e2000(e, *(tuple(F.col(f"of_{end}.{k}") for k in "lab") for end in "uv"), "away")
    e = e.withColumn("weight", F.col("away") / factor)
    return e.select("image_id", "u", "v", "bsum", "blen", rounded("weight", 6).alias("weight"))


def mutual_best(weighted: DataFrame, limit: float) -> DataFrame:
    """Edges under the limit that are the least (by weight, then ends) of both their regions: image_id, u, v. No region is in two."""
    under = weighted.where(F.col("weight") < limit)
    rank = F.struct("weight", "u", "v")
    both = under.select("image_id", F.explode(F.array("u", "v")).alias("id"), rank.alias("rank"))
    best = both.groupBy("image_id", "id").agg(F.min("rank").alias("rank"))
    return best.groupBy("image_id", F.col("rank.u").alias("u"), F.col("rank.v").alias("v")).agg(F.count("*").alias("n")).where("n = 2").drop("n")


def contract(nodes: DataFrame, edges: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after `merges` (image_id, id, to): sums are added, a face stays one, edges inside a region go."""
    sums = [c for c in nodes.columns if c not in ("image_id", "id", "face")]
    moved = nodes.hint("merge").join(merges, ["image_id", "id"], "left").withColumn("id", F.coalesce("to", "id")).drop("to")
    face = [F.max("face").alias("face")] if "face" in nodes.columns else []
    made = moved.groupBy("image_id", "id").agg(*[F.sum(c).alias(c) for c in sums], *face)
    e = edges
    for end in "uv":
        e = e.hint("merge").join(merges.select("image_id", F.col("id").alias(end), "to"), ["image_id", end], "left").withColumn(end, F.coalesce("to", end)).drop("to")
    low, high = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    e = e.where("u <> v").groupBy("image_id", low, high).agg(*[F.sum(c).alias(c) for c in edges.columns if c not in ("image_id", "u", "v")])
    return made, e


def merge_round(nodes: DataFrame, edges: DataFrame, limit: float = MERGE, least_px: int = LEAST_PX) -> DataFrame:
    """The merges of one round: image_id, id, to. The region of the greater id joins the other."""
    weighted = checkpointed(edge_weights(nodes, edges, least_px))
    return mutual_best(weighted, limit).select("image_id", F.col("v").alias("id"), F.col("u").alias("to"))


def merge_regions(nodes: DataFrame, edges: DataFrame, limit: float = MERGE, least_px: int = LEAST_PX) -> tuple[DataFrame, DataFrame]:
    """The regions left when no edge is under the limit, and image_id, id, root of every region given.

    Every round merges all edges that are the best of both ends, so a round at least halves the regions of a patch of
    like colour. Strictly one merge at a time may end otherwise: a merged mean moves its other edges before they are judged."""
    nodes, edges = checkpointed(nodes), checkpointed(edges)
    roots = nodes.select("image_id", "id", F.col("id").alias("root"))
    while True:
        merges = checkpointed(merge_round(nodes, edges, limit, least_px))
        if merges.isEmpty():
            return nodes, roots
        nodes, edges = map(checkpointed, contract(nodes, edges, merges))
        roots = checkpointed(roots.hint("merge").join(merges.withColumnRenamed("id", "root"), ["image_id", "root"], "left").select("image_id", "id", F.coalesce("to", "root").alias("root")))


def component_graph(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (image_id, id: the component's first pixel as a struct, label, n) and edges (image_id, u < v, sides: pixels of the two that are
    4-neighbours) of components (image_id, y, x, label, root_y, root_x)."""
    px = parts.select("image_id", "y", "x", "label", F.struct("root_y", "root_x").alias("id"))
    nodes = px.groupBy("image_id", "id").agg(F.first("label").alias("label"), F.count("*").alias("n"))
    right, down = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    nxt = lambda w, at: F.when(F.lead(at).over(w) == F.col(at) + 1, F.lead("id").over(w))
    both = px.select("image_id", "id", F.array(nxt(right, "x"), nxt(down, "y")).alias("next"))
    pairs = both.select("image_id", "id", F.explode("next").alias("o")).where("o is not null and o <> id")
    return nodes, pairs.groupBy("image_id", F.least("id", "o").alias("u"), F.greatest("id", "o").alias("v")).agg(F.count("*").alias("sides"))


def absorb_round(nodes: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """Which small components take which label now: image_id, id, to_label.

    A component under `least` pixels goes when no neighbour that is small too comes before it (fewer pixels, then the earlier first
    pixel). It takes the label of most pixels beside it, the lowest on ties; one without neighbours stays."""
    at = nodes.select("image_id", "id", "label", "n")
    other = at.select("image_id", F.col("id").alias("other"), F.col("label").alias("o_label"), F.col("n").alias("o_n"))
    ends = F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("other")), F.struct(F.col("v").alias("id"), F.col("u").alias("other"))))
    sides = edges.select("image_id", ends.alias("e"), "sides").select("image_id", "e.id", "e.other", "sides")
    met = sides.hint("merge").join(at.where(F.col("n") < least), ["image_id", "id"]).hint("merge").join(other, ["image_id", "other"])
    before = (F.col("o_n") < least) & (F.struct(F.col("o_n").alias("n"), F.col("other").alias("id")) < F.struct("n", "id"))
    by_label = met.groupBy("image_id", "id", "o_label").agg(F.sum("sides").alias("sides"), F.max(before).alias("waits"))
    best = by_label.groupBy("image_id", "id").agg(F.max(F.struct("sides", (-F.col("o_label")).alias("k"))).alias("m"), F.max("waits").alias("waits"))
    return best.where("not waits").select("image_id", "id", (-F.col("m.k")).alias("to_label"))


#: What a row of a square is: a small component, a link to one of the same square, a link to one of another, and sides to large components of a label.
NODE, NEAR, FAR, VOTE = range(4)
#: Stands for a missing label.
NO_LABEL = -(1 << 62)


def absorb_square(rows: Iterable[tuple[int, int, int, int]], least: int) -> list[tuple[int, int, int, int, bool]]:
    """What becomes of a square's small components: place, place of the one it is part of then, label, pixels, and whether that is large.

    Rows are (NODE, place, label, pixels), (NEAR, place, other place, sides), (FAR, place, 0, 0) and (VOTE, place, label, sides).
    Components with a neighbour in another square stay, and so do those that wait for them."""
    label, n, beside, votes, far, joined, large = {}, {}, defaultdict(dict), defaultdict(Counter), set(), {}, set()
    for kind, p, a, b in rows:
        if kind == NODE:
            label[p], n[p], joined[p] = a, b, p
        elif kind == NEAR:
            beside[p][a] = b
        elif kind == VOTE:
            votes[p][a] += b
        else:
            far.add(p)
    todo = [(size, p) for p, size in n.items()]
    heapify(todo)
    while todo:
        size, p = heappop(todo)
        if p in far or n.get(p) != size or any((n[q], q) < (size, p) for q in beside[p]):
            continue
        said = Counter(votes[p])
        for q, sides in beside[p].items():
            said[label[q]] += sides
        to = max(said, key=lambda k: (said[k], k != NO_LABEL, -k), default=NO_LABEL)
        if to == NO_LABEL:
            continue
        one = {p, *(q for q in beside[p] if label[q] == to)}
        first, whole = min(one), sum(n[q] for q in one)
        around, heard = Counter(), Counter()
        for q in one:
            around.update({o: k for o, k in beside.pop(q, {}).items() if o not in one})
            heard.update(votes.pop(q, {}))
            joined[q] = first
            del n[q]
        label[first] = to
        for o in around:
            for q in one:
                beside[o].pop(q, None)
        # next to large ground of its label it is part of that
        if whole >= least or to in heard:
            large.add(first)
            for o, sides in around.items():
                votes[o][to] += sides
        else:
            n[first], beside[first], votes[first] = whole, dict(around), heard
            if far & one:
                far.add(first)
            for o, sides in around.items():
                beside[o][first] = sides
            heappush(todo, (whole, first))
        # who waited for one of these may go now
        for o in around:
            heappush(todo, (n[o], o))
    size = dict.fromkeys(large, least) | n
    out = []
    for p in joined:
        r = p
        while joined[r] != r:
            r = joined[r]
        out.append((p, r, label[r], size[r], r in large))
    return out


def absorb_squares(small: DataFrame, beside: DataFrame, least: int, down: int, along: int) -> DataFrame:
    """absorb_square() for all squares of the small components' first pixels, moved by (down, along): image_id, id, root, label, n, large."""
    side = max(SIDE, 8 * least)
    y, x = (lambda c: F.col(f"{c}.root_y") + down), (lambda c: F.col(f"{c}.root_x") + along)
    home = lambda c: [F.floor(y(c) / side).cast("long"), F.floor(x(c) / side).cast("long")]
    place = lambda c: (F.pmod(y(c), F.lit(side)) * side + F.pmod(x(c), F.lit(side))).cast("long")
    row = lambda kind, a, b: F.struct(F.lit(kind).cast("long").alias("kind"), place("id").alias("p"), F.coalesce(F.col(a) if isinstance(a, str) else a, F.lit(NO_LABEL)).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    same = (home("id")[0] == home("other")[0]) & (home("id")[1] == home("other")[1])
    link = F.when(F.col("other").isNull(), row(VOTE, "label", "sides")).when(same, row(NEAR, place("other"), "sides")).otherwise(row(FAR, F.lit(0), "sides"))
    at = [h.alias(k) for h, k in zip(home("id"), ("ty", "tx"), strict=True)]
    rows = small.select("image_id", *at, row(NODE, "label", "n").alias("r")).union(beside.select("image_id", *at, link.alias("r")))
    squares = rows.groupBy("image_id", "ty", "tx").agg(F.collect_list("r").alias("r"))
    squares = squares.select("image_id", "ty", "tx", "r.kind", "r.p", "r.a", "r.b")
    names = ("at", "root", "label", "n", "large")

    @F.pandas_udf(T.StructType([T.StructField(c, T.ArrayType(T.LongType())) for c in names]))
    def absorbed(kind: pd.Series, p: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        done = [absorb_square(zip(*(v.tolist() for v in r), strict=True), least) for r in zip(kind, p, a, b, strict=True)]
        return pd.DataFrame({c: [[int(e[k]) for e in d] for d in done] for k, c in enumerate(names)}, columns=list(names))

    e = squares.withColumn("d", absorbed("kind", "p", "a", "b")).select("image_id", "ty", "tx", F.explode(F.arrays_zip(*[F.col(f"d.{c}").alias(c) for c in names])).alias("e"))
    kinds = {f.name: f.dataType for f in small.schema["id"].dataType.fields}
    first = lambda c: F.struct((F.col("ty") * side + F.floor(F.col(c) / side) - down).cast(kinds["root_y"]).alias("root_y"), (F.col("tx") * side + F.col(c) % side - along).cast(kinds["root_x"]).alias("root_x"))
    label = F.when(F.col("e.label") != NO_LABEL, F.col("e.label")).cast(small.schema["label"].dataType)
    return e.select("image_id", first("e.at").alias("id"), first("e.root").alias("root"), label.alias("label"), F.col("e.n").alias("n"), (F.col("e.large") == 1).alias("large"))


def absorb_small(nodes: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """image_id, id, label of every component given, after small ones have joined what surrounds them most.

    The result is that of taking the smallest one again and again: which label a component takes depends on its neighbours alone, and it
    goes before any of them here as there; neighbours never go at one time. Large components keep their label, so small ones are all that
    is followed. They meet by squares (of SIDE pixels, or eight times `least`); what waits across an edge goes when the squares
    have moved by half a side, where every small component has its neighbours with it in one of four ways. Images no larger than a
    square are done in one pass."""
    nodes, edges = checkpointed(nodes), checkpointed(edges)
    at = nodes.select("image_id", "id", "label", (F.col("n") < least).alias("small"))
    other = at.select("image_id", F.col("id").alias("other"), "label", "small")
    ends = F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("other")), F.struct(F.col("v").alias("id"), F.col("u").alias("other"))))
    met = edges.select("image_id", ends.alias("e"), "sides").select("image_id", "e.id", "e.other", "sides")
    met = met.hint("merge").join(at.where("small").select("image_id", "id"), ["image_id", "id"]).hint("merge").join(other, ["image_id", "other"])
    link = lambda small: [F.when(small, F.col("other")).alias("other"), F.when(~small, F.col("label")).alias("label")]
    added = lambda d: d.groupBy("image_id", "id", "other", "label").agg(F.sum("sides").alias("sides"))
    beside = checkpointed(added(met.select("image_id", "id", *link(F.col("small")), "sides")))
    small = nodes.where(F.col("n") < least).select("image_id", "id", "label", "n")
    fate = small.select("image_id", "id", F.col("id").alias("root"), "label")
    half, idle = max(SIDE, 8 * least) // 2, 0
    for turn in itertools.count():
        moved = absorb_squares(small, beside, least, turn // 2 % 2 * half, turn % 2 * half)
        done = checkpointed(moved)
        news = done.select("image_id", F.col("id").alias("root"), F.col("root").alias("to"), F.col("label").alias("now"))
        # the last look at what has its place already finds nothing and leaves it
        fate = checkpointed(fate.hint("merge").join(news, ["image_id", "root"], "left").select("image_id", "id", F.coalesce("to", "root").alias("root"), F.when(F.col("to").isNull(), F.col("label")).otherwise(F.col("now")).alias("label")))
        idle = 0 if not done.where("large or id <> root").isEmpty() else idle + 1
        if idle == 4 or not turn and beside.where(F.col("other").isNotNull() & ~_one_square(max(SIDE, 8 * least))).isEmpty():
            break
        here, there = done.select("image_id", "id", F.struct("root", "label", "large").alias("p")), done.select("image_id", F.col("id").alias("other"), F.struct("root", "label", "large").alias("q"))
        links = beside.hint("merge").join(here.where("not p.large"), ["image_id", "id"]).hint("merge").join(there, ["image_id", "other"], "left")
        links = links.select("image_id", F.col("p.root").alias("id"), F.when(~F.coalesce(F.col("q.large"), F.lit(True)), F.col("q.root")).alias("other"), F.when(F.col("q.large"), F.col("q.label")).otherwise(F.col("label")).alias("label"), "sides")
        beside = checkpointed(added(links.where("other is null or id <> other")))
        small = done.where("not large").select("image_id", F.col("root").alias("id"), "label", "n").distinct()
    return nodes.where(F.col("n") >= least).select("image_id", "id", "label").unionByName(fate.select("image_id", "id", "label"))


def _one_square(side: int) -> Column:
    """Whether a small component and its neighbour begin in one square."""
    return (F.floor(F.col("id.root_y") / side) == F.floor(F.col("other.root_y") / side)) & (F.floor(F.col("id.root_x") / side) == F.floor(F.col("other.root_x") / side))


def absorb_small_regions(px: DataFrame, least: int, eight: bool = False) -> DataFrame:
    """Opaque pixels (image_id, y, x, label) after components of less than `least` pixels have been absorbed. What is clear has no say."""
    from .pixels import pixel_components

    parts = checkpointed(pixel_components(px.where(F.col("a") > CLEAR), eight))
    done = absorb_small(*component_graph(parts), least)
    at = done.select("image_id", F.col("id.root_y").alias("root_y"), F.col("id.root_x").alias("root_x"), "label")
    return parts.drop("label").hint("merge").join(at, ["image_id", "root_y", "root_x"]).select("image_id", "y", "x", "label")


def tiles(px: DataFrame, side: int) -> DataFrame:
    """Pixels with id: the square of `side` that they lie in, counted along rows."""
    wide = F.floor(F.max("x").over(Window.partitionBy("image_id")) / side) + 1
    ident: Column = F.floor(F.col("y") / side) * wide + F.floor(F.col("x") / side)
    return px.withColumn("id", ident)
