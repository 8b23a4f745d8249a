"""Stitch streams as tables: blocks, runs, segments, marks. All windows share one (design_id, seq) layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import distance, kth

#: Points that gather before they are put away.
CHUNK = 256
#: Units (0.1 mm) that end a run when stitched over.
HOP_U = 75


def design():
    """A design's records in order. Windows are made on use: they need a session."""
    return Window.partitionBy("design_id").orderBy("seq")


def so_far():
    return design().rowsBetween(Window.unboundedPreceding, 0)


def blocks(df: DataFrame) -> DataFrame:
    """Block number: colour changes so far."""
    return df.withColumn("block", F.sum((F.col("cmd") == "color").cast("int")).over(so_far()))


def islands(df: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """Maximal stretches of equal `flag`: keys, flag, first, last and length."""
    w = Window.partitionBy(*keys).orderBy(order)
    wf = Window.partitionBy(*keys, flag).orderBy(order)
    return df.withColumn("__i", F.row_number().over(w) - F.row_number().over(wf)).groupBy(*keys, flag, "__i").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("__i")


def runs(df: DataFrame, hop_u: int = HOP_U) -> DataFrame:
    """Needle-down stitches with run number: any other command, or a hop, ends a run."""
    prev = lambda c: F.lag(c).over(design())
    opens = prev("cmd").isNull() | (prev("cmd") != "stitch") | (distance(F.col("x_u") - prev("x_u"), F.col("y_u") - prev("y_u")) >= hop_u)
    marked = blocks(df).withColumn("__open", opens & (F.col("cmd") == "stitch"))
    return marked.withColumn("run", F.sum(F.col("__open").cast("int")).over(so_far()) - 1).where("cmd = 'stitch'").drop("__open", "cmd")


def break_kinds(df: DataFrame, hop_u: int = HOP_U) -> DataFrame:
    """What opened each run: color before trim before start before jump before hop."""
    marked = df.withColumn("__n", F.sum((F.col("cmd") == "stitch").cast("int")).over(design().rowsBetween(Window.unboundedPreceding, -1)))
    between = marked.where("cmd <> 'stitch'").groupBy("design_id", F.coalesce("__n", F.lit(0)).alias("__n")).agg(F.max(F.when(F.col("cmd") == "color", 3).when(F.col("cmd") == "trim", 2).otherwise(1)).alias("__k"))
    first = runs(df, hop_u).withColumn("__n", F.row_number().over(design()) - 1).groupBy("design_id", "run").agg(F.min("__n").alias("__n"))
    kind = F.when(F.col("__k") == 3, "color").when(F.col("__k") == 2, "trim").when(F.col("__n") == 0, "start").when(F.col("__k") == 1, "jump").otherwise("hop")
    return first.hint("merge").join(between, ["design_id", "__n"], "left").select("design_id", "run", kind.alias("break_kind"))


def segments(df: DataFrame, hop_u: int = HOP_U) -> DataFrame:
    """Steps inside a run: both ends, length, block, run and the step's own seq."""
    w = Window.partitionBy("design_id", "run").orderBy("seq")
    r = runs(df, hop_u).withColumn("x0", F.lag("x_u").over(w)).withColumn("y0", F.lag("y_u").over(w))
    return r.where("x0 is not null").select("design_id", "block", "run", "seq", "x0", "y0", F.col("x_u").alias("x1"), F.col("y_u").alias("y1"), distance(F.col("x_u") - F.col("x0"), F.col("y_u") - F.col("y0")).alias("len"))


def reversals(df: DataFrame, below: float = -0.2, hop_u: int = HOP_U) -> DataFrame:
    """Segments with the cosine to the one before in their run, and whether it turns back."""
    w = Window.partitionBy("design_id", "run").orderBy("seq")
    s = segments(df, hop_u).withColumn("dx", F.col("x1") - F.col("x0")).withColumn("dy", F.col("y1") - F.col("y0"))
    dot = F.col("dx") * F.lag("dx").over(w) + F.col("dy") * F.lag("dy").over(w)
    size = F.col("len") * F.lag("len").over(w)
    cos = F.when(size > 0, dot / size)
    return s.withColumn("cos", cos).withColumn("reversal", F.coalesce(F.col("cos") < below, F.lit(False)))


def classify_runs(df: DataFrame, lock_n: int = 5, lock_u: float = 10, satin_share: float = 0.6, run_share: float = 0.2, run_u: float = 40, hop_u: int = HOP_U) -> DataFrame:
    """lock, satin, run, fill or other from a run's steps, median length and share of reversals."""
    g = reversals(df, hop_u=hop_u).groupBy("design_id", "block", "run").agg(F.count("*").alias("n"), kth(F.collect_list("len"), 0.5).alias("median_len"), F.avg(F.col("reversal").cast("int")).alias("reversal_share"))
    kind = F.when((F.col("n") <= lock_n) & (F.col("median_len") <= lock_u), "lock").when(F.col("reversal_share") >= satin_share, "satin").when((F.col("reversal_share") <= run_share) & (F.col("median_len") <= run_u), "run").when(F.col("n") > lock_n, "fill").otherwise("other")
    return g.withColumn("kind", kind)


def infer_trims(df: DataFrame, long_u: float = 30, short_u: float = 25) -> DataFrame:
    """Segments with `inferred_trim`: a long move between two short ones."""
    w = Window.partitionBy("design_id", "block").orderBy("seq")
    s = segments(df, 1 << 30)
    hit = (F.col("len") >= long_u) & (F.lag("len").over(w) < short_u) & (F.lead("len").over(w) < short_u)
    return s.withColumn("inferred_trim", F.coalesce(hit, F.lit(False)))


def drop_equal_neighbours(df: DataFrame) -> DataFrame:
    """Stitches of runs without those that repeat their predecessor's place."""
    w = Window.partitionBy("design_id", "run").orderBy("seq")
    same = (F.lag("x_u").over(w) == F.col("x_u")) & (F.lag("y_u").over(w) == F.col("y_u"))
    return runs(df).withColumn("__same", F.coalesce(same, F.lit(False))).where("not __same").drop("__same")


def drop_coincident(df: DataFrame, tolerance_u: float = 0.1) -> DataFrame:
    """Stitches of runs without those nearer than the tolerance to the last one kept. One ordered pass per run."""
    pts = runs(df).groupBy("design_id", "run").agg(F.array_sort(F.collect_list(F.struct("seq", "x_u", "y_u", "block"))).alias("pts"))

    # kept points gather in chunks, so that a point is copied a bounded number of times within its chunk and chunks alone are copied on
    head = F.slice("pts", 1, 1)
    start = F.struct(head.alias("chunk"), F.slice(F.array(head), 2, 1).alias("full"))

    def step(acc, p):
        last = F.element_at(acc["chunk"], -1)
        far = distance(p["x_u"] - last["x_u"], p["y_u"] - last["y_u"]) >= tolerance_u
        whole = F.size(acc["chunk"]) >= CHUNK
        chunk = F.when(whole, F.array(p)).otherwise(F.concat(acc["chunk"], F.array(p)))
        full = F.when(whole, F.concat(acc["full"], F.array(acc["chunk"]))).otherwise(acc["full"])
        return F.when(far, F.struct(chunk.alias("chunk"), full.alias("full"))).otherwise(acc)

    kept = F.aggregate(F.slice("pts", 2, F.size("pts")), start, step, lambda acc: F.concat(F.flatten(acc["full"]), acc["chunk"]))
    return pts.select("design_id", "run", F.explode(kept).alias("p")).select("design_id", "run", "p.*")


def split_long_moves(df: DataFrame, max_u: float = 121) -> DataFrame:
    """Points of runs with steps longer than the limit cut into equal parts (part 1..parts; the last is the stitch itself)."""
    w = Window.partitionBy("design_id", "run").orderBy("seq")
    r = runs(df, 1 << 30).withColumn("x0", F.coalesce(F.lag("x_u").over(w), "x_u")).withColumn("y0", F.coalesce(F.lag("y_u").over(w), "y_u"))
    r = r.withColumn("parts", F.greatest(F.lit(1), F.ceil(distance(F.col("x_u") - F.col("x0"), F.col("y_u") - F.col("y0")) / max_u).cast("int")))
    at = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * F.col("part") / F.col("parts")
    return r.withColumn("part", F.explode(F.sequence(F.lit(1), "parts"))).select("design_id", "run", "seq", "part", "parts", at("x0", "x_u").alias("x"), at("y0", "y_u").alias("y"))


def sample_segments(df: DataFrame, step_u: float = 5, hop_u: int = HOP_U) -> DataFrame:
    """Midpoints of equal parts of every segment, none longer than the step, each standing for `weight` units of thread."""
    n = F.greatest(F.lit(1), F.ceil(F.col("len") / step_u).cast("int"))
    s = segments(df, hop_u).withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * (F.col("i") + 0.5) / F.col("n")
    return s.select("design_id", "block", "run", "seq", at("x0", "x1").alias("x"), at("y0", "y1").alias("y"), (F.col("len") / F.col("n")).alias("weight"))


def jump_trim_marks(df: DataFrame) -> DataFrame:
    """Needle-up moves as segments and trims as points; a colour change breaks the chain."""
    w = Window.partitionBy("design_id", "block").orderBy("seq")
    b = blocks(df).withColumn("x0", F.lag("x_u").over(w)).withColumn("y0", F.lag("y_u").over(w))
    return b.where("cmd = 'trim' or (cmd = 'jump' and x0 is not null)").select("design_id", "block", "seq", "cmd", F.when(F.col("cmd") == "jump", F.col("x0")).alias("x0"), F.when(F.col("cmd") == "jump", F.col("y0")).alias("y0"), F.col("x_u").alias("x1"), F.col("y_u").alias("y1"))


def collapse_jump_runs(df: DataFrame, trim_at: int = 3) -> DataFrame:
    """Consecutive jumps become one row at the last of them: a trim from `trim_at` on, else a jump; trailing jumps go."""
    w = Window.partitionBy("design_id").orderBy("seq")
    j = df.withColumn("__j", F.col("cmd") == "jump").withColumn("__g", F.sum((~F.col("__j") | ~F.coalesce(F.lag("__j").over(w), F.lit(False))).cast("int")).over(so_far()))
    last = F.max("seq").over(Window.partitionBy("design_id"))
    g = j.withColumn("__last", last).groupBy("design_id", "__g").agg(F.max("seq").alias("seq"), F.max_by("x_u", "seq").alias("x_u"), F.max_by("y_u", "seq").alias("y_u"), F.max_by("cmd", "seq").alias("cmd"), F.count("*").alias("n"), F.max("__last").alias("__last"))
    cmd = F.when((F.col("cmd") == "jump") & (F.col("n") >= trim_at), "trim").otherwise(F.col("cmd"))
    return g.where(~((F.col("cmd") == "jump") & (F.col("seq") == F.col("__last")))).select("design_id", "seq", cmd.alias("cmd"), "x_u", "y_u")


def center_on_stitch_bbox(df: DataFrame) -> DataFrame:
    """Every record moved by the rounded middle of the stitches' bounding box."""
    w = Window.partitionBy("design_id")
    mid = lambda c: F.coalesce(F.floor((F.min(F.when(F.col("cmd") == "stitch", F.col(c))).over(w) + F.max(F.when(F.col("cmd") == "stitch", F.col(c))).over(w)) / 2 + 0.5), F.lit(0))
    return df.withColumn("__mx", mid("x_u")).withColumn("__my", mid("y_u")).select("design_id", "seq", "cmd", (F.col("x_u") - F.col("__mx")).alias("x_u"), (F.col("y_u") - F.col("__my")).alias("y_u"))


def trim_before(df: DataFrame) -> DataFrame:
    """Stitches with whether a trim or colour change stands between them and the one before."""
    marked = df.withColumn("__n", F.sum((F.col("cmd") == "stitch").cast("int")).over(so_far()))
    cut = F.max(F.col("cmd").isin("trim", "color").cast("int")).over(Window.partitionBy("design_id", "__n"))
    seen = marked.withColumn("__cut", cut)
    w = Window.partitionBy("design_id").orderBy("seq")
    return seen.where("cmd = 'stitch'").withColumn("trim_before", F.coalesce(F.lag("__cut").over(w), F.lit(0)) == 1).select("design_id", "seq", "x_u", "y_u", "trim_before")


def phase_labels(df: DataFrame, short_u: float = 12, reverse_share: float = 0.5, hop_u: int = HOP_U) -> DataFrame:
    """A label for each segment from its nine neighbours: lock L, zigzag Z, running R, other O."""
    w = Window.partitionBy("design_id", "run").orderBy("seq").rowsBetween(-4, 4)
    r = reversals(df, hop_u=hop_u).withColumn("med", kth(F.collect_list("len").over(w), 0.5)).withColumn("rev", F.avg(F.col("reversal").cast("int")).over(w))
    label = F.when(F.col("med") <= short_u, "L").when(F.col("rev") >= reverse_share, "Z").when(F.col("rev") == 0, "R").otherwise("O")
    return r.select("design_id", "block", "run", "seq", "len", label.alias("label"))


def tail_locks(df: DataFrame, tiny_u: float = 8, last: int = 4, least: int = 2, hop_u: int = HOP_U) -> DataFrame:
    """Runs with how many of their last steps are tiny, and whether that makes a lock."""
    w = Window.partitionBy("design_id", "run").orderBy(F.desc("seq"))
    t = segments(df, hop_u).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= last)
    return t.groupBy("design_id", "run").agg(F.sum((F.col("len") <= tiny_u).cast("int")).cast("int").alias("tiny")).withColumn("locked", F.col("tiny") >= least)


def cut_gaps(df: DataFrame, hop_u: int = HOP_U) -> DataFrame:
    """Distance from each run's end to the next run's start, with what opened the next run."""
    ends = runs(df, hop_u).groupBy("design_id", "run").agg(F.min_by("x_u", "seq").alias("x0"), F.min_by("y_u", "seq").alias("y0"), F.max_by("x_u", "seq").alias("x1"), F.max_by("y_u", "seq").alias("y1"))
    w = Window.partitionBy("design_id").orderBy("run")
    gaps = ends.withColumn("gap", distance(F.col("x0") - F.lag("x1").over(w), F.col("y0") - F.lag("y1").over(w)))
    return gaps.hint("merge").join(break_kinds(df, hop_u), ["design_id", "run"]).where("gap is not null").select("design_id", "run", "gap", F.col("break_kind").isin("trim", "color").alias("cut"))
