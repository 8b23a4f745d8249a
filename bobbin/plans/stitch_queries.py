"""Queries over stitch streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import measures as M
from ..operators import stream as S
from .registry import query


def runs_sql(view: str = "v_stitches", hop: int = 75, tag: str = "") -> str:
    """Common table expressions b (blocks), r (runs), s (segments) in DuckDB's dialect."""
    return f"""b{tag} AS (SELECT *, SUM(CASE WHEN cmd = 'color' THEN 1 ELSE 0 END) OVER w AS block, LAG(cmd) OVER w AS pc, LAG(x_u) OVER w AS px, LAG(y_u) OVER w AS py
  FROM {view} WINDOW w AS (PARTITION BY design_id ORDER BY seq)),
r{tag} AS (SELECT design_id, seq, x_u, y_u, CAST(block AS BIGINT) AS block, CAST(run AS BIGINT) AS run FROM (
  SELECT *, SUM(CASE WHEN cmd = 'stitch' AND (pc IS NULL OR pc <> 'stitch' OR SQRT(CAST((x_u - px) * (x_u - px) + (y_u - py) * (y_u - py) AS DOUBLE)) >= {hop}) THEN 1 ELSE 0 END)
    OVER (PARTITION BY design_id ORDER BY seq) - 1 AS run FROM b{tag}) q WHERE cmd = 'stitch'),
s{tag} AS (SELECT *, SQRT(CAST((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) AS DOUBLE)) AS len FROM (
  SELECT design_id, block, run, seq, LAG(x_u) OVER w AS x0, LAG(y_u) OVER w AS y0, x_u AS x1, y_u AS y1 FROM r{tag} WINDOW w AS (PARTITION BY design_id, run ORDER BY seq)) q WHERE x0 IS NOT NULL)"""


RUNS, WHOLE = runs_sql(), runs_sql(hop=1 << 30)
#: Segments with the turn to the one before.
TURNS = RUNS + """, t AS (SELECT *, CASE WHEN len * pl > 0 THEN ((x1 - x0) * pdx + (y1 - y0) * pdy) / (len * pl) END AS cos FROM (
  SELECT *, LAG(len) OVER w AS pl, LAG(x1 - x0) OVER w AS pdx, LAG(y1 - y0) OVER w AS pdy FROM s WINDOW w AS (PARTITION BY design_id, run ORDER BY seq)) q)"""
#: What opened each run.
KINDS = RUNS + """, m AS (SELECT *, COALESCE(SUM(CASE WHEN cmd = 'stitch' THEN 1 ELSE 0 END) OVER (PARTITION BY design_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM v_stitches),
g AS (SELECT design_id, n, MAX(CASE cmd WHEN 'color' THEN 3 WHEN 'trim' THEN 2 ELSE 1 END) AS k FROM m WHERE cmd <> 'stitch' GROUP BY 1, 2),
f AS (SELECT design_id, run, MIN(n) AS n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY design_id ORDER BY seq) - 1 AS n FROM r) q GROUP BY 1, 2),
k AS (SELECT f.design_id, f.run, CASE WHEN g.k = 3 THEN 'color' WHEN g.k = 2 THEN 'trim' WHEN f.n = 0 THEN 'start' WHEN g.k = 1 THEN 'jump' ELSE 'hop' END AS break_kind
  FROM f LEFT JOIN g ON f.design_id = g.design_id AND f.n = g.n)"""
CLASSES = TURNS + """, c AS (SELECT *, CASE WHEN n <= 5 AND median_len <= 10 THEN 'lock' WHEN reversal_share >= 0.6 THEN 'satin' WHEN reversal_share <= 0.2 AND median_len <= 40 THEN 'run' WHEN n > 5 THEN 'fill' ELSE 'other' END AS kind FROM (
  SELECT design_id, block, run, COUNT(*) AS n, LIST_SORT(LIST(len))[CAST(FLOOR(COUNT(*) * 0.5) AS INT) + 1] AS median_len, AVG(CASE WHEN cos < -0.2 THEN 1 ELSE 0 END) AS reversal_share FROM t GROUP BY 1, 2, 3) q)"""
#: Sample points of segments, 5 units apart at most.
SAMPLES = RUNS + """, p AS (SELECT design_id, block, run, seq, x0 + (x1 - x0) * (i + 0.5) / n AS x, y0 + (y1 - y0) * (i + 0.5) / n AS y, len / n AS weight
  FROM (SELECT *, UNNEST(RANGE(n)) AS i FROM (SELECT *, GREATEST(1, CAST(CEIL(len / 5) AS BIGINT)) AS n FROM s) q) q)"""
KTH = "LIST_SORT(LIST({v}))[LEAST(COUNT(*), CAST(FLOOR(COUNT(*) * {q}) AS BIGINT) + 1)]"


def r4(df, *cols):
    """Rounded to four places, as the twins do."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: C.rounded(c, 4) if kinds[c] == "double" else F.round(c, 4) for c in cols})


@query("p1_units", "v_stitches", sql="SELECT design_id, seq, ROUND(x_u * 0.1, 4) AS x_mm, CAST(ROUND((x_u * 0.1) / 0.1) AS INT) AS back_u FROM v_stitches")
def _(st):
    mm = C.to_mm(F.col("x_u"))
    return st.select("design_id", "seq", F.round(mm, 4).alias("x_mm"), C.to_units(mm).alias("back_u"))


@query("p3_dihedral", "v_stitches", sql="SELECT design_id, seq, k, CASE WHEN k IN (0, 3) THEN x_u WHEN k IN (1, 2) THEN -x_u WHEN k IN (4, 7) THEN y_u ELSE -y_u END AS x_u, CASE WHEN k IN (0, 1) THEN y_u WHEN k IN (2, 3) THEN -y_u WHEN k IN (4, 5) THEN x_u ELSE -x_u END AS y_u FROM v_stitches, (SELECT UNNEST(RANGE(8)) AS k) q WHERE cmd = 'stitch'")
def _(st):
    return dihedral(st.where("cmd = 'stitch'"))


def dihedral(df):
    """The eight symmetries of the plane, k = 0 to 7 (mirrors and half turn, then the same with axes swapped)."""
    x, y = F.col("x_u"), F.col("y_u")
    forms = [(x, y), (-x, y), (-x, -y), (x, -y), (y, x), (-y, x), (-y, -x), (y, -x)]
    each = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), a.alias("x"), b.alias("y")) for k, (a, b) in enumerate(forms)])
    return df.select("design_id", "seq", F.explode(each).alias("f")).select("design_id", "seq", "f.k", F.col("f.x").alias("x_u"), F.col("f.y").alias("y_u"))


@query("p4_segments", "v_stitches", sql=f"WITH {RUNS} SELECT design_id, block, run, seq, x0, y0, x1, y1, ROUND(len, 4) AS len FROM s")
def _(st):
    return r4(S.segments(st), "len")


@query("p5_split_long_moves", "v_stitches", sql=f"""WITH {WHOLE}, q AS (SELECT *, COALESCE(LAG(x_u) OVER w, x_u) AS x0, COALESCE(LAG(y_u) OVER w, y_u) AS y0 FROM r WINDOW w AS (PARTITION BY design_id, run ORDER BY seq)),
n AS (SELECT *, GREATEST(1, CAST(CEIL(SQRT(CAST((x_u - x0) * (x_u - x0) + (y_u - y0) * (y_u - y0) AS DOUBLE)) / 20) AS INT)) AS parts FROM q)
SELECT design_id, run, seq, CAST(part AS INT) AS part, parts, ROUND(x0 + (x_u - x0) * part / parts, 4) AS x, ROUND(y0 + (y_u - y0) * part / parts, 4) AS y FROM (SELECT *, UNNEST(RANGE(1, parts + 1)) AS part FROM n) z""")
def _(st):
    return r4(S.split_long_moves(st, 20), "x", "y")


@query("p7_sample_segments", "v_stitches", sql=f"WITH {SAMPLES} SELECT design_id, run, COUNT(*) AS samples, ROUND(SUM(weight), 3) AS thread_u FROM p GROUP BY 1, 2")
def _(st):
    return S.sample_segments(st).groupBy("design_id", "run").agg(F.count("*").alias("samples"), F.round(F.sum("weight"), 3).alias("thread_u"))


@query("w1_blocks", "v_stitches", sql="SELECT design_id, seq, cmd, CAST(SUM(CASE WHEN cmd = 'color' THEN 1 ELSE 0 END) OVER (PARTITION BY design_id ORDER BY seq) AS BIGINT) AS block FROM v_stitches")
def _(st):
    return S.blocks(st).select("design_id", "seq", "cmd", "block")


@query("w2_runs", "v_stitches", sql=f"WITH {RUNS} SELECT design_id, seq, block, run FROM r")
def _(st):
    return S.runs(st).select("design_id", "seq", "block", "run")


@query("w3_break_kind", "v_stitches", sql=f"WITH {KINDS} SELECT design_id, run, break_kind FROM k")
def _(st):
    return S.break_kinds(st)


@query("w4_islands", "v_stitches", sql="""SELECT design_id, up, MIN(seq) AS first, MAX(seq) AS last, COUNT(*) AS length FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY design_id ORDER BY seq) - ROW_NUMBER() OVER (PARTITION BY design_id, up ORDER BY seq) AS i FROM (SELECT *, cmd <> 'stitch' AS up FROM v_stitches) q) z GROUP BY design_id, up, i""")
def _(st):
    return S.islands(st.withColumn("up", F.col("cmd") != "stitch"), ["design_id"], "seq", "up")


@query("w5_reversals", "v_stitches", sql=f"WITH {TURNS} SELECT design_id, run, COUNT(*) AS n, CAST(SUM(CASE WHEN cos < -0.2 THEN 1 ELSE 0 END) AS BIGINT) AS reversals FROM t GROUP BY 1, 2")
def _(st):
    return S.reversals(st).groupBy("design_id", "run").agg(F.count("*").alias("n"), F.sum(F.col("reversal").cast("int")).alias("reversals"))


@query("w6_classify_runs", "v_stitches", sql=f"WITH {CLASSES} SELECT design_id, block, run, n, ROUND(median_len, 4) AS median_len, ROUND(reversal_share, 4) AS reversal_share, kind FROM c")
def _(st):
    return r4(S.classify_runs(st), "median_len", "reversal_share")


@query("w9_tail_lock", "v_stitches", sql=f"""WITH {RUNS} SELECT design_id, run, CAST(SUM(CASE WHEN len <= 8 THEN 1 ELSE 0 END) AS INT) AS tiny, SUM(CASE WHEN len <= 8 THEN 1 ELSE 0 END) >= 2 AS locked FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY design_id, run ORDER BY seq DESC) AS rn FROM s) q WHERE rn <= 4 GROUP BY 1, 2""")
def _(st):
    return S.tail_locks(st)


GAPS = KINDS + """, e AS (SELECT design_id, run, ARG_MIN(x_u, seq) AS x0, ARG_MIN(y_u, seq) AS y0, ARG_MAX(x_u, seq) AS x1, ARG_MAX(y_u, seq) AS y1 FROM r GROUP BY 1, 2),
h AS (SELECT e.design_id, e.run, SQRT(CAST((x0 - lx) * (x0 - lx) + (y0 - ly) * (y0 - ly) AS DOUBLE)) AS gap, break_kind IN ('trim', 'color') AS cut FROM (
  SELECT *, LAG(x1) OVER w AS lx, LAG(y1) OVER w AS ly FROM e WINDOW w AS (PARTITION BY design_id ORDER BY run)) e JOIN k ON e.design_id = k.design_id AND e.run = k.run WHERE lx IS NOT NULL)"""


@query("w14_cut_gaps", "v_stitches", sql=f"WITH {GAPS} SELECT design_id, run, ROUND(gap, 4) AS gap, cut FROM h")
def _(st):
    return r4(S.cut_gaps(st), "gap")


@query("w21_jump_trim_marks", "v_stitches", sql=f"""WITH {RUNS}, q AS (SELECT *, LAG(x_u) OVER w AS x0, LAG(y_u) OVER w AS y0 FROM b WINDOW w AS (PARTITION BY design_id, block ORDER BY seq))
SELECT design_id, CAST(block AS BIGINT) AS block, seq, cmd, CASE WHEN cmd = 'jump' THEN x0 END AS x0, CASE WHEN cmd = 'jump' THEN y0 END AS y0, x_u AS x1, y_u AS y1 FROM q WHERE cmd = 'trim' OR (cmd = 'jump' AND x0 IS NOT NULL)""")
def _(st):
    return S.jump_trim_marks(st)


@query("w26_trim_before", "v_stitches", sql="""WITH m AS (SELECT *, SUM(CASE WHEN cmd = 'stitch' THEN 1 ELSE 0 END) OVER (PARTITION BY design_id ORDER BY seq) AS n FROM v_stitches),
g AS (SELECT *, MAX(CASE WHEN cmd IN ('trim', 'color') THEN 1 ELSE 0 END) OVER (PARTITION BY design_id, n) AS cut FROM m)
SELECT design_id, seq, x_u, y_u, COALESCE(LAG(cut) OVER (PARTITION BY design_id ORDER BY seq), 0) = 1 AS trim_before FROM g WHERE cmd = 'stitch'""")
def _(st):
    return S.trim_before(st)


@query("f1_drop_equal_neighbours", "v_stitches", sql=f"""WITH {RUNS}, q AS (SELECT *, LAG(x_u) OVER w = x_u AND LAG(y_u) OVER w = y_u AS same FROM r WINDOW w AS (PARTITION BY design_id, run ORDER BY seq))
SELECT design_id, seq, x_u, y_u, block, run FROM q WHERE same IS NULL OR NOT same""")
def _(st):
    return S.drop_equal_neighbours(st)


@query("f1_drop_coincident", "v_stitches")
def _(st):
    return S.drop_coincident(st, 6)


@query("f3_infer_trims", "v_stitches", sql=f"""WITH {WHOLE}, q AS (SELECT *, len >= 30 AND LAG(len) OVER w < 25 AND LEAD(len) OVER w < 25 AS hit FROM s WINDOW w AS (PARTITION BY design_id, block ORDER BY seq))
SELECT design_id, block, run, seq, COALESCE(hit, false) AS inferred_trim FROM q""")
def _(st):
    return S.infer_trims(st).select("design_id", "block", "run", "seq", "inferred_trim")


@query("s3_collapse_jump_runs", "v_stitches", sql="""WITH j AS (SELECT *, cmd = 'jump' AS j, MAX(seq) OVER (PARTITION BY design_id) AS fin FROM v_stitches),
g AS (SELECT *, SUM(CASE WHEN j AND COALESCE(pj, false) THEN 0 ELSE 1 END) OVER (PARTITION BY design_id ORDER BY seq) AS g FROM (SELECT *, LAG(j) OVER (PARTITION BY design_id ORDER BY seq) AS pj FROM j) q),
o AS (SELECT design_id, g, MAX(seq) AS seq, ARG_MAX(cmd, seq) AS cmd, ARG_MAX(x_u, seq) AS x_u, ARG_MAX(y_u, seq) AS y_u, COUNT(*) AS n, MAX(fin) AS fin FROM g GROUP BY 1, 2)
SELECT design_id, seq, CASE WHEN cmd = 'jump' AND n >= 2 THEN 'trim' ELSE cmd END AS cmd, x_u, y_u FROM o WHERE NOT (cmd = 'jump' AND seq = fin)""")
def _(st):
    return S.collapse_jump_runs(st, 2)


@query("s4_center", "v_stitches", sql="""WITH m AS (SELECT *, FLOOR((MIN(CASE WHEN cmd = 'stitch' THEN x_u END) OVER w + MAX(CASE WHEN cmd = 'stitch' THEN x_u END) OVER w) / 2.0 + 0.5) AS mx, FLOOR((MIN(CASE WHEN cmd = 'stitch' THEN y_u END) OVER w + MAX(CASE WHEN cmd = 'stitch' THEN y_u END) OVER w) / 2.0 + 0.5) AS my FROM v_stitches WINDOW w AS (PARTITION BY design_id))
SELECT design_id, seq, cmd, CAST(x_u - COALESCE(mx, 0) AS BIGINT) AS x_u, CAST(y_u - COALESCE(my, 0) AS BIGINT) AS y_u FROM m""")
def _(st):
    return S.center_on_stitch_bbox(st)


@query("a1_plan_stats", "v_stitches", sql="""WITH p AS (SELECT *, cmd = 'jump' AND (pc IS NULL OR pc <> 'trim') AS lone FROM (SELECT *, LAG(cmd) OVER (PARTITION BY design_id ORDER BY seq) AS pc FROM v_stitches) q),
g AS (SELECT design_id, COUNT(*) FILTER (cmd = 'stitch') AS stitches, COUNT(*) FILTER (cmd = 'color') AS color_changes, COUNT(*) FILTER (cmd = 'trim') AS trims, COUNT(*) FILTER (lone) AS jumps,
 MIN(x_u) FILTER (cmd = 'stitch') AS min_x, MAX(x_u) FILTER (cmd = 'stitch') AS max_x, MIN(y_u) FILTER (cmd = 'stitch') AS min_y, MAX(y_u) FILTER (cmd = 'stitch') AS max_y FROM p GROUP BY 1)
SELECT *, max_x - min_x AS width_u, max_y - min_y AS height_u FROM g""")
def _(st):
    return M.plan_stats(st)


@query("a2_thread_length", "v_stitches", sql=f"WITH {RUNS} SELECT design_id, block, ROUND(SUM(len) * 0.1 * 1.35, 3) AS thread_mm FROM s GROUP BY GROUPING SETS ((design_id, block), (design_id))")
def _(st):
    return M.thread_length(st).withColumn("thread_mm", F.round("thread_mm", 3))


@query("a3_record_kinds", "v_stitches", sql="SELECT design_id, " + ", ".join(f"COUNT(*) FILTER (cmd = '{k}') AS {k}" for k in ("stitch", "jump", "trim", "color")) + " FROM v_stitches GROUP BY 1")
def _(st):
    return M.record_kinds(st)


@query("a4_bbox", "v_stitches", sql="SELECT design_id, " + ", ".join(f"COALESCE({f}({c}_u) FILTER (cmd NOT IN ('color', 'end')), 0) AS {f.lower()}_{c}" for c in "xy" for f in ("MIN", "MAX")) + " FROM v_stitches GROUP BY 1")
def _(st):
    return M.bbox(st)


@query("a5_block_summary", "v_stitches", sql=f"WITH {RUNS} SELECT design_id, block, COUNT(*) AS steps, COUNT(DISTINCT run) AS runs, " + ", ".join(f"ROUND({KTH.format(v='len', q=q)}, 4) AS p{int(q * 100)}" for q in (0.1, 0.5, 0.9)) + ", ROUND(SUM(len) * 0.1, 3) AS mm, MIN(LEAST(x0, x1)) AS min_x, MIN(LEAST(y0, y1)) AS min_y, MAX(GREATEST(x0, x1)) AS max_x, MAX(GREATEST(y0, y1)) AS max_y FROM s GROUP BY 1, 2")
def _(st):
    return r4(M.block_summary(st), "p10", "p50", "p90").withColumn("mm", F.round("mm", 3))


@query("a6_break_histogram", "v_stitches", sql=f"WITH {KINDS} SELECT design_id, " + ", ".join(f"COUNT(*) FILTER (break_kind = '{k}') AS {k}" for k in ("start", "trim", "color", "jump", "hop")) + " FROM k GROUP BY 1")
def _(st):
    return M.break_histogram(st)


@query("a7_trims_per_1000", "v_stitches", sql=f"""WITH {KINDS}, q AS (SELECT design_id, COUNT(*) FILTER (break_kind = 'trim') AS trims, MAX(CASE WHEN break_kind = 'trim' AND run = 0 THEN 1 ELSE 0 END) AS fst FROM k GROUP BY 1),
n AS (SELECT design_id, COUNT(*) AS stitches FROM v_stitches WHERE cmd = 'stitch' GROUP BY 1)
SELECT n.design_id, stitches, CASE WHEN stitches >= 30 THEN ROUND((COALESCE(trims, 0) - COALESCE(fst, 0)) * 1000.0 / stitches, 4) END AS trims_per_1000 FROM n LEFT JOIN q ON n.design_id = q.design_id""")
def _(st):
    return r4(M.trims_per_1000(st), "trims_per_1000")


@query("a8_same_hole_rate", "v_stitches", sql="""SELECT design_id, CAST(SUM(n) AS BIGINT) AS n, CASE WHEN SUM(n) >= 30 THEN ROUND(SUM(CASE WHEN n >= 2 THEN 1 ELSE 0 END) / SUM(n), 4) END AS same_hole_rate
FROM (SELECT design_id, x_u, y_u, COUNT(*) AS n FROM v_stitches WHERE cmd = 'stitch' GROUP BY 1, 2, 3) q GROUP BY 1""")
def _(st):
    return r4(M.same_hole_rate(st), "same_hole_rate")


@query("a12_dominant_angle", "v_stitches", sql=f"""WITH {RUNS}, a AS (SELECT *, ATAN2(CAST(y1 - y0 AS DOUBLE), CAST(x1 - x0 AS DOUBLE)) AS th FROM s WHERE len > 0),
g AS (SELECT design_id, run, SUM(SIN(2 * th) * len) AS sn, SUM(COS(2 * th) * len) AS cs, SUM(len) AS l, COUNT(*) AS n FROM a GROUP BY 1, 2)
SELECT design_id, run, CASE WHEN SQRT(sn * sn + cs * cs) / l > 0.01 THEN (CAST(ROUND(DEGREES(ATAN2(sn, cs)) / 2, 2) * 100 AS BIGINT) + 36000) % 18000 END AS angle_c, ROUND(SQRT(sn * sn + cs * cs) / l, 4) AS concentration, n FROM g""")
def _(st):
    # hundredths of a degree; runs without a direction to speak of have none
    return M.dominant_angle(st).select("design_id", "run", F.when(F.col("concentration") > 0.01, F.pmod((F.round("angle", 2) * 100 + 0.5).cast("long"), F.lit(18000))).alias("angle_c"), F.round("concentration", 4).alias("concentration"), "n")


def cells_sql(view: str, tag: str) -> str:
    return runs_sql(view, 75, tag) + f""", t{tag} AS (SELECT *, CASE WHEN len * pl > 0 THEN ((x1 - x0) * pdx + (y1 - y0) * pdy) / (len * pl) END AS cos FROM (
  SELECT *, LAG(len) OVER w AS pl, LAG(x1 - x0) OVER w AS pdx, LAG(y1 - y0) OVER w AS pdy FROM s{tag} WINDOW w AS (PARTITION BY design_id, run ORDER BY seq)) q),
cell{tag} AS (SELECT *, CASE WHEN rev >= 0.5 THEN 'satin' WHEN med <= 25 THEN 'run' ELSE 'fill' END AS typ FROM (
  SELECT design_id, CAST(FLOOR((x0 + x1) / 2.0 / 20) AS BIGINT) AS ci, CAST(FLOOR((y0 + y1) / 2.0 / 20) AS BIGINT) AS cj, SUM(len) AS tot, {KTH.format(v='len', q=0.5)} AS med, AVG(CASE WHEN cos < -0.866 THEN 1 ELSE 0 END) AS rev FROM t{tag} GROUP BY 1, 2, 3) q WHERE tot >= 20)"""


BOTH = cells_sql("v_stitches", "") + ", " + cells_sql("v_stitches_b", "2")


@query("a13_cell_map", "v_stitches", sql=f"""WITH {cells_sql('v_stitches', '')}, dr AS (SELECT design_id, CAST(FLOOR((x0 + x1) / 2.0 / 20) AS BIGINT) AS ci, CAST(FLOOR((y0 + y1) / 2.0 / 20) AS BIGINT) AS cj, SUM(len * SIN(2 * ATAN2(CAST(y1 - y0 AS DOUBLE), CAST(x1 - x0 AS DOUBLE)))) AS sn, SUM(len * COS(2 * ATAN2(CAST(y1 - y0 AS DOUBLE), CAST(x1 - x0 AS DOUBLE)))) AS cs, SUM(len) AS l FROM s GROUP BY 1, 2, 3)
SELECT design_id, ci, cj, ROUND(tot, 4) AS tot, ROUND(med, 4) AS med, ROUND(rev, 4) AS rev, typ, ROUND(SQRT(sn * sn + cs * cs) / l, 4) AS concentration,
 CASE WHEN SQRT(sn * sn + cs * cs) / l > 0.01 THEN (CAST(ROUND(DEGREES(ATAN2(sn, cs)) / 2, 2) * 100 AS BIGINT) + 36000) % 18000 END AS angle_c FROM cell JOIN dr USING (design_id, ci, cj)""")
def _(st):
    angle = F.when(F.col("concentration") > 0.01, F.pmod((F.round("angle", 2) * 100 + 0.5).cast("long"), F.lit(18000)))
    return r4(M.cell_map(st).withColumn("angle_c", angle).drop("angle"), "tot", "med", "rev", "concentration")


@query("j5_type_confusion", "v_stitches", "v_stitches_b", sql=f"WITH {BOTH} SELECT a.typ AS pt, b.typ AS ot, COUNT(*) AS cells FROM cell a JOIN cell2 b ON a.design_id = b.design_id AND a.ci = b.ci AND a.cj = b.cj GROUP BY 1, 2")
def _(a, b):
    return M.type_confusion(M.cell_map(a), M.cell_map(b))


@query("a35_type_chance", "v_stitches", "v_stitches_b", sql=f"""WITH {BOTH}, sa AS (SELECT design_id, typ, COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY design_id) AS p FROM cell GROUP BY 1, 2), sb AS (SELECT design_id, typ, COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY design_id) AS p FROM cell2 GROUP BY 1, 2)
SELECT sa.design_id, ROUND(SUM(sa.p * sb.p), 4) AS chance FROM sa JOIN sb ON sa.design_id = sb.design_id AND sa.typ = sb.typ GROUP BY 1""")
def _(a, b):
    return r4(M.type_chance(M.cell_map(a), M.cell_map(b)), "chance")


@query("a36_mask_iou", "v_stitches", "v_stitches_b", sql=f"""WITH {BOTH}, j AS (SELECT COALESCE(a.design_id, b.design_id) AS design_id, a.ci AS ai, b.ci AS bi FROM cell a FULL JOIN cell2 b ON a.design_id = b.design_id AND a.ci = b.ci AND a.cj = b.cj),
g AS (SELECT design_id, COUNT(*) AS n, COUNT(*) FILTER (ai IS NOT NULL AND bi IS NOT NULL) AS c, COUNT(ai) AS na, COUNT(bi) AS nb FROM j GROUP BY 1)
SELECT design_id, ROUND(c / n, 4) AS iou, ROUND(c / na, 4) AS recall, ROUND(c / nb, 4) AS precision, na - c AS missing, nb - c AS overspill FROM g""")
def _(a, b):
    return r4(M.mask_iou(M.cell_map(a), M.cell_map(b)), "iou", "recall", "precision")


ADV = """, adv AS (SELECT design_id, run, COUNT(*) AS n, LIST_SORT(LIST(d))[LEAST(COUNT(*), CAST(FLOOR(COUNT(*) * 0.5) AS BIGINT) + 1)] AS advance FROM (
  SELECT design_id, run, SQRT(CAST((x2 - x_u) * (x2 - x_u) + (y2 - y_u) * (y2 - y_u) AS DOUBLE)) AS d FROM (SELECT *, LEAD(x_u, 2) OVER w AS x2, LEAD(y_u, 2) OVER w AS y2 FROM r WINDOW w AS (PARTITION BY design_id, run ORDER BY seq)) q WHERE x2 IS NOT NULL) z GROUP BY 1, 2)"""


@query("a15_rail_advance", "v_stitches", sql=f"WITH {RUNS}{ADV} SELECT design_id, run, n, ROUND(advance, 4) AS advance FROM adv")
def _(st):
    return r4(M.rail_advance(st), "advance")


@query("a16_satin_stats", "v_stitches", sql=f"WITH {RUNS}{ADV}, wd AS (SELECT design_id, run, {KTH.format(v='len', q=0.5)} AS width, MAX(len) AS widest FROM s GROUP BY 1, 2) SELECT wd.design_id, wd.run, ROUND(width, 4) AS width, ROUND(widest, 4) AS widest, ROUND(advance, 4) AS density FROM wd LEFT JOIN adv ON wd.design_id = adv.design_id AND wd.run = adv.run")
def _(st):
    return r4(M.satin_stats(st), "width", "widest", "density")


@query("a18_class_census", "v_stitches", sql=f"WITH {CLASSES}, z AS (SELECT c.kind, ROUND(s.len, 4) AS len FROM s JOIN c ON s.design_id = c.design_id AND s.run = c.run) SELECT kind, COUNT(*) AS n, {KTH.format(v='len', q=0.5)} AS median, {KTH.format(v='len', q=0.9)} AS p90, MAX(len) AS most FROM z GROUP BY 1")
def _(st):
    return M.class_census(st)


@query("a39_pass_count", "v_stitches", sql=f"""WITH {SAMPLES}, o AS (SELECT design_id, seq, CAST(FLOOR((ROW_NUMBER() OVER (PARTITION BY design_id ORDER BY seq) - 1) / 16.0) AS BIGINT) AS chunk FROM s)
SELECT p.design_id, CAST(FLOOR(x / 10) AS BIGINT) AS cx, CAST(FLOOR(y / 10) AS BIGINT) AS cy, COUNT(DISTINCT chunk) AS passes FROM p JOIN o ON p.design_id = o.design_id AND p.seq = o.seq GROUP BY 1, 2, 3""")
def _(st):
    return M.pass_count_grid(st)


@query("a43_distance_bands", "v_stitches", sql=f"""WITH {GAPS} SELECT cut, band, COUNT(*) AS n FROM (SELECT cut, CASE WHEN gap * 0.1 < 3 THEN '[0,3)' WHEN gap * 0.1 < 6 THEN '[3,6)' WHEN gap * 0.1 < 11.8 THEN '[6,11.8)' ELSE '[11.8,)' END AS band FROM h) q GROUP BY CUBE (cut, band)""")
def _(st):
    return M.distance_bands(st)


@query("a46_paired_means", "v_stitches", "v_stitches_b", sql="""WITH a AS (SELECT design_id, COUNT(*) FILTER (cmd = 'trim') AS m FROM v_stitches GROUP BY 1), b AS (SELECT design_id, COUNT(*) FILTER (cmd = 'trim') AS m FROM v_stitches_b GROUP BY 1)
SELECT COUNT(*) AS designs, ROUND(AVG(a.m), 4) AS before, ROUND(AVG(b.m), 4) AS after FROM a JOIN b ON a.design_id = b.design_id""")
def _(a, b):
    return r4(M.paired_means(M.plan_stats(a), M.plan_stats(b), "trims"), "before", "after")


@query("a48_audit", "v_stitches", sql=f"""WITH {GAPS}, {CLASSES[CLASSES.index(', t AS') + 2:]}, base AS (SELECT design_id, COUNT(*) FILTER (cmd = 'trim') AS trims, COUNT(*) FILTER (cmd = 'jump') AS jumps FROM v_stitches GROUP BY 1),
gg AS (SELECT design_id, MIN(gap) FILTER (cut) AS shortest_cut, SUM(gap) AS travel FROM h GROUP BY 1), ss AS (SELECT s.design_id, COUNT(*) FILTER (len < 12 AND kind = 'fill') AS short_fill_steps FROM s JOIN c ON s.design_id = c.design_id AND s.run = c.run GROUP BY 1),
tw AS (SELECT design_id, run, SQRT(CAST(POW(LEAD(x_u, 2) OVER w - x_u, 2) + POW(LEAD(y_u, 2) OVER w - y_u, 2) AS DOUBLE)) AS two FROM r WINDOW w AS (PARTITION BY design_id, run ORDER BY seq)), sg AS (SELECT tw.design_id, MAX(two) AS satin_gap FROM tw JOIN c ON tw.design_id = c.design_id AND tw.run = c.run WHERE kind = 'satin' GROUP BY 1)
SELECT base.design_id, trims, jumps, ROUND(shortest_cut, 4) AS shortest_cut, ROUND(travel, 3) AS travel, COALESCE(short_fill_steps, 0) AS short_fill_steps, ROUND(satin_gap, 4) AS satin_gap FROM base LEFT JOIN gg ON base.design_id = gg.design_id LEFT JOIN ss ON base.design_id = ss.design_id LEFT JOIN sg ON base.design_id = sg.design_id""")
def _(st):
    return r4(M.audit_stats(st, 12), "shortest_cut", "satin_gap").withColumn("travel", F.round("travel", 3))


# ---- quality rules and their report


#: Satin steps: their share of short ones, and small satin runs.
SATIN_STEPS = runs_sql(tag="k") + """, tk AS (SELECT *, CASE WHEN len * pl > 0 THEN ((x1 - x0) * pdx + (y1 - y0) * pdy) / (len * pl) END AS cos FROM (
  SELECT *, LAG(len) OVER w AS pl, LAG(x1 - x0) OVER w AS pdx, LAG(y1 - y0) OVER w AS pdy FROM sk WINDOW w AS (PARTITION BY design_id, run ORDER BY seq)) q),
ck AS (SELECT design_id, run FROM (SELECT design_id, run, COUNT(*) AS n, LIST_SORT(LIST(len))[CAST(FLOOR(COUNT(*) * 0.5) AS INT) + 1] AS med, AVG(CASE WHEN cos < -0.2 THEN 1 ELSE 0 END) AS rev FROM tk GROUP BY 1, 2) q WHERE NOT (n <= 5 AND med <= 10) AND rev >= 0.6),
ss AS (SELECT sk.* FROM sk JOIN ck USING (design_id, run)), sx AS (SELECT design_id, COUNT(*) AS n, AVG(CASE WHEN len < 22 THEN 1 ELSE 0 END) AS sh FROM ss GROUP BY 1),
se AS (SELECT design_id, run, LIST_SORT(LIST(len))[LEAST(COUNT(*), CAST(FLOOR(COUNT(*) * 0.5) AS BIGINT) + 1)] AS col, GREATEST(MAX(GREATEST(x0, x1)) - MIN(LEAST(x0, x1)), MAX(GREATEST(y0, y1)) - MIN(LEAST(y0, y1))) AS ext FROM ss GROUP BY 1, 2),
sm AS (SELECT design_id, COUNT(*) FILTER (col < 24 OR ext < 30) AS small FROM se GROUP BY 1)"""


@query("q1_qc_report", "v_stitches", sql=f"""WITH {WHOLE}, st AS (SELECT design_id, COUNT(*) FILTER (cmd = 'stitch') AS stitches, COUNT(*) FILTER (cmd = 'color') AS colors, COUNT(*) FILTER (cmd = 'trim') AS trims FROM v_stitches GROUP BY 1),
cs AS (SELECT * FROM s),
ln AS (SELECT cs.design_id, COUNT(*) FILTER (len > 36) AS too_long FROM cs GROUP BY 1), {SATIN_STEPS},
hole AS (SELECT design_id, SUM(CASE WHEN n >= 2 THEN 1 ELSE 0 END) / SUM(n) AS rate FROM (SELECT design_id, x_u, y_u, COUNT(*) AS n FROM v_stitches WHERE cmd = 'stitch' GROUP BY 1, 2, 3) q GROUP BY 1),
f AS (SELECT design_id, 'too_long' AS code, 'block' AS severity FROM ln WHERE too_long > 29 UNION ALL SELECT design_id, 'too_short', 'warn' FROM sx WHERE n >= 8 AND sh > 0.25 UNION ALL SELECT design_id, 'lettering_small', 'warn' FROM sm WHERE small > 2
 UNION ALL SELECT design_id, 'trims', 'warn' FROM st WHERE stitches >= 30 AND trims * 1000.0 / stitches > 45 UNION ALL SELECT design_id, 'stops', 'warn' FROM st WHERE colors > 10
 UNION ALL SELECT design_id, 'stabiliser', 'info' FROM st WHERE stitches > 500 UNION ALL SELECT h.design_id, 'same_hole', 'info' FROM hole h JOIN st ON h.design_id = st.design_id WHERE rate > 0.02 AND stitches >= 30),
g AS (SELECT design_id, COUNT(*) FILTER (severity = 'warn') AS w, COUNT(*) FILTER (severity = 'block') AS bl, COUNT(*) AS n FROM f GROUP BY 1),
z AS (SELECT st.design_id, COALESCE(n, 0) AS findings, GREATEST(0, 100 - 12 * COALESCE(w, 0) - 30 * COALESCE(bl, 0)) AS score FROM st LEFT JOIN g ON st.design_id = g.design_id)
SELECT design_id, findings, CAST(score AS BIGINT) AS score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM z""")
def _(st):
    from .qc import Limits, qc_report

    return qc_report(st, Limits(longest_u=36, too_many_long=29, shortest_u=22, satin_steps=8, column_u=24, extent_u=30, small_shapes=2, trims_per_1000=45, many_stitches=500, same_hole=0.02))


