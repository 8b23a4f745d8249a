"""Queries over techniques inside runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import measures as M
from ..operators import technique as T
from .registry import query
from .stitch_queries import CLASSES, KINDS, KTH, RUNS, TURNS, WHOLE, r4, runs_sql

#: Ties by peeling: each recursion takes one bounce off the front, then the second one off the end.
TIES = """p0 AS (SELECT design_id, run, LIST(x_u ORDER BY seq) AS xs, LIST(y_u ORDER BY seq) AS ys, LIST(seq ORDER BY seq) AS qs FROM r GROUP BY 1, 2),
h AS (SELECT *, 0 AS k FROM p0 UNION ALL SELECT design_id, run, xs[5:], ys[5:], qs[5:], k + 1 FROM h WHERE LEN(xs) >= 5 AND xs[1] = xs[3] AND ys[1] = ys[3] AND xs[2] = xs[4] AND ys[2] = ys[4]),
h1 AS (SELECT design_id, run, ARG_MAX(xs, k) AS xs, ARG_MAX(ys, k) AS ys, ARG_MAX(qs, k) AS qs FROM h GROUP BY 1, 2),
t AS (SELECT *, 0 AS k FROM h1 UNION ALL SELECT design_id, run, xs[:-5], ys[:-5], qs[:-5], k + 1 FROM t WHERE LEN(xs) >= 5 AND xs[-1] = xs[-3] AND ys[-1] = ys[-3] AND xs[-2] = xs[-4] AND ys[-2] = ys[-4]),
t1 AS (SELECT design_id, run, ARG_MAX(xs, k) AS xs, ARG_MAX(ys, k) AS ys, ARG_MAX(qs, k) AS qs FROM t GROUP BY 1, 2)"""
#: Moves with ties: after every ninth stitch of a design the next eight repeat its place and the one before in turn.
TIED = """SELECT design_id, seq, cmd, CASE WHEN seq % 40 < 13 AND seq % 40 >= 2 THEN (seq % 2) * 6 + FLOOR(seq / 40) ELSE x_u END AS x_u, CASE WHEN seq % 40 < 13 AND seq % 40 >= 2 THEN FLOOR(seq / 40) ELSE y_u END AS y_u FROM v_stitches"""

PHASES = TURNS + """, z0 AS (SELECT *, SQRT(CAST(POW(LEAD(x1) OVER w - x0, 2) + POW(LEAD(y1) OVER w - y0, 2) AS DOUBLE)) AS two, COUNT(*) OVER (PARTITION BY design_id, run) AS n FROM t WINDOW w AS (PARTITION BY design_id, run ORDER BY seq)),
z1 AS (SELECT *, LIST_SORT(LIST(len) OVER w) AS ls, LIST_SORT(LIST_FILTER(LIST(two) OVER w, lambda v: v IS NOT NULL)) AS ts, AVG(CASE WHEN cos < -0.2 THEN 1.0 ELSE 0.0 END) OVER w AS rev FROM z0 WINDOW w AS (PARTITION BY design_id, run ORDER BY seq ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
lb AS (SELECT design_id, block, run, seq, len, CASE WHEN n < 5 THEN 'O' WHEN ls[LEN(ls) // 2 + 1] <= 5.5 AND rev >= 0.3 THEN 'L' WHEN rev >= 0.6 AND ls[LEN(ls) // 2 + 1] >= 6 THEN CASE WHEN COALESCE(ts[LEN(ts) // 2 + 1], 0) > 14 THEN 'Z' ELSE 'S' END WHEN rev <= 0.35 THEN 'R' ELSE 'O' END AS label FROM z1)"""
MERGED = PHASES + """, i0 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY design_id, run ORDER BY seq) AS i, ROW_NUMBER() OVER (PARTITION BY design_id, run ORDER BY seq) - ROW_NUMBER() OVER (PARTITION BY design_id, run, label ORDER BY seq) AS isl FROM lb),
i1 AS (SELECT design_id, run, label, isl, MIN(i) AS lo, MAX(i) AS hi, COUNT(*) AS c FROM i0 GROUP BY 1, 2, 3, 4),
i2 AS (SELECT *, LEAD(lo, 1, 1000000000) OVER (PARTITION BY design_id, run ORDER BY lo) AS till, ROW_NUMBER() OVER (PARTITION BY design_id, run ORDER BY lo) - 1 AS phase FROM i1 WHERE c >= 5 OR lo = 1),
ph AS (SELECT i0.design_id, i0.block, i0.run, phase, ANY_VALUE(i2.label) AS label, COUNT(*) AS steps, LIST_SORT(LIST(len))[COUNT(*) // 2 + 1] AS median_len FROM i0 JOIN i2 ON i0.design_id = i2.design_id AND i0.run = i2.run AND i0.i >= lo AND i0.i < till GROUP BY 1, 2, 3, 4)"""
#: Elements: the lowest run that overlapping boxes of one block reach.
ELEMENTS = """bx AS (SELECT design_id, run, MIN(block) AS block, MIN(x_u) - 3 AS x0, MIN(y_u) - 3 AS y0, MAX(x_u) + 3 AS x1, MAX(y_u) + 3 AS y1 FROM r GROUP BY 1, 2),
ov AS (SELECT p.design_id, p.run AS u, q.run AS v FROM bx p JOIN bx q ON p.design_id = q.design_id AND p.block = q.block AND p.run <> q.run AND p.x1 >= q.x0 AND q.x1 >= p.x0 AND p.y1 >= q.y0 AND q.y1 >= p.y0),
rc AS (SELECT design_id, run, run AS seen FROM bx UNION SELECT rc.design_id, rc.run, ov.v FROM rc JOIN ov ON rc.design_id = ov.design_id AND rc.seen = ov.u),
el AS (SELECT design_id, run, MIN(seen) AS element FROM rc GROUP BY 1, 2)"""


def recursive(sql: str) -> str:
    return "WITH RECURSIVE " + sql


def lines_sql(cell: float, src: str, order: str) -> str:
    """Points of segments with their cells."""
    n = f"GREATEST(2, CAST(FLOOR(len / {cell}) AS BIGINT) + 1)"
    at = lambda a, b: f"CAST(FLOOR(ROUND(({a} + ({b} - {a}) * CAST(t AS DOUBLE) / (pts - 1)) / {cell}, 6)) AS BIGINT)"
    return f"""l0 AS (SELECT *, {order} AS idx, {n} AS pts FROM {src}), l1 AS (SELECT *, UNNEST(RANGE(pts)) AS t FROM l0),
ln AS (SELECT *, {at('x0', 'x1')} AS cx, {at('y0', 'y1')} AS cy FROM l1)"""


@query("f2_strip_ties", "v_stitches", sql=recursive(f"{runs_sql(f'({TIED})')}, {TIES} SELECT design_id, run, UNNEST(qs) AS seq, CAST(UNNEST(xs) AS BIGINT) AS x_u, CAST(UNNEST(ys) AS BIGINT) AS y_u FROM t1"))
def _(st):
    tied = (F.col("seq") % 40 < 13) & (F.col("seq") % 40 >= 2)
    k = F.floor(F.col("seq") / 40)
    st = st.select("design_id", "seq", "cmd", F.when(tied, (F.col("seq") % 2) * 6 + k).otherwise(F.col("x_u")).alias("x_u"), F.when(tied, k).otherwise(F.col("y_u")).alias("y_u"))
    return T.strip_ties(st)


@query("p6_densify", "v_stitches", sql=f"WITH {RUNS} SELECT design_id, run, seq, k AS part, ROUND(x0 + (x1 - x0) * CAST(k AS DOUBLE) / n, 4) AS x, ROUND(y0 + (y1 - y0) * CAST(k AS DOUBLE) / n, 4) AS y FROM (SELECT *, UNNEST(RANGE(1, n + 1)) AS k FROM (SELECT *, GREATEST(1, CAST(CEIL(len / 7) AS BIGINT)) AS n FROM s) q) q")
def _(st):
    return r4(T.densify(st, 7), "x", "y").withColumn("part", F.col("part").cast("long"))


@query("w7_phase_labels", "v_stitches", sql=f"WITH {PHASES} SELECT design_id, block, run, seq, label FROM lb")
def _(st):
    return T.phase_labels(st).drop("len")


@query("w8_merge_short_phases", "v_stitches", sql=f"WITH {MERGED} SELECT design_id, block, run, phase, label, steps, ROUND(median_len, 4) AS median_len FROM ph")
def _(st):
    return r4(T.phases(st), "median_len")


ADVANCE = CLASSES + """, fs AS (SELECT s.*, ATAN2(CAST(y1 - y0 AS DOUBLE), CAST(x1 - x0 AS DOUBLE)) AS th FROM s JOIN c USING (design_id, run) WHERE c.kind = 'fill' AND len > 0),
fa AS (SELECT design_id, run, SUM(SIN(2 * th) * len) AS sn, SUM(COS(2 * th) * len) AS cs, SUM(len) AS l FROM fs GROUP BY 1, 2),
fb AS (SELECT *, SQRT(sn * sn + cs * cs) / l AS conc, ATAN2(sn, cs) / 2 AS axis FROM fa),
fc AS (SELECT fs.design_id, conc, ABS((x1 - x0) * COS(axis) + (y1 - y0) * SIN(axis)) / len AS along, ABS((y1 - y0) * COS(axis) - (x1 - x0) * SIN(axis)) AS across FROM fs JOIN fb USING (design_id, run)),
fd AS (SELECT design_id, MAX(conc) AS concentration, LIST_SORT(LIST(across) FILTER (ROUND(conc, 6) >= 0.6 AND ROUND(along, 6) < 0.707107 AND across > 0.000001)) AS st FROM fc GROUP BY 1)"""


@query("a14_row_advance", "v_stitches", sql=f"WITH {ADVANCE} SELECT design_id, COALESCE(LEN(st), 0) AS n, ROUND(CASE WHEN LEN(st) >= 1 THEN st[LEN(st) // 2 + 1] END, 4) AS advance, ROUND(concentration, 4) AS concentration FROM fd")
def _(st):
    return r4(T.row_advance(st, 1), "advance", "concentration")


SATIN = CLASSES + ", ss AS (SELECT s.* FROM s JOIN c USING (design_id, run) WHERE c.kind = 'satin')"


@query("a15_satin_advance", "v_stitches", sql=f"WITH {SATIN}, tw AS (SELECT r.design_id, SQRT(CAST(POW(LEAD(x_u, 2) OVER w - x_u, 2) + POW(LEAD(y_u, 2) OVER w - y_u, 2) AS DOUBLE)) AS two FROM r JOIN c USING (design_id, run) WHERE c.kind = 'satin' WINDOW w AS (PARTITION BY r.design_id, run ORDER BY seq)), tl AS (SELECT design_id, LIST_SORT(LIST(two) FILTER (two IS NOT NULL)) AS l FROM tw GROUP BY 1) SELECT design_id, COALESCE(LEN(l), 0) AS n, ROUND(CASE WHEN LEN(l) >= 5 THEN l[LEN(l) // 2 + 1] END, 4) AS advance FROM tl")
def _(st):
    return r4(T.satin_advance(st, 5), "advance")


@query("a21_lettering_small", "v_stitches", sql=f"WITH {SATIN}, e AS (SELECT design_id, run, {KTH.format(v='len', q=0.5)} AS col, GREATEST(MAX(GREATEST(x0, x1)) - MIN(LEAST(x0, x1)), MAX(GREATEST(y0, y1)) - MIN(LEAST(y0, y1))) AS ext FROM ss GROUP BY 1, 2) SELECT design_id, COUNT(*) FILTER (col < 24 OR ext < 30) AS small, COUNT(*) AS total, ROUND(MIN(col), 4) AS narrowest FROM e GROUP BY 1")
def _(st):
    return r4(T.small_lettering(st, 24, 30), "narrowest")


@query("a22_stitch_length", "v_stitches", sql=f"WITH {SATIN}, {runs_sql(hop=1 << 30, tag='w')}, q AS (SELECT design_id, COUNT(*) AS satin_steps, AVG(CASE WHEN len < 22 THEN 1 ELSE 0 END) AS sh FROM ss GROUP BY 1) SELECT d.design_id, d.too_long, ROUND(d.longest, 4) AS longest, COALESCE(satin_steps, 0) AS satin_steps, ROUND(CASE WHEN satin_steps >= 8 THEN sh END, 4) AS short_share FROM (SELECT design_id, COUNT(*) FILTER (len > 30) AS too_long, MAX(len) AS longest FROM sw GROUP BY 1) d LEFT JOIN q USING (design_id)")
def _(st):
    return r4(T.short_satin(st, 30, 22, 8), "longest", "short_share")


@query("a37_underlay_share", "v_stitches", sql=f"WITH {WHOLE}, k AS (SELECT * FROM s WHERE len > 0 AND len <= 121), {lines_sql(8, 'k', 'ROW_NUMBER() OVER (PARTITION BY design_id ORDER BY seq)')}, lt AS (SELECT design_id, cx, cy, MAX(idx) AS last, ARG_MAX(block, idx) AS lb FROM ln GROUP BY 1, 2, 3), e AS (SELECT design_id, idx, len, AVG(CASE WHEN last > idx + 3 AND lb = block THEN 1.0 ELSE 0.0 END) AS sh FROM ln JOIN lt USING (design_id, cx, cy) GROUP BY 1, 2, 3) SELECT design_id, ROUND(SUM(CASE WHEN ROUND(sh, 9) >= 0.3 THEN len ELSE 0 END) * 0.1, 3) AS underlay_mm, ROUND(SUM(len) * 0.1, 3) AS sewn_mm FROM e WHERE len >= 5 GROUP BY 1")
def _(st):
    u = T.underlay_share(st, 8, 3, 0.3)
    return u.select("design_id", F.round("underlay_mm", 3).alias("underlay_mm"), F.round("sewn_mm", 3).alias("sewn_mm"))


@query("a38_exposed_drag", "v_stitches", "v_stitches_b", sql=f"WITH {WHOLE}, k AS (SELECT * FROM s WHERE len > 0), {lines_sql(20, 'k', 'seq')}, hd AS (SELECT DISTINCT design_id, CAST(FLOOR(x_u / 20) AS BIGINT) AS cx, CAST(FLOOR(y_u / 20) AS BIGINT) AS cy FROM v_stitches_b WHERE cmd = 'stitch'), e AS (SELECT ln.design_id, ln.seq, len, AVG(CASE WHEN hd.cx IS NULL THEN 1.0 ELSE 0.0 END) AS f FROM ln LEFT JOIN hd ON ln.design_id = hd.design_id AND ln.cx = hd.cx AND ln.cy = hd.cy GROUP BY 1, 2, 3) SELECT design_id, ROUND(SUM(f * len) * 0.1, 3) AS drag_mm, COUNT(*) FILTER (ROUND(f, 9) > 0.5 AND len >= 20) AS walks, ROUND(MAX(f * len) * 0.1, 3) AS worst_mm FROM e GROUP BY 1")
def _(st, other):
    hidden = other.where("cmd = 'stitch'").select("design_id", F.floor(F.col("x_u") / 20).alias("cx"), F.floor(F.col("y_u") / 20).alias("cy"))
    d = T.exposed_drag(st, hidden, 20)
    return d.select("design_id", F.round("drag_mm", 3).alias("drag_mm"), "walks", F.round("worst_mm", 3).alias("worst_mm"))


@query("a44_trim_attribution", "v_stitches", sql=f"WITH {KINDS}, o AS (SELECT design_id, run, MIN(block) AS block FROM r GROUP BY 1, 2), e AS (SELECT k.design_id, block, COUNT(*) AS runs, COUNT(*) FILTER (break_kind = 'trim') AS trims, COUNT(*) FILTER (break_kind = 'jump') AS jumps, COUNT(*) FILTER (break_kind = 'hop') AS hops FROM k JOIN o ON k.design_id = o.design_id AND k.run = o.run GROUP BY 1, 2), p AS (SELECT *, SUM(trims) OVER (PARTITION BY design_id) AS tot, ROW_NUMBER() OVER (PARTITION BY design_id ORDER BY trims DESC, block) AS place FROM e) SELECT design_id, block, runs, trims, jumps, hops, ROUND(CASE WHEN tot > 0 THEN trims / tot END, 4) AS share, place FROM p WHERE place <= 8")
def _(st):
    return r4(T.trim_attribution(st), "share").withColumn("place", F.col("place").cast("long"))


@query("j13_elements", "v_stitches", sql=recursive(f"{RUNS}, {ELEMENTS} SELECT * FROM el"))
def _(st):
    return T.elements(st)


RECIPES = f"{MERGED}, {ELEMENTS}, o1 AS (SELECT ph.*, element, LAG(label) OVER (PARTITION BY ph.design_id, element ORDER BY ph.run, phase) AS before FROM ph JOIN el ON ph.design_id = el.design_id AND ph.run = el.run), o2 AS (SELECT design_id, element, STRING_AGG(label, '.' ORDER BY run, phase) AS recipe FROM o1 WHERE before IS NULL OR before <> label GROUP BY 1, 2)"


@query("x12_recipes", "v_stitches", sql=recursive(f"{RECIPES} SELECT * FROM o2"))
def _(st):
    return T.recipes(st)


@query("a19_recipe_census", "v_stitches", sql=recursive(f"{RECIPES} SELECT recipe, COUNT(*) AS elements FROM o2 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 18"))
def _(st):
    return T.recipe_census(st)


KEY = "SELECT DISTINCT design_id, x0, y0, x1, y1, n FROM (SELECT design_id, run, MIN(x_u) AS x0, MIN(y_u) AS y0, MAX(x_u) AS x1, MAX(y_u) AS y1, COUNT(*) AS n FROM {r} GROUP BY 1, 2) q"


@query("j20_lost_gained_runs", "v_stitches", sql=f"WITH a AS (SELECT * FROM v_stitches), b_ AS (SELECT design_id, seq, cmd, x_u + CASE WHEN design_id % 3 = 0 AND seq % 50 = 7 THEN 1 ELSE 0 END AS x_u, y_u FROM v_stitches), {runs_sql('a', tag='1')}, {runs_sql('b_', tag='2')}, ka AS ({KEY.format(r='r1')}), kb AS ({KEY.format(r='r2')}) SELECT *, 'lost' AS side FROM (SELECT * FROM ka EXCEPT SELECT * FROM kb) l UNION ALL SELECT *, 'gained' FROM (SELECT * FROM kb EXCEPT SELECT * FROM ka) g")
def _(st):
    moved = st.withColumn("x_u", F.col("x_u") + F.when((F.col("design_id") % 3 == 0) & (F.col("seq") % 50 == 7), 1).otherwise(0))
    return T.lost_and_gained(st, moved)


@query("q14_worksheet", "v_stitches", sql=f"""WITH {RUNS}, ps AS (SELECT design_id, COUNT(*) FILTER (cmd = 'stitch') AS stitches, COUNT(*) FILTER (cmd = 'color') AS color_changes, COUNT(*) FILTER (cmd = 'trim') AS trims,
 MAX(x_u) FILTER (cmd = 'stitch') - MIN(x_u) FILTER (cmd = 'stitch') AS w, MAX(y_u) FILTER (cmd = 'stitch') - MIN(y_u) FILTER (cmd = 'stitch') AS h FROM v_stitches GROUP BY 1), bl AS (SELECT DISTINCT design_id, block FROM s),
 th AS (SELECT design_id, STRING_AGG(CASE block % 3 WHEN 0 THEN 'Snow' WHEN 1 THEN 'Coal' ELSE 'Rose' END, ' > ' ORDER BY block) AS threads FROM bl GROUP BY 1)
SELECT ps.design_id, ROUND(w * 0.1, 2) AS width_mm, ROUND(h * 0.1, 2) AS height_mm, ROUND(w * (0.1 / 25.4), 2) AS width_in, ROUND(h * (0.1 / 25.4), 2) AS height_in, stitches, color_changes, trims, threads, CASE WHEN stitches > 580 THEN 'heavy' ELSE 'standard' END AS stabiliser FROM ps LEFT JOIN th USING (design_id)""")
def _(st):
    names = st.sparkSession.createDataFrame([(0, "Snow"), (1, "Coal"), (2, "Rose")], "place long, name string")
    return T.worksheet(st, names, 580)
