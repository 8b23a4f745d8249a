"""Queries over placements, shades, walks and regions of rasters."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import layout as Y
from ..operators import pixels as P
from ..operators import regions as R
from .catalogue_queries import lab_sql
from .colour_queries import de2000_sql
from .compare_queries import FORCED, SIG
from .pixel_queries import decide_sql
from .registry import query
from .stitch_queries import CLASSES, RUNS, SAMPLES, r4

C30, S30 = math.cos(math.radians(30)), math.sin(math.radians(30))


def place_sql(cos: float, sin: float, width: str, hoop: tuple[int, int], off: tuple[int, int]) -> str:
    at = lambda c, o: f"CAST(FLOOR(ROUND((t{c} - (lo{c} + hi{c}) / 2) * scale, 6) + 0.5) + {o} AS BIGINT) AS {c}_u"
    return f"""WITH t AS (SELECT design_id, seq, cmd, ROUND(x_u * CAST({cos!r} AS DOUBLE) - y_u * CAST({sin!r} AS DOUBLE), 6) AS tx, ROUND(x_u * CAST({sin!r} AS DOUBLE) + y_u * CAST({cos!r} AS DOUBLE), 6) AS ty FROM v_stitches),
e AS (SELECT design_id, MIN(tx) AS lox, MAX(tx) AS hix, MIN(ty) AS loy, MAX(ty) AS hiy FROM t WHERE cmd = 'stitch' GROUP BY 1),
z AS (SELECT *, GREATEST(0.1, (hix - lox) / 10) AS wide, GREATEST(0.1, (hiy - loy) / 10) AS high FROM e), z2 AS (SELECT *, LEAST(GREATEST({width}, 1.0), {hoop[0]}) / wide AS s1 FROM z),
z3 AS (SELECT *, CASE WHEN high * s1 > {hoop[1]} THEN {hoop[1]} / high ELSE s1 END AS scale FROM z2)
SELECT design_id, seq, cmd, {at('x', off[0])}, {at('y', off[1])} FROM t JOIN z3 USING (design_id) UNION ALL SELECT design_id, MAX(seq) + 1, 'end', {off[0]}, {off[1]} FROM v_stitches GROUP BY 1"""


@query("p2_place_design", "v_stitches", sql=place_sql(0.0, 1.0, "80.0", (100, 60), (25, -10)))
def _(st):
    return Y.place_design(st, 90, 80, (100, 60), (2.5, -1.0))


@query("p2_place_turned", "v_stitches", sql=place_sql(C30, S30, "wide", (130, 180), (0, 0)))
def _(st):
    return Y.place_design(st, 30, None, (130, 180))


ENDS = "en AS (SELECT design_id, run, ARG_MIN(x_u, seq) AS x0, ARG_MIN(y_u, seq) AS y0, ARG_MAX(x_u, seq) AS x1, ARG_MAX(y_u, seq) AS y1, MIN(block) AS block FROM r GROUP BY 1, 2)"


@query("w20_shade_blocks", "v_stitches", "v_threads", sql=f"""WITH {RUNS}, {ENDS}, k AS (SELECT *, CASE WHEN run % 4 = 0 THEN 7 ELSE run % 5 + 1 END AS key FROM en),
f AS (SELECT *, ROW_NUMBER() OVER o AS n, LAG(key) OVER (PARTITION BY design_id ORDER BY run) AS pk, SQRT(CAST(POW(x0 - LAG(x1) OVER o, 2) + POW(y0 - LAG(y1) OVER o, 2) AS DOUBLE)) AS gap FROM k WINDOW o AS (PARTITION BY design_id, key ORDER BY run))
SELECT f.design_id, DENSE_RANK() OVER (PARTITION BY f.design_id ORDER BY r * 2126 + g * 7152 + b * 722, key) - 1 AS block, run, key AS shade, n = 1 OR CASE WHEN pk <> key THEN gap >= 5 ELSE run % 3 = 0 END AS jump, n = 1 OR CASE WHEN pk <> key THEN gap >= 5 AND gap > 30 ELSE FALSE END AS trim
FROM f LEFT JOIN v_threads t ON t.thread_idx = key""")
def _(st, threads):
    ends = run_ends(st).withColumns({"shade": F.when(F.col("run") % 4 != 0, F.col("run") % 5 + 1), "base": F.lit(7), "jump": F.col("run") % 3 == 0, "trim": F.lit(False)})
    out = Y.shade_blocks(ends, threads.select(F.col("thread_idx").alias("shade"), (F.col("r") * 2126 + F.col("g") * 7152 + F.col("b") * 722).alias("light")))
    return out


def run_ends(st):
    """Both ends and the block of every run."""
    from ..operators.stream import runs

    return runs(st).groupBy("design_id", "run").agg(F.min_by("x_u", "seq").alias("x0"), F.min_by("y_u", "seq").alias("y0"), F.max_by("x_u", "seq").alias("x1"), F.max_by("y_u", "seq").alias("y1"), F.min("block").alias("block"))


@query("w11_travel_chains", "v_stitches", sql=f"""WITH {SAMPLES}, z AS (SELECT design_id, CAST(FLOOR(ROUND(x / 10, 6)) AS BIGINT) AS x, CAST(FLOOR(ROUND(y / 10, 6)) AS BIGINT) AS y, SUM(weight) * 0.1 AS mm FROM p GROUP BY 1, 2, 3),
dn AS (SELECT design_id, x + i AS cx, y + j AS cy, SUM(mm) / 9 AS density FROM z CROSS JOIN (VALUES (-1), (0), (1)) AS dx(i) CROSS JOIN (VALUES (-1), (0), (1)) AS dy(j) GROUP BY 1, 2, 3),
q0 AS (SELECT *, CAST(FLOOR(ROUND((x0 + x1) / 2.0 / 10, 6)) AS BIGINT) AS cx, CAST(FLOOR(ROUND((y0 + y1) / 2.0 / 10, 6)) AS BIGINT) AS cy, COUNT(*) OVER (PARTITION BY design_id, run) AS n FROM s),
q1 AS (SELECT q0.*, ROUND(COALESCE(density, 0), 6) < 1.5 AS bare FROM q0 LEFT JOIN dn USING (design_id, cx, cy)),
q2 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY design_id, run ORDER BY seq) - ROW_NUMBER() OVER (PARTITION BY design_id, run, bare ORDER BY seq) AS g FROM q1)
SELECT design_id, run, MIN(seq) AS first, COUNT(*) AS steps, ROUND(SUM(len) * 0.1, 4) AS mm, COUNT(*) < MAX(n) AND COUNT(*) <= 8 AND ROUND(SUM(len), 6) <= 120 AS travel FROM q2 WHERE bare GROUP BY design_id, run, g""")
def _(st):
    return r4(Y.travel_chains(st, 1.5), "mm")


@query("w12_transport", "v_stitches", sql=f"""WITH {CLASSES}, {ENDS}, k AS (SELECT en.design_id, en.block, en.run, CAST(FLOOR(en.x0 / 200.0) AS BIGINT) AS shape, COALESCE(kind IN ('run', 'lock'), FALSE) AS travel FROM en LEFT JOIN c ON c.design_id = en.design_id AND c.run = en.run),
w AS (SELECT *, LAST_VALUE(CASE WHEN NOT travel THEN shape END IGNORE NULLS) OVER (PARTITION BY design_id, block ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, FIRST_VALUE(CASE WHEN NOT travel THEN shape END IGNORE NULLS) OVER (PARTITION BY design_id, block ORDER BY run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM k)
SELECT design_id, block, run, before, after, travel AND NOT COALESCE(before = after AND shape = before, FALSE) AS transport FROM w""")
def _(st):
    from ..operators.stream import classify_runs

    kinds = classify_runs(st).select("design_id", "run", F.col("kind").isin("run", "lock").alias("travel"))
    runs = run_ends(st).hint("merge").join(kinds, ["design_id", "run"], "left").select("design_id", "block", "run", F.floor(F.col("x0") / 200).alias("shape"), F.coalesce("travel", F.lit(False)).alias("travel"))
    return Y.transport(runs)


FORMS = "(VALUES (0, 1, 0, 0, 1), (1, 0, -1, 1, 0), (2, -1, 0, 0, -1), (3, 0, 1, -1, 0), (4, -1, 0, 0, 1), (5, 1, 0, 0, -1), (6, 0, 1, 1, 0), (7, 0, -1, -1, 0)) AS fm(form, a, b, c, d)"


@query("q31_crossval", "v_stitches", "v_stitches_b", sql=f"""WITH t AS (SELECT p.design_id, form, p.x_u - (q.x_u * a + q.y_u * b) AS ex, p.y_u - (q.x_u * c + q.y_u * d) AS ey FROM v_stitches p JOIN v_stitches_b q ON p.design_id = q.design_id AND p.seq = q.seq CROSS JOIN {FORMS}),
m AS (SELECT design_id, form, FLOOR(AVG(ex) + 0.5) AS ox, FLOOR(AVG(ey) + 0.5) AS oy FROM t GROUP BY 1, 2), e AS (SELECT t.design_id, t.form, POW(ex - ox, 2) + POW(ey - oy, 2) AS e2 FROM t JOIN m ON t.design_id = m.design_id AND t.form = m.form),
g AS (SELECT design_id, form, ROUND(SQRT(AVG(e2)), 6) AS rms, ROUND(SQRT(MAX(e2)), 6) AS worst, COUNT(*) AS compared FROM e GROUP BY 1, 2)
SELECT design_id, form, rms, worst, compared FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY design_id ORDER BY rms, form) AS k FROM g) q WHERE k = 1""")
def _(a, b):
    at = lambda d: d.select("design_id", F.col("seq").alias("pos"), "x_u", "y_u")
    return Y.cross_validate(at(a), at(b))


@query("a29_subject_contrast", "v_pixels", sql=f"""WITH {lab_sql('v_pixels', 'z')}, s AS (SELECT image_id, QUANTILE_CONT(ll, 0.5) FILTER (label = 1) AS mid, COUNT(*) FILTER (label = 1) AS nb, COUNT(*) FILTER (label <> 1) AS nf FROM z GROUP BY 1),
o AS (SELECT z.image_id, QUANTILE_CONT(ABS(ll - mid), 0.9) AS p90 FROM z JOIN s ON z.image_id = s.image_id WHERE label <> 1 GROUP BY 1)
SELECT s.image_id, ROUND(CASE WHEN nb >= 195 AND nf >= 195 THEN p90 END, 4) AS contrast FROM s LEFT JOIN o ON s.image_id = o.image_id""")
def _(px):
    return r4(R.subject_contrast(px, F.col("label") == 1, 195), "contrast")


PHOTOS = f"{SIG}, z AS ({decide_sql('sig', 'CAST(0.28 AS DOUBLE)')})"


@query("q12_photo_rules", "v_signals", sql=f"""WITH {PHOTOS}, p AS (SELECT image_id, CAST(ucm * 30 AS DOUBLE) AS px, CAST(grad * 2 AS DOUBLE) AS ct, alpha > 0.5 AS face, CAST(60 + image_id % 80 AS DOUBLE) AS wd FROM z JOIN (SELECT image_id, alpha FROM v_signals) v USING (image_id) WHERE class IN ('photo_subject', 'photo_scene'))
SELECT image_id, 'coarse' AS code, 'warn' AS severity, px AS metric FROM p WHERE px < 10 UNION ALL SELECT image_id, 'contrast', 'warn', ct FROM p WHERE ct < 10 UNION ALL SELECT image_id, 'face_small', 'block', wd FROM p WHERE face AND wd <= 101.6""")
def _(s):
    d = P.decide(s)
    return R.photo_rules(d.select("image_id", F.col("class").isin("photo_subject", "photo_scene").alias("photo"), (F.col("ucm") * 30).alias("px_per_mm"), (F.col("grad") * 2).alias("contrast"), (F.col("alpha") > 0.5).alias("face"), (F.col("image_id") % 80 + 60).alias("width_mm")))


@query("q13_override_rules", "v_signals", "v_shapes", sql=f"""WITH {PHOTOS}, f AS (SELECT z.image_id, {FORCED} AS forced, class FROM z JOIN v_signals v ON v.image_id = z.image_id)
SELECT image_id, 'override:' || forced AS code, 1 AS count FROM f WHERE forced <> class UNION ALL SELECT design_id, 'unsewn', COUNT(*) FROM v_shapes WHERE NOT stitched GROUP BY 1""")
def _(s, shapes):
    warnings = shapes.where("not stitched").select(F.col("design_id").alias("image_id"), F.lit("unsewn").alias("code"), F.lit(1).alias("count"))
    return R.override_rules(P.decide(s).withColumn("forced", F.expr(FORCED)), warnings)


@query("a59_region_classes", "v_pixels", sql="""SELECT image_id, label, CASE WHEN AVG(CAST(r > 200 AS INT)) >= 0.5 THEN 'eyes' WHEN AVG(CAST(g > 150 AS INT)) >= 0.5 THEN 'skin' WHEN AVG(CAST(b > 125 AS INT)) >= 0.5 THEN 'background' ELSE 'subject' END AS class FROM v_pixels GROUP BY 1, 2""")
def _(px):
    return R.region_classes(px, {"eyes": F.col("r") > 200, "skin": F.col("g") > 150, "background": F.col("b") > 125})


@query("q28_split_tonal", "v_pixels", sql=f"""WITH op AS (SELECT * FROM v_pixels WHERE a > 127), {lab_sql('op', 'pl')}, ct AS (SELECT image_id, label, COUNT(*) AS n, QUANTILE_CONT(ll, 0.05) AS lo, QUANTILE_CONT(ll, 0.95) AS hi, QUANTILE_CONT(ll, 0.25) AS q1, QUANTILE_CONT(ll, 1.0 / 3) AS t1, QUANTILE_CONT(ll, 0.5) AS q2, QUANTILE_CONT(ll, 2.0 / 3) AS t2, QUANTILE_CONT(ll, 0.75) AS q3 FROM pl GROUP BY 1, 2),
bn AS (SELECT image_id, label, n, AVG(ll) FILTER (ROUND(ll, 9) <= ROUND(lo, 9)) AS l1, AVG(aa) FILTER (ROUND(ll, 9) <= ROUND(lo, 9)) AS a1, AVG(bb) FILTER (ROUND(ll, 9) <= ROUND(lo, 9)) AS b1,
 AVG(ll) FILTER (ROUND(ll, 9) >= ROUND(hi, 9)) AS l2, AVG(aa) FILTER (ROUND(ll, 9) >= ROUND(hi, 9)) AS a2, AVG(bb) FILTER (ROUND(ll, 9) >= ROUND(hi, 9)) AS b2 FROM pl JOIN ct USING (image_id, label) GROUP BY 1, 2, 3), {de2000_sql('bn', 'd')},
sp AS (SELECT image_id, label, LEAST(GREATEST(CAST(FLOOR(ROUND(de / 25, 6) + 0.5) AS BIGINT), 2), 4) AS parts FROM d WHERE n >= 150 AND ROUND(de, 6) >= 18),
u AS (SELECT image_id, label, y, x, parts, ROUND(ll, 9) AS v, ROUND(q1, 9) AS q1, ROUND(t1, 9) AS t1, ROUND(q2, 9) AS q2, ROUND(t2, 9) AS t2, ROUND(q3, 9) AS q3 FROM pl JOIN sp USING (image_id, label) JOIN ct USING (image_id, label))
SELECT image_id, label, y, x, parts, CASE parts WHEN 2 THEN CAST(v >= q2 AS INT) WHEN 3 THEN CAST(v >= t1 AS INT) + CAST(v >= t2 AS INT) ELSE CAST(v >= q1 AS INT) + CAST(v >= q2 AS INT) + CAST(v >= q3 AS INT) END AS part FROM u""")
def _(px):
    return R.split_tonal(px, part=25)


@query("a51_boundary_distance", "v_pixels", sql="""WITH m AS (SELECT image_id, y, x, a > 127 AND label = 0 AS ina, a > 127 AND label = 2 AND image_id % 7 <> 3 AS inb FROM v_pixels),
nb AS (SELECT p.image_id, p.y, p.x, COUNT(*) FILTER (q.ina) AS ca, COUNT(*) FILTER (q.inb) AS cb FROM m p JOIN m q ON p.image_id = q.image_id AND ABS(p.y - q.y) <= 1 AND ABS(p.x - q.x) <= 1 GROUP BY 1, 2, 3),
e AS (SELECT m.*, ina AND ca < 9 AS oa, inb AND cb < 9 AS ob FROM m JOIN nb USING (image_id, y, x)),
d AS (SELECT p.image_id, 0 AS side, p.y, p.x, MIN(POW(p.y - q.y, 2) + POW(p.x - q.x, 2)) AS d2 FROM e p JOIN e q ON p.image_id = q.image_id WHERE p.oa AND q.ob GROUP BY 1, 2, 3, 4
 UNION ALL SELECT p.image_id, 1, p.y, p.x, MIN(POW(p.y - q.y, 2) + POW(p.x - q.x, 2)) FROM e p JOIN e q ON p.image_id = q.image_id WHERE p.ob AND q.oa GROUP BY 1, 2, 3, 4),
g AS (SELECT image_id, MAX(SQRT(d2)) AS h, AVG(SQRT(d2)) AS m FROM d GROUP BY 1) SELECT i.image_id, ROUND(h, 4) AS hausdorff, ROUND(g.m, 4) AS mean FROM (SELECT DISTINCT image_id FROM v_pixels) i LEFT JOIN g ON g.image_id = i.image_id""")
def _(px):
    seen = px.where("a > 127")
    return r4(R.boundary_distance(seen.where("label = 0"), seen.where("label = 2 and image_id % 7 <> 3"), px), "hausdorff", "mean")


@query("u13_phantom_colours", "v_pixels", sql=f"""WITH o AS (SELECT * FROM v_pixels WHERE a > 127), {lab_sql('o', 'z')}, eg AS (SELECT p.image_id, p.y, p.x, COUNT(q.label) > 0 AS edge FROM o p LEFT JOIN o q ON p.image_id = q.image_id AND ABS(p.y - q.y) + ABS(p.x - q.x) = 1 AND p.label <> q.label GROUP BY 1, 2, 3),
g AS (SELECT image_id, label, ROUND(AVG(CAST(edge AS INT)), 9) AS edges, AVG(ll) AS l, AVG(aa) AS a, AVG(bb) AS b FROM z JOIN eg USING (image_id, y, x) GROUP BY 1, 2),
t AS (SELECT j.image_id, j.label, j.l - p.l AS jl, j.a - p.a AS ja, j.b - p.b AS jb, q.l - p.l AS al, q.a - p.a AS aa, q.b - p.b AS ab FROM g j JOIN g p ON j.image_id = p.image_id AND p.label <> j.label JOIN g q ON j.image_id = q.image_id AND q.label <> j.label AND p.label < q.label WHERE j.edges >= 0.7),
t2 AS (SELECT *, (jl * al + ja * aa + jb * ab) / (al * al + aa * aa + ab * ab) AS t FROM t WHERE al * al + aa * aa + ab * ab > 0),
gone AS (SELECT DISTINCT image_id, label FROM t2 WHERE ROUND(t, 6) > 0.15 AND ROUND(t, 6) < 0.85 AND ROUND(SQRT(POW(jl - t * al, 2) + POW(ja - t * aa, 2) + POW(jb - t * ab, 2)), 6) < 6),
nr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id, label ORDER BY d, dest) AS k FROM (SELECT g.image_id, g.label, k.label AS dest, ROUND(SQRT(POW(g.l - k.l, 2) + POW(g.a - k.a, 2) + POW(g.b - k.b, 2)), 6) AS d FROM g JOIN gone USING (image_id, label) JOIN (SELECT g.* FROM g ANTI JOIN gone USING (image_id, label)) k ON k.image_id = g.image_id) q)
SELECT g.image_id, g.label, COALESCE(dest, g.label) AS to_label FROM g LEFT JOIN nr ON nr.image_id = g.image_id AND nr.label = g.label AND nr.k = 1""")
def _(px):
    return R.phantom_colours(px, 0.7)


REJECTED = "rj AS (SELECT CASE layer WHEN 1 THEN 'short' WHEN 2 THEN 'wide' ELSE 'ratio' END AS reason, w_u * h_u AS cells, CAST(w_u AS DOUBLE) / h_u AS margin FROM v_shapes WHERE NOT stitched)"


@query("a40_gate_attribution", "v_shapes", sql=f"WITH {REJECTED}, g AS (SELECT reason, COUNT(*) AS shapes, SUM(cells) AS cells, QUANTILE_CONT(margin, 0.5) AS median, QUANTILE_CONT(margin, 0.9) AS p90 FROM rj GROUP BY 1) SELECT reason, shapes, CAST(cells AS BIGINT) AS cells, ROUND(median, 4) AS median, ROUND(p90, 4) AS p90, ROUND(cells / SUM(cells) OVER (), 4) AS share FROM g")
def _(s):
    reason = F.when(F.col("layer") == 1, "short").when(F.col("layer") == 2, "wide").otherwise("ratio")
    rejected = s.where("not stitched").select(reason.alias("reason"), (F.col("w_u") * F.col("h_u")).alias("cells"), (F.col("w_u") / F.col("h_u")).alias("margin"))
    return r4(R.gate_attribution(rejected), "median", "p90", "share")


@query("a41_straddle_patterns", "v_shapes", sql="""WITH p AS (SELECT CASE shape_id % 4 WHEN 0 THEN 'pure' WHEN 1 THEN 'ring' WHEN 2 THEN 'split' ELSE 'speckle' END AS pattern, w_u * h_u AS cells FROM v_shapes)
SELECT pattern, COUNT(*) AS shapes, CAST(SUM(cells) AS BIGINT) AS cells, ROUND(SUM(cells) / (SELECT SUM(cells) FROM p), 4) AS share FROM p GROUP BY ROLLUP (pattern)""")
def _(s):
    k = F.col("shape_id") % 4
    pattern = F.when(k == 0, "pure").when(k == 1, "ring").when(k == 2, "split").otherwise("speckle")
    return r4(R.straddle_patterns(s.select(pattern.alias("pattern"), (F.col("w_u") * F.col("h_u")).alias("cells"))), "share")
