"""Queries over thread laid in cells: coverage, stacking, bare artwork, colour surfaces, registration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage as V
from . import qc
from .registry import query
from .stitch_queries import RUNS, SAMPLES, r4
from .technique_queries import TIES, lines_sql, recursive

WR = "WINDOW w AS (PARTITION BY design_id, run ORDER BY seq)"


def ribbon_sql(cell: int) -> str:
    """Common table expressions up to grid: two ribbons a quarter width off every sample of every untied step."""
    at = lambda c, d, e, s: f"CAST(FLOOR(ROUND(({c}0 + {d} * (i + 0.5) / np {s} {e} / len * off) / {cell}, 6)) AS BIGINT)"
    return f"""{RUNS}, {TIES}, tp AS (SELECT design_id, run, UNNEST(qs) AS seq, UNNEST(xs) AS x, UNNEST(ys) AS y FROM t1),
ts AS (SELECT *, LAG(x) OVER w AS x0, LAG(y) OVER w AS y0, CAST(x - LAG(x) OVER w AS DOUBLE) AS dx, CAST(y - LAG(y) OVER w AS DOUBLE) AS dy, COUNT(*) OVER (PARTITION BY design_id, run) AS n FROM tp {WR}),
tu AS (SELECT *, SQRT(dx * dx + dy * dy) AS len FROM ts),
tv AS (SELECT *, CASE WHEN len * LAG(len) OVER w > 0 THEN (dx * LAG(dx) OVER w + dy * LAG(dy) OVER w) / (len * LAG(len) OVER w) END AS cos FROM tu {WR}),
tc AS (SELECT design_id, run, COUNT(cos) AS turns, COUNT(*) FILTER (cos < -0.5) AS back FROM tv GROUP BY 1, 2),
tw AS (SELECT tv.*, CASE WHEN n >= 4 AND turns >= 3 AND back >= turns * 0.75 THEN 0.5 ELSE 1.0 END AS weight FROM tv JOIN tc USING (design_id, run) WHERE len > 0),
tx AS (SELECT *, UNNEST(RANGE(np)) AS i FROM (SELECT *, GREATEST(1, CAST(CEIL(ROUND(len, 9)) AS BIGINT)) AS np FROM tw) q),
grid AS (SELECT design_id, {at('x', 'dx', 'dy', '-')} AS cx, {at('y', 'dy', 'dx', '+')} AS cy, SUM(len / np * 4 * weight / 2) / {cell * cell} AS units FROM tx CROSS JOIN (VALUES (CAST(-1 AS DOUBLE)), (1)) AS o(off) GROUP BY 1, 2, 3)"""


def patch_sql(src: str, key: str, least: int) -> str:
    """Patches pa of the cells of `src` under equal (design_id, key)."""
    return f"""rr AS (SELECT design_id, {key}, cx, cy, cy * 100000 + cx AS start FROM {src} UNION SELECT n.design_id, n.{key}, n.cx, n.cy, r.start FROM rr r JOIN {src} n ON n.design_id = r.design_id AND n.{key} = r.{key} AND ABS(n.cx - r.cx) <= 1 AND ABS(n.cy - r.cy) <= 1),
ro AS (SELECT design_id, {key}, cx, cy, MIN(start) AS root FROM rr GROUP BY 1, 2, 3, 4), pa AS (SELECT design_id, {key}, root, COUNT(*) AS cells FROM ro GROUP BY 1, 2, 3 HAVING COUNT(*) >= {least})"""


@query("a9_coverage_grid", "v_stitches", sql=recursive(f"{ribbon_sql(10)} SELECT design_id, cx, cy, ROUND(units, 4) AS units FROM grid"))
def _(st):
    return r4(V.ribbon_grid(st), "units")


STACK = f"""{ribbon_sql(10)}, oc AS (SELECT design_id, 'warn' AS level, cx, cy FROM grid WHERE ROUND(units, 6) >= 1.5 UNION ALL SELECT design_id, 'block', cx, cy FROM grid WHERE ROUND(units, 6) >= 2.5), {patch_sql('oc', 'level', 3)},
mt AS (SELECT design_id, QUANTILE_CONT(units, 0.5) AS p50, QUANTILE_CONT(units, 0.95) AS p95, MAX(units) AS most, CAST(COUNT(*) AS DOUBLE) AS area_mm2 FROM grid WHERE ROUND(units, 6) >= 0.25 GROUP BY 1),
ov AS (SELECT design_id, CAST(SUM(cells) FILTER (level = 'warn') AS DOUBLE) AS wm, CAST(SUM(cells) FILTER (level = 'block') AS DOUBLE) AS bm FROM pa GROUP BY 1),
sk AS (SELECT mt.*, COALESCE(wm, 0.0) AS over_warn_mm2, COALESCE(bm, 0.0) AS over_block_mm2 FROM mt LEFT JOIN ov USING (design_id))"""


@query("a10_coverage_metrics", "v_stitches", sql=recursive(f"{STACK} SELECT design_id, ROUND(p50, 4) AS p50, ROUND(p95, 4) AS p95, ROUND(most, 4) AS most, area_mm2, over_warn_mm2, over_block_mm2 FROM sk"))
def _(st):
    return r4(V.stacking(V.ribbon_grid(st), 1.5, 2.5, patch_mm2=3), "p50", "p95", "most")


@query("q6_stacking_rule", "v_stitches", sql=recursive(f"{STACK} SELECT design_id, 'stacked' AS code, CASE WHEN over_block_mm2 > 0 THEN 'block' ELSE 'warn' END AS severity, CASE WHEN over_block_mm2 > 0 THEN over_block_mm2 ELSE over_warn_mm2 END AS metric FROM sk WHERE over_warn_mm2 > 0 OR over_block_mm2 > 0"))
def _(st):
    return qc.stacking_rule(st, qc.Limits(stacked=1.5, overstacked=2.5, patch_mm2=3))


CLAIMED = """dz AS (SELECT DISTINCT design_id FROM v_stitches), bx AS (SELECT s.* FROM v_shapes s JOIN dz USING (design_id)),
c1 AS (SELECT *, UNNEST(RANGE(CAST(CEIL((cx_u - w_u) / 20.0 - 0.5) AS BIGINT), CAST(FLOOR((cx_u + w_u) / 20.0 - 0.5) AS BIGINT) + 1)) AS cx FROM bx),
c2 AS (SELECT *, UNNEST(RANGE(CAST(CEIL((cy_u - h_u) / 20.0 - 0.5) AS BIGINT), CAST(FLOOR((cy_u + h_u) / 20.0 - 0.5) AS BIGINT) + 1)) AS cy FROM c1),
wanted AS (SELECT design_id, cx, cy, shape_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY design_id, cx, cy ORDER BY w_u * h_u, shape_id) AS k FROM c2) q WHERE k = 1),
bare AS (SELECT w.* FROM wanted w LEFT JOIN (SELECT * FROM grid WHERE ROUND(units, 6) >= 0.25) g ON w.design_id = g.design_id AND w.cx = g.cx AND w.cy = g.cy WHERE g.units IS NULL)"""


def _wanted(st, s):
    return V.claimed_cells(s.join(st.select("design_id").distinct(), "design_id", "left_semi"), 20)


@query("j18_uncovered_cells", "v_stitches", "v_shapes", sql=recursive(f"{ribbon_sql(20)}, {CLAIMED} SELECT design_id, cx, cy, shape_id FROM bare"))
def _(st, s):
    return V.bare_cells(_wanted(st, s), V.ribbon_grid(st, 20))


@query("q7_uncovered_rule", "v_stitches", "v_shapes", sql=recursive(f"{ribbon_sql(20)}, {CLAIMED}, {patch_sql('bare', 'shape_id', 2)} SELECT design_id, shape_id, COUNT(*) AS patches, CAST(SUM(cells) * 4 AS DOUBLE) AS area_mm2, CAST(MAX(cells) * 4 AS DOUBLE) AS largest_mm2 FROM pa GROUP BY 1, 2"))
def _(st, s):
    return V.uncovered(_wanted(st, s), V.ribbon_grid(st, 20), 20)


@query("a11_thread_density", "v_stitches", sql=f"""WITH {SAMPLES}, z AS (SELECT design_id, CAST(FLOOR(ROUND(x / 10, 6)) AS BIGINT) AS x, CAST(FLOOR(ROUND(y / 10, 6)) AS BIGINT) AS y, SUM(weight) * 0.1 AS mm FROM p GROUP BY 1, 2, 3)
SELECT design_id, x + i AS cx, y + j AS cy, ROUND(SUM(mm) / 9, 4) AS density FROM z CROSS JOIN (VALUES (-1), (0), (1)) AS dx(i) CROSS JOIN (VALUES (-1), (0), (1)) AS dy(j) GROUP BY 1, 2, 3""")
def _(st):
    return r4(V.thread_density(st), "density")


@query("a58_opacity", "v_pixels", sql="""WITH z AS (SELECT image_id, y + j AS y, x + i AS x, COUNT(*) / 9 AS share FROM v_pixels CROSS JOIN (VALUES (-1), (0), (1)) AS dx(i) CROSS JOIN (VALUES (-1), (0), (1)) AS dy(j) WHERE a > 127 AND label <> 1 GROUP BY 1, 2, 3)
SELECT image_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, ROUND(share, 4) AS share FROM z WHERE share >= 0.55""")
def _(px):
    return r4(V.opaque(px.where("a > 127 and label <> 1"), 1), "share").withColumns({c: F.col(c).cast("long") for c in "yx"})


def surface_sql(view: str, tag: str, cell: int) -> str:
    """su{tag}: the block that shows in each cell."""
    from .stitch_queries import runs_sql

    body = lines_sql(cell, f"k{tag}", "seq").replace("l0", f"l0{tag}").replace("l1", f"l1{tag}").replace("ln AS", f"ln{tag} AS")
    return f"{runs_sql(view, 75, tag)}, k{tag} AS (SELECT * FROM s{tag} WHERE len > 0), {body}, su{tag} AS (SELECT design_id, cx, cy, ARG_MAX(block, seq) AS block FROM ln{tag} GROUP BY 1, 2, 3)"


SURFACES = surface_sql("v_stitches", "a", 20) + ", " + surface_sql("v_stitches_b", "z", 20) + ", bt AS (SELECT p.design_id, p.block AS pro, q.block AS ours FROM sua p LEFT JOIN suz q ON p.design_id = q.design_id AND p.cx = q.cx AND p.cy = q.cy)"


@query("q17_colour_surface", "v_stitches", "v_stitches_b", sql=f"WITH {SURFACES} SELECT design_id, COUNT(*) AS cells, ROUND(AVG(CAST(pro = ours AS INT)), 4) AS agreement FROM bt WHERE ours IS NOT NULL GROUP BY 1")
def _(a, b):
    return r4(V.colour_surface(V.box_cover(a, 20), V.box_cover(b, 20))[0], "agreement")


@query("q17_colour_recall", "v_stitches", "v_stitches_b", sql=f"WITH {SURFACES} SELECT design_id, pro AS block, COUNT(*) AS cells, ROUND(AVG(COALESCE(CAST(pro = ours AS INT), 0)), 4) AS recall FROM bt GROUP BY 1, 2 HAVING COUNT(*) >= 15")
def _(a, b):
    return r4(V.colour_surface(V.box_cover(a, 20), V.box_cover(b, 20))[1], "recall")


@query("q16_registration", "v_stitches", "v_stitches_b", sql=f"""WITH {SURFACES}, mv AS (SELECT i, j FROM (VALUES (-2), (-1), (0), (1), (2)) AS p(i) CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) AS q(j)),
ht AS (SELECT z.design_id, i, j, COUNT(a.cx) AS c, COUNT(*) AS nb FROM suz z CROSS JOIN mv LEFT JOIN sua a ON a.design_id = z.design_id AND a.cx = z.cx + i AND a.cy = z.cy + j GROUP BY 1, 2, 3), na AS (SELECT design_id, COUNT(*) AS na FROM sua GROUP BY 1),
rk AS (SELECT design_id, i, j, ROUND(CAST(c AS DOUBLE) / (na + nb - c), 9) AS iou FROM ht JOIN na USING (design_id))
SELECT design_id, i AS dx, j AS dy, iou FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY design_id ORDER BY iou DESC, i * i + j * j, i, j) AS k FROM rk) q WHERE k = 1""")
def _(a, b):
    return V.best_shift(V.box_cover(a, 20), V.box_cover(b, 20))
