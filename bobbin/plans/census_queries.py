"""Queries over what a corpus is made of and over bare stretches of rings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import census as C
from ..operators.stream import runs
from .registry import query
from .stitch_queries import CLASSES, KTH, RUNS, r4
from .technique_queries import ELEMENTS, MERGED, RECIPES, recursive

FILLS = CLASSES + """, f0 AS (SELECT s.*, CASE WHEN len > 10 THEN CAST(ROUND(((DEGREES(ATAN2(CAST(y1 - y0 AS DOUBLE), CAST(x1 - x0 AS DOUBLE))) + 360) % 180) / 5) * 5 AS INT) % 180 END AS bin FROM s JOIN c USING (design_id, run) WHERE c.kind = 'fill'),
f1 AS (SELECT design_id, run, bin AS angle FROM (SELECT design_id, run, bin, ROW_NUMBER() OVER (PARTITION BY design_id, run ORDER BY COUNT(*) DESC, bin) AS k FROM f0 WHERE bin IS NOT NULL GROUP BY 1, 2, 3) q WHERE k = 1),
f2 AS (SELECT f0.*, angle, ROUND(x0 * COS(RADIANS(angle)) + y0 * SIN(RADIANS(angle)), 6) AS t0, ROUND(x1 * COS(RADIANS(angle)) + y1 * SIN(RADIANS(angle)), 6) AS t1, y0 * COS(RADIANS(angle)) - x0 * SIN(RADIANS(angle)) AS o0, y1 * COS(RADIANS(angle)) - x1 * SIN(RADIANS(angle)) AS o1 FROM f0 JOIN f1 USING (design_id, run)),
f3 AS (SELECT *, CASE WHEN len > 10 AND t1 <> t0 THEN SIGN(t1 - t0) END AS way FROM f2),
f4 AS (SELECT *, LAST_VALUE(way IGNORE NULLS) OVER (PARTITION BY design_id, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pw FROM f3),
f5 AS (SELECT *, SUM(CASE WHEN way <> pw THEN 1 ELSE 0 END) OVER (PARTITION BY design_id, run ORDER BY seq) AS rw FROM f4),
f6 AS (SELECT design_id, run, rw, MIN(angle) AS angle, COUNT(*) + 1 AS pts, (SUM(o1) + ARG_MIN(o0, seq)) / (COUNT(*) + 1) AS ctr, LIST_SORT(LIST_APPEND(LIST(t1), ARG_MIN(t0, seq)))[(COUNT(*) + 1) // 2 + 1] AS mid FROM f5 GROUP BY 1, 2, 3),
f7 AS (SELECT *, ABS(ctr - LAG(ctr) OVER (PARTITION BY design_id, run ORDER BY rw)) AS gap FROM f6),
f8 AS (SELECT design_id, run, MIN(angle) AS angle, COUNT(*) AS rows, LIST_SORT(LIST(ROUND(gap, 6)) FILTER (gap > 0.5 AND gap < 30)) AS gaps FROM f7 GROUP BY 1, 2 HAVING COUNT(*) >= 3),
f9 AS (SELECT design_id, run, LIST_SORT(LIST(len))[COUNT(*) // 2 + 1] AS step FROM f5 WHERE len > 10 GROUP BY 1, 2),
g0 AS (SELECT f6.design_id, f6.run, rw, CAST(ROUND(((mid % ROUND(step, 6)) + ROUND(step, 6)) % ROUND(step, 6) / ROUND(step, 6) * 100) AS INT) AS ph FROM f6 JOIN f9 USING (design_id, run) WHERE rw < 24 AND pts > 2),
g1 AS (SELECT *, LAG(ph) OVER w AS pp, ROW_NUMBER() OVER w AS k FROM g0 WINDOW w AS (PARTITION BY design_id, run ORDER BY rw)),
g2 AS (SELECT design_id, run, STRING_AGG(CAST((ph - pp + 200) % 100 AS VARCHAR), ',' ORDER BY rw) AS stagger FROM g1 WHERE pp IS NOT NULL AND k <= 13 GROUP BY 1, 2)"""


@query("a17_fill_stats", "v_stitches", sql=f"WITH {FILLS} SELECT f8.design_id, f8.run, angle, rows, ROUND(CASE WHEN LEN(gaps) > 0 THEN gaps[LEN(gaps) // 2 + 1] END, 4) AS row_gap, ROUND(step, 4) AS step, COALESCE(stagger, '') AS stagger FROM f8 JOIN f9 USING (design_id, run) LEFT JOIN g2 USING (design_id, run)")
def _(st):
    return r4(C.fill_stats(st), "row_gap", "step").withColumn("stagger", F.array_join("stagger", ","))


def ranks_sql(qs: dict[str, float]) -> str:
    return ", ".join(f"{KTH.format(v='v', q=q)} AS {k}" for k, q in qs.items())


UNDER = f"""un AS (SELECT CASE WHEN z THEN 'with zigzag' ELSE 'no zigzag' END AS name, ROUND(w, 4) AS v FROM (SELECT ph.design_id, element, BOOL_OR(label = 'Z') AS z, ARG_MAX(median_len, ph.run * 1000000 + phase) FILTER (label = 'S' AND steps >= 8) AS w FROM ph JOIN el ON ph.design_id = el.design_id AND ph.run = el.run GROUP BY 1, 2) q WHERE w IS NOT NULL)"""
LENGTHS = """sl AS (SELECT i2.label AS name, ROUND(len, 4) AS v FROM i0 JOIN i2 ON i0.design_id = i2.design_id AND i0.run = i2.run AND i0.i >= lo AND i0.i < till WHERE len > 0.3)"""


#: Recipes with the parts that several sections read worked out once.
ONCE = RECIPES.replace(" el AS (", " el AS MATERIALIZED (").replace("\nel AS (", "\nel AS MATERIALIZED (").replace("\nph AS (", "\nph AS MATERIALIZED (").replace("\ni0 AS (", "\ni0 AS MATERIALIZED (").replace("\ni2 AS (", "\ni2 AS MATERIALIZED (")


@query("a20_underlay_by_width", "v_stitches", sql=recursive(f"{MERGED}, {ELEMENTS}, {UNDER} SELECT name AS under, COUNT(*) AS n, {ranks_sql({'p10': 0.1, 'median': 0.5, 'p90': 0.9})}, MAX(v) AS most FROM un GROUP BY 1"))
def _(st):
    return C.underlay_by_width(st)


@query("q19_corpus_census", "v_stitches", sql=recursive(f"""{ONCE}, {UNDER}, {LENGTHS}
SELECT * FROM (SELECT 'recipe' AS section, recipe AS name, COUNT(*) AS n, CAST(NULL AS DOUBLE) AS p10, CAST(NULL AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS p90, CAST(NULL AS DOUBLE) AS most FROM o2 GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 18) q
UNION ALL SELECT 'underlay', name, COUNT(*), {ranks_sql({'p10': 0.1, 'median': 0.5, 'p90': 0.9})}, MAX(v) FROM un GROUP BY 2
UNION ALL SELECT 'length', name, COUNT(*), NULL, {ranks_sql({'median': 0.5, 'p90': 0.9})}, MAX(v) FROM sl GROUP BY 2"""))
def _(st):
    return C.corpus_census(st)


@query("w13_bare_arcs", "v_stitches", "v_stitches_b", sql=f"""WITH {RUNS}, th AS (SELECT DISTINCT design_id, FLOOR(x_u / 10.0) AS cx, FLOOR(y_u / 10.0) AS cy FROM v_stitches_b WHERE cmd = 'stitch'),
rg AS (SELECT r.design_id, r.run, ROW_NUMBER() OVER w - 1 AS i, COUNT(*) OVER (PARTITION BY r.design_id, run) AS n, x_u, y_u, th.cx IS NULL AS bare FROM r LEFT JOIN th ON r.design_id = th.design_id AND FLOOR(x_u / 10.0) = th.cx AND FLOOR(y_u / 10.0) = th.cy WINDOW w AS (PARTITION BY r.design_id, run ORDER BY seq)),
fs AS (SELECT design_id, run, MIN(i) FILTER (NOT bare) AS cut FROM rg GROUP BY 1, 2),
ro AS (SELECT rg.*, (i - COALESCE(cut, 0) + n) % n AS j, i AS pos FROM rg JOIN fs USING (design_id, run)),
rb AS (SELECT *, j - ROW_NUMBER() OVER (PARTITION BY design_id, run, bare ORDER BY j) AS isl FROM ro),
rs AS (SELECT *, CASE WHEN LEAD(j) OVER w = j + 1 THEN SQRT(CAST(POW(LEAD(x_u) OVER w - x_u, 2) + POW(LEAD(y_u) OVER w - y_u, 2) AS DOUBLE)) ELSE 0 END AS step FROM rb WHERE bare WINDOW w AS (PARTITION BY design_id, run, isl ORDER BY j)),
ra AS (SELECT design_id, run, isl, MIN(j) AS j0, ARG_MIN(pos, j) AS first, COUNT(*) AS places, SUM(step) AS length FROM rs GROUP BY 1, 2, 3)
SELECT design_id, run, ROW_NUMBER() OVER (PARTITION BY design_id, run ORDER BY first) AS arc, places, ROUND(length, 4) AS length FROM ra""")
def _(a, b):
    cell = lambda c: F.floor(F.col(c) / 10)
    thread = b.where("cmd = 'stitch'").select("design_id", cell("x_u").alias("cx"), cell("y_u").alias("cy"), F.lit(True).alias("hit")).distinct()
    r = runs(a).withColumns({"cx": cell("x_u"), "cy": cell("y_u")}).hint("merge").join(thread, ["design_id", "cx", "cy"], "left")
    rings = r.select("design_id", "run", F.col("seq").alias("i"), F.col("x_u").alias("x"), F.col("y_u").alias("y"), F.col("hit").isNull().alias("bare"))
    return r4(C.bare_arcs(rings, ["design_id", "run"]), "length")
