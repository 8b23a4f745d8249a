"""Corners of runs, taken as spines of a column two millimetres wide."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.spines import spine_corners
from ..operators.stream import runs
from .registry import query
from .stitch_queries import RUNS, r4


@query("w10_spine_corners", "v_stitches", sql="WITH RECURSIVE " + RUNS + """, sp AS (SELECT design_id, run, ROW_NUMBER() OVER (PARTITION BY design_id, run ORDER BY seq) - 1 AS i, x_u AS x, y_u AS y FROM r),
s2 AS (SELECT *, SQRT(POW(LEAD(x) OVER w - x, 2) + POW(LEAD(y) OVER w - y, 2)) AS step, COUNT(*) OVER (PARTITION BY design_id, run) AS n FROM sp WINDOW w AS (PARTITION BY design_id, run ORDER BY i)),
s3 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY design_id, run ORDER BY step ASC NULLS LAST) - 1 AS rk FROM s2), s4 AS (SELECT *, MAX(CASE WHEN rk = FLOOR((n - 1) / 2) THEN step END) OVER (PARTITION BY design_id, run) AS med FROM s3),
s5 AS (SELECT *, GREATEST(1, CAST(ROUND_EVEN(ROUND(20 / med, 9), 0) AS BIGINT)) AS k FROM s4 WHERE n >= 5 AND med > 0), s6 AS (SELECT * FROM s5 WHERE n > 2 * k),
tu AS (SELECT p.design_id, p.run, p.i, p.k, DEGREES(ATAN2(c.y - p.y, c.x - p.x) - ATAN2(p.y - a.y, p.x - a.x)) + 180 AS t FROM s6 p JOIN s6 a ON a.design_id = p.design_id AND a.run = p.run AND a.i = p.i - p.k JOIN s6 c ON c.design_id = p.design_id AND c.run = p.run AND c.i = p.i + p.k),
ht AS (SELECT design_id, run, i, k, ROUND(ABS(t - 360 * FLOOR(t / 360) - 180), 6) AS turn FROM tu WHERE ROUND(ABS(t - 360 * FLOOR(t / 360) - 180), 6) >= 30),
nx AS (SELECT p.design_id, p.run, p.i, MIN(q.i) AS nxt FROM ht p JOIN ht q ON p.design_id = q.design_id AND p.run = q.run AND q.i - p.i > 2 * q.k GROUP BY 1, 2, 3),
kp AS (SELECT design_id, run, MIN(i) AS i FROM ht GROUP BY 1, 2 UNION ALL SELECT kp.design_id, kp.run, nx.nxt FROM kp JOIN nx ON nx.design_id = kp.design_id AND nx.run = kp.run AND nx.i = kp.i)
SELECT ht.design_id, ht.run, ht.i, ROUND(turn, 4) AS turn FROM kp JOIN ht ON kp.design_id = ht.design_id AND kp.run = ht.run AND kp.i = ht.i""")
def _(st):
    place = F.row_number().over(Window.partitionBy("design_id", "run").orderBy("seq")) - 1
    spine = runs(st).select("design_id", "run", place.cast("long").alias("i"), F.col("x_u").alias("x"), F.col("y_u").alias("y"), F.lit(20.0).alias("width"))
    return r4(spine_corners(spine, ["design_id", "run"]), "turn")
