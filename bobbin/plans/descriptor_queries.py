"""Queries over letter-like shapes and outline descriptors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import descriptors as D
from .registry import query
from .stitch_queries import r4

#: A shape's box stands for its letter: height 2 h_u, stroke half its smaller side.
LETTERS = "lt AS (SELECT design_id, shape_id, CAST(cx_u AS DOUBLE) AS cx, CAST(cy_u AS DOUBLE) AS cy, CAST(h_u * 2 AS DOUBLE) AS height, LEAST(w_u, h_u) / 2.0 AS stroke FROM v_shapes)"
LINKS = f"""{LETTERS}, lk AS (SELECT p.design_id, p.shape_id AS u, q.shape_id AS v FROM lt p JOIN lt q ON p.design_id = q.design_id AND p.shape_id < q.shape_id
 AND LEAST(p.height, q.height) / GREATEST(p.height, q.height) >= 0.5 AND LEAST(p.stroke, q.stroke) / GREATEST(p.stroke, q.stroke) >= 0.5
 AND ROUND(SQRT(POW(p.cx - q.cx, 2) + POW(p.cy - q.cy, 2)), 9) <= 3 * GREATEST(p.height, q.height))"""


def letters(s):
    return s.select("design_id", "shape_id", F.col("cx_u").cast("double").alias("cx"), F.col("cy_u").cast("double").alias("cy"), (F.col("h_u") * 2.0).alias("height"), (F.least("w_u", "h_u") / 2).alias("stroke"))


@query("j14_linked_shapes", "v_shapes", sql=f"WITH {LINKS} SELECT design_id, u, v FROM lk")
def _(s):
    return D.linked_shapes(letters(s))


@query("j14_text_clusters", "v_shapes", sql=f"""WITH RECURSIVE {LINKS}, bt AS (SELECT design_id, u, v FROM lk UNION ALL SELECT design_id, v, u FROM lk),
rc AS (SELECT design_id, u AS id, u AS seen FROM bt UNION SELECT rc.design_id, rc.id, bt.v FROM rc JOIN bt ON rc.design_id = bt.design_id AND rc.seen = bt.u), rt AS (SELECT design_id, id AS shape_id, MIN(seen) AS cluster FROM rc GROUP BY 1, 2),
rk AS (SELECT rt.*, stroke AS own, COUNT(*) OVER (PARTITION BY rt.design_id, cluster) AS members, ROW_NUMBER() OVER (PARTITION BY rt.design_id, cluster ORDER BY stroke, rt.shape_id) - 1 AS k FROM rt JOIN lt ON rt.design_id = lt.design_id AND rt.shape_id = lt.shape_id)
SELECT design_id, shape_id, cluster, members, MAX(CASE WHEN k = FLOOR(members / 2) THEN own END) OVER (PARTITION BY design_id, cluster) AS stroke FROM rk WHERE members >= 3""")
def _(s):
    return D.text_clusters(letters(s))


BINS = """pr AS (SELECT p.design_id, p.shape_id, p.vertex, q.x_u - p.x_u AS dx, q.y_u - p.y_u AS dy, SQRT(POW(q.x_u - p.x_u, 2) + POW(q.y_u - p.y_u, 2)) AS r FROM v_vertices p JOIN v_vertices q ON p.design_id = q.design_id AND p.shape_id = q.shape_id AND p.vertex <> q.vertex),
sc AS (SELECT *, r / AVG(r) OVER (PARTITION BY design_id, shape_id) AS s FROM pr),
bn AS (SELECT design_id, shape_id, vertex, CAST(((ROUND(s, 9) >= 0.217637641)::INT + (ROUND(s, 9) >= 0.378929142)::INT + (ROUND(s, 9) >= 0.659753955)::INT + (ROUND(s, 9) >= 1.148698355)::INT) * 12
 + LEAST(11, FLOOR(ROUND((ATAN2(dy, dx) + PI()) / (2 * PI()) * 12, 9))) AS INT) AS bin, COUNT(*) AS n FROM sc GROUP BY 1, 2, 3, 4)"""


def outline(v):
    return v.select("design_id", "shape_id", "vertex", F.col("x_u").alias("x"), F.col("y_u").alias("y"))


@query("p13_log_polar_bins", "v_vertices", sql=f"WITH {BINS} SELECT design_id, shape_id, vertex, bin, n FROM bn")
def _(v):
    return D.log_polar(outline(v), ["design_id", "shape_id"])


@query("j23_shape_distance_join", "v_vertices", sql=f"""WITH {BINS}, tt AS (SELECT design_id, shape_id, vertex, SUM(n) AS total FROM bn GROUP BY 1, 2, 3), hs AS (SELECT bn.design_id, bn.shape_id, bn.vertex, bin, n / total AS p FROM bn JOIN tt USING (design_id, shape_id, vertex)),
pp AS (SELECT a.design_id, a.shape_id AS u, b.shape_id AS v, a.vertex AS i, b.vertex AS j FROM tt a JOIN tt b ON a.design_id = b.design_id AND a.shape_id < b.shape_id),
sh AS (SELECT pp.*, SUM(CASE WHEN x.p + y.p > 0 THEN x.p * y.p / (x.p + y.p) ELSE 0 END) AS met FROM pp LEFT JOIN hs x ON x.design_id = pp.design_id AND x.shape_id = u AND x.vertex = i LEFT JOIN hs y ON y.design_id = pp.design_id AND y.shape_id = v AND y.vertex = j AND y.bin = x.bin GROUP BY 1, 2, 3, 4, 5),
ch AS (SELECT *, 1 - 2 * COALESCE(met, 0) AS chi FROM sh), si AS (SELECT design_id, u, v, AVG(m) AS d FROM (SELECT design_id, u, v, i, MIN(chi) AS m FROM ch GROUP BY 1, 2, 3, 4) q GROUP BY 1, 2, 3), sj AS (SELECT design_id, u, v, AVG(m) AS d FROM (SELECT design_id, u, v, j, MIN(chi) AS m FROM ch GROUP BY 1, 2, 3, 4) q GROUP BY 1, 2, 3)
SELECT design_id, u, v, ABS(ROUND(GREATEST(si.d, sj.d), 4)) AS distance FROM si JOIN sj USING (design_id, u, v) WHERE ROUND(GREATEST(si.d, sj.d), 9) <= 0.25""")
def _(v):
    return r4(D.shape_distances(outline(v)), "distance").withColumn("distance", F.abs("distance"))
