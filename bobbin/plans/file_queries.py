"""Queries over machine files made from the stitch streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import dst as D
from .registry import query

#: Ten times the size, so that moves pass a record's limit.
TEN = """m AS (SELECT design_id, seq, cmd, x_u * 10 AS x, y_u * 10 AS y FROM v_stitches)"""


def large(s):
    return s.withColumns({"x_u": F.col("x_u") * 10, "y_u": F.col("y_u") * 10})


@query("s5_to_dst_records", "v_stitches", sql=f"""WITH {TEN}, d AS (SELECT *, x - COALESCE(LAG(x) OVER w, 0) AS dx, y - COALESCE(LAG(y) OVER w, 0) AS dy FROM m WINDOW w AS (PARTITION BY design_id ORDER BY seq)),
n AS (SELECT *, GREATEST(CASE WHEN cmd = 'trim' THEN 3 ELSE 1 END, CAST(CEIL(GREATEST(ABS(dx), ABS(dy)) / 121.0) AS INT)) AS n FROM d)
SELECT design_id, SUM(n) AS records, SUM(CASE WHEN cmd IN ('trim', 'jump') THEN n ELSE n - 1 END) AS jumps, SUM(CAST(cmd = 'color' AS INT)) AS colors, SUM(dx) AS end_x, SUM(dy) AS end_y FROM n GROUP BY 1""")
def _(s):
    is_ = lambda k: F.count_if(F.col("kind") == k)
    return D.to_dst_records(large(s)).groupBy("design_id").agg(F.count("*").alias("records"), is_("jump").alias("jumps"), is_("color").alias("colors"), F.sum("dx").alias("end_x"), F.sum("dy").alias("end_y"))


@query("s6_to_exp_records", "v_stitches", sql=f"""WITH {TEN}, p AS (SELECT * FROM m WHERE cmd <> 'color'),
d AS (SELECT *, x - COALESCE(LAG(x) OVER w, 0) AS dx, y - COALESCE(LAG(y) OVER w, 0) AS dy FROM p WINDOW w AS (PARTITION BY design_id ORDER BY seq)),
n AS (SELECT *, CAST(CEIL(GREATEST(ABS(dx), ABS(dy)) / 127.0) AS INT) AS n FROM d),
a AS (SELECT design_id, SUM(CASE WHEN cmd = 'stitch' THEN GREATEST(1, n) ELSE 0 END) AS stitches, SUM(CASE WHEN cmd = 'jump' THEN GREATEST(1, n) WHEN cmd = 'trim' THEN n ELSE 0 END) AS jumps, SUM(CAST(cmd = 'trim' AS INT)) AS trims, SUM(dx) AS end_x, SUM(dy) AS end_y FROM n GROUP BY 1)
SELECT a.*, c.colors FROM a JOIN (SELECT design_id, SUM(CAST(cmd = 'color' AS INT)) AS colors FROM m GROUP BY 1) c ON a.design_id = c.design_id""")
def _(s):
    is_ = lambda k: F.count_if(F.col("kind") == k)
    return D.to_exp_records(large(s)).groupBy("design_id").agg(is_("stitch").alias("stitches"), is_("jump").alias("jumps"), is_("trim").alias("trims"), is_("color").alias("colors"), F.sum("dx").alias("end_x"), F.sum("dy").alias("end_y"))


@query("s1_dst_round_trip", "v_stitches", sql="""WITH d AS (SELECT *, COALESCE(LAG(x_u) OVER w, 0) AS lx, COALESCE(LAG(y_u) OVER w, 0) AS ly FROM v_stitches WINDOW w AS (PARTITION BY design_id ORDER BY seq)),
r AS (SELECT design_id, seq, i, CASE WHEN cmd = 'trim' THEN 'jump' ELSE cmd END AS kind, CASE WHEN cmd = 'trim' THEN lx + CAST(FLOOR(CAST((x_u - lx) * i AS DOUBLE) / 3 + 0.5) AS BIGINT) ELSE x_u END AS x_u,
 CASE WHEN cmd = 'trim' THEN ly + CAST(FLOOR(CAST((y_u - ly) * i AS DOUBLE) / 3 + 0.5) AS BIGINT) ELSE y_u END AS y_u FROM d CROSS JOIN (VALUES (1), (2), (3)) AS k(i) WHERE i = 1 OR cmd = 'trim')
SELECT design_id, ROW_NUMBER() OVER (PARTITION BY design_id ORDER BY seq, i) - 1 AS rec, kind, x_u, y_u FROM r""")
def _(s):
    return D.decode_dst(D.dst_files(s))


@query("s2_dst_label", "v_stitches", sql="SELECT DISTINCT design_id, CAST(design_id AS VARCHAR) AS label FROM v_stitches")
def _(s):
    return D.dst_files(s).select("design_id", D.dst_label(F.col("content")).alias("label"))
