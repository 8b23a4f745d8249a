"""Queries over regions, garments and hoops."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import catalogue as K
from ..operators import shapes as S
from .registry import query
from .stitch_queries import r4

SEW = "sew AS (SELECT design_id, shape_id, ROW_NUMBER() OVER (PARTITION BY design_id ORDER BY layer, shape_id) - 1 AS sew_index FROM v_shapes WHERE stitched)"
PAIRS = """p AS (SELECT a.design_id, a.shape_id AS prev_id, b.shape_id AS cur_id, (a.cx_u - b.cx_u) * (a.cx_u - b.cx_u) + (a.cy_u - b.cy_u) * (a.cy_u - b.cy_u) AS d2
  FROM v_shapes_prev a JOIN v_shapes b ON a.design_id = b.design_id AND a.thread_idx = b.thread_idx WHERE (a.cx_u - b.cx_u) * (a.cx_u - b.cx_u) + (a.cy_u - b.cy_u) * (a.cy_u - b.cy_u) <= 625)"""


@query("a33_polygon_measures", "v_vertices", sql="""WITH e AS (SELECT *, COALESCE(LEAD(x_u) OVER w, FIRST_VALUE(x_u) OVER w) AS nx, COALESCE(LEAD(y_u) OVER w, FIRST_VALUE(y_u) OVER w) AS ny FROM v_vertices WINDOW w AS (PARTITION BY design_id, shape_id ORDER BY vertex))
SELECT design_id, shape_id, SUM(x_u * ny - nx * y_u) / 2 AS signed_area, ABS(SUM(x_u * ny - nx * y_u)) / 2 AS area, ROUND(SUM(SQRT(CAST((nx - x_u) * (nx - x_u) + (ny - y_u) * (ny - y_u) AS DOUBLE))), 4) AS perimeter,
 MIN(x_u) AS min_x, MAX(x_u) AS max_x, MIN(y_u) AS min_y, MAX(y_u) AS max_y, AVG(x_u) AS mid_x, AVG(y_u) AS mid_y, CASE WHEN ABS(VAR_POP(x_u) - VAR_POP(y_u)) > 1e-6 OR ABS(COVAR_POP(x_u, y_u)) > 1e-6 THEN (ROUND(DEGREES(ATAN2(ROUND(2 * COVAR_POP(x_u, y_u), 6), ROUND(VAR_POP(x_u) - VAR_POP(y_u), 6))) / 2, 4) + 180) % 180 END AS axis,
 ROUND(SUM((x_u + nx) * (x_u * ny - nx * y_u)) / (3 * SUM(x_u * ny - nx * y_u)), 4) AS centroid_x, ROUND(SUM((y_u + ny) * (x_u * ny - nx * y_u)) / (3 * SUM(x_u * ny - nx * y_u)), 4) AS centroid_y, ROUND(ABS(SUM(x_u * ny - nx * y_u)) / SUM(SQRT(CAST((nx - x_u) * (nx - x_u) + (ny - y_u) * (ny - y_u) AS DOUBLE))), 4) AS width FROM e GROUP BY 1, 2""")
def _(v):
    return r4(S.polygon_measures(v), "perimeter", "centroid_x", "centroid_y", "width")


@query("f9_drop_nested", "v_shapes", sql="""SELECT design_id, shape_id FROM v_shapes a WHERE NOT EXISTS (SELECT 1 FROM v_shapes b WHERE a.design_id = b.design_id AND a.shape_id <> b.shape_id AND b.w_u * b.h_u > a.w_u * a.h_u
 AND b.cx_u - b.w_u <= a.cx_u - a.w_u AND b.cx_u + b.w_u >= a.cx_u + a.w_u AND b.cy_u - b.h_u <= a.cy_u - a.h_u AND b.cy_u + b.h_u >= a.cy_u + a.h_u)""")
def _(s):
    return S.drop_nested(s).select("design_id", "shape_id")


@query("j4_match_first_round", "v_shapes_prev", "v_shapes", sql=f"""WITH {PAIRS} SELECT design_id, prev_id, cur_id, d2 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY design_id, prev_id ORDER BY d2, prev_id, cur_id) AS a, ROW_NUMBER() OVER (PARTITION BY design_id, cur_id ORDER BY d2, prev_id, cur_id) AS b FROM p) q WHERE a = 1 AND b = 1""")
def _(prev, cur):
    return S.mutual_best(S.shape_candidates(prev, cur))


@query("j4_match_shape_ids", "v_shapes_prev", "v_shapes")
def _(prev, cur):
    return S.match_shape_ids(prev, cur)


@query("j16_apply_edits", "v_shapes", sql="SELECT design_id, shape_id, CASE WHEN shape_id % 5 = 0 THEN 7 ELSE thread_idx END AS thread_idx, shape_id % 5 = 0 AS edited FROM v_shapes WHERE shape_id % 7 <> 0")
def _(s):
    return S.apply_edits(s, s.where("shape_id % 7 = 0"), s.where("shape_id % 5 = 0").withColumn("thread_idx", F.lit(7)))[0]


@query("j16_unknown_edits", "v_shapes", "v_shapes_prev", sql="SELECT DISTINCT design_id, shape_id FROM v_shapes_prev WHERE shape_id % 4 = 0")
def _(s, prev):
    return S.apply_edits(s, prev.where("shape_id % 4 = 0"), prev.where("shape_id % 8 = 0"))[1]


@query("j17_t1_order", "v_shapes", sql=f"WITH {SEW} SELECT s.design_id, s.shape_id, layer, sew_index, ROW_NUMBER() OVER (PARTITION BY s.design_id ORDER BY layer, sew_index NULLS LAST, s.shape_id) AS place FROM v_shapes s LEFT JOIN sew ON s.design_id = sew.design_id AND s.shape_id = sew.shape_id")
def _(s):
    return S.sort_key_layers(s)


@query("w16_sew_index", "v_shapes", sql=f"WITH {SEW} SELECT * FROM sew")
def _(s):
    return S.sew_index(s)


@query("w17_shape_ids", "v_shapes", sql="""WITH k AS (SELECT *, SUBSTRING(SHA256(CONCAT(CAST(FLOOR(cx_u / 5.0) AS BIGINT), ':', CAST(FLOOR(cy_u / 5.0) AS BIGINT), ':', thread_idx)), 1, 10) AS base FROM v_shapes),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY design_id, base ORDER BY thread_idx, cx_u, cy_u, shape_id) AS n FROM k) SELECT design_id, shape_id, CASE WHEN n = 1 THEN base ELSE CONCAT(base, '-', n) END AS key FROM n""")
def _(s):
    return S.shape_ids(s)


TIER = "CASE shape_id % 3 WHEN 0 THEN 'run' WHEN 1 THEN 'satin' ELSE 'fill' END"


def tagged(s):
    """Shapes with a tier and whether they are enclosed, both by their id."""
    k = F.col("shape_id") % 3
    return s.withColumns({"tier": F.when(k == 0, "run").when(k == 1, "satin").otherwise("fill"), "enclosed": (F.col("shape_id") % 4 == 1)})


@query("w18_layer_order", "v_shapes", sql=f"""WITH v AS (SELECT *, {TIER} AS tier, shape_id % 4 = 1 AS enclosed, BOOL_OR(stitched) OVER (PARTITION BY design_id, layer) AS votes FROM v_shapes),
g AS (SELECT design_id, layer, CASE WHEN BOOL_AND(enclosed) THEN 0 WHEN BOOL_AND(tier IN ('run', 'satin')) THEN 2 ELSE 1 END AS depth, CAST(FLOOR(SUM(r * 2126 + g * 7152 + b * 722) / COUNT(*)) AS BIGINT) AS light, CAST(SUM(w_u * h_u) AS BIGINT) AS area FROM v WHERE stitched OR NOT votes GROUP BY 1, 2)
SELECT *, ROW_NUMBER() OVER (PARTITION BY design_id ORDER BY depth, light, area DESC, layer) AS place FROM g""")
def _(s):
    return S.layer_order(tagged(s))


@query("j17_effective_order", "v_shapes", sql=f"""WITH {SEW}, o AS (SELECT s.design_id, s.shape_id, COALESCE(CASE WHEN s.shape_id % 5 = 0 THEN layer END, CASE WHEN s.shape_id % 3 = 0 THEN s.shape_id % 7 END, sew_index, 1000000000) AS "order" FROM v_shapes s LEFT JOIN sew ON s.design_id = sew.design_id AND s.shape_id = sew.shape_id)
SELECT *, ROW_NUMBER() OVER (PARTITION BY design_id ORDER BY "order", shape_id) AS place FROM o""")
def _(s):
    return S.effective_order(s.withColumns({"override": F.when(F.col("shape_id") % 5 == 0, F.col("layer")), "stored": F.when(F.col("shape_id") % 3 == 0, F.col("shape_id") % 7)}))


META = ("layer", "thread_idx", "w_u", "h_u", "cx_u", "cy_u", "tier")


@query("j4_carry_meta", "v_shapes_prev", "v_shapes", sql=f"""WITH {PAIRS}, m AS (SELECT design_id, prev_id, cur_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY design_id, prev_id ORDER BY d2, prev_id, cur_id) AS a, ROW_NUMBER() OVER (PARTITION BY design_id, cur_id ORDER BY d2, prev_id, cur_id) AS b FROM p) q WHERE a = 1 AND b = 1)
SELECT c.design_id, c.shape_id, m.prev_id, {', '.join(f"COALESCE(CASE WHEN c.shape_id % {k} <> 0 THEN c.{n} END, o.{n}) AS {n}" for k, n in enumerate(META[:-1], 2))}, COALESCE(CASE WHEN c.shape_id % 8 <> 0 THEN {TIER.replace('shape_id', 'c.shape_id')} END, CASE WHEN o.shape_id IS NOT NULL THEN {TIER.replace('shape_id', 'o.shape_id')} END) AS tier
FROM v_shapes c LEFT JOIN m ON m.design_id = c.design_id AND m.cur_id = c.shape_id LEFT JOIN v_shapes_prev o ON o.design_id = m.design_id AND o.shape_id = m.prev_id""")
def _(prev, cur):
    found = S.mutual_best(S.shape_candidates(prev, cur))
    some = tagged(cur).withColumns({n: F.when(F.col("shape_id") % k != 0, F.col(n)) for k, n in enumerate(META, 2)})
    return S.carry_meta(some, tagged(prev), found, list(META))


@query("j16_added_threads", "v_shapes", sql="""WITH o AS (SELECT DISTINCT design_id, (thread_idx + 3) % 200 AS thread_idx FROM v_shapes WHERE shape_id % 5 = 0), n AS (SELECT design_id, COUNT(DISTINCT thread_idx) AS n FROM v_shapes GROUP BY 1)
SELECT o.design_id, o.thread_idx, n + ROW_NUMBER() OVER (PARTITION BY o.design_id ORDER BY o.thread_idx) - 1 AS place FROM o JOIN n USING (design_id) WHERE NOT EXISTS (SELECT 1 FROM v_shapes v WHERE v.design_id = o.design_id AND v.thread_idx = o.thread_idx)""")
def _(s):
    return S.added_threads(s.where("shape_id % 5 = 0").withColumn("thread_idx", (F.col("thread_idx") + 3) % 200), s)


@query("j24_sew_facts", "v_shapes", sql=f"""WITH {SEW}, f AS (SELECT design_id, shape_id, DENSE_RANK() OVER (PARTITION BY design_id ORDER BY layer) - 1 AS block, {TIER} AS tier FROM v_shapes WHERE stitched)
SELECT s.design_id, s.shape_id, layer, sew_index, block, f.tier FROM v_shapes s LEFT JOIN sew ON s.design_id = sew.design_id AND s.shape_id = sew.shape_id LEFT JOIN f ON s.design_id = f.design_id AND s.shape_id = f.shape_id""")
def _(s):
    return S.sew_facts(tagged(s))


@query("w19_compact_layers", "v_shapes", sql="SELECT design_id, shape_id, layer, DENSE_RANK() OVER (PARTITION BY design_id ORDER BY layer) - 1 AS compact FROM v_shapes WHERE layer <> 2")
def _(s):
    return S.compact_layers(s.where("layer <> 2"))


@query("w22_color_blocks", "v_shapes", sql=f"WITH {SEW} SELECT s.design_id, layer, MIN(sew_index) AS first, MAX(sew_index) AS last, COUNT(*) AS shapes, ARG_MIN(r, sew_index) AS r, ARG_MIN(g, sew_index) AS g, ARG_MIN(b, sew_index) AS b FROM v_shapes s JOIN sew ON s.design_id = sew.design_id AND s.shape_id = sew.shape_id GROUP BY 1, 2")
def _(s):
    return S.color_blocks(s)


@query("u6_merge_shapes", "v_shapes", sql="""WITH j AS (SELECT *, shape_id % 9 AS grp, CAST(w_u * h_u AS BIGINT) * 4 AS area FROM v_shapes WHERE shape_id % 9 < 3),
g AS (SELECT design_id, grp, thread_idx, LIST_SORT(LIST(DISTINCT shape_id)) AS ids, CAST(SUM(area) AS BIGINT) AS area, ARG_MAX(shape_id, area * 10000000000 - shape_id) AS primary_id FROM j GROUP BY 1, 2, 3)
SELECT design_id, grp AS "group", thread_idx, SUBSTRING(SHA256(ARRAY_TO_STRING(ids, ',')), 1, 12) AS key, LEN(ids) AS members, primary_id, area FROM g WHERE LEN(ids) >= 2""")
def _(s):
    return S.merge_shapes(s, s.where("shape_id % 9 < 3").select("design_id", (F.col("shape_id") % 9).alias("group"), "shape_id"))


@query("a61_unsewn_summary", "v_shapes", sql="""SELECT design_id, COUNT(*) AS shapes, STRING_AGG(CAST(shape_id AS VARCHAR), ',' ORDER BY shape_id) AS ids, COUNT(DISTINCT thread_idx) AS threads, CAST(SUM(w_u * h_u * 4) AS BIGINT) AS area, MAX(w_u * h_u * 4) AS largest,
 COUNT(*) FILTER (shape_id % 4 = 1) AS by_enclosure, COUNT(*) FILTER (shape_id % 4 <> 1) AS by_override FROM v_shapes WHERE NOT stitched GROUP BY 1""")
def _(s):
    return S.unsewn_summary(tagged(s))


@query("x9_group_key", "v_shapes", sql="SELECT design_id, thread_idx, SUBSTRING(SHA256(ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT CAST(shape_id AS VARCHAR))), ',')), 1, 16) AS key FROM v_shapes GROUP BY 1, 2")
def _(s):
    return S.group_key(s, ["design_id", "thread_idx"], "shape_id")


@query("p17_region_weight", "v_shapes", sql="SELECT design_id, shape_id, w_u * h_u * CASE layer WHEN 1 THEN 9.0 WHEN 2 THEN 4.5 WHEN 3 THEN 2.0 WHEN 4 THEN 1.0 ELSE 1.0 END AS weight FROM v_shapes")
def _(s):
    kind = F.when(F.col("layer") == 1, "eyes").when(F.col("layer") == 2, "skin").when(F.col("layer") == 3, "subject").when(F.col("layer") == 4, "background")
    return s.select("design_id", "shape_id", C.region_weight(F.col("w_u") * F.col("h_u"), kind).alias("weight"))


SIZES = "z AS (SELECT design_id, (MAX(x_u) - MIN(x_u)) / 10.0 AS w, (MAX(y_u) - MIN(y_u)) / 10.0 AS h FROM v_stitches WHERE cmd = 'stitch' GROUP BY 1)"


def sizes(st):
    return st.where("cmd = 'stitch'").groupBy("design_id").agg(((F.max("x_u") - F.min("x_u")) / 10).alias("w"), ((F.max("y_u") - F.min("y_u")) / 10).alias("h"))


@query("f4_hoop_fit", "v_stitches", "v_hoops", sql=f"WITH {SIZES} SELECT design_id, hoop_id, CASE WHEN w <= width_mm AND h <= height_mm THEN 'fits' WHEN h <= width_mm AND w <= height_mm THEN 'rotated' ELSE 'exceeds' END AS fit FROM z CROSS JOIN v_hoops")
def _(st, hoops):
    return K.hoop_fit(sizes(st), hoops).select("design_id", "hoop_id", "fit")


@query("j10_suggest_hoop", "v_stitches", "v_hoops", sql=f"""WITH {SIZES}, f AS (SELECT design_id, ARG_MIN(hoop_id, ord) AS hoop FROM z CROSS JOIN v_hoops WHERE (w <= width_mm AND h <= height_mm) OR (h <= width_mm AND w <= height_mm) GROUP BY 1)
SELECT z.design_id, COALESCE(hoop, (SELECT ARG_MAX(hoop_id, width_mm * height_mm) FROM v_hoops)) AS hoop_id FROM z LEFT JOIN f ON z.design_id = f.design_id""")
def _(st, hoops):
    return K.suggest_hoop(sizes(st), hoops)


@query("j8_fixture_matrix", "v_stitches", "v_garments", sql="SELECT design_id, garment_id FROM (SELECT DISTINCT design_id FROM v_stitches) d CROSS JOIN v_garments")
def _(st, g):
    return K.fixture_matrix(st.select("design_id").distinct(), g.select("garment_id"))


@query("p14_fit_scale", "v_stitches", "v_garments", sql=f"WITH {SIZES} SELECT design_id, garment_id, ROUND(LEAST(width_in * 25.4 / w, height_in * 25.4 / h), 4) AS scale FROM z CROSS JOIN v_garments WHERE w > 0 AND h > 0")
def _(st, g):
    return r4(K.fit_scale(sizes(st).where("w > 0 and h > 0"), g).select("design_id", "garment_id", "scale"), "scale")


@query("p12_size_band", "v_stitches", sql=f"WITH {SIZES} SELECT design_id, CASE WHEN h > 0 THEN ROUND(h * 0.75, 1) END AS lo, CASE WHEN h > 0 THEN ROUND(h * 2.0, 1) END AS hi FROM (SELECT design_id, FLOOR(h) AS h FROM z) q")
def _(st):
    lo, hi = C.size_band(F.floor("h"))
    return sizes(st).select("design_id", lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))
