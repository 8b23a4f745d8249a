"""Queries over sides, groups of designs, rings and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as K
from ..operators import measures as M
from ..operators import pixels as P
from .pixel_queries import SIG, decide_sql
from .registry import query
from .stitch_queries import BOTH

RATE = """b AS (SELECT design_id, COUNT(*) FILTER (WHERE cmd = 'trim') AS t, COUNT(*) FILTER (WHERE cmd = 'stitch') AS s FROM v_stitches GROUP BY 1), a AS (SELECT design_id, COUNT(*) FILTER (WHERE cmd = 'trim') AS t, COUNT(*) FILTER (WHERE cmd = 'stitch') AS s FROM v_stitches_b GROUP BY 1),
d AS (SELECT a.design_id, b.t - a.t AS d_trims, a.s - b.s AS d_stitches FROM a JOIN b ON a.design_id = b.design_id),
rate AS (SELECT *, CASE WHEN d_trims > 0 THEN ROUND(CAST(d_stitches AS DOUBLE) / d_trims, 6) END AS rate, d_stitches - d_trims * 25 AS score, d_stitches - d_trims * 25 > 0 AS worse FROM d WHERE d_trims <> 0 OR d_stitches <> 0)"""


@query("a45_exchange_rate", "v_stitches", "v_stitches_b", sql=f"WITH {RATE} SELECT * FROM rate")
def _(a, b):
    return K.exchange_rate(a, b).withColumn("rate", F.round("rate", 6))


@query("a45_exchange_totals", "v_stitches", "v_stitches_b", sql=f"WITH {RATE} SELECT COUNT(*) AS designs, CAST(SUM(d_trims) AS BIGINT) AS d_trims, CAST(SUM(d_stitches) AS BIGINT) AS d_stitches, CAST(SUM(score) AS BIGINT) AS score, COUNT(*) FILTER (worse) AS worse, ROUND(CASE WHEN SUM(d_trims) > 0 THEN SUM(d_stitches) / SUM(d_trims) END, 6) AS rate FROM rate")
def _(a, b):
    return K.exchange_totals(K.exchange_rate(a, b)).withColumn("rate", F.round("rate", 6))


@query("t8_worst_fixtures", "v_stitches", "v_stitches_b", sql=f"WITH {RATE} SELECT design_id, score FROM rate ORDER BY score DESC, design_id LIMIT 10")
def _(a, b):
    return K.worst(K.exchange_rate(a, b), "score", 10).select("design_id", "score")


@query("u1_combine_designs", "v_stitches", sql="""WITH s AS (SELECT CAST(FLOOR(design_id / 10) AS BIGINT) AS g, *, LAG(design_id) OVER w AS pd, LAG(x_u) OVER w AS px, LAG(y_u) OVER w AS py FROM v_stitches WINDOW w AS (PARTITION BY CAST(FLOOR(design_id / 10) AS BIGINT) ORDER BY design_id, seq)),
u AS (SELECT g, design_id, seq, 2 AS k, cmd, x_u, y_u FROM s UNION ALL SELECT g, design_id, seq, k, c, px, py FROM s CROSS JOIN (VALUES (0, 'trim'), (1, 'color')) AS z(k, c) WHERE pd <> design_id)
SELECT g, ROW_NUMBER() OVER (PARTITION BY g ORDER BY design_id, seq, k) - 1 AS pos, cmd, x_u, y_u FROM u""")
def _(s):
    return K.combine_designs(s.withColumn("g", F.floor(F.col("design_id") / 10)), "g")


@query("x12_collapse_tokens", "v_stitches", sql="""WITH b AS (SELECT *, SUM(CAST(cmd = 'color' AS INT)) OVER (PARTITION BY design_id ORDER BY seq) AS block FROM v_stitches),
c AS (SELECT *, LAG(cmd) OVER (PARTITION BY design_id, block ORDER BY seq) AS p FROM b) SELECT design_id, block, STRING_AGG(cmd, '.' ORDER BY seq) AS phrase FROM c WHERE p IS NULL OR p <> cmd GROUP BY 1, 2""")
def _(s):
    return K.command_phrases(s)


@query("w15_dedupe_ring", "v_vertices", sql="SELECT design_id, shape_id, vertex * 10 AS vertex, x_u, y_u FROM v_vertices")
def _(v):
    step = v.withColumn("vertex", F.col("vertex") * 10)
    doubled = step.where("vertex % 20 = 0").withColumn("vertex", F.col("vertex") + 5)
    closing = step.where("vertex = 0").withColumn("vertex", F.lit(99))
    return K.dedupe_ring(step.unionByName(doubled).unionByName(closing))


@query("j6_cells_of_shape", "v_vertices", sql="""WITH s AS (SELECT design_id, shape_id, MIN(x_u) AS x0, MAX(x_u) AS x1, MIN(y_u) AS y0, MAX(y_u) AS y1 FROM v_vertices GROUP BY 1, 2),
c AS (SELECT *, UNNEST(RANGE(CAST(FLOOR(y0 / 20) AS BIGINT), CAST(FLOOR(y1 / 20) AS BIGINT) + 1)) AS cy FROM s), d AS (SELECT *, UNNEST(RANGE(CAST(FLOOR(x0 / 20) AS BIGINT), CAST(FLOOR(x1 / 20) AS BIGINT) + 1)) AS cx FROM c)
SELECT design_id, shape_id, cy, cx FROM d WHERE cx * 20 + 10 >= x0 AND cx * 20 + 10 < x1 AND cy * 20 + 10 >= y0 AND cy * 20 + 10 < y1""")
def _(v):
    return K.cells_of_shapes(v)


WIDTHS = "st AS (SELECT design_id, shape_id, AVG(w) AS mean, STDDEV_POP(w) / AVG(w) AS cv FROM (SELECT design_id, shape_id, UNNEST([w_u, h_u, w_u + layer]) AS w FROM v_shapes) q GROUP BY 1, 2)"


def widths(s):
    return s.select("design_id", "shape_id", F.explode(F.array("w_u", "h_u", F.col("w_u") + F.col("layer"))).alias("width"))


@query("a52_stroke_stats", "v_shapes", sql=f"WITH {WIDTHS} SELECT design_id, shape_id, ROUND(mean, 6) AS mean, ROUND(cv, 6) AS cv FROM st")
def _(s):
    return K.stroke_stats(widths(s)).withColumns({"mean": F.round("mean", 6), "cv": F.round("cv", 6)})


@query("f11_text_candidates", "v_shapes", sql=f"WITH {WIDTHS} SELECT s.design_id, s.shape_id FROM v_shapes s JOIN st ON s.design_id = st.design_id AND s.shape_id = st.shape_id WHERE cv <= 0.32 AND CAST(w_u AS DOUBLE) / h_u BETWEEN 0.05 AND 1.4")
def _(s):
    return K.text_candidates(s.hint("merge").join(K.stroke_stats(widths(s)), ["design_id", "shape_id"])).select("design_id", "shape_id")


FORCED = "CASE forced_class WHEN 'BUILDING' THEN 'photo_subject' WHEN 'MACHINERY' THEN 'photo_scene' END"


@query("a42_confusion_matrix", "v_signals", sql="""WITH e AS (SELECT forced_class IN ('BUILDING', 'MACHINERY') AS truth, UNNEST([{'arm': 'ucm', 'said': ucm >= 0.28}, {'arm': 'grad', 'said': grad >= 8}, {'arm': 'alpha', 'said': alpha >= 0.5}]) AS e FROM v_signals)
SELECT e.arm AS arm, COUNT(*) FILTER (WHERE truth AND e.said) AS tp, COUNT(*) FILTER (WHERE NOT truth AND e.said) AS fp, COUNT(*) FILTER (WHERE NOT truth AND NOT e.said) AS tn, COUNT(*) FILTER (WHERE truth AND NOT e.said) AS fn FROM e GROUP BY 1""")
def _(s):
    return K.confusion(s, F.col("forced_class").isin("BUILDING", "MACHINERY"), {"ucm": F.col("ucm") >= 0.28, "grad": F.col("grad") >= 8, "alpha": F.col("alpha") >= 0.5})


@query("a42_tier_matrix", "v_stitches", "v_stitches_b", sql=f"""WITH {BOTH} SELECT a.typ AS tier, {', '.join(f"COUNT(*) FILTER (b.typ = '{t}') AS {t}" for t in ('run', 'satin', 'fill'))} FROM cell a JOIN cell2 b ON a.design_id = b.design_id AND a.ci = b.ci AND a.cj = b.cj GROUP BY 1""")
def _(a, b):
    cells = M.cell_map(a).select("design_id", "ci", "cj", F.col("typ").alias("tier")).hint("merge").join(M.cell_map(b).select("design_id", "ci", "cj", F.col("typ").alias("said")), ["design_id", "ci", "cj"])
    return K.tier_matrix(cells, "tier", "said", ("run", "satin", "fill"))


@query("f12_photo_class", "v_signals", sql=f"WITH {SIG}, z AS ({decide_sql('sig', 'CAST(0.28 AS DOUBLE)')}) SELECT z.image_id, COALESCE({FORCED} IN ('photo_subject', 'photo_scene'), FALSE) OR class IN ('photo_subject', 'photo_scene') AS photo FROM z JOIN v_signals v ON v.image_id = z.image_id")
def _(s):
    return P.decide(s).select("image_id", K.photo_class(F.expr(FORCED), F.col("class")).alias("photo"))


@query("f13_route_by_class", "v_signals", sql=f"""WITH {SIG}, z AS ({decide_sql('sig', 'CAST(0.28 AS DOUBLE)')}), t AS (SELECT image_id, CASE image_id % 3 WHEN 0 THEN 'Tatami' WHEN 1 THEN 'contour' END AS technique, image_id % 5 = 0 AS split FROM v_signals)
SELECT z.image_id, split OR class IN ('photo_subject', 'photo_scene') AS split_tone, CASE WHEN class = 'photo_subject' AND LOWER(COALESCE(technique, 'tatami')) = 'tatami' THEN 'streamline' ELSE technique END AS technique FROM z JOIN t ON t.image_id = z.image_id""")
def _(s):
    technique = F.when(F.col("image_id") % 3 == 0, "Tatami").when(F.col("image_id") % 3 == 1, "contour")
    split, chosen = K.route(F.col("class"), technique, F.col("image_id") % 5 == 0)
    return P.decide(s).select("image_id", split.alias("split_tone"), chosen.alias("technique"))


@query("x10_run_key", "v_shapes", "v_garments", sql="SELECT design_id, garment_id, 'd' || CAST(design_id AS VARCHAR) || ' @ ' || PRINTF('%g', ROUND(width_in * 25.4, 4)) || 'mm/' || garment_id AS run_key FROM (SELECT DISTINCT design_id FROM v_shapes) s CROSS JOIN v_garments g")
def _(s, g):
    key = K.run_key(F.concat(F.lit("d"), F.col("design_id").cast("string")), F.round(F.col("width_in") * 25.4, 4), F.col("garment_id"))
    return s.select("design_id").distinct().crossJoin(F.broadcast(g)).select("design_id", "garment_id", key.alias("run_key"))
