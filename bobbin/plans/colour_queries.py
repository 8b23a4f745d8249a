"""Queries over the colours of regions and palettes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import colour as K
from .catalogue_queries import de2000_sql, lab_sql
from .registry import query
from .stitch_queries import r4

#: A region's spool: a thread of the chart, by image and label.
SPOOLS = "sp AS (SELECT i.image_id, i.label, t.thread_idx, t.r AS tr, t.g AS tg, t.b AS tb FROM (SELECT DISTINCT image_id, label FROM v_pixels) i JOIN v_threads t ON t.thread_idx = (i.image_id * 3 + i.label) % 60 + 1)"
ERRORS = f"""{SPOOLS}, px AS (SELECT *, COUNT(*) OVER (PARTITION BY image_id, label) AS n, ROW_NUMBER() OVER (PARTITION BY image_id, label ORDER BY y, x) - 1 AS i FROM v_pixels WHERE a > 127),
sm AS (SELECT * FROM px WHERE n >= 50 AND (i = 0 OR FLOOR(i * LEAST(n, 64) / n) <> FLOOR((i - 1) * LEAST(n, 64) / n))), {lab_sql('sm', 'sl')}, sc AS (SELECT image_id, label, thread_idx, tr AS r, tg AS g, tb AS b FROM sp), {lab_sql('sc', 'tl')},
pr AS (SELECT s.image_id, s.label, s.r, s.g, s.b, thread_idx, s.ll AS l1, s.aa AS a1, s.bb AS b1, t.ll AS l2, t.aa AS a2, t.bb AS b2 FROM sl s JOIN tl t ON s.image_id = t.image_id AND s.label = t.label), {de2000_sql('pr', 'd')},
er AS (SELECT image_id, label, thread_idx, COUNT(*) AS samples, QUANTILE_CONT(de, 0.5) AS delta_e, QUANTILE_CONT(r, 0.5) AS median_r, QUANTILE_CONT(g, 0.5) AS median_g, QUANTILE_CONT(b, 0.5) AS median_b FROM d GROUP BY 1, 2, 3)"""


def errors(px, t):
    regions = px.select("image_id", "label").distinct().withColumn("thread_idx", (F.col("image_id") * 3 + F.col("label")) % 60 + 1)
    spools = regions.join(t.select("thread_idx", *[F.col(c).alias(f"t{c}") for c in "rgb"]), "thread_idx")
    return K.region_colour_error(px, spools, 50, 64)


@query("a26_region_colour_error", "v_pixels", "v_threads", sql=f"WITH {ERRORS} SELECT image_id, label, thread_idx, samples, ROUND(delta_e, 4) AS delta_e, ROUND(median_r, 4) AS median_r, ROUND(median_g, 4) AS median_g, ROUND(median_b, 4) AS median_b FROM er")
def _(px, t):
    return r4(errors(px, t), "delta_e", "median_r", "median_g", "median_b")


@query("q2_thread_match_rule", "v_pixels", "v_threads", sql=f"""WITH {ERRORS}, ov AS (SELECT image_id, thread_idx % 4 AS thread_idx, label, ROUND(delta_e, 6) AS delta_e FROM er WHERE ROUND(delta_e, 6) > 30)
SELECT image_id, thread_idx, ROUND(MAX(delta_e), 4) AS delta_e, ARG_MAX(label, delta_e) AS worst, STRING_AGG(CAST(label AS VARCHAR), ',' ORDER BY label) AS regions, CASE WHEN MAX(delta_e) > 45 THEN 'block' ELSE 'warn' END AS severity FROM ov GROUP BY 1, 2""")
def _(px, t):
    e = errors(px, t).withColumn("thread_idx", F.col("thread_idx") % 4)
    return r4(K.thread_match_rule(e, 30, 45).withColumn("delta_e", F.round("delta_e", 6)), "delta_e")


@query("a27_tonal_span", "v_pixels", sql=f"""WITH op AS (SELECT * FROM v_pixels WHERE a > 127), {lab_sql('op', 'pl')}, ct AS (SELECT image_id, label, COUNT(*) AS n, QUANTILE_CONT(ll, 0.05) AS lo, QUANTILE_CONT(ll, 0.95) AS hi FROM pl GROUP BY 1, 2),
bn AS (SELECT image_id, label, n, AVG(ll) FILTER (ROUND(ll, 9) <= ROUND(lo, 9)) AS l1, AVG(aa) FILTER (ROUND(ll, 9) <= ROUND(lo, 9)) AS a1, AVG(bb) FILTER (ROUND(ll, 9) <= ROUND(lo, 9)) AS b1,
 AVG(ll) FILTER (ROUND(ll, 9) >= ROUND(hi, 9)) AS l2, AVG(aa) FILTER (ROUND(ll, 9) >= ROUND(hi, 9)) AS a2, AVG(bb) FILTER (ROUND(ll, 9) >= ROUND(hi, 9)) AS b2 FROM pl JOIN ct USING (image_id, label) GROUP BY 1, 2, 3), {de2000_sql('bn', 'd')}
SELECT image_id, label, n, ROUND(CASE WHEN n >= 24 THEN de ELSE 0 END, 4) AS span FROM d""")
def _(px):
    return r4(K.tonal_span(px), "span")


GROUPED = "gc AS (SELECT design_id AS grp, shape_key AS id, r, g, b, COUNT(*) AS weight FROM (SELECT design_id, r * 65536 + g * 256 + b AS shape_key, r, g, b FROM v_shapes) q GROUP BY 1, 2, 3, 4, 5)"


@query("j15_merge_similar_colours", "v_shapes", sql=f"""WITH RECURSIVE {GROUPED}, {lab_sql('gc', 'cl')}, lk AS (SELECT p.grp, p.id AS u, q.id AS v FROM cl p JOIN cl q ON p.grp = q.grp AND p.id <> q.id AND ROUND(SQRT(POW(p.ll - q.ll, 2) + POW(p.aa - q.aa, 2) + POW(p.bb - q.bb, 2)), 6) <= 6),
rc AS (SELECT grp, id, id AS seen FROM gc UNION SELECT rc.grp, rc.id, lk.v FROM rc JOIN lk ON rc.grp = lk.grp AND rc.seen = lk.u), rt AS (SELECT grp, id, MIN(seen) AS root FROM rc GROUP BY 1, 2),
sm AS (SELECT rt.grp, root, SUM(weight) AS total FROM rt JOIN gc ON rt.grp = gc.grp AND rt.id = gc.id GROUP BY 1, 2), rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY grp ORDER BY total DESC, root) AS rank FROM sm)
SELECT rt.grp, rt.id, rt.root, rank, CAST(total AS BIGINT) AS total FROM rt JOIN rk ON rt.grp = rk.grp AND rt.root = rk.root""")
def _(s):
    key = (F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).alias("id")
    return K.merge_similar_colours(s.groupBy(F.col("design_id").alias("grp"), key, "r", "g", "b").agg(F.count("*").alias("weight")), 6.0)


@query("j21_nearest_pro_colour", "v_shapes", "v_threads", sql="""WITH o AS (SELECT DISTINCT design_id, r * 65536 + g * 256 + b AS grp, r, g, b FROM v_shapes), p AS (SELECT DISTINCT s.design_id, t.thread_idx AS other, t.r AS pr, t.g AS pg, t.b AS pb FROM v_shapes s JOIN v_threads t ON s.thread_idx = t.thread_idx)
SELECT design_id, grp, other, d2 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY design_id, grp ORDER BY d2, other) AS k FROM (SELECT o.design_id, grp, other, (r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb) AS d2 FROM o JOIN p ON o.design_id = p.design_id) q) q WHERE k = 1""")
def _(s, t):
    ours = s.select("design_id", (F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).alias("grp"), "r", "g", "b").distinct()
    theirs = s.select("design_id", "thread_idx").distinct().join(t.select("thread_idx", "r", "g", "b"), "thread_idx").withColumnRenamed("thread_idx", "grp")
    return K.nearest_other_colour(ours, theirs)


MEANS = "pm AS (SELECT image_id, label AS id, CAST(FLOOR(AVG(r) + 0.5) AS BIGINT) AS r, CAST(FLOOR(AVG(g) + 0.5) AS BIGINT) AS g, CAST(FLOOR(AVG(b) + 0.5) AS BIGINT) AS b, COUNT(*) AS weight FROM (SELECT image_id, label * 4 + y % 4 AS label, r, g, b FROM v_pixels) q GROUP BY 1, 2)"


def means(px):
    whole = lambda c: F.floor(F.avg(c) + 0.5).cast("long").alias(c)
    return px.groupBy("image_id", (F.col("label") * 4 + F.col("y") % 4).alias("id")).agg(*[whole(c) for c in "rgb"], F.count("*").alias("weight"))


@query("u9_merge_near_colours_first", "v_pixels", sql=f"""WITH {MEANS}, pp AS (SELECT p.image_id, p.id AS k1, q.id AS k2, (p.r - q.r) * (p.r - q.r) + (p.g - q.g) * (p.g - q.g) + (p.b - q.b) * (p.b - q.b) AS d2 FROM pm p JOIN pm q ON p.image_id = q.image_id AND p.id < q.id),
bs AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY d2, k1, k2) AS k FROM pp WHERE d2 < 256) q WHERE k = 1)
SELECT image_id, id, r, g, b, weight FROM pm WHERE NOT EXISTS (SELECT 1 FROM bs WHERE bs.image_id = pm.image_id AND pm.id IN (k1, k2))
UNION ALL SELECT pm.image_id, MIN(id), CAST(FLOOR(SUM(r * weight) / SUM(weight) + 0.5) AS BIGINT), CAST(FLOOR(SUM(g * weight) / SUM(weight) + 0.5) AS BIGINT), CAST(FLOOR(SUM(b * weight) / SUM(weight) + 0.5) AS BIGINT), CAST(SUM(weight) AS BIGINT) FROM pm JOIN bs ON bs.image_id = pm.image_id AND pm.id IN (k1, k2) GROUP BY 1""")
def _(px):
    return K.merge_nearest_pair(means(px))


@query("u9_merge_near_colours", "v_pixels")
def _(px):
    return K.merge_near_colours(means(px))


SEEDS = f"""dc AS (SELECT image_id, r, g, b, COUNT(*) AS weight FROM v_pixels WHERE a > 127 GROUP BY 1, 2, 3, 4), {lab_sql('dc', 'dl')}, rl AS (SELECT image_id, ROUND(ll, 6) AS ll, ROUND(aa, 6) AS aa, ROUND(bb, 6) AS bb, CAST(SUM(weight) AS BIGINT) AS weight FROM dl GROUP BY 1, 2, 3, 4),
rn AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY ll, aa, bb) - 1 AS i, COUNT(*) OVER (PARTITION BY image_id) AS n FROM rl),
sd AS (SELECT image_id, k AS centre, ll AS cl, aa AS ca, bb AS cb FROM rn, (SELECT UNNEST(RANGE(4)) AS k) q WHERE i = FLOOR((k * 2 + 1) * n / 8)),
na AS (SELECT * FROM (SELECT rl.*, centre, ROW_NUMBER() OVER (PARTITION BY rl.image_id, ll, aa, bb ORDER BY ROUND(SQRT(POW(ll - cl, 2) + POW(aa - ca, 2) + POW(bb - cb, 2)), 6), centre) AS k FROM rl JOIN sd ON rl.image_id = sd.image_id) q WHERE k = 1)"""


def lab_colours(px):
    c = K.lab(px.where("a > 127").groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("weight")))
    return c.select("image_id", *[F.round(x, 6).alias(x) for x in "LAB"], "weight").groupBy("image_id", "L", "A", "B").agg(F.sum("weight").alias("weight"))


@query("a53_kmeans_first_round", "v_pixels", sql=f"WITH {SEEDS} SELECT image_id, centre, ROUND(SUM(ll * weight) / SUM(weight), 3) AS c_l, ROUND(SUM(aa * weight) / SUM(weight), 3) AS c_a, ROUND(SUM(bb * weight) / SUM(weight), 3) AS c_b, CAST(SUM(weight) AS BIGINT) AS weight FROM na GROUP BY 1, 2")
def _(px):
    c = lab_colours(px)
    out = K.kmeans_round(c, K.kmeans_seeds(c, 4))
    return out.select("image_id", F.col("centre").cast("long").alias("centre"), *[F.round(x, 3).alias(f"c_{x.lower()}") for x in "LAB"], "weight")


@query("a53_kmeans_centres", "v_pixels")
def _(px):
    return K.kmeans_centres(lab_colours(px), 4)


@query("a54_median_cut_first", "v_pixels", sql="""WITH dc AS (SELECT image_id, r, g, b, COUNT(*) AS weight FROM v_pixels WHERE a > 127 GROUP BY 1, 2, 3, 4), sp AS (SELECT image_id, MAX(r) - MIN(r) AS sr, MAX(g) - MIN(g) AS sg, MAX(b) - MIN(b) AS sb FROM dc GROUP BY 1),
ax AS (SELECT dc.*, CASE WHEN sr >= sg AND sr >= sb THEN r WHEN sg >= sb THEN g ELSE b END AS v FROM dc JOIN sp USING (image_id)), rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY v, r, g, b) - 1 AS k, COUNT(*) OVER (PARTITION BY image_id) AS n FROM ax)
SELECT image_id, CAST(k >= FLOOR(n / 2) AS INT) AS box, CAST(FLOOR(SUM(r * weight) / SUM(weight) + 0.5) AS INT) AS r, CAST(FLOOR(SUM(g * weight) / SUM(weight) + 0.5) AS INT) AS g, CAST(FLOOR(SUM(b * weight) / SUM(weight) + 0.5) AS INT) AS b, CAST(SUM(weight) AS BIGINT) AS weight FROM rk GROUP BY 1, 2""")
def _(px):
    return K.median_cut(px.where("a > 127").groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("weight")), 2)


@query("a54_median_cut", "v_pixels")
def _(px):
    return K.median_cut(px.where("a > 127").groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("weight")), 8)
