"""Queries over charts, scorecards, submissions, licences and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import text as X
from ..operators import catalogue as K
from .registry import query
from .stitch_queries import r4


@query("f5_filter_threads", "v_threads", sql="SELECT brand_id, thread_idx, name FROM v_threads WHERE CONTAINS(LOWER(name), 'blue') OR CONTAINS(LOWER(number), '12')")
def _(t):
    return K.filter_threads(t, "BLUE ".strip()).unionByName(K.filter_threads(t, "12")).select("brand_id", "thread_idx", "name").distinct()


@query("j1_nearest_thread_rgb", "v_shapes", "v_threads", sql="""WITH c AS (SELECT DISTINCT r, g, b FROM v_shapes), d AS (SELECT c.*, thread_idx, (c.r - t.r) * (c.r - t.r) + (c.g - t.g) * (c.g - t.g) + (c.b - t.b) * (c.b - t.b) AS d2 FROM c CROSS JOIN v_threads t)
SELECT r, g, b, thread_idx, d2 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY r, g, b ORDER BY d2, thread_idx) AS n FROM d) q WHERE n = 1""")
def _(s, t):
    return K.nearest_thread_rgb(s, t)


def lab_sql(src: str, out: str) -> str:
    """Common table expressions that add L, A, B to rows with r, g, b."""
    lin = lambda c: f"CASE WHEN {c} / 255.0 <= 0.04045 THEN CAST({c} / 255.0 AS DOUBLE) / 12.92 ELSE POW((CAST({c} / 255.0 AS DOUBLE) + 0.055) / 1.055, 2.4) END"
    f = lambda t: f"CASE WHEN {t} > 0.008856451679035631 THEN POW({t}, 1.0 / 3) ELSE ({t} * 903.2962962962963 + 16) / 116 END"
    return f"""{out}l AS (SELECT *, {lin('r')} AS lr, {lin('g')} AS lg, {lin('b')} AS lb FROM {src}),
{out}x AS (SELECT *, (lr * 0.4124564 + lg * 0.3575761 + lb * 0.1804375) / 0.95047 AS tx, lr * 0.2126729 + lg * 0.7151522 + lb * 0.0721750 AS ty, (lr * 0.0193339 + lg * 0.1191920 + lb * 0.9503041) / 1.08883 AS tz FROM {out}l),
{out}f AS (SELECT *, {f('tx')} AS fx, {f('ty')} AS fy, {f('tz')} AS fz FROM {out}x),
{out} AS (SELECT *, 116 * fy - 16 AS ll, 500 * (fx - fy) AS aa, 200 * (fy - fz) AS bb FROM {out}f)"""


def de2000_sql(src: str, out: str) -> str:
    """Common table expressions that add de (CIEDE2000) to rows with l1, a1, b1, l2, a2, b2."""
    hue = lambda x, y: f"CASE WHEN {x} = 0 AND {y} = 0 THEN 0 ELSE (CASE WHEN DEGREES(ATAN2({y}, {x})) < 0 THEN DEGREES(ATAN2({y}, {x})) + 360 ELSE DEGREES(ATAN2({y}, {x})) END) END"
    return f"""{out}1 AS (SELECT *, POW((SQRT(a1 * a1 + b1 * b1) + SQRT(a2 * a2 + b2 * b2)) / 2, 7) AS c7 FROM {src}),
{out}2 AS (SELECT *, a1 * (1.5 - 0.5 * SQRT(c7 / (c7 + 6103515625.0))) AS p1, a2 * (1.5 - 0.5 * SQRT(c7 / (c7 + 6103515625.0))) AS p2 FROM {out}1),
{out}3 AS (SELECT *, SQRT(p1 * p1 + b1 * b1) AS k1, SQRT(p2 * p2 + b2 * b2) AS k2, {hue('p1', 'b1')} AS h1, {hue('p2', 'b2')} AS h2 FROM {out}2),
{out}4 AS (SELECT *, CASE WHEN k1 * k2 = 0 THEN 0 WHEN ABS(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 > h1 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END AS dh,
  CASE WHEN k1 * k2 = 0 THEN h1 + h2 WHEN ABS(h1 - h2) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS mh, (l1 + l2) / 2 AS ml, (k1 + k2) / 2 AS mk FROM {out}3),
{out}5 AS (SELECT *, 1 - 0.17 * COS(RADIANS(mh - 30)) + 0.24 * COS(RADIANS(2 * mh)) + 0.32 * COS(RADIANS(3 * mh + 6)) - 0.2 * COS(RADIANS(4 * mh - 63)) AS tt FROM {out}4),
{out}6 AS (SELECT *, (l2 - l1) / (1 + 0.015 * POW(ml - 50, 2) / SQRT(20 + POW(ml - 50, 2))) AS ul, (k2 - k1) / (1 + 0.045 * mk) AS uk, 2 * SQRT(k1 * k2) * SIN(RADIANS(dh / 2)) / (1 + 0.015 * mk * tt) AS uh,
  -2 * SQRT(POW(mk, 7) / (POW(mk, 7) + 6103515625.0)) * SIN(RADIANS(60 * EXP(-POW((mh - 275) / 25, 2)))) AS rt FROM {out}5),
{out} AS (SELECT *, SQRT(GREATEST(0, ul * ul + uk * uk + uh * uh + rt * uk * uh)) AS de FROM {out}6)"""


def pairs_sql(colors: str, chart: str = "SELECT r, g, b, MIN(thread_idx) AS thread_idx FROM v_threads GROUP BY 1, 2, 3") -> str:
    """d: every colour of `colors` with every colour of the chart (its lowest thread), with de."""
    return f"""cc AS ({colors}), ch AS ({chart}), {lab_sql('cc', 'cl')}, {lab_sql('ch', 'hl')},
pr AS (SELECT c.*, t.thread_idx, c.ll AS l1, c.aa AS a1, c.bb AS b1, t.ll AS l2, t.aa AS a2, t.bb AS b2 FROM cl c CROSS JOIN hl t), {de2000_sql('pr', 'd')}"""


DISTINCT = "SELECT DISTINCT r, g, b FROM v_shapes"
NEAREST = pairs_sql(DISTINCT) + ", nn AS (SELECT r, g, b, thread_idx, ROUND(de, 6) AS delta_e FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY r, g, b ORDER BY ROUND(de, 6), thread_idx) AS k FROM d) q WHERE k = 1)"


@query("p8_rgb_to_lab", "v_threads", sql=f"WITH {lab_sql('v_threads', 'z')} SELECT thread_idx, ROUND(ll, 4) AS lab_l, ROUND(aa, 4) AS lab_a, ROUND(bb, 4) AS lab_b FROM z")
def _(t):
    return K.with_lab(t, "lab_").select("thread_idx", F.round("lab_L", 4).alias("lab_l"), F.round("lab_A", 4).alias("lab_a"), F.round("lab_B", 4).alias("lab_b"))


@query("p9_delta_e76", "v_threads", sql=f"WITH {lab_sql('v_threads', 'z')} SELECT a.thread_idx AS a_idx, b.thread_idx AS b_idx, ROUND(SQRT(POW(a.ll - b.ll, 2) + POW(a.aa - b.aa, 2) + POW(a.bb - b.bb, 2)), 3) AS delta_e FROM z a JOIN z b ON b.thread_idx = a.thread_idx + 1")
def _(t):
    z = K.with_lab(t, "lab_")
    n = z.select((F.col("thread_idx") - 1).alias("thread_idx"), F.col("thread_idx").alias("b_idx"), *[F.col(f"lab_{c}").alias(f"n_{c}") for c in "LAB"])
    return z.join(n, "thread_idx").select(F.col("thread_idx").alias("a_idx"), "b_idx", F.round(C.delta_e76(tuple(F.col(f"lab_{c}") for c in "LAB"), tuple(F.col(f"n_{c}") for c in "LAB")), 3).alias("delta_e"))


@query("p9_delta_e2000", "v_threads", sql=f"WITH {lab_sql('v_threads', 'z')}, pr AS (SELECT a.thread_idx AS a_idx, b.thread_idx AS b_idx, a.ll AS l1, a.aa AS a1, a.bb AS b1, b.ll AS l2, b.aa AS a2, b.bb AS b2 FROM z a JOIN z b ON b.thread_idx = a.thread_idx + 1), {de2000_sql('pr', 'd')} SELECT a_idx, b_idx, ROUND(de, 4) AS delta_e FROM d")
def _(t):
    z = K.with_lab(t, "lab_")
    n = z.select((F.col("thread_idx") - 1).alias("thread_idx"), F.col("thread_idx").alias("b_idx"), *[F.col(f"lab_{c}").alias(f"n_{c}") for c in "LAB"])
    return z.join(n, "thread_idx").select(F.col("thread_idx").alias("a_idx"), "b_idx", F.round(C.delta_e2000(tuple(F.col(f"lab_{c}") for c in "LAB"), tuple(F.col(f"n_{c}") for c in "LAB")), 4).alias("delta_e"))


@query("p10_luminance", "v_threads", sql=f"WITH {lab_sql('v_threads', 'z')} SELECT thread_idx, ROUND(lr * 0.2126 + lg * 0.7152 + lb * 0.0722, 4) AS luminance FROM z")
def _(t):
    return t.select("thread_idx", F.round(C.luminance(F.col("r"), F.col("g"), F.col("b")), 4).alias("luminance"))


@query("j2_nearest_thread_lab", "v_shapes", "v_threads", sql=f"WITH {NEAREST} SELECT r, g, b, thread_idx, ROUND(delta_e, 4) AS delta_e FROM nn")
def _(s, t):
    return r4(K.nearest_thread_lab(s, t), "delta_e")


@query("j3_snap_palette", "v_shapes", "v_threads", sql=f"WITH {NEAREST} SELECT s.shape_id, nn.thread_idx, DENSE_RANK() OVER (ORDER BY nn.thread_idx) - 1 AS label FROM v_shapes s JOIN nn ON s.r = nn.r AND s.g = nn.g AND s.b = nn.b")
def _(s, t):
    return K.snap_palette(s, t)


@query("a34_palette_costs", "v_shapes", "v_threads", sql=f"WITH {pairs_sql(DISTINCT)}, m AS (SELECT *, MIN(de) OVER (PARTITION BY r, g, b) AS fl FROM d) SELECT thread_idx, COUNT(*) AS colors, ROUND(SUM(ROUND(de, 6)), 2) AS cost, ROUND(SUM(ROUND(fl, 6)), 2) AS floors FROM m GROUP BY 1")
def _(s, t):
    costs = K.palette_costs(s.select("r", "g", "b").distinct(), K.chart_colors(t))
    return costs.groupBy("thread_idx").agg(F.count("*").alias("colors"), F.round(F.sum("delta_e"), 2).alias("cost"), F.round(F.sum("floor"), 2).alias("floors"))


def _weighted(s):
    return s.groupBy("r", "g", "b").agg(F.count("*").alias("weight"))


WEIGHTED = "SELECT r, g, b, COUNT(*) AS w FROM v_shapes GROUP BY 1, 2, 3"


@query("t5_select_palette_first", "v_shapes", "v_threads", sql=f"WITH {pairs_sql(WEIGHTED)}, s1 AS (SELECT thread_idx, ROUND(SUM(w * ROUND(de, 6)), 3) AS cost FROM d GROUP BY 1) SELECT 1 AS place, thread_idx FROM s1 ORDER BY cost, thread_idx LIMIT 1")
def _(s, t):
    chosen = K.select_palette(_weighted(s), t, 1, extra=0)
    return s.sparkSession.createDataFrame([(k + 1, c) for k, c in enumerate(chosen)], "place int, thread_idx long")


SECOND = f"""{pairs_sql(WEIGHTED)}, s1 AS (SELECT thread_idx FROM (SELECT thread_idx, ROUND(SUM(w * ROUND(de, 6)), 3) AS cost FROM d GROUP BY 1) q ORDER BY cost, thread_idx LIMIT 1),
n1 AS (SELECT r, g, b, ROUND(de, 6) AS near FROM d WHERE thread_idx = (SELECT thread_idx FROM s1)),
s2 AS (SELECT d.thread_idx, ROUND(SUM(w * LEAST(near, ROUND(de, 6))), 3) AS cost FROM d JOIN n1 ON d.r = n1.r AND d.g = n1.g AND d.b = n1.b WHERE d.thread_idx <> (SELECT thread_idx FROM s1) GROUP BY 1)"""


@query("t5_select_palette", "v_shapes", "v_threads", sql=f"WITH {SECOND} SELECT 1 AS place, thread_idx FROM s1 UNION ALL (SELECT 2, thread_idx FROM s2 ORDER BY cost, thread_idx LIMIT 1)")
def _(s, t):
    chosen = K.select_palette(_weighted(s), t, 2, extra=0)
    return s.sparkSession.createDataFrame([(k + 1, c) for k, c in enumerate(chosen)], "place int, thread_idx long")


@query("t5_select_palette_whole", "v_shapes", "v_threads")
def _(s, t):
    chosen = K.select_palette(_weighted(s), t, 6)
    return s.sparkSession.createDataFrame([(k + 1, c) for k, c in enumerate(chosen)], "place int, thread_idx long")


#: The palette to be improved: the six lowest threads of the chart's colours.
FIRST_SIX = f"""{pairs_sql(WEIGHTED)}, sx AS (SELECT thread_idx, ROW_NUMBER() OVER (ORDER BY thread_idx) - 1 AS place FROM (SELECT DISTINCT thread_idx FROM d ORDER BY thread_idx LIMIT 6) q), ds AS (SELECT r, g, b, w, thread_idx, ROUND(de, 6) AS de FROM d),
hd AS (SELECT r, g, b, place, de, ROW_NUMBER() OVER (PARTITION BY r, g, b ORDER BY de, place) AS k FROM ds JOIN sx USING (thread_idx)), st AS (SELECT x.r, x.g, x.b, x.de AS d1, x.place AS near, y.de AS d2 FROM hd x JOIN hd y ON x.r = y.r AND x.g = y.g AND x.b = y.b AND x.k = 1 AND y.k = 2)"""


def first_six(t):
    return [r["thread_idx"] for r in K.chart_colors(t).select("thread_idx").orderBy("thread_idx").limit(6).collect()]


@query("t6_swap_costs", "v_shapes", "v_threads", sql=f"""WITH {FIRST_SIX} SELECT sx.place, ds.thread_idx, ROUND(SUM(w * LEAST(ds.de, CASE WHEN near = sx.place THEN d2 ELSE d1 END)), 2) AS cost
FROM ds JOIN st USING (r, g, b) CROSS JOIN sx WHERE ds.thread_idx NOT IN (SELECT thread_idx FROM sx) GROUP BY 1, 2""")
def _(s, t):
    costs = K.palette_costs(_weighted(s), K.chart_colors(t))
    return K.swap_costs(costs, first_six(t)).withColumn("cost", F.round("cost", 2)).withColumn("place", F.col("place").cast("long"))


@query("t6_swap_palette", "v_shapes", "v_threads")
def _(s, t):
    chosen, cost = K.swap_palette(_weighted(s), t, first_six(t))
    return s.sparkSession.createDataFrame([(k, c, cost) for k, c in enumerate(chosen)], "place int, thread_idx long, cost double")


@query("s10_palette_lines", "v_threads", sql="SELECT thread_idx, r, g, b, CAST(thread_idx AS VARCHAR) AS number, name FROM v_threads WHERE b < 200")
def _(t):
    line = F.concat_ws(" ", "r", "g", F.when(F.col("b") < 200, F.col("b")).otherwise(F.col("b") + 100), "name", "number")
    return K.parse_palette_lines(t.select("thread_idx", line.alias("line"))).select("thread_idx", "r", "g", "b", "number", "name")


@query("s11_brand_catalogue", "v_threads", sql="WITH g AS (SELECT brand_id, COUNT(*) AS threads, REGEXP_REPLACE(REGEXP_REPLACE(LOWER(brand_id), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM v_threads GROUP BY 1) SELECT *, threads >= 8 AS ok FROM g WHERE slug <> 'brand-11'")
def _(t):
    return K.build_brand_catalogue(t, 8, ("brand-11",))


@query("j7_scorecard_diff", "v_scorecard_base", "v_scorecard_new", sql="SELECT COALESCE(a.run_key, b.run_key) AS run_key, CASE WHEN a.run_key IS NULL THEN 'new' WHEN b.run_key IS NULL THEN 'missing' ELSE 'shared' END AS state FROM (SELECT DISTINCT run_key FROM v_scorecard_base) a FULL JOIN (SELECT DISTINCT run_key FROM v_scorecard_new) b ON a.run_key = b.run_key")
def _(a, b):
    return K.scorecard_diff(a, b)


DIFF = """a AS (SELECT run_key, finding, COUNT(*) AS n FROM v_scorecard_base WHERE run_key IN (SELECT run_key FROM v_scorecard_new) GROUP BY 1, 2), b AS (SELECT run_key, finding, COUNT(*) AS n FROM v_scorecard_new WHERE run_key IN (SELECT run_key FROM v_scorecard_base) GROUP BY 1, 2),
d AS (SELECT COALESCE(a.run_key, b.run_key) AS run_key, COALESCE(a.finding, b.finding) AS finding, COALESCE(a.n, 0) AS before, COALESCE(b.n, 0) AS after FROM a FULL JOIN b ON a.run_key = b.run_key AND a.finding = b.finding),
f AS (SELECT *, CASE WHEN before = 0 THEN 'appeared' WHEN after = 0 THEN 'resolved' ELSE 'count' END AS change, before = 0 AND finding LIKE '%:block' AS new_block FROM d WHERE before <> after)"""
DELTAS = """ma AS (SELECT run_key, AVG(metric) AS o FROM v_scorecard_base GROUP BY 1), mb AS (SELECT run_key, AVG(metric) AS n FROM v_scorecard_new GROUP BY 1),
md AS (SELECT ma.run_key, o, n, (n - o) / CASE WHEN o <> 0 THEN ABS(o) ELSE GREATEST(ABS(n), 1e-9) END AS rel FROM ma JOIN mb ON ma.run_key = mb.run_key)"""


@query("u2_findings_diff", "v_scorecard_base", "v_scorecard_new", sql=f"WITH {DIFF} SELECT * FROM f")
def _(a, b):
    return K.findings_diff(a, b)


@query("u3_metric_deltas", "v_scorecard_base", "v_scorecard_new", sql=f"WITH {DELTAS} SELECT run_key, ROUND(o, 4) AS old, ROUND(n, 4) AS new, ROUND(rel, 4) AS relative FROM md WHERE ABS(rel) >= 0.05")
def _(a, b):
    return r4(K.metric_deltas(a, b), "old", "new", "relative")


@query("u4_regression_gate", "v_scorecard_base", "v_scorecard_new", sql=f"""WITH {DIFF}, {DELTAS}, ks AS (SELECT COALESCE(x.run_key, y.run_key) AS run_key, CASE WHEN x.run_key IS NULL THEN 'new' WHEN y.run_key IS NULL THEN 'missing' ELSE 'shared' END AS state FROM (SELECT DISTINCT run_key FROM v_scorecard_base) x FULL JOIN (SELECT DISTINCT run_key FROM v_scorecard_new) y ON x.run_key = y.run_key),
g AS (SELECT run_key, COUNT(*) AS changes, BOOL_OR(new_block) AS nb FROM f GROUP BY 1),
z AS (SELECT ks.run_key, state, COALESCE(changes, 0) AS changes, COALESCE(nb, false) AS new_block, md.run_key IS NOT NULL AS drift FROM ks LEFT JOIN g ON ks.run_key = g.run_key LEFT JOIN md ON ks.run_key = md.run_key AND ABS(rel) >= 0.05)
SELECT *, CASE WHEN state = 'missing' OR new_block THEN 'fail' WHEN state = 'new' OR changes > 0 OR drift THEN 'report' ELSE 'same' END AS verdict FROM z""")
def _(a, b):
    return K.regression_gate(a, b)


@query("u7_shared_and_excluded", "v_scorecard_base", "v_scorecard_new", sql="SELECT run_key, 'shared' AS side FROM (SELECT run_key FROM v_scorecard_base INTERSECT SELECT run_key FROM v_scorecard_new) q UNION ALL SELECT run_key, 'base' FROM (SELECT run_key FROM v_scorecard_base EXCEPT SELECT run_key FROM v_scorecard_new) q UNION ALL SELECT run_key, 'new' FROM (SELECT run_key FROM v_scorecard_new EXCEPT SELECT run_key FROM v_scorecard_base) q")
def _(a, b):
    x, y = a.select("run_key"), b.select("run_key")
    return x.intersect(y).withColumn("side", F.lit("shared")).union(x.subtract(y).withColumn("side", F.lit("base"))).union(y.subtract(x).withColumn("side", F.lit("new")))


@query("x11_finding_keys", "v_scorecard_base", sql="SELECT run_key, ARRAY_TO_STRING(LIST_SORT(LIST(finding)), '|') AS findings FROM v_scorecard_base GROUP BY 1")
def _(a):
    return K.finding_keys(a)


@query("r1_dedupe_submissions", "v_submissions", sql="""WITH e AS (SELECT *, COALESCE(SUM(CASE WHEN state = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY content_key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS era FROM v_submissions)
SELECT event_id, content_key, FIRST_VALUE(event_id) OVER w AS job_id, ROW_NUMBER() OVER w = 1 AS runs FROM e WINDOW w AS (PARTITION BY content_key, era ORDER BY ts, event_id)""")
def _(s):
    return K.dedupe_submissions(s)


@query("r2_job_state_counts", "v_submissions", sql="SELECT state, COUNT(*) AS jobs FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY content_key ORDER BY ts DESC, event_id DESC) AS n FROM v_submissions) q WHERE n = 1 GROUP BY 1")
def _(s):
    return K.job_state_counts(s)


@query("x7_content_key", "v_submissions", sql="""SELECT event_id, SHA256(CONCAT(SHA256(content_key), '|', '{"order":"1","state":"', state, '"}')) AS key, SHA256(CONCAT(SHA256(content_key), '|', '{"state":"', state, '"}')) AS generation FROM v_submissions""")
def _(s):
    config = F.create_map(F.lit("state"), F.col("state"), F.lit("order"), F.lit("1"))
    return s.select("event_id", K.content_key(F.col("content_key"), config).alias("key"), K.generation_key(F.col("content_key"), config).alias("generation"))


@query("x2_strip_emails", "v_licences", sql="""SELECT font_id, SHA256(TRIM(REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(license, '[(<][^()<> ]+@[^()<> ]+[)>]', '', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '', 'g'), ' {2,}', ' ', 'g'))) AS text_hash FROM v_licences""")
def _(d):
    return d.select("font_id", F.sha2(X.strip_emails(F.col("license")), 256).alias("text_hash"))


@query("x4_first_paragraph", "v_licences", sql="SELECT font_id, SHA256(STRING_SPLIT(license, chr(10))[1]) AS head_hash FROM v_licences")
def _(d):
    return d.select("font_id", F.sha2(X.first_paragraph(F.col("license"), "\n"), 256).alias("head_hash"))


@query("x14_style_prop", "v_markup", sql="SELECT page_id, NULLIF(TRIM(REGEXP_EXTRACT(REGEXP_EXTRACT(html, '<style>p\\{([^}]*)\\}', 1), '(?:^|;)\\s*margin\\s*:\\s*([^;]+)', 1)), '') AS margin FROM v_markup")
def _(p):
    return p.select("page_id", X.style_prop(F.regexp_extract("html", r"<style>p\{([^}]*)\}", 1), "margin").alias("margin"))


@query("x16_safe_stem", "pages", sql="SELECT page_id, REGEXP_REPLACE(REGEXP_REPLACE(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g') AS stem FROM pages")
def _(p):
    return p.select("page_id", X.safe_stem(F.col("url")).alias("stem"))


@query("p15_chance_correct", "v_signals", sql="SELECT image_id, ROUND(CASE WHEN alpha >= 0.999 THEN ucm ELSE GREATEST(0, (ucm - alpha) / (1 - alpha)) END, 4) AS kappa FROM v_signals")
def _(s):
    return s.select("image_id", F.round(C.chance_correct(F.col("ucm"), F.col("alpha")), 4).alias("kappa"))


@query("p16_gate_confidence", "v_signals", sql="SELECT image_id, ROUND(LEAST(1.0, 0.5 + 0.5 * ABS(ucm - 0.33) / 0.2), 4) AS confidence FROM v_signals")
def _(s):
    return s.select("image_id", F.round(C.gate_confidence(F.col("ucm"), 0.33, 0.2), 4).alias("confidence"))


@query("p11_chi2_distance", "v_descriptors", sql="""WITH e AS (SELECT shape_id, UNNEST(embedding) AS v, UNNEST(RANGE(LEN(embedding))) AS i FROM v_descriptors),
n AS (SELECT shape_id, i, v * v AS v, SUM(v * v) OVER (PARTITION BY shape_id) AS t FROM e)
SELECT a.shape_id, ROUND(SUM(CASE WHEN a.v / a.t + b.v / b.t = 0 THEN 0 ELSE POW(a.v / a.t - b.v / b.t, 2) / (a.v / a.t + b.v / b.t) END) / 2, 4) AS distance FROM n a JOIN n b ON b.shape_id = a.shape_id + 1 AND a.i = b.i GROUP BY 1""")
def _(d):
    h = d.select("shape_id", F.transform("embedding", lambda v: v.cast("double") * v.cast("double")).alias("h"))
    n = h.select((F.col("shape_id") - 1).alias("shape_id"), F.col("h").alias("g"))
    return h.join(n, "shape_id").select("shape_id", F.round(C.chi2_distance(F.col("h"), F.col("g")), 4).alias("distance"))
