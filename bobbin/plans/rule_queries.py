"""Queries over quality rules, corpus studies, sheets and text sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import catalogue as K
from ..operators import study as D
from ..operators import technique as T
from ..sources import text as R
from . import qc
from .registry import query
from .stitch_queries import CLASSES, GAPS, KTH, RUNS, r4
from .technique_queries import ADVANCE, SATIN

SMALL = f"e AS (SELECT design_id, run, {KTH.format(v='len', q=0.5)} AS col, GREATEST(MAX(GREATEST(x0, x1)) - MIN(LEAST(x0, x1)), MAX(GREATEST(y0, y1)) - MIN(LEAST(y0, y1))) AS ext FROM ss GROUP BY 1, 2), sm AS (SELECT design_id, COUNT(*) FILTER (col < 24 OR ext < 30) AS small, COUNT(*) AS total FROM e GROUP BY 1)"


@query("q10_lettering_rule", "v_stitches", sql=f"WITH {SATIN}, {SMALL} SELECT design_id, 'lettering_small' AS code, 'warn' AS severity, CAST(small AS DOUBLE) AS metric, CAST(total AS BIGINT) AS total FROM sm WHERE small > 2")
def _(st):
    return qc.lettering_rule(st, qc.Limits(column_u=24, extent_u=30, small_shapes=2))


DENSITY = f"""{ADVANCE}, fr AS (SELECT design_id, CASE WHEN LEN(st) >= 1 THEN st[LEN(st) // 2 + 1] END AS fill FROM fd), tw AS (SELECT r.design_id, SQRT(CAST(POW(LEAD(x_u, 2) OVER w - x_u, 2) + POW(LEAD(y_u, 2) OVER w - y_u, 2) AS DOUBLE)) AS two FROM r JOIN c USING (design_id, run) WHERE c.kind = 'satin' WINDOW w AS (PARTITION BY r.design_id, run ORDER BY seq)),
sa AS (SELECT design_id, CASE WHEN LEN(l) >= 1 THEN l[LEN(l) // 2 + 1] END AS satin FROM (SELECT design_id, LIST_SORT(LIST(two) FILTER (two IS NOT NULL)) AS l FROM tw GROUP BY 1) q),
fa_ AS (SELECT row_number() OVER (ORDER BY fabric_id) - 1 AS k, density_adjust FROM v_fabrics), ds AS (SELECT d.design_id, density_adjust, fill, satin FROM (SELECT DISTINCT design_id FROM v_stitches) d JOIN fa_ ON k = d.design_id % 7 LEFT JOIN fr USING (design_id) LEFT JOIN sa USING (design_id)),
dm AS (SELECT design_id, 'fill' AS part, fill / (11.0 * density_adjust) AS ratio FROM ds WHERE fill IS NOT NULL UNION ALL SELECT design_id, 'satin', satin / (11.0 * density_adjust) FROM ds WHERE satin IS NOT NULL)"""


@query("q5_density_rule", "v_stitches", "v_fabrics", sql=f"WITH {DENSITY} SELECT design_id, CASE WHEN ratio > 1 THEN part || '_open' ELSE part || '_dense' END AS code, 'warn' AS severity, ROUND(ratio, 4) AS metric FROM dm WHERE ROUND(ratio, 6) > 1.5 OR ROUND(ratio, 6) < ROUND(1 / 1.5, 6)")
def _(st, fabrics):
    place = fabrics.select("density_adjust", (F.row_number().over(D.by("fabric_id")) - 1).alias("k"))
    adjust = st.select("design_id").distinct().join(F.broadcast(place), F.col("design_id") % 7 == F.col("k")).select("design_id", "density_adjust")
    return r4(qc.density_rule(st, adjust, qc.Limits(fill_u=11, satin_u=11, samples=1)), "metric")


@query("q3_stitch_length_rules", "v_stitches", sql=f"""WITH {SATIN}, q AS (SELECT design_id, COUNT(*) AS n, AVG(CASE WHEN len < 22 THEN 1 ELSE 0 END) AS sh FROM ss GROUP BY 1), w AS (SELECT *, LAG(cmd) OVER o AS pc, LAG(x_u) OVER o AS px, LAG(y_u) OVER o AS py FROM v_stitches WINDOW o AS (PARTITION BY design_id ORDER BY seq)),
ln AS (SELECT design_id, COUNT(*) AS too_long FROM w WHERE cmd = 'stitch' AND pc = 'stitch' AND SQRT(CAST((x_u - px) * (x_u - px) + (y_u - py) * (y_u - py) AS DOUBLE)) > 36 GROUP BY 1)
SELECT design_id, 'too_long' AS code, 'block' AS severity FROM ln WHERE too_long > 29 UNION ALL SELECT design_id, 'too_short', 'warn' FROM q WHERE n >= 8 AND sh > 0.25""")
def _(st):
    return qc.stitch_length_rules(st, qc.Limits(longest_u=36, too_many_long=29, shortest_u=22, satin_steps=8)).select("design_id", "code", "severity")


@query("j19_mitre_pairs", "v_stitches", sql=f"WITH {GAPS}, {CLASSES.replace('WITH ', '')[CLASSES.index(', t AS') + 2:]}, z AS (SELECT e.* FROM e JOIN c ON e.design_id = c.design_id AND e.run = c.run WHERE c.kind = 'satin') SELECT DISTINCT p.design_id, p.run FROM z p JOIN z q ON p.design_id = q.design_id AND p.run <> q.run AND POW(p.x1 - q.x0, 2) + POW(p.y1 - q.y0, 2) < 10000")
def _(st):
    return D.satin_mitres(st, 100)


@query("q18_corpus_study", "v_stitches", sql=f"""WITH {SATIN}, sn AS (SELECT design_id, COUNT(*) FILTER (cmd = 'stitch') AS stitches, COUNT(*) FILTER (cmd = 'trim') AS trims, COUNT(*) FILTER (cmd = 'color') + 1 AS blocks FROM v_stitches GROUP BY 1),
rn AS (SELECT design_id, COUNT(DISTINCT run) AS runs FROM r GROUP BY 1), kn AS (SELECT design_id, COUNT(*) FILTER (kind = 'satin') AS satin, COUNT(*) FILTER (kind = 'fill') AS fill, COUNT(*) FILTER (kind = 'run') AS run, COUNT(*) FILTER (kind = 'lock') AS lock FROM c GROUP BY 1),
wd AS (SELECT design_id, run, {KTH.format(v='len', q=0.5)} AS w FROM ss GROUP BY 1, 2), wm AS (SELECT design_id, LIST_SORT(LIST(w))[COUNT(*) // 2 + 1] AS width, MAX(w) AS widest FROM wd GROUP BY 1),
tl AS (SELECT design_id, run, COUNT(*) FILTER (len <= 8 AND k <= 4) AS tiny FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY design_id, run ORDER BY seq DESC) AS k FROM s) q GROUP BY 1, 2), lk AS (SELECT design_id, COUNT(*) FILTER (tiny >= 2) AS locked FROM tl GROUP BY 1)
SELECT sn.design_id, stitches, runs, blocks, ROUND(trims * 1000.0 / stitches, 4) AS trims_per_1000, COALESCE(satin, 0) AS satin, COALESCE(fill, 0) AS fill, COALESCE(run, 0) AS run, COALESCE(lock, 0) AS lock, ROUND(width, 4) AS width, ROUND(widest, 4) AS widest, COALESCE(locked, 0) AS locked
FROM sn LEFT JOIN rn USING (design_id) LEFT JOIN kn USING (design_id) LEFT JOIN wm USING (design_id) LEFT JOIN lk USING (design_id)""")
def _(st):
    return r4(D.corpus_study(st), "trims_per_1000", "width", "widest")


@query("a47_acceptance_sheet", "v_shapes", "v_stitches", sql="""WITH sh AS (SELECT design_id, layer AS variant, COUNT(*) AS shapes, COUNT(DISTINCT CASE WHEN stitched THEN thread_idx END) AS threads, COUNT(*) FILTER (NOT stitched) AS warnings FROM v_shapes GROUP BY 1, 2),
st AS (SELECT design_id, COUNT(*) FILTER (cmd = 'stitch') AS stitches, COUNT(*) FILTER (cmd = 'trim') AS trims FROM v_stitches GROUP BY 1) SELECT sh.design_id, variant, shapes, threads, warnings, stitches, trims FROM sh LEFT JOIN st ON sh.design_id = st.design_id""")
def _(s, st):
    return D.acceptance_sheet(s, st)


@query("q32_variant_sheet", "v_shapes", "v_stitches", "v_garments", sql="""WITH sh AS (SELECT design_id, COUNT(*) AS shapes, COUNT(DISTINCT CASE WHEN stitched THEN thread_idx END) AS threads FROM v_shapes GROUP BY 1), st AS (SELECT design_id, COUNT(*) FILTER (cmd = 'stitch') AS stitches, COUNT(*) FILTER (cmd = 'trim') AS trims FROM v_stitches GROUP BY 1)
SELECT sh.design_id, garment_id, shapes, threads, stitches, trims FROM sh CROSS JOIN v_garments LEFT JOIN st ON sh.design_id = st.design_id""")
def _(s, st, g):
    return D.variant_sheet(s, st, g.select("garment_id"))


@query("j11_fabric_for_garment", "v_stitches", "v_garments", "v_fabrics", sql="SELECT d.design_id, g.garment_id, COALESCE(f.fabric_id, 'pique_knit') AS fabric_id, COALESCE(f.trim_at_mm, 3.0) AS trim_at_mm, d.reach_u > COALESCE(f.trim_at_mm, 3.0) * 10 AS trims FROM (SELECT design_id, MAX(ABS(x_u)) % 61 AS reach_u FROM v_stitches GROUP BY 1) d CROSS JOIN v_garments g LEFT JOIN v_fabrics f ON g.fabric_id = f.fabric_id AND f.fabric_id <> 'terry_towel'")
def _(st, g, f):
    look = K.fabric_for_garment(g, f.where("fabric_id <> 'terry_towel'"), "pique_knit")
    d = st.groupBy("design_id").agg((F.max(F.abs("x_u")) % 61).alias("reach_u"))
    return K.fixture_matrix(d, look).select("design_id", "garment_id", "fabric_id", "trim_at_mm", (F.col("reach_u") > F.col("trim_at_mm") * 10).alias("trims"))


@query("t3_top_far_points", "v_stitches", sql="""WITH p AS (SELECT design_id, seq, x_u, y_u, x_u * x_u + y_u * y_u AS d2 FROM v_stitches WHERE cmd = 'stitch'), a AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY design_id ORDER BY d2 DESC, seq) AS k FROM p WHERE d2 > 0) q WHERE k = 1),
f AS (SELECT p.* FROM p JOIN a ON p.design_id = a.design_id WHERE p.d2 > 0 AND POW(p.x_u - a.x_u, 2) + POW(p.y_u - a.y_u, 2) > 2500), b AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY design_id ORDER BY d2 DESC, seq) AS k FROM f) q WHERE k = 1)
SELECT design_id, seq, 1 AS place FROM a UNION ALL SELECT design_id, seq, 2 FROM b""")
def _(st):
    p = st.where("cmd = 'stitch'").withColumn("d", F.col("x_u") * F.col("x_u") + F.col("y_u") * F.col("y_u"))
    return D.top_far_points(p, 2, 50).select("design_id", "seq", "place")


@query("s8_stitch_csv", "v_stitches", sql=f"WITH {RUNS} SELECT design_id, seq, CAST(block AS BIGINT) AS block, CAST(run AS BIGINT) AS run, ROUND(x_u * 0.1, 4) AS x_mm, ROUND(y_u * 0.1, 4) AS y_mm, seq % 9 = 0 AS trim FROM r")
def _(st):
    from ..operators.stream import runs

    r = runs(st)
    said = F.element_at(F.array(F.lit(" TRUE "), F.lit("1"), F.lit("t"), F.lit("Yes")), (F.col("seq") % 4 + 1).cast("int"))
    line = F.concat_ws(",", "block", "run", F.when(F.col("seq") % 9 == 0, said).otherwise("no"), F.lit("0"), F.round(F.col("x_u") * 0.1, 1), F.round(F.col("y_u") * 0.1, 1))
    return r4(R.parse_stitch_lines(r.select("design_id", "seq", line.alias("line"))), "x_mm", "y_mm").select("design_id", "seq", "block", "run", "x_mm", "y_mm", "trim")


@query("s9_thread_charts", "v_threads", sql="SELECT brand_id, CAST(ROW_NUMBER() OVER (PARTITION BY brand_id ORDER BY thread_idx) - 1 AS BIGINT) AS idx, number, name, r, g, b FROM v_threads")
def _(t):
    entry = F.struct("thread_idx", F.array("number", "name", F.concat_ws(",", "r", "g", "b")).alias("e"))
    text = F.to_json(F.struct(F.col("brand_id").alias("id"), F.concat(F.lit("Chart "), "brand_id").alias("label"), "threads"))
    charts = t.groupBy("brand_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.struct(x["e"][0].alias("number"), x["e"][1].alias("name"), F.transform(F.split(x["e"][2], ","), lambda c: c.cast("int")).alias("rgb"))).alias("threads")).select(text.alias("text"))
    return R.parse_charts(charts)


@query("s15_scorecards", "v_scorecard_base", sql="SELECT run_key AS key, CAST(COUNT(*) AS BIGINT) AS score, CAST(MAX(metric) AS DOUBLE) AS top FROM v_scorecard_base GROUP BY 1")
def _(b):
    rows = b.groupBy("run_key").agg(F.count("*").alias("score"), F.max("metric").alias("top"))
    body = F.to_json(F.map_from_entries(F.collect_list(F.struct("run_key", F.struct("score", F.struct("top").alias("metrics"))))))
    # a file for every thousand keys or so; each has the two capture stamps
    files = rows.groupBy(F.pmod(F.xxhash64("run_key"), F.lit(8)).alias("file")).agg(body.alias("j")).select(F.concat(F.lit('{"_captured":"2026-01-01","_version":"3",'), F.expr("substring(j, 2)")).alias("text"))
    return R.parse_scorecards(files).select("key", "score", F.col("metrics")["top"].alias("top"))


@query("x3_fix_mojibake", "v_licences", sql="SELECT font_id, SHA256(CASE WHEN font_id % 2 = 0 THEN 'Bézier © ' || category ELSE category END) AS text_hash FROM v_licences")
def _(d):
    said = F.when(F.col("font_id") % 2 == 0, F.concat(F.lit("Bézier © "), "category")).otherwise(F.col("category"))
    broken = F.decode(F.encode(said, "UTF-8"), "ISO-8859-1")
    return d.select("font_id", F.sha2(X.fix_mojibake(broken), 256).alias("text_hash"))


@query("x13_parse_colour", "v_markup", sql="""WITH h AS (SELECT page_id, SUBSTRING(MD5(html), 1, 6) AS hex FROM v_markup), c AS (SELECT page_id, page_id % 6 AS k, CAST(('0x' || hex[1:2])::INT AS INT) AS r, CAST(('0x' || hex[3:4])::INT AS INT) AS g, CAST(('0x' || hex[5:6])::INT AS INT) AS b FROM h)
SELECT page_id, CASE k WHEN 1 THEN (r // 16) * 17 WHEN 3 THEN 0 WHEN 0 THEN r WHEN 2 THEN r END AS r, CASE k WHEN 1 THEN (g // 16) * 17 WHEN 3 THEN 128 WHEN 0 THEN g WHEN 2 THEN g END AS g, CASE k WHEN 1 THEN (b // 16) * 17 WHEN 3 THEN 0 WHEN 0 THEN b WHEN 2 THEN b END AS b FROM c""")
def _(p):
    hexa = F.substring(F.md5("html"), 1, 6)
    byte = lambda i: F.conv(F.substring(hexa, 2 * i + 1, 2), 16, 10)
    k = F.col("page_id") % 6
    short = F.concat(F.lit("#"), *[F.substring(hexa, 2 * i + 1, 1) for i in range(3)])
    said = F.when(k == 0, F.concat(F.lit("#"), hexa)).when(k == 1, short).when(k == 2, F.concat(F.lit("rgb( "), F.concat_ws(" , ", *[byte(i) for i in range(3)]), F.lit(" )"))).when(k == 3, " Green ").when(k == 4, "none").otherwise("url(#a)")
    c = X.parse_colour(said)
    return p.select("page_id", c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"))
