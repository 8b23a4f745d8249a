"""Queries over rasters and image signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pixels as P
from .catalogue_queries import lab_sql
from .registry import query

FRAME = "f AS (SELECT *, MAX(y) OVER (PARTITION BY image_id) + 1 AS h, MAX(x) OVER (PARTITION BY image_id) + 1 AS w FROM v_pixels)"
RING2 = "(y < 2 OR y >= h - 2 OR x < 2 OR x >= w - 2)"
KEY = "CAST(FLOOR(r / 16) * 65536 + FLOOR(g / 16) * 256 + FLOOR(b / 16) AS BIGINT)"
MODAL = f"""bins AS (SELECT image_id, {KEY} AS key, COUNT(*) AS n, AVG(r) AS br, AVG(g) AS bg, AVG(b) AS bb0 FROM f WHERE {RING2} GROUP BY 1, 2),
modal AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY n DESC, key) AS k FROM bins) q WHERE k = 1)"""
NINE = "(VALUES (-1), (0), (1)) AS dy(j) CROSS JOIN (VALUES (-1), (0), (1)) AS dx(i)"
VOTES = f"""o AS (SELECT image_id, y, x, label FROM v_pixels WHERE a > 127), s AS (SELECT image_id, y + j AS y, x + i AS x, label AS v FROM o CROSS JOIN {NINE}),
c AS (SELECT o.image_id, o.y, o.x, o.label, v, COUNT(*) AS n FROM o JOIN s ON o.image_id = s.image_id AND o.y = s.y AND o.x = s.x GROUP BY ALL),
t AS (SELECT *, MAX(n) OVER (PARTITION BY image_id, y, x) AS most FROM c),
votes AS (SELECT image_id, y, x, label, COUNT(*) AS ties, MIN(v) AS mode FROM t WHERE n = most GROUP BY 1, 2, 3, 4)"""
DISC1 = "(VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) AS d(j, i)"


def parts_sql(where: str) -> str:
    """Common table expressions: comp has the root of every pixel's 4-connected component."""
    return f"""RECURSIVE px AS (SELECT image_id, y, x, label, y * 100000 + x AS id FROM v_pixels WHERE {where}),
reach(image_id, id, y, x, label, start) AS (SELECT image_id, id, y, x, label, id FROM px
  UNION SELECT n.image_id, n.id, n.y, n.x, n.label, r.start FROM reach r JOIN px n ON n.image_id = r.image_id AND n.label = r.label AND ABS(n.y - r.y) + ABS(n.x - r.x) = 1),
comp AS (SELECT image_id, y, x, label, MIN(start) AS root FROM reach GROUP BY 1, 2, 3, 4)"""


@query("f7_knockout_background", "v_pixels", sql="""WITH c AS (SELECT image_id, r AS r0, g AS g0, b AS b0 FROM v_pixels WHERE y = 0 AND x = 0)
SELECT p.image_id, y, x, CASE WHEN (r >= 231 AND g >= 231 AND b >= 231) OR (ABS(r - r0) <= 24 AND ABS(g - g0) <= 24 AND ABS(b - b0) <= 24) THEN 0 ELSE a END AS a FROM v_pixels p JOIN c ON p.image_id = c.image_id""")
def _(px):
    return P.knockout(px).select("image_id", "y", "x", "a")


@query("a23_colour_shares", "v_pixels", sql="""WITH n AS (SELECT image_id, COUNT(*) FILTER (WHERE a > 127) AS n FROM v_pixels GROUP BY 1), k AS (SELECT * FROM (VALUES (0), (1), (2), (3)) AS k(label)),
m AS (SELECT image_id, label, COUNT(*) AS m FROM v_pixels WHERE a > 127 GROUP BY 1, 2)
SELECT n.image_id, k.label, ROUND(CASE WHEN n > 0 THEN CAST(COALESCE(m, 0) AS DOUBLE) / n ELSE 0.0 END, 6) AS share FROM n CROSS JOIN k LEFT JOIN m ON m.image_id = n.image_id AND m.label = k.label""")
def _(px):
    return P.colour_shares(px, 4).withColumn("share", F.round("share", 6))


@query("a24_dominant_border_colour", "v_pixels", sql=f"WITH {FRAME}, {MODAL} SELECT image_id, key, n, ROUND(br, 4) AS border_r, ROUND(bg, 4) AS border_g, ROUND(bb0, 4) AS border_b FROM modal")
def _(px):
    return P.dominant_border_colour(px).select("image_id", "key", "n", *[F.round(f"border_{c}", 4).alias(f"border_{c}") for c in "rgb"])


@query("a25_border_agreement", "v_pixels", sql=f"""WITH {FRAME}, {MODAL}, m3 AS (SELECT image_id, br AS r, bg AS g, bb0 AS b FROM modal), {lab_sql('m3', 'ref')}, {lab_sql('f', 'pix')},
e AS (SELECT p.*, SQRT(POW(p.ll - q.ll, 2) + POW(p.aa - q.aa, 2) + POW(p.bb - q.bb, 2)) <= 30 AS near, LEAST(8, h, w) AS k FROM pix p JOIN ref q ON p.image_id = q.image_id),
whole AS (SELECT image_id, AVG(CAST(near AS INT)) FILTER (WHERE {RING2}) AS agreement, COUNT(*) FILTER (WHERE {RING2}) AS n,
 {' + '.join(f"CAST(COALESCE(AVG(CAST(near AS INT)) FILTER (WHERE {v} AND {u}) > 0.5, FALSE) AS INT)" for v in ('y < k', 'y >= h - k') for u in ('x < k', 'x >= w - k'))} AS corners FROM e GROUP BY 1),
rest AS (SELECT image_id, MAX(m) AS m FROM (SELECT image_id, {KEY} AS key, COUNT(*) AS m FROM e WHERE {RING2} AND NOT near GROUP BY 1, 2) q GROUP BY 1)
SELECT whole.image_id, ROUND(agreement, 6) AS agreement, ROUND(CAST(COALESCE(m, 0) AS DOUBLE) / n, 6) AS rival, corners FROM whole LEFT JOIN rest ON whole.image_id = rest.image_id""")
def _(px):
    return P.border_agreement(px, 30.0).withColumns({"agreement": F.round("agreement", 6), "rival": F.round("rival", 6)})


@query("a28_boundary_contrast", "v_pixels", sql=f"""WITH o AS (SELECT image_id, y, x, label, r, g, b FROM v_pixels WHERE a > 127), {lab_sql('o', 'z')},
p AS (SELECT p.image_id, LEAST(p.label, q.label) AS a_label, GREATEST(p.label, q.label) AS b_label, SQRT(POW(p.ll - q.ll, 2) + POW(p.aa - q.aa, 2) + POW(p.bb - q.bb, 2)) AS d
 FROM z p JOIN z q ON p.image_id = q.image_id AND p.label <> q.label AND ((q.y = p.y AND q.x = p.x + 1) OR (q.x = p.x AND q.y = p.y + 1)))
SELECT image_id, a_label, b_label, ROUND(SUM(d), 3) AS bsum, COUNT(*) AS blen FROM p GROUP BY 1, 2, 3""")
def _(px):
    return P.boundary_contrast(px).withColumn("bsum", F.round("bsum", 3))


@query("a30_unique_colour_mass", "v_pixels", sql=f"WITH {VOTES} SELECT image_id, ROUND(AVG(CAST(mode <> label AS INT)), 6) AS mass FROM votes GROUP BY 1")
def _(px):
    return P.unique_colour_mass(px).withColumn("mass", F.round("mass", 6))


@query("u10_pixel_mode_filter", "v_pixels", sql=f"WITH {VOTES} SELECT image_id, y, x, CASE WHEN ties > 1 THEN label ELSE mode END AS label FROM votes")
def _(px):
    return P.mode_filter(px)


@query("a32_alpha_softness", "v_pixels", sql="SELECT image_id, ROUND(AVG(CAST(r > 8 AND r < 247 AS INT)), 6) AS softness FROM v_pixels GROUP BY 1")
def _(px):
    return P.alpha_softness(px, channel="r").withColumn("softness", F.round("softness", 6))


@query("a57_dilate", "v_pixels", sql=f"SELECT DISTINCT image_id, y + j AS y, x + i AS x FROM v_pixels CROSS JOIN {DISC1} WHERE label = 0")
def _(px):
    return P.dilate(px.where("label = 0"), 1)


@query("a57_erode", "v_pixels", sql=f"SELECT image_id, y + j AS y, x + i AS x FROM v_pixels CROSS JOIN {DISC1} WHERE label < 2 GROUP BY 1, 2, 3 HAVING COUNT(*) = 5")
def _(px):
    return P.erode(px.where("label < 2"), 1)


@query("a57_close", "v_pixels", sql=f"""WITH d AS (SELECT DISTINCT image_id, y + j AS y, x + i AS x FROM v_pixels CROSS JOIN {DISC1} WHERE label = 0)
SELECT image_id, y + j AS y, x + i AS x FROM d CROSS JOIN (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) AS s(j, i) GROUP BY 1, 2, 3 HAVING COUNT(*) = 5""")
def _(px):
    return P.close_cells(px.where("label = 0"), 1)


@query("a57_open", "v_pixels", sql=f"""WITH e AS (SELECT image_id, y + j AS y, x + i AS x FROM v_pixels CROSS JOIN {DISC1} WHERE label < 2 GROUP BY 1, 2, 3 HAVING COUNT(*) = 5)
SELECT DISTINCT image_id, y + j AS y, x + i AS x FROM e CROSS JOIN (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) AS s(j, i)""")
def _(px):
    return P.open_cells(px.where("label < 2"), 1)


@query("a58_solid_cells", "v_pixels", sql="SELECT image_id, CAST(FLOOR(y / 2) AS BIGINT) AS cy, CAST(FLOOR(x / 2) AS BIGINT) AS cx, COUNT(*) / 4.0 AS covered FROM v_pixels WHERE label = 0 GROUP BY 1, 2, 3 HAVING COUNT(*) >= 2")
def _(px):
    return P.solid_cells(px.where("label = 0"))


@query("j12_connected_components", "v_pixels", sql=f"WITH {parts_sql('TRUE')} SELECT image_id, label, CAST(FLOOR(root / 100000) AS INT) AS root_y, root % 100000 AS root_x, COUNT(*) AS pixels FROM comp GROUP BY 1, 2, 3, 4")
def _(px):
    return P.component_sizes(px, eight=False)


@query("f10_despeckle", "v_pixels", sql=f"WITH {parts_sql('TRUE')} SELECT image_id, y, x, label FROM (SELECT *, COUNT(*) OVER (PARTITION BY image_id, root) AS n FROM comp) q WHERE n >= 4")
def _(px):
    return P.despeckle(px, 4, eight=False).select("image_id", "y", "x", "label")


@query("j25_border_connected", "v_pixels", sql=f"""WITH {parts_sql('label = 0')}, h AS (SELECT image_id, MAX(y) + 1 AS h, MAX(x) + 1 AS w FROM v_pixels GROUP BY 1)
SELECT comp.image_id, y, x, MAX(CAST(y < 1 OR y >= h - 1 OR x < 1 OR x >= w - 1 AS INT)) OVER (PARTITION BY comp.image_id, root) = 1 AS outside FROM comp JOIN h ON comp.image_id = h.image_id""")
def _(px):
    frame = px.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    return P.border_connected(px.where("label = 0"), frame, eight=False).select("image_id", "y", "x", "outside")


PALETTE = "pal AS (SELECT image_id, label, COUNT(*) AS pixels, FLOOR(AVG(r) + 0.5) AS r, FLOOR(AVG(g) + 0.5) AS g, FLOOR(AVG(b) + 0.5) AS b FROM v_pixels WHERE a > 127 GROUP BY 1, 2)"


@query("u8_merge_palette_colours", "v_pixels", sql=f"""WITH {PALETTE}, m AS (SELECT image_id, CASE WHEN label IN (0, 2) THEN 0 ELSE label END AS t, SUM(pixels) AS pixels, FLOOR(SUM(r * pixels) / SUM(pixels) + 0.5) AS r,
 FLOOR(SUM(g * pixels) / SUM(pixels) + 0.5) AS g, FLOOR(SUM(b * pixels) / SUM(pixels) + 0.5) AS b FROM pal GROUP BY 1, 2) SELECT image_id, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY t) - 1 AS label, pixels, r, g, b FROM m""")
def _(px):
    return P.merge_palette(P.palette_of(px), [0, 2])


@query("t4_cap_colours", "v_pixels", sql=f"""WITH {PALETTE}, k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY pixels DESC, label) AS n FROM pal),
d AS (SELECT k.image_id, k.label, k.pixels, k.n, q.label AS t, ROW_NUMBER() OVER (PARTITION BY k.image_id, k.label ORDER BY POW(k.r - q.r, 2) + POW(k.g - q.g, 2) + POW(k.b - q.b, 2), q.label) AS best FROM k JOIN k q ON k.image_id = q.image_id AND q.n <= 2)
SELECT image_id, label, pixels, CASE WHEN n <= 2 THEN label ELSE t END AS to_label FROM d WHERE best = 1""")
def _(px):
    return P.cap_colours(P.palette_of(px), 2)


@query("t4_cap_warnings", "v_pixels", sql=f"""WITH {PALETTE}, k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY pixels DESC, label) AS n FROM pal)
SELECT image_id, COUNT(*) AS colours, 2 AS kept, ROUND(COALESCE(SUM(pixels) FILTER (n > 2), 0) / SUM(pixels), 6) AS changed FROM k GROUP BY 1 HAVING COUNT(*) > 2""")
def _(px):
    return P.cap_warnings(P.palette_of(px), 2).withColumn("changed", F.round("changed", 6))


def decide_sql(src: str, photo: str) -> str:
    """Select list that decides on rows of `src`."""
    sure = lambda v, t, m: f"LEAST(1.0, ABS({v} - {t}) * 0.5 / {m} + 0.5)"
    return f"""SELECT *, CASE WHEN raw <> 'flat' AND confidence < 0.55 THEN 'flat' ELSE raw END AS class, raw <> 'flat' AND confidence < 0.55 AS uncertain FROM (
 SELECT *, CASE WHEN ucm >= {photo} THEN CASE WHEN grad >= 8.0 THEN 'photo_subject' ELSE 'photo_scene' END WHEN grad >= 0.0015 THEN 'gradient' ELSE 'flat' END AS raw,
 LEAST({sure('ucm', photo, '0.08')}, CASE WHEN ucm >= {photo} THEN {sure('grad', '8.0', '3.0')} ELSE {sure('grad', '0.0015', '0.0008')} END) AS confidence FROM {src}) raw_"""


SIG = "sig AS (SELECT image_id, CAST(ucm AS DOUBLE) AS ucm, CAST(grad AS DOUBLE) AS grad FROM v_signals)"


@query("q23_classify_images", "v_signals", sql=f"WITH {SIG} SELECT image_id, class, ROUND(confidence, 6) AS confidence, uncertain FROM ({decide_sql('sig', 'CAST(0.28 AS DOUBLE)')}) z")
def _(s):
    return P.decide(s).select("image_id", "class", F.round("confidence", 6).alias("confidence"), "uncertain")


STEPS = [0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0]


@query("w23_sweep_ranges", "v_signals", sql=f"""WITH {SIG}, base AS (SELECT image_id, ucm, grad, class AS base FROM ({decide_sql('sig', 'CAST(0.28 AS DOUBLE)')}) z), ms AS (SELECT * FROM (VALUES {', '.join(f'({i}, CAST({m} AS DOUBLE))' for i, m in enumerate(STEPS))}) AS ms(i, m)),
swept AS (SELECT * FROM base CROSS JOIN ms), d AS ({decide_sql('swept', '(m * CAST(0.28 AS DOUBLE))')}),
g AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY i) - ROW_NUMBER() OVER (PARTITION BY image_id, class ORDER BY i) AS grp FROM d)
SELECT image_id, base, class, MIN(m) AS from_m, MAX(m) AS to_m, COUNT(*) AS steps FROM g WHERE class <> base GROUP BY image_id, base, class, grp""")
def _(s):
    return P.sweep_ranges(s.select("image_id", "ucm", "grad"), STEPS)
