"""Queries over graphs of regions: merging like neighbours, absorbing small components, and the image clean-up made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pixels as P
from ..operators import regiongraph as G
from ..operators.graph import checkpointed
from .catalogue_queries import de2000_sql, lab_sql
from .pixel_queries import parts_sql
from .registry import query
from .stitch_queries import r4

#: Squares of four pixels are the regions; sizes are small here, so the protection of large regions starts at eight pixels.
SIDE, LIMIT, LEAST_PX = 4, 20.0, 8
GRAPH = f"""tl AS (SELECT image_id, y, x, r, g, b, CAST(FLOOR(y / {SIDE}) * (FLOOR(MAX(x) OVER (PARTITION BY image_id) / {SIDE}) + 1) + FLOOR(x / {SIDE}) AS BIGINT) AS id, a FROM v_pixels),
tq AS (SELECT * FROM tl WHERE a > 127), {lab_sql('tq', 'tz')},
nd AS (SELECT image_id, id, SUM(ll) AS l, SUM(aa) AS sa, SUM(bb) AS sb, COUNT(*) AS n FROM tz GROUP BY 1, 2),
eg AS (SELECT p.image_id, LEAST(p.id, q.id) AS u, GREATEST(p.id, q.id) AS v, SUM(SQRT(POW(p.ll - q.ll, 2) + POW(p.aa - q.aa, 2) + POW(p.bb - q.bb, 2))) AS bsum, COUNT(*) AS blen
 FROM tz p JOIN tz q ON p.image_id = q.image_id AND p.id <> q.id AND ((q.y = p.y AND q.x = p.x + 1) OR (q.x = p.x AND q.y = p.y + 1)) GROUP BY 1, 2, 3),
em AS (SELECT eg.*, p.l / p.n AS l1, p.sa / p.n AS a1, p.sb / p.n AS b1, q.l / q.n AS l2, q.sa / q.n AS a2, q.sb / q.n AS b2, LEAST(p.n, q.n) AS small, GREATEST(p.n, q.n) AS big, SUM(0) OVER () AS zero
 FROM eg JOIN nd p ON p.image_id = eg.image_id AND p.id = u JOIN nd q ON q.image_id = eg.image_id AND q.id = v),
tt AS (SELECT image_id, SUM(n) AS total FROM nd GROUP BY 1), {de2000_sql('em', 'ed')},
ew AS (SELECT ed.image_id, u, v, ROUND(de / (CASE WHEN small >= {LEAST_PX} AND big / small >= 18 THEN 0.6 ELSE 1.0 END) / (CASE WHEN bsum / blen >= 6 AND small >= {LEAST_PX} AND small >= total * 0.09 THEN 0.5 ELSE 1.0 END), 6) AS weight FROM ed JOIN tt USING (image_id)),
bs AS (SELECT image_id, id, weight, u, v, ROW_NUMBER() OVER (PARTITION BY image_id, id ORDER BY weight, u, v) AS k FROM (SELECT image_id, u AS id, weight, u, v FROM ew WHERE weight < {LIMIT} UNION ALL SELECT image_id, v, weight, u, v FROM ew WHERE weight < {LIMIT}) q),
mg AS (SELECT image_id, v AS id, u AS target FROM bs WHERE k = 1 GROUP BY 1, 2, 3 HAVING COUNT(*) = 2)"""


@query("u12_region_edges", "v_pixels", sql=f"WITH {GRAPH} SELECT image_id, u, v, weight FROM (SELECT image_id, u, v, ROUND(weight, 4) AS weight FROM ew) q")
def _(px):
    return r4(G.edge_weights(*G.region_graph(G.tiles(px, SIDE)), LEAST_PX).select("image_id", "u", "v", "weight"), "weight")


@query("u12_merge_first_round", "v_pixels", sql=f"""WITH {GRAPH}, mv AS (SELECT nd.image_id, COALESCE(target, nd.id) AS id, l, sa, sb, n FROM nd LEFT JOIN mg ON nd.image_id = mg.image_id AND nd.id = mg.id)
SELECT image_id, id, ROUND(SUM(l) / SUM(n), 3) AS mean_l, ROUND(SUM(sa) / SUM(n), 3) AS mean_a, ROUND(SUM(sb) / SUM(n), 3) AS mean_b, CAST(SUM(n) AS BIGINT) AS n FROM mv GROUP BY 1, 2""")
def _(px):
    nodes, edges = map(checkpointed, G.region_graph(G.tiles(px, SIDE)))
    made, _ = G.contract(nodes, edges, G.merge_round(nodes, edges, LIMIT, LEAST_PX))
    return made.select("image_id", "id", *[F.round(F.col(k) / F.col("n"), 3).alias(f"mean_{k}") for k in "lab"], "n")


@query("u12_merge_region_graph", "v_pixels")
def _(px):
    nodes, roots = G.merge_regions(*G.region_graph(G.tiles(px, SIDE)), LIMIT, LEAST_PX)
    return roots.hint("merge").join(nodes.select("image_id", F.col("id").alias("root"), "n"), ["image_id", "root"]).select("image_id", "id", "root", "n")


LEAST = 4
ABSORB = f"""{parts_sql('a > 127')}, cs AS (SELECT image_id, root, MIN(label) AS label, COUNT(*) AS n FROM comp GROUP BY 1, 2),
nb AS (SELECT p.image_id, p.root, q.root AS other, COUNT(*) AS sides FROM comp p JOIN comp q ON p.image_id = q.image_id AND p.root <> q.root AND ABS(p.y - q.y) + ABS(p.x - q.x) = 1 GROUP BY 1, 2, 3),
mt AS (SELECT nb.image_id, nb.root, o.label, SUM(sides) AS sides, MAX(CAST(o.n < {LEAST} AND (o.n < c.n OR (o.n = c.n AND o.root < c.root)) AS INT)) AS waits FROM nb JOIN cs c ON c.image_id = nb.image_id AND c.root = nb.root AND c.n < {LEAST}
 JOIN cs o ON o.image_id = nb.image_id AND o.root = nb.other GROUP BY 1, 2, 3)"""


@query("u11_absorb_first_round", "v_pixels", sql=f"""WITH {ABSORB} SELECT image_id, CAST(FLOOR(root / 100000) AS INT) AS root_y, CAST(root % 100000 AS INT) AS root_x, to_label
FROM (SELECT *, label AS to_label, ROW_NUMBER() OVER (PARTITION BY image_id, root ORDER BY sides DESC, label) AS k, MAX(waits) OVER (PARTITION BY image_id, root) AS w FROM mt) q WHERE k = 1 AND w = 0""")
def _(px):
    parts = P.pixel_components(px.where(F.col("a") > P.CLEAR), eight=False)
    return G.absorb_round(*G.component_graph(parts), LEAST).select("image_id", "id.root_y", "id.root_x", "to_label")


@query("u11_absorb_small_regions", "v_pixels")
def _(px):
    return G.absorb_small_regions(px, LEAST)
