"""Queries over registration and the score of one set of designs against another."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import parity as P
from ..operators.stream import blocks
from ..sources.shared import laid
from .registry import query
from .stitch_queries import cells_sql, r4, runs_sql
from .technique_queries import lines_sql

#: The other version, planted up to 12 mm away.
AWAY = "SELECT design_id, seq, cmd, x_u + (design_id % 5 - 2) * 60 AS x_u, y_u + (design_id % 3 - 1) * 45 AS y_u FROM v_stitches_b"


def away(b):
    by = lambda c, n, k: (F.col(c) + (F.col("design_id") % n - n // 2) * k).alias(c)
    return b.select("design_id", "seq", "cmd", by("x_u", 5, 60), by("y_u", 3, 45))


def lattice_sql(tag: str) -> str:
    at = lambda c: f"CAST(FLOOR(ROUND(({c}0 + ({c}1 - {c}0) * (i + 0.5) / n) / 2.5, 6)) AS BIGINT)"
    return f"""q{tag} AS (SELECT DISTINCT design_id, {at('x')} AS qx, {at('y')} AS qy FROM (SELECT *, UNNEST(RANGE(n)) AS i FROM (SELECT *, GREATEST(1, CAST(CEIL(len / 2.5) AS BIGINT)) AS n FROM s{tag}) u) v),
c{tag} AS (SELECT design_id, (MIN(LEAST(x0, x1)) + MAX(GREATEST(x0, x1))) / 2.0 AS mx, (MIN(LEAST(y0, y1)) + MAX(GREATEST(y0, y1))) / 2.0 AS my FROM s{tag} GROUP BY 1)"""


#: Every seed and its moves with a mask made anew for each.
ROUND = f"""WITH far AS ({AWAY}), {runs_sql('v_stitches', 75, 'a')}, {runs_sql('far', 75, 'z')}, {lattice_sql('a')}, {lattice_sql('z')},
cd AS (SELECT ca.design_id, CAST(FLOOR((ca.mx - cz.mx) / 2.5 + 0.5) AS BIGINT) AS sx, CAST(FLOOR((ca.my - cz.my) / 2.5 + 0.5) AS BIGINT) AS sy FROM ca JOIN cz USING (design_id)),
sd AS (SELECT design_id, 0 AS seed, 0 AS sx, 0 AS sy FROM cd UNION ALL SELECT design_id, 1, sx, sy FROM cd WHERE sx <> 0 OR sy <> 0),
mv AS (SELECT * FROM (VALUES (-1, 0, 0), (0, 1, 0), (1, -1, 0), (2, 0, 1), (3, 0, -1), (4, 1, 1), (5, -1, -1), (6, 1, -1), (7, -1, 1)) AS m(move, i, j)),
tr AS (SELECT design_id, seed, move, sx + 4 * i AS sx, sy + 4 * j AS sy FROM sd CROSS JOIN mv WHERE SQRT(CAST(sx * sx + sy * sy AS DOUBLE)) * 2.5 <= 400 AND SQRT(CAST(POW(sx + 4 * i, 2) + POW(sy + 4 * j, 2) AS DOUBLE)) * 2.5 <= 400),
pm AS (SELECT DISTINCT design_id, FLOOR(qx / 2.0) AS cx, FLOOR(qy / 2.0) AS cy FROM qa), na AS (SELECT design_id, COUNT(*) AS na FROM pm GROUP BY 1),
om AS (SELECT DISTINCT tr.design_id, seed, move, FLOOR((qx + sx) / 2.0) AS cx, FLOOR((qy + sy) / 2.0) AS cy FROM tr JOIN qz ON tr.design_id = qz.design_id),
ht AS (SELECT om.design_id, seed, move, COUNT(pm.cx) AS c, COUNT(*) AS nb FROM om LEFT JOIN pm ON om.design_id = pm.design_id AND om.cx = pm.cx AND om.cy = pm.cy GROUP BY 1, 2, 3)
SELECT tr.design_id, tr.seed, tr.move, tr.sx, tr.sy, ROUND(CAST(c AS DOUBLE) / (na + nb - c), 9) AS iou FROM tr JOIN ht ON tr.design_id = ht.design_id AND tr.seed = ht.seed AND tr.move = ht.move JOIN na ON tr.design_id = na.design_id"""


@query("q16_climb_first_round", "v_stitches", "v_stitches_b", sql=ROUND)
def _(a, b):
    return P.first_round(a, away(b), window=0)


@query("q16_registration_climb", "v_stitches", "v_stitches_b")
def _(a, b):
    return P.register(a, away(b), window=0)


#: Settings at which these sparse designs have solid ground: cells of 2 mm, windows filled to a third.
CELL, RATIO, LEAST = 20.0, 2, 0.3
BOX = "(VALUES (-1), (0), (1)) AS p(i) CROSS JOIN (VALUES (-1), (0), (1)) AS q(j)"
PLUS = "(VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) AS d(i, j)"


def tagged(sql: str, tag: str) -> str:
    return sql.replace("l0", f"l0{tag}").replace("l1", f"l1{tag}").replace("ln AS", f"ln{tag} AS")


def solid_sql(src: str, keys: str) -> str:
    n = keys.count(",") + 3
    return f"SELECT {keys}, cx + i AS cx, cy + j AS cy FROM (SELECT DISTINCT {keys}, cx, cy FROM {src}) u CROSS JOIN {BOX} GROUP BY {', '.join(str(k + 1) for k in range(n))} HAVING COUNT(*) / 9.0 >= {LEAST}"


def side_sql(view: str, t: str, colour: str) -> str:
    """Everything that one side brings: cells, solid ground, colours, cell map, underlay, drag, counts."""
    w = f"w{t}"
    ground = f"SELECT DISTINCT design_id, cx + i AS cx, cy + j AS cy FROM {{src}} CROSS JOIN {PLUS}"
    whole = f"SELECT design_id, cx + i AS cx, cy + j AS cy FROM {{src}} CROSS JOIN {PLUS} GROUP BY 1, 2, 3 HAVING COUNT(*) = 5"
    at = "CAST(FLOOR((x0 + x1) / 2.0 / 40) AS BIGINT) AS ci, CAST(FLOOR((y0 + y1) / 2.0 / 40) AS BIGINT) AS cj"
    th = "2 * ATAN2(CAST(y1 - y0 AS DOUBLE), CAST(x1 - x0 AS DOUBLE))"
    smp = "(x0 + (x1 - x0) * (i + 0.5) / n)"
    return f"""{cells_sql(view, t).replace('/ 2.0 / 20', '/ 2.0 / 40')}, {runs_sql(view, 1 << 30, w)},
k{t} AS (SELECT * FROM s{t} WHERE len > 0), {tagged(lines_sql(20, f'k{t}', 'seq'), t)}, gr{t} AS (SELECT DISTINCT design_id, block, cx, cy FROM ln{t}), so{t} AS ({solid_sql(f'gr{t}', 'design_id')}),
co{t} AS (SELECT *, MIN(block) OVER (PARTITION BY design_id, r, g, b) AS grp FROM (SELECT design_id, block, v.r, v.g, v.b FROM (SELECT DISTINCT design_id, CAST(block AS BIGINT) AS block FROM b{t}) u JOIN v_threads v ON v.thread_idx = {colour}) u),
dr{t} AS (SELECT design_id, {at}, SUM(len * SIN({th})) AS sn, SUM(len * COS({th})) AS cs, SUM(len) AS l FROM s{t} GROUP BY 1, 2, 3),
cm{t} AS (SELECT cell{t}.design_id, cell{t}.ci, cell{t}.cj, typ, CASE WHEN SQRT(sn * sn + cs * cs) / l > 0.000001 THEN DEGREES(ATAN2(sn, cs)) / 2 END AS angle FROM cell{t} JOIN dr{t} USING (design_id, ci, cj)),
ku{t} AS (SELECT * FROM s{w} WHERE len > 0 AND len <= 121), {tagged(lines_sql(8, f'ku{t}', 'ROW_NUMBER() OVER (PARTITION BY design_id ORDER BY seq)'), 'u' + t)},
lt{t} AS (SELECT design_id, cx, cy, MAX(idx) AS last, ARG_MAX(block, idx) AS lb FROM lnu{t} GROUP BY 1, 2, 3),
us{t} AS (SELECT *, AVG(hit) OVER (PARTITION BY design_id, idx) AS sh, COUNT(*) OVER (PARTITION BY design_id, idx) AS np FROM (SELECT x.design_id, x.idx, x.len, x.cx, x.cy, CASE WHEN last > idx + 3 AND lb = block THEN 1.0 ELSE 0.0 END AS hit FROM lnu{t} x JOIN lt{t} y ON x.design_id = y.design_id AND x.cx = y.cx AND x.cy = y.cy) u WHERE len >= 5),
uf{t} AS (SELECT design_id, SUM(CASE WHEN ROUND(sh, 9) >= 0.3 THEN len / np ELSE 0 END) / SUM(len / np) AS f FROM us{t} GROUP BY 1),
uc{t} AS (SELECT DISTINCT design_id, FLOOR(cx / 5.0) AS cx, FLOOR(cy / 5.0) AS cy FROM us{t} WHERE ROUND(sh, 9) >= 0.3),
sp{t} AS (SELECT design_id, CAST(FLOOR({smp} / 20) AS BIGINT) AS cx, CAST(FLOOR({smp.replace('x0', 'y0').replace('x1', 'y1')} / 20) AS BIGINT) AS cy, ck FROM (SELECT *, UNNEST(RANGE(n)) AS i FROM (SELECT *, GREATEST(1, CAST(CEIL(len / 5) AS BIGINT)) AS n, CAST(FLOOR((ROW_NUMBER() OVER (PARTITION BY design_id ORDER BY seq) - 1) / 16.0) AS BIGINT) AS ck FROM s{t}) u) v),
e1{t} AS (SELECT DISTINCT design_id, cx, cy FROM ln{t}), e2{t} AS ({ground.format(src=f'e1{t}')}), e3{t} AS ({whole.format(src=f'e2{t}')}), e4{t} AS ({whole.format(src=f'e3{t}')}), e5{t} AS ({ground.format(src=f'e4{t}')}),
hd{t} AS (SELECT design_id, cx, cy FROM sp{t} GROUP BY 1, 2, 3 HAVING COUNT(DISTINCT ck) >= 2 UNION SELECT * FROM e5{t}),
kd{t} AS (SELECT * FROM s{w} WHERE len > 0), {tagged(lines_sql(20, f'kd{t}', 'seq'), 'd' + t)},
dg{t} AS (SELECT design_id, SUM(f * len) * 0.1 AS drag FROM (SELECT x.design_id, x.seq, x.len, AVG(CASE WHEN h.cx IS NULL THEN 1.0 ELSE 0.0 END) AS f FROM lnd{t} x LEFT JOIN hd{t} h ON x.design_id = h.design_id AND x.cx = h.cx AND x.cy = h.cy GROUP BY 1, 2, 3) u GROUP BY 1),
tc{t} AS (SELECT design_id, COUNT(*) FILTER (cmd = 'trim') AS trims, MIN(x_u) FILTER (cmd = 'stitch') AS lo, MAX(x_u) FILTER (cmd = 'stitch') AS hi FROM {view} GROUP BY 1),
tl{t} AS (SELECT design_id, SUM(CASE WHEN len <= 121 THEN len ELSE 0 END) * 0.1 AS mm FROM s{t} GROUP BY 1)"""


SCORE = f"""WITH {side_sql('v_stitches', 'a', 'block % 5')}, {side_sql('v_stitches_b', 'z', 'block % 7 * 11')},
nr AS (SELECT design_id, grp, ARG_MIN(other, CAST(d2 AS BIGINT) * 100000 + other) AS other FROM (SELECT o.design_id, o.grp, p.grp AS other, (o.r - p.r) * (o.r - p.r) + (o.g - p.g) * (o.g - p.g) + (o.b - p.b) * (o.b - p.b) AS d2 FROM coz o JOIN coa p ON o.design_id = p.design_id) u GROUP BY 1, 2),
mn AS (SELECT c.design_id, c.block, nr.other AS grp FROM coz c JOIN nr ON c.design_id = nr.design_id AND c.grp = nr.grp), rk AS (SELECT design_id, grp, MIN(block) AS rank FROM mn GROUP BY 1, 2),
pl AS (SELECT g.design_id, c.grp, g.cx, g.cy FROM gra g JOIN coa c ON g.design_id = c.design_id AND g.block = c.block), ol AS (SELECT g.design_id, c.grp, g.cx, g.cy FROM grz g JOIN mn c ON g.design_id = c.design_id AND g.block = c.block),
pg AS ({solid_sql('pl', 'design_id, grp')}), og AS ({solid_sql('ol', 'design_id, grp')}),
pt AS (SELECT design_id, cx, cy, MAX(grp) AS pt FROM pg GROUP BY 1, 2, 3), ot AS (SELECT design_id, cx, cy, ARG_MAX(grp, rank) AS ot FROM og JOIN rk USING (design_id, grp) GROUP BY 1, 2, 3),
gd AS (SELECT COALESCE(x.design_id, y.design_id) AS design_id, COALESCE(x.cx, y.cx) AS cx, COALESCE(x.cy, y.cy) AS cy, x.cx IS NOT NULL AS p, y.cx IS NOT NULL AS o FROM soa x FULL JOIN soz y ON x.design_id = y.design_id AND x.cx = y.cx AND x.cy = y.cy),
gt AS (SELECT gd.*, pt, ot, CASE WHEN pt IS NOT DISTINCT FROM ot THEN 1.0 ELSE 0.0 END AS same FROM gd LEFT JOIN pt USING (design_id, cx, cy) LEFT JOIN ot USING (design_id, cx, cy)),
cv AS (SELECT design_id, COUNT(*) FILTER (p AND o) / CAST(COUNT(*) AS DOUBLE) AS iou, COALESCE(COUNT(*) FILTER (p AND o) / CAST(NULLIF(COUNT(*) FILTER (p), 0) AS DOUBLE), 0) AS recall, AVG(same) AS agr, COUNT(*) FILTER (p) AS np, COUNT(*) FILTER (o) AS no FROM gt GROUP BY 1),
ar AS (SELECT design_id, grp, COUNT(*) * 4.0 AS mm2 FROM pg GROUP BY 1, 2 HAVING COUNT(*) * 4.0 >= 15), ab AS (SELECT *, mm2 / SUM(mm2) OVER (PARTITION BY design_id) AS share FROM ar),
sn AS (SELECT design_id, pt AS grp, AVG(same) AS seen FROM gt WHERE pt IS NOT NULL GROUP BY 1, 2), wo AS (SELECT design_id, MIN(COALESCE(seen, 1)) AS worst FROM ab LEFT JOIN sn USING (design_id, grp) WHERE share >= 0.03 GROUP BY 1),
sh AS (SELECT design_id, CAST(FLOOR(x.cx / 2.0) AS BIGINT) AS ci, CAST(FLOOR(x.cy / 2.0) AS BIGINT) AS cj FROM soa x JOIN soz y USING (design_id, cx, cy) GROUP BY 1, 2, 3 HAVING COUNT(*) >= 2),
al AS (SELECT design_id, AVG(1 - LEAST(d, 180 - d) / 90) AS dir, AVG(CASE WHEN pt = ot THEN 1.0 ELSE 0.0 END) AS typ, AVG(CASE WHEN pt = 'run' THEN 1.0 ELSE 0 END) * AVG(CASE WHEN ot = 'run' THEN 1.0 ELSE 0 END) + AVG(CASE WHEN pt = 'satin' THEN 1.0 ELSE 0 END) * AVG(CASE WHEN ot = 'satin' THEN 1.0 ELSE 0 END) + AVG(CASE WHEN pt = 'fill' THEN 1.0 ELSE 0 END) * AVG(CASE WHEN ot = 'fill' THEN 1.0 ELSE 0 END) AS chance
 FROM (SELECT design_id, a.typ AS pt, z.typ AS ot, ABS(((a.angle + 360) % 180) - ((z.angle + 360) % 180)) AS d FROM sh JOIN cma a USING (design_id, ci, cj) JOIN cmz z USING (design_id, ci, cj)) u GROUP BY 1),
ui AS (SELECT COALESCE(x.design_id, y.design_id) AS design_id, COUNT(*) FILTER (x.cx IS NOT NULL AND y.cx IS NOT NULL) / CAST(COUNT(*) AS DOUBLE) AS iou FROM uca x FULL JOIN ucz y ON x.design_id = y.design_id AND x.cx = y.cx AND x.cy = y.cy GROUP BY 1),
un AS (SELECT a.design_id, 0.5 * LEAST((z.f + 0.02) / (a.f + 0.02), (a.f + 0.02) / (z.f + 0.02)) + 0.5 * CASE WHEN a.f < 0.01 AND z.f < 0.01 OR ui.iou IS NULL THEN 1 ELSE ui.iou END AS underlay FROM ufa a JOIN ufz z USING (design_id) LEFT JOIN ui ON a.design_id = ui.design_id),
tv AS (SELECT design_id, 0.75 / (1 + GREATEST(COALESCE(q.drag, 0) - COALESCE(p.drag, 0), 0) / (0.2 * GREATEST((GREATEST(a.hi, z.hi) - LEAST(a.lo, z.lo)) * 0.1, 10))) + 0.25 * LEAST(1, CAST(a.trims + 8 AS DOUBLE) / (z.trims + 8)) AS travel FROM tca a JOIN tcz z USING (design_id) LEFT JOIN dga p USING (design_id) LEFT JOIN dgz q USING (design_id)),
fin AS (SELECT design_id, 0.5 * iou + 0.3 * agr + 0.2 * COALESCE(worst, recall) AS coverage, COALESCE(GREATEST(0, (dir - 0.5) / 0.5), 0) AS direction, COALESCE(CASE WHEN chance >= 0.999 THEN typ ELSE GREATEST(0, (typ - chance) / (1 - chance)) END, 0) AS sttype,
 tz.mm / GREATEST(no * 4.0, 1) / NULLIF(ta.mm / GREATEST(np * 4.0, 1), 0) AS dn, COALESCE(underlay, 1) AS underlay, travel, COALESCE(dir, 0) AS dr, COALESCE(typ, 0) AS tr
 FROM cv LEFT JOIN wo USING (design_id) LEFT JOIN al USING (design_id) LEFT JOIN un USING (design_id) LEFT JOIN tv USING (design_id) JOIN tla ta USING (design_id) JOIN tlz tz USING (design_id)),
fi AS (SELECT *, CASE WHEN dn > 0 THEN LEAST(dn, 1 / dn) ELSE 0 END AS density FROM fin)
SELECT design_id, ROUND(coverage, 4) AS coverage, ROUND(direction, 4) AS direction, ROUND(sttype, 4) AS sttype, ROUND(density, 4) AS density, ROUND(underlay, 4) AS underlay, ROUND(travel, 4) AS travel, ROUND(dr, 4) AS direction_raw, ROUND(tr, 4) AS sttype_raw,
 ROUND(20 * coverage + 20 * direction + 20 * sttype + 15 * density + 10 * underlay + 15 * travel, 3) AS score, ROUND(20 * coverage + 20 * dr + 20 * tr + 15 * density + 10 * underlay + 15 * travel, 3) AS score_raw FROM fi"""


def coloured(st, threads, number):
    """Blocks of designs with the colour of a thread by number."""
    each = blocks(st).select("design_id", "block").distinct().withColumn("thread_idx", number)
    return each.join(threads.select("thread_idx", "r", "g", "b"), "thread_idx").drop("thread_idx")


@query("q15_parity_score", "v_stitches", "v_stitches_b", "v_threads", sql=SCORE)
def _(a, b, t):
    n = F.col("block")
    # both sides lie in the same buckets
    both = laid(a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b"))), "design_id", "side")
    # columns of their own, for what meets one side with the other
    a, b = (both.where(F.col("side") == s).select(*[F.col(c).alias(c) for c in ("design_id", "seq", "cmd", "x_u", "y_u")]) for s in "ab")
    got = P.parity_score(a, b, coloured(a, t, n % 5), coloured(b, t, n % 7 * 11), CELL, RATIO, 1, LEAST, (8.0, 5), (20.0, 1), {"gap": 3, "covered": 0.3})
    return r4(got, *P.WEIGHTS, "direction_raw", "sttype_raw").withColumns({c: F.round(c, 3) for c in ("score", "score_raw")})
