"""Queries over links between shapes. A run stands for a shape, named by where it begins; running and lock runs are walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import links as N
from ..operators.layout import transport
from ..operators.stream import classify_runs, segments
from .layout_queries import ENDS, run_ends
from .registry import query
from .stitch_queries import CLASSES, r4

STEPS = f"""{CLASSES}, {ENDS}, kk AS (SELECT en.design_id, en.block, en.run, CAST(FLOOR(en.x0 / 200.0) AS BIGINT) AS shape, COALESCE(kind IN ('run', 'lock'), FALSE) AS travel FROM en LEFT JOIN c ON c.design_id = en.design_id AND c.run = en.run),
wk AS (SELECT *, LAST_VALUE(CASE WHEN NOT travel THEN shape END IGNORE NULLS) OVER (PARTITION BY design_id, block ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, FIRST_VALUE(CASE WHEN NOT travel THEN shape END IGNORE NULLS) OVER (PARTITION BY design_id, block ORDER BY run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM kk),
stp AS (SELECT s.design_id, s.block, s.run, s.seq, s.x0, s.y0, s.x1, s.y1, s.len, wk.travel AND NOT COALESCE(before = after AND shape = before, FALSE) AS transport FROM s JOIN wk ON wk.design_id = s.design_id AND wk.run = s.run)"""
COVER = f"""{STEPS}, sa AS (SELECT *, CAST(GREATEST(1, CEIL(ROUND(len / 2.0, 9))) AS INT) AS n FROM stp), sb AS (SELECT *, UNNEST(RANGE(n)) AS i FROM sa),
sm AS (SELECT *, CAST(FLOOR(ROUND((x0 + (x1 - x0) * (i + 0.5) / n) / 2.0, 6)) AS BIGINT) AS cx, CAST(FLOOR(ROUND((y0 + (y1 - y0) * (i + 0.5) / n) / 2.0, 6)) AS BIGINT) AS cy, len / n AS part FROM sb),
cv AS (SELECT design_id, cx + a AS cx, cy + b AS cy, MAX(block) AS last FROM sm CROSS JOIN (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) AS dd(a, b) WHERE NOT transport GROUP BY 1, 2, 3),
lk AS (SELECT sm.*, COALESCE(last < block, TRUE) AS bare FROM sm LEFT JOIN cv USING (design_id, cx, cy) WHERE transport),
op AS (SELECT *, CAST(bare AND COALESCE((i = 0 AND (LAG(x1) OVER w <> x0 OR LAG(y1) OVER w <> y0)) OR NOT LAG(bare) OVER w, TRUE) AS INT) AS o FROM lk WINDOW w AS (PARTITION BY design_id, block ORDER BY seq, i)),
sx AS (SELECT *, SUM(o) OVER (PARTITION BY design_id, block ORDER BY seq, i) AS stretch FROM op),
se AS (SELECT design_id, block, stretch, SUM(part) AS a, SUM(CASE WHEN bare THEN part ELSE 0 END) AS b, SUM(CAST(i = 0 AS INT)) AS k FROM sx GROUP BY 1, 2, 3),
lc AS (SELECT design_id, CAST(SUM(k) AS BIGINT) AS segments, SUM(a) * 0.1 AS thread_mm, SUM(b) * 0.1 AS uncovered_mm, MAX(b) * 0.1 AS max_mm FROM se GROUP BY 1)"""


def steps(st):
    """Steps of runs with whether their run is a walk between shapes.

    A design's runs are numbered from 0, so what they tell comes to its steps as one array by place: only rows of runs are shuffled, no step is."""
    kinds = classify_runs(st).select("design_id", "run", F.col("kind").isin("run", "lock").alias("travel"))
    runs = run_ends(st).hint("merge").join(kinds, ["design_id", "run"], "left").select("design_id", "block", "run", F.floor(F.col("x0") / 200).alias("shape"), F.coalesce("travel", F.lit(False)).alias("travel"))
    told = transport(runs).groupBy("design_id").agg(F.array_sort(F.collect_list(F.struct("run", "transport"))).alias("told"))
    return segments(st).hint("merge").join(told, "design_id").withColumn("transport", F.get("told", F.col("run").cast("int"))["transport"]).drop("told")


@query("q8_link_cover", "v_stitches", sql=f"WITH {COVER} SELECT design_id, segments, ROUND(thread_mm, 3) AS thread_mm, ROUND(uncovered_mm, 3) AS uncovered_mm, ROUND(max_mm, 3) AS max_mm FROM lc")
def _(st):
    return N.link_cover(steps(st)).select("design_id", "segments", *[F.round(c, 3).alias(c) for c in ("thread_mm", "uncovered_mm", "max_mm")])


@query("q8_link_rule", "v_stitches", sql=f"WITH {COVER} SELECT design_id, 'link_uncovered' AS code, 'block' AS severity, ROUND(max_mm, 3) AS max_mm, CAST(3 AS DOUBLE) AS limit_mm, ROUND(uncovered_mm, 3) AS uncovered_mm, ROUND(thread_mm, 3) AS thread_mm FROM lc WHERE ROUND(max_mm, 6) > 3")
def _(st):
    return N.link_rule(N.link_cover(steps(st)), 3.0).select("design_id", "code", "severity", "limit_mm", *[F.round(c, 3).alias(c) for c in ("thread_mm", "uncovered_mm", "max_mm")])


@query("a56_link_exposure", "v_stitches", sql=f"""WITH {STEPS}, sa AS (SELECT *, CAST(GREATEST(1, CEIL(ROUND(len, 9))) AS INT) AS n FROM stp WHERE transport), sb AS (SELECT *, UNNEST(RANGE(n)) AS i FROM sa),
sp AS (SELECT design_id, run, seq, i, len / n AS part, x0 + (x1 - x0) * (i + 0.5) / n AS x, y0 + (y1 - y0) * (i + 0.5) / n AS y FROM sb),
nr AS (SELECT sp.design_id, sp.run, sp.seq, sp.i, MIN(part) AS part, LEAST(COALESCE(MIN(SQRT(POW(x - x0 - (x1 - x0) * t, 2) + POW(y - y0 - (y1 - y0) * t, 2))), 8), 8) AS d
 FROM (SELECT sp.*, o.x0, o.y0, o.x1, o.y1, CASE WHEN o.len > 0 THEN GREATEST(0, LEAST(1, ((x - o.x0) * (o.x1 - o.x0) + (y - o.y0) * (o.y1 - o.y0)) / (POW(o.x1 - o.x0, 2) + POW(o.y1 - o.y0, 2)))) ELSE 0 END AS t
  FROM sp LEFT JOIN (SELECT * FROM stp WHERE NOT transport) o ON o.design_id = sp.design_id AND x BETWEEN LEAST(o.x0, o.x1) - 8 AND GREATEST(o.x0, o.x1) + 8 AND y BETWEEN LEAST(o.y0, o.y1) - 8 AND GREATEST(o.y0, o.y1) + 8) sp GROUP BY 1, 2, 3, 4)
SELECT design_id, run, ROUND(SUM(part) * 0.1, 3) AS thread_mm, ROUND(SUM(CASE WHEN ROUND(d, 6) > 2 THEN part ELSE 0 END) * 0.1, 3) AS bare_mm, ROUND(MAX(d) * 0.1, 4) AS worst_mm, SUM(CASE WHEN ROUND(d, 6) > 2 THEN part ELSE 0 END) > 0 AS exposed FROM nr GROUP BY 1, 2""")
def _(st):
    return r4(N.link_exposure(steps(st)), "worst_mm").withColumns({c: F.round(c, 3) for c in ("thread_mm", "bare_mm")})
