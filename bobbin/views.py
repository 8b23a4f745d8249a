"""Canonical tables as views over the driver's tables; one text for Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .sources.shared import dealt

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_ORDER = "l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice, l_quantity, l_tax"
#: Rows of a driver table numbered by a key, from which a view is made.
_NUMBERED = {
    "v_stitches": f"""  SELECT l_suppkey AS design_id,
         ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY {_ORDER}) - 1 AS seq,
         (CAST(ROUND(l_quantity) AS INT) % 61) - 25 AS dx_u,
         CAST(ROUND(l_discount * 100) AS INT) * 4 - 20 AS dy_u,
         CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN 'trim'
              WHEN l_linenumber = 6 AND l_returnflag = 'A' AND l_linestatus = 'F' THEN 'jump'
              WHEN l_linenumber = 5 AND l_returnflag = 'N' AND l_linestatus = 'F' AND l_tax >= 0.065 THEN 'color'
              ELSE 'stitch' END AS cmd
  FROM lineitem""",
    "v_pixels": f"""  SELECT l_suppkey AS image_id, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY {_ORDER}) - 1 AS n,
         CAST(ROUND(l_quantity) AS INT) * 5 AS r, CAST(l_linenumber * 36 AS INT) AS g, CAST(l_partkey % 256 AS INT) AS b,
         CASE WHEN l_tax < 0.005 THEN 0 ELSE 255 END AS a, CAST(ROUND(l_quantity) AS INT) % 3 AS label
  FROM lineitem""",
}
_FINDINGS = """SELECT CONCAT('d', CAST(o_custkey % {mod} AS STRING), ' @ 80mm/left_chest') AS run_key,
       CONCAT(o_orderpriority, ':', CASE o_orderstatus WHEN 'F' THEN 'info' WHEN 'O' THEN 'warn' ELSE 'block' END) AS finding,
       ROUND(o_totalprice / 1000) AS metric
FROM orders WHERE o_orderkey % 2 = {half}"""

VIEWS: dict[str, str] = {
    "v_stitches": f"""SELECT design_id, seq, cmd,
       CAST(SUM(dx_u) OVER (PARTITION BY design_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS x_u,
       CAST(SUM(dy_u) OVER (PARTITION BY design_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS y_u
FROM (
{_NUMBERED['v_stitches']}) w""",
    "v_stitches_b": """SELECT design_id, seq, cmd, x_u + (seq % 3) - 1 AS x_u, y_u + (seq % 5) - 2 AS y_u
FROM v_stitches WHERE seq % 17 <> 0""",
    "v_threads": """SELECT p_brand AS brand_id, p_partkey AS thread_idx, CAST(p_partkey AS STRING) AS number, p_name AS name,
       CAST((p_partkey * 73 + 41) % 256 AS INT) AS r, CAST((p_partkey * 151 + 7) % 256 AS INT) AS g, CAST((p_partkey * 199 + 113) % 256 AS INT) AS b
FROM part""",
    "v_shapes": """SELECT o_custkey AS design_id, o_orderkey AS shape_id,
       CAST((o_orderkey * 37) % 1000 AS INT) AS cx_u, CAST((o_orderkey * 91) % 1000 AS INT) AS cy_u,
       CAST(10 + 10 * (o_orderkey % 13) AS INT) AS w_u, CAST(10 + 10 * (o_orderkey % 7) AS INT) AS h_u,
       CAST((o_orderkey * 17) % 200 AS INT) AS thread_idx,
       CAST((o_orderkey * 29) % 256 AS INT) AS r, CAST((o_orderkey * 53) % 256 AS INT) AS g, CAST((o_orderkey * 97) % 256 AS INT) AS b,
       CAST(SUBSTRING(o_orderpriority, 1, 1) AS INT) AS layer, o_orderstatus <> 'P' AS stitched
FROM orders""",
    "v_shapes_prev": """SELECT design_id, shape_id + 1000000000 AS shape_id, cx_u + CAST((shape_id % 5) - 2 AS INT) AS cx_u,
       cy_u + CAST((shape_id % 3) - 1 AS INT) AS cy_u, w_u, h_u, thread_idx, layer
FROM v_shapes WHERE shape_id % 11 <> 0""",
    "v_vertices": """SELECT s.design_id, s.shape_id, k.i AS vertex,
       s.cx_u + CASE WHEN k.i IN (0, 3) THEN -s.w_u ELSE s.w_u END AS x_u,
       s.cy_u + CASE WHEN k.i IN (0, 1) THEN -s.h_u ELSE s.h_u END AS y_u
FROM v_shapes s CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) k""",
    "v_pixels": f"""SELECT image_id, CAST(FLOOR(n / 24) AS INT) AS y, CAST(n % 24 AS INT) AS x, r, g, b, a, label
FROM (
{_NUMBERED['v_pixels']}) w""",
    "v_scorecard_base": _FINDINGS.format(mod=300, half=0),
    "v_scorecard_new": _FINDINGS.format(mod=310, half=1),
    "v_submissions": """SELECT event_id, ts, CONCAT('k', CAST(user_id AS STRING)) AS content_key,
       CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'running' ELSE 'queued' END AS state
FROM events""",
    "v_licences": "SELECT doc_id AS font_id, lang AS category, text AS license FROM documents",
    "v_markup": "SELECT page_id, html FROM pages",
    "v_texts": "SELECT item_id AS text_id, text FROM benchmark",
    "v_descriptors": "SELECT vec_id AS shape_id, label, embedding FROM embeddings",
    "v_signals": """SELECT c_custkey AS image_id, (c_custkey % 100) / 100 AS ucm, (c_custkey % 37) / 4 AS grad, (c_custkey % 10) / 10 AS alpha,
       c_mktsegment AS forced_class
FROM customer""",
    "v_font_glyphs": """SELECT font_id, CHR(CAST(CASE WHEN k < 26 THEN 65 + k WHEN k < 36 THEN 71 + k ELSE 12 + k END AS INT)) AS ch, adv, cols, run_len_mm,
       CASE WHEN cols > 0 THEN tall END AS col_height_u, CASE WHEN run_len_mm IS NOT NULL THEN tall + 3 END AS run_height_u
FROM (
  SELECT *, CASE WHEN font_id % 9 = 4 OR (n * 7 + p_size) % 23 = 0 THEN 0 ELSE CAST((n * 7 + p_size) % 11 + 1 AS INT) END AS cols
  FROM (
    SELECT CAST(FLOOR((p_partkey - 1) / 40) AS BIGINT) AS font_id, (p_partkey - 1) % 40 AS k, p_partkey AS n, p_size, CAST(p_size - 1 AS INT) AS adv,
           CASE WHEN p_size % 3 = 0 THEN NULL ELSE 2.5 END AS run_len_mm,
           CAST(CASE WHEN p_partkey % 97 = 0 THEN 1900 WHEN p_partkey % 53 = 0 THEN 60 ELSE 200 + (p_partkey * 37) % 300 END AS INT) AS tall
    FROM part) g) h""",
    "v_fonts": """SELECT font_id, CONCAT('f', CAST(font_id AS STRING)) AS key,
       CASE WHEN font_id % 7 = 3 THEN NULL ELSE CONCAT(CASE font_id % 5 WHEN 1 THEN 'Bead/' WHEN 2 THEN 'ABC' ELSE '@#~' END, CASE WHEN font_id % 2 = 0 THEN '' ELSE CAST(font_id AS STRING) END) END AS name,
       CASE font_id % 13 WHEN 0 THEN 'SIL Open Font License 1.1' WHEN 1 THEN 'CC-BY-SA 4.0' WHEN 2 THEN 'labelled CC-BY-NC-SA4 .0' WHEN 3 THEN 'GPLv3' WHEN 4 THEN 'this is public domain'
         WHEN 5 THEN 'CC BY 3.0' WHEN 6 THEN 'a NonCommercial font' WHEN 7 THEN 'OFL-1.1' WHEN 8 THEN 'CC BY-ND 2.5' WHEN 9 THEN 'CC BY 4.0' WHEN 10 THEN 'CC0' WHEN 11 THEN 'made at home' END AS license
FROM (SELECT DISTINCT CAST(FLOOR((p_partkey - 1) / 40) AS BIGINT) AS font_id FROM part) f""",
    #: Garments.
    "v_garments": """SELECT garment_id, CAST(width_in AS DOUBLE) AS width_in, CAST(height_in AS DOUBLE) AS height_in, fabric_id
FROM (VALUES ('hat_front', 5.0, 2.25, 'structured_cap'), ('left_chest', 4.0, 4.0, 'pique_knit'), ('full_back', 12.0, 12.0, 'fleece_sweatshirt'),
             ('beanie', 4.5, 2.5, 'jersey_tee'), ('sleeve', 3.0, 3.0, 'jersey_tee'), ('tote', 8.0, 8.0, 'canvas_tote'),
             ('jacket_back', 12.0, 10.0, 'canvas_tote'), ('patch', 3.5, 3.5, 'canvas_tote'), ('towel', 6.0, 6.0, 'terry_towel'),
             ('blanket', 10.0, 8.0, 'fleece_sweatshirt')) AS g(garment_id, width_in, height_in, fabric_id)""",
    #: Hoops.
    "v_hoops": "SELECT * FROM (VALUES (0, '4x4', 100, 100), (1, '5x7', 130, 180), (2, '6x10', 160, 250), (3, '8x8', 200, 200)) AS h(ord, hoop_id, width_mm, height_mm)",
    #: Fabrics.
    "v_fabrics": """SELECT fabric_id, CAST(density_adjust AS DOUBLE) AS density_adjust, CAST(trim_at_mm AS DOUBLE) AS trim_at_mm
FROM (VALUES ('structured_cap', 1.0, 3.0), ('pique_knit', 1.0, 3.0), ('jersey_tee', 1.0, 3.0), ('fleece_sweatshirt', 0.9, 3.5),
             ('canvas_tote', 1.0, 3.0), ('terry_towel', 0.85, 4.0), ('woven_dress', 1.0, 3.0)) AS f(fabric_id, density_adjust, trim_at_mm)""",
}


def needed(sql: str, names: tuple[str, ...] = tuple(VIEWS)) -> list[str]:
    """Views that a text uses, dependencies first."""
    found: list[str] = []
    for name in names:
        if re.search(rf"\b{name}\b", sql):
            found += [*needed(VIEWS[name]), name]
    return list(dict.fromkeys(found))


def with_views(sql: str) -> str:
    """A query text with the views it uses as common table expressions before its own."""
    own = [f"{n} AS ({VIEWS[n]})" for n in needed(sql)]
    body = sql.strip()
    if not own:
        return body
    if m := re.match(r"(?i)WITH\s+(RECURSIVE\s+)?", body):
        return f"WITH {m[1] or ''}{', '.join(own)}, {body[m.end():]}"
    return f"WITH {', '.join(own)} {body}"


def _numbered(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Numbered rows, dealt by their key. It takes the view's name for it only after the numbering: so Spark knows that rows
    lie by it already, and windows by design or image need no shuffle of their own."""
    alias = re.search(r"l_suppkey AS (\w+)", _NUMBERED[name])
    dealt(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_suppkey").createOrReplaceTempView("lineitem")
    return spark.sql(_NUMBERED[name].replace(alias[0], "l_suppkey")).withColumnRenamed("l_suppkey", alias[1])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A canonical view (or a driver table) as a DataFrame."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = with_views(f"SELECT * FROM {name}")
    for v, text in _NUMBERED.items():
        if text in sql:
            _numbered(spark, sf_dir, v).createOrReplaceTempView(f"{v}_rows")
            sql = sql.replace(f"(\n{text}) w", f"{v}_rows")
    for t in BASE:
        if re.search(rf"\b{t}\b", sql):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)
