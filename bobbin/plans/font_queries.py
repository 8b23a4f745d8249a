"""Queries over font manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fonts as K
from .registry import query

FONTS = """fonts AS (SELECT font_id, category, category || '-' || CAST(font_id AS VARCHAR) AS key, CASE WHEN font_id % 7 <> 0 THEN 'Font ' || CAST(font_id AS VARCHAR) END AS name,
 COALESCE(CASE category WHEN 'en' THEN 'Sans' WHEN 'de' THEN 'Serif' END, 'Other') AS grp FROM v_licences)"""


def fonts(v):
    groups = v.sparkSession.createDataFrame([("en", "Sans"), ("de", "Serif")], "category string, group string")
    named = v.select("font_id", "category", F.concat("category", F.lit("-"), F.col("font_id").cast("string")).alias("key"), F.when(F.col("font_id") % 7 != 0, F.concat(F.lit("Font "), F.col("font_id").cast("string"))).alias("name"))
    return K.font_groups(named, groups)


@query("j26_font_groups", "v_licences", sql=f"WITH {FONTS} SELECT font_id, grp FROM fonts")
def _(v):
    return fonts(v).select("font_id", F.col("group").alias("grp"))


@query("f6_filter_fonts", "v_licences", sql=f"WITH {FONTS} SELECT font_id FROM fonts WHERE grp = 'Sans' AND (CONTAINS(LOWER(COALESCE(name, '')), 'nt 1') OR CONTAINS(LOWER(COALESCE(key, '')), 'nt 1'))")
def _(v):
    return K.filter_fonts(fonts(v), "NT 1", "Sans").select("font_id")


@query("t2_credit_lines", "v_licences", sql=f"WITH {FONTS} SELECT key, COALESCE(name, key) AS name, '/fonts/bin/' || key || '.embf' AS font_at, '/fonts/' || key || '.LICENSE.txt' AS licence_at FROM fonts")
def _(v):
    return K.credit_lines(fonts(v))
