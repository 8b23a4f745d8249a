"""Queries over glyphs, font releases and licence text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import glyphs as G
from .registry import query

#: What the queries take as pulled and grandfathered.
PULLED, OLD = ("f1", "f14", "f40"), ("f3", "f5")

LETTERS = """lt AS (SELECT *, COALESCE(CASE WHEN latin THEN kind IN ('upper', 'lower') ELSE kind = 'other' END, FALSE) AS is_letter, cols > 0 OR COALESCE(run_len_mm, 0) > 0 AS sews FROM (
  SELECT *, BOOL_OR(kind IN ('upper', 'lower')) OVER (PARTITION BY font_id) AS latin FROM (
    SELECT *, CASE WHEN ch BETWEEN 'A' AND 'Z' THEN 'upper' WHEN ch BETWEEN 'a' AND 'z' THEN 'lower' WHEN ch BETWEEN '0' AND '9' THEN 'digit' WHEN REGEXP_MATCHES(ch, '^\\p{L}$') THEN 'other' END AS kind FROM v_font_glyphs) a) b),
ro AS (SELECT font_id, COALESCE(BOOL_AND(cols = 0) FILTER (is_letter), FALSE) AS runs_only FROM lt GROUP BY 1),
gl AS (SELECT lt.*, ro.runs_only, CASE WHEN ro.runs_only THEN run_height_u ELSE col_height_u END AS height_u FROM lt JOIN ro USING (font_id))"""
STATS = LETTERS + """, st AS (SELECT font_id, COUNT(*) FILTER (is_letter) AS letters, COUNT(*) FILTER (is_letter AND NOT sews) AS dead,
  COUNT(*) FILTER ((is_letter OR kind = 'digit') AND NOT COALESCE(adv > 0, FALSE)) AS bad_advance, COUNT(*) FILTER (kind = 'upper') AS upper_n, COUNT(*) FILTER (kind = 'lower') AS lower_n,
  COUNT(*) FILTER (kind = 'digit') AS digit_n, COUNT(*) FILTER (kind = 'other') AS other_n, BOOL_OR(runs_only) AS runs_only FROM gl GROUP BY 1)"""
STUNTED = """, cm AS (SELECT font_id, kind, COUNT(*) AS n, LIST_SORT(LIST(height_u) FILTER (height_u IS NOT NULL)) AS hs FROM gl WHERE is_letter GROUP BY 1, 2),
su AS (SELECT gl.font_id, gl.ch, gl.height_u, hs[LEN(hs) // 2 + 1] AS median FROM gl JOIN cm ON gl.font_id = cm.font_id AND gl.kind = cm.kind
  WHERE is_letter AND cm.n >= 8 AND (gl.height_u IS NULL OR (hs[LEN(hs) // 2 + 1] > 0 AND gl.height_u / hs[LEN(hs) // 2 + 1] < 0.45)))"""
TALL = """, fm AS (SELECT font_id, LIST_SORT(LIST(height_u)) AS hs FROM gl WHERE is_letter AND height_u > 0 GROUP BY 1),
tg AS (SELECT gl.font_id, ch, height_u, hs[LEN(hs) // 2 + 1] AS median FROM gl JOIN fm USING (font_id) WHERE LENGTH(ch) = 1 AND height_u > 0 AND height_u / hs[LEN(hs) // 2 + 1] > 4)"""
QC = STATS + STUNTED + TALL + """, sn AS (SELECT font_id, COUNT(*) AS k FROM su GROUP BY 1), tn AS (SELECT font_id, COUNT(*) AS k FROM tg GROUP BY 1),
fl AS (SELECT st.*, letters > 0 AND (dead = letters OR dead > letters * 0.1) AS gone, COALESCE(sn.k, 0) AS stunted, COALESCE(tn.k, 0) AS tall FROM st LEFT JOIN sn USING (font_id) LEFT JOIN tn USING (font_id)),
qc AS (SELECT font_id, CONCAT_WS(',', CASE WHEN upper_n = 0 AND other_n = 0 THEN 'no_letters' END, CASE WHEN gone THEN 'dead_letters' END, CASE WHEN bad_advance > 0 THEN 'advance' END) AS fails,
  CONCAT_WS(',', CASE WHEN upper_n = 0 AND other_n > 0 AND lower_n = 0 THEN 'no_latin' END, CASE WHEN upper_n > 0 AND lower_n = 0 THEN 'no_lowercase' END, CASE WHEN digit_n = 0 THEN 'no_digits' END,
    CASE WHEN NOT gone AND dead > 0 THEN 'some_dead' END, CASE WHEN stunted > 0 THEN 'stunted' END, CASE WHEN tall > 0 THEN 'tall' END) AS warnings FROM fl)"""


def licence_sql(t: str) -> str:
    """The licence named by text `t`, as nested choices over what each pattern finds."""
    has = lambda p: f"REGEXP_MATCHES({t}, '(?i){p}')"
    got = lambda p, k=1: f"REGEXP_EXTRACT({t}, '(?i){p}', {k})"
    part = lambda x: f"REGEXP_MATCHES({got(X.CC_PARTS)}, '(?i)\\b{x}\\b')"
    nc, nd = f"({has(X.NC)} OR {part('NC')})", f"({has(X.ND)} OR {part('ND')})"
    ver = lambda v: f"COALESCE(NULLIF({v}, ''), '4.0')"
    return f"""CASE WHEN {has(X.GPL)} THEN 'GPL-3.0' WHEN {has(X.OFL)} THEN 'OFL-1.1'
 WHEN {nc} OR {nd} THEN 'CC-BY-' || CASE WHEN {nc} THEN 'NC-' ELSE '' END || CASE WHEN {nd} THEN 'ND-' ELSE '' END || CASE WHEN {part('SA')} THEN 'SA-' ELSE '' END || COALESCE(NULLIF({got(X.CC_VERSION)} || '.' || {got(X.CC_VERSION, 2)}, '.'), '4.0')
 WHEN {has(X.CC_SA)} THEN 'CC-BY-SA-' || {ver(got(X.CC_SA_VERSION))} WHEN {has(X.CC_BY)} THEN 'CC-BY-' || {ver(got(X.CC_BY_VERSION))} WHEN {has(X.CC_ZERO)} THEN 'CC0' ELSE 'SEE-LICENSE-FILE' END"""


RELEASE = QC + f""", li AS (SELECT *, {licence_sql("COALESCE(license, '')")} AS license_id FROM v_fonts),
rl AS (SELECT li.font_id, key, name, license_id, CASE WHEN key IN {PULLED} THEN 'pulled' WHEN COALESCE(fails, 'x') <> '' THEN 'qc' WHEN NOT (license_id IN {G.RELEASED} OR key IN {OLD}) THEN 'licence' END AS reason
  FROM li LEFT JOIN qc USING (font_id))"""


@query("x1_license_id", "v_licences", "v_fonts", sql=f"SELECT font_id, {licence_sql('license')} AS license_id FROM (SELECT font_id, COALESCE(license, '') AS license FROM v_licences UNION ALL SELECT -1 - font_id, COALESCE(license, '') FROM v_fonts) q")
def _(d, f):
    every = d.select("font_id", "license").union(f.select(-1 - F.col("font_id"), "license"))
    return every.select("font_id", X.license_id(F.col("license")).alias("license_id"))


@query("a49_glyph_qc_stats", "v_font_glyphs", sql=f"WITH {STATS} SELECT font_id, letters, dead, bad_advance, upper_n AS upper, lower_n AS lower, digit_n AS digit, other_n AS other, runs_only FROM st")
def _(g):
    return G.glyph_qc_stats(g)


@query("w24_stunted_glyphs", "v_font_glyphs", sql=f"WITH {LETTERS}{STUNTED} SELECT * FROM su")
def _(g):
    return G.stunted_glyphs(g)


@query("w25_tall_glyphs", "v_font_glyphs", sql=f"WITH {LETTERS}{TALL} SELECT * FROM tg")
def _(g):
    return G.tall_glyphs(g)


@query("q29_font_qc", "v_font_glyphs", sql=f"WITH {QC} SELECT font_id, fails, warnings, fails = '' AS pass FROM qc")
def _(g):
    return G.font_qc(g)


@query("q30_font_release", "v_fonts", "v_font_glyphs", sql=f"WITH {RELEASE} SELECT * FROM rl")
def _(f, g):
    return G.font_release(f, G.font_qc(g), PULLED, OLD)


@query("f8_licence_gate", "v_fonts", "v_font_glyphs", sql=f"WITH {RELEASE} SELECT font_id, key, name, license_id FROM rl WHERE reason IS NULL")
def _(f, g):
    return G.licence_gate(f, G.font_qc(g), PULLED, OLD)


@query("s14_manifest", "v_fonts", "v_font_glyphs", sql=f"WITH {RELEASE} SELECT key, TRIM(COALESCE(name, key)) AS name, license_id, (SELECT COUNT(*) FROM v_font_glyphs g WHERE g.font_id = rl.font_id) AS glyph_count FROM rl WHERE reason IS NULL")
def _(f, g):
    return G.manifest(f, g, G.licence_gate(f, G.font_qc(g), PULLED, OLD))


@query("j9_unsupported_chars", "v_texts", "v_font_glyphs", sql="""WITH tx AS (SELECT text_id, text_id % 5 AS font_id, STRING_SPLIT(text, '') AS cs FROM v_texts), ex AS (SELECT text_id, font_id, UNNEST(cs) AS ch, GENERATE_SUBSCRIPTS(cs, 1) AS pos FROM tx),
u AS (SELECT text_id, font_id, ch, MIN(pos) AS pos FROM ex WHERE ch NOT IN (' ', chr(9), '') GROUP BY 1, 2, 3), own AS (SELECT font_id, ch, cols > 0 OR run_len_mm IS NOT NULL AS sews FROM v_font_glyphs),
r AS (SELECT u.*, COALESCE(a.sews, b.sews, c.sews, FALSE) AS ok FROM u LEFT JOIN own a ON a.font_id = u.font_id AND a.ch = u.ch LEFT JOIN own b ON b.font_id = u.font_id AND b.ch = UPPER(u.ch) LEFT JOIN own c ON c.font_id = u.font_id AND c.ch = LOWER(u.ch))
SELECT text_id, font_id, STRING_AGG(ch, '' ORDER BY pos) AS unsupported FROM r WHERE NOT ok GROUP BY 1, 2""")
def _(t, g):
    return G.unsupported_chars(t.select("text_id", (F.col("text_id") % 5).alias("font_id"), "text"), g)


@query("t9_name_sample", "v_fonts", "v_font_glyphs", sql="""WITH hs AS (SELECT font_id, LIST_SORT(LIST(DISTINCT ch)) AS hs FROM v_font_glyphs GROUP BY 1),
n AS (SELECT f.font_id, COALESCE(name, 'Sample') AS nm, UPPER(COALESCE(name, 'Sample')) AS up, hs FROM v_fonts f JOIN hs USING (font_id)),
k AS (SELECT *, LIST_FILTER(STRING_SPLIT(nm, ''), lambda c: c = ' ' OR LIST_CONTAINS(hs, c)) AS k1, LIST_FILTER(STRING_SPLIT(up, ''), lambda c: c = ' ' OR LIST_CONTAINS(hs, c)) AS k2 FROM n),
p AS (SELECT *, TRIM(ARRAY_TO_STRING(k1, '')) AS p1, TRIM(ARRAY_TO_STRING(k2, '')) AS p2 FROM k)
SELECT font_id, CASE WHEN LEN(k1) = LENGTH(nm) THEN nm WHEN LEN(k2) = LENGTH(up) THEN up WHEN LENGTH(CASE WHEN LENGTH(p2) > LENGTH(p1) THEN p2 ELSE p1 END) >= 3 THEN CASE WHEN LENGTH(p2) > LENGTH(p1) THEN p2 ELSE p1 END
  WHEN LEN(hs) > 0 THEN ARRAY_TO_STRING((LIST_FILTER(hs, lambda c: c >= 'A') || LIST_FILTER(hs, lambda c: c < 'A'))[1:6], '') ELSE '?' END AS sample FROM p""")
def _(f, g):
    return G.name_sample(f, g)


@query("x15_attr_map", "v_markup", sql="""WITH a AS (SELECT page_id, REGEXP_EXTRACT_ALL(REGEXP_EXTRACT(html, '<a [^>]*>'), '([A-Za-z_:][A-Za-z0-9_:.-]*)\\s*=\\s*["'']([^"'']*)["'']', 1) AS ks, REGEXP_EXTRACT_ALL(REGEXP_EXTRACT(html, '<a [^>]*>'), '([A-Za-z_:][A-Za-z0-9_:.-]*)\\s*=\\s*["'']([^"'']*)["'']', 2) AS vs FROM v_markup)
SELECT page_id, vs[LIST_POSITION(ks, 'href')] AS href, CAST(LEN(LIST_DISTINCT(ks)) AS INT) AS names FROM a WHERE LEN(ks) > 0""")
def _(p):
    m = X.attr_map(F.regexp_extract("html", r"<a [^>]*>", 0))
    return p.select("page_id", m.alias("m")).where(F.size("m") > 0).select("page_id", F.try_element_at("m", F.lit("href")).alias("href"), F.size("m").alias("names"))


@query("x5_attribution_override", "v_fonts", sql="""SELECT font_id, CASE key WHEN 'f2' THEN 'set by hand' WHEN 'f9' THEN 'kept as written' ELSE SUBSTRING(COALESCE(license, ''), 1, 20) END AS attribution FROM v_fonts""")
def _(f):
    own = f.sparkSession.createDataFrame([("f2", "set by hand"), ("f9", "kept as written")], "key string, attribution string")
    return X.override(f.withColumn("attribution", F.substring(F.coalesce("license", F.lit("")), 1, 20)), own, "key", "attribution").select("font_id", "attribution")
