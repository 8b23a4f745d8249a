"""Glyphs of fonts: coverage, stitchability, outliers, release gates. One aggregate a font; windows stay inside a font."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import license_id

#: Shares and ratios of the font checks, and the licences that may be released.
DEAD_SHARE, STUNTED, TALL, CASE_LEAST = 0.10, 0.45, 4.0, 8
RELEASED = ("OFL-1.1", "CC-BY-4.0", "CC0")


def _n(cond: Column) -> Column:
    return F.sum(F.coalesce(cond, F.lit(False)).cast("int")).cast("long")


def sews() -> Column:
    """Whether a glyph produces stitches: columns, or a run whose stitch length is given."""
    return (F.col("cols") > 0) | (F.coalesce(F.col("run_len_mm"), F.lit(0.0)) > 0)


def letters(glyphs: DataFrame) -> DataFrame:
    """`glyphs` with case (upper, lower, digit, other or null), whether each is a letter that the font's checks
    look at (Latin ones, or all letters of a font without any) and the height on the font's own channel: runs where no letter has
    columns, else columns; null without geometry."""
    ch = F.col("ch")
    kind = F.when(ch.rlike("^[A-Z]$"), "upper").when(ch.rlike("^[a-z]$"), "lower").when(ch.rlike("^[0-9]$"), "digit").when(ch.rlike(r"^\p{L}$"), "other")
    font = Window.partitionBy("font_id")
    g = glyphs.withColumn("case", kind)
    g = g.withColumn("latin", F.max(F.col("case").isin("upper", "lower")).over(font))
    wanted = F.when(F.col("latin"), F.col("case").isin("upper", "lower")).otherwise(F.col("case") == "other")
    g = g.withColumn("is_letter", F.coalesce(wanted, F.lit(False)))
    g = g.withColumn("runs_only", F.coalesce(F.max(F.when(F.col("is_letter"), F.col("cols") > 0)).over(font) == F.lit(False), F.lit(False)))
    return g.withColumn("height_u", F.when(F.col("runs_only"), F.col("run_height_u")).otherwise(F.col("col_height_u")))


def glyph_qc_stats(glyphs: DataFrame) -> DataFrame:
    """Letters, those that sew nothing, advances that are missing or not positive, and coverage, of each font."""
    g = letters(glyphs)
    bad = (F.col("is_letter") | (F.col("case") == "digit")) & ~F.coalesce(F.col("adv") > 0, F.lit(False))
    return g.groupBy("font_id").agg(
        _n(F.col("is_letter")).alias("letters"), _n(F.col("is_letter") & ~sews()).alias("dead"), _n(bad).alias("bad_advance"),
        *[_n(F.col("case") == c).alias(c) for c in ("upper", "lower", "digit", "other")], F.max("runs_only").alias("runs_only"),
    )


def stunted_glyphs(glyphs: DataFrame, ratio: float = STUNTED, least: int = CASE_LEAST) -> DataFrame:
    """Letters far shorter than the median of their case, or without geometry; cases of fewer than `least` letters pass."""
    g = letters(glyphs).where("is_letter")
    case = Window.partitionBy("font_id", "case")
    ranked = g.withColumn("n", F.count("*").over(case)).withColumn("m", F.count("height_u").over(case))
    ranked = ranked.withColumn("k", F.row_number().over(case.orderBy(F.col("height_u").asc_nulls_last(), "ch")))
    ranked = ranked.withColumn("median", F.max(F.when(F.col("k") == F.floor(F.col("m") / 2) + 1, F.col("height_u"))).over(case))
    short = F.col("height_u").isNull() | ((F.col("median") > 0) & (F.col("height_u") / F.col("median") < ratio))
    return ranked.where((F.col("n") >= least) & short).select("font_id", "ch", "height_u", "median")


def tall_glyphs(glyphs: DataFrame, ratio: float = TALL) -> DataFrame:
    """Single-character glyphs over `ratio` times the median height of the font's letters."""
    g = letters(glyphs)
    known = g.where("is_letter and height_u > 0").withColumn("k", F.row_number().over(Window.partitionBy("font_id").orderBy("height_u", "ch"))).withColumn("m", F.count("*").over(Window.partitionBy("font_id")))
    medians = known.where(F.col("k") == F.floor(F.col("m") / 2) + 1).select("font_id", F.col("height_u").alias("median"))
    single = g.where((F.length("ch") == 1) & (F.col("height_u") > 0))
    return single.join(medians, "font_id").where(F.col("height_u") / F.col("median") > ratio).select("font_id", "ch", "height_u", "median")


def font_qc(glyphs: DataFrame) -> DataFrame:
    """Hard failures and warnings of each font, and whether it passes (no failure)."""
    s = glyph_qc_stats(glyphs)
    count = lambda df, name: df.groupBy("font_id").agg(F.count("*").alias(name))
    s = s.join(count(stunted_glyphs(glyphs), "stunted"), "font_id", "left").join(count(tall_glyphs(glyphs), "tall"), "font_id", "left")
    no_letters = (F.col("upper") == 0) & (F.col("other") == 0)
    dead = (F.col("letters") > 0) & ((F.col("dead") == F.col("letters")) | (F.col("dead") > F.col("letters") * DEAD_SHARE))
    code = lambda cond, name: F.when(cond, F.lit(name))
    fails = [code(no_letters, "no_letters"), code(dead, "dead_letters"), code(F.col("bad_advance") > 0, "advance")]
    warns = [
        code((F.col("upper") == 0) & (F.col("other") > 0) & (F.col("lower") == 0), "no_latin"), code((F.col("upper") > 0) & (F.col("lower") == 0), "no_lowercase"), code(F.col("digit") == 0, "no_digits"),
        code(~dead & (F.col("dead") > 0), "some_dead"), code(F.col("stunted") > 0, "stunted"), code(F.col("tall") > 0, "tall"),
    ]
    return s.select("font_id", F.concat_ws(",", *fails).alias("fails"), F.concat_ws(",", *warns).alias("warnings")).withColumn("pass", F.col("fails") == "")


def font_release(fonts: DataFrame, qc: DataFrame, pulled: tuple[str, ...] = (), grandfathered: tuple[str, ...] = (), allowed: tuple[str, ...] = RELEASED) -> DataFrame:
    """Each font's licence id and why it is left out: pulled, qc, then licence; null if it is released."""
    ident = license_id(F.col("license"))
    free = ident.isin(*allowed) | F.col("key").isin(*grandfathered)
    why = F.when(F.col("key").isin(*pulled), "pulled").when(~F.coalesce(F.col("pass"), F.lit(False)), "qc").when(~free, "licence")
    return fonts.join(qc.select("font_id", "pass"), "font_id", "left").select("font_id", "key", "name", ident.alias("license_id"), why.alias("reason"))


def licence_gate(fonts: DataFrame, qc: DataFrame, pulled: tuple[str, ...] = (), grandfathered: tuple[str, ...] = (), allowed: tuple[str, ...] = RELEASED) -> DataFrame:
    """The fonts that may be released."""
    return font_release(fonts, qc, pulled, grandfathered, allowed).where("reason is null").drop("reason")


def manifest(fonts: DataFrame, glyphs: DataFrame, gated: DataFrame) -> DataFrame:
    """A row for each released font: key, name (trimmed; the key if null), licence and how many glyphs it has."""
    size = glyphs.groupBy("font_id").agg(F.count("*").alias("glyph_count"))
    return gated.join(size, "font_id", "left").select("key", F.trim(F.coalesce("name", "key")).alias("name"), "license_id", F.coalesce("glyph_count", F.lit(0).cast("long")).alias("glyph_count"))


def write_manifest(rows: DataFrame, path: str) -> None:
    """JSON lines, in the order of keys over all files."""
    rows.repartitionByRange("key").sortWithinPartitions("key").write.json(path)


def unsupported_chars(texts: DataFrame, glyphs: DataFrame) -> DataFrame:
    """text_id, font_id and the characters of the text that the font can't sew, each once, in order of appearance.

    A character is set by its own glyph, else by that of its other case; blanks and tabs need none."""
    each = texts.select("text_id", "font_id", F.posexplode(F.split("text", "")).alias("at", "ch")).where(~F.col("ch").isin(" ", "\t", ""))
    first = each.groupBy("text_id", "font_id", "ch").agg(F.min("at").alias("at"))
    own = glyphs.select("font_id", F.col("ch").alias("__as"), sews().alias("__sews"))
    tries = first.select("*", F.posexplode(F.array("ch", F.upper("ch"), F.lower("ch"))).alias("__k", "__as"))
    met = tries.join(own, ["font_id", "__as"]).groupBy("text_id", "font_id", "ch").agg(F.min_by("__sews", "__k").alias("sews"))
    left = first.join(met.where("sews"), ["text_id", "font_id", "ch"], "left_anti")
    return left.groupBy("text_id", "font_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "ch"))), lambda x: x["ch"]), "").alias("unsupported"))


def name_sample(fonts: DataFrame, glyphs: DataFrame) -> DataFrame:
    """What shows a font best: its name, the name in capitals, what is left of either (three characters or more) without
    characters it lacks, its first six letters then digits, any five characters, or a question mark."""
    has = glyphs.groupBy("font_id").agg(F.array_sort(F.collect_set("ch")).alias("set"))
    f = fonts.join(has, "font_id", "left").withColumn("set", F.coalesce("set", F.expr("cast(array() as array<string>)")))
    name = F.coalesce("name", F.lit("Sample"))
    caps = F.translate(name, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    chars = lambda t: F.filter(F.split(t, ""), lambda c: c != "")
    own = lambda c: (c == " ") | F.array_contains(F.col("set"), c)
    whole = lambda t: F.forall(chars(t), own)
    strip = lambda t: F.trim(F.regexp_replace(F.array_join(F.filter(chars(t), own), ""), r"\s+", " "))
    best = F.when(F.length(strip(caps)) > F.length(strip(name)), strip(caps)).otherwise(strip(name))
    of = lambda p: F.filter("set", lambda c: c.rlike(p))
    few = F.array_join(F.slice(F.concat(of("^[A-Za-z]$"), of("^[0-9]$")), 1, 6), "")
    any_ = F.array_join(F.slice(F.filter("set", lambda c: (F.length(c) == 1) & (c != " ")), 1, 5), "")
    said = F.when(whole(name), name).when(whole(caps), caps).when(F.length(best) >= 3, best).when(few != "", few).when(any_ != "", any_).otherwise("?")
    return f.select("font_id", said.alias("sample"))
