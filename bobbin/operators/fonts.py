"""Font manifests: groups, filters, credits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def font_groups(fonts: DataFrame, groups: DataFrame, default: str = "Other") -> DataFrame:
    """Each font's group by its category; `default` where `groups` (category, group) has none."""
    return fonts.join(groups, "category", "left").withColumn("group", F.coalesce("group", F.lit(default)))


def filter_fonts(fonts: DataFrame, text: str = "", group: str = "All") -> DataFrame:
    """Fonts of a group (All: any) whose name or key holds the text, whatever its case; a blank text fits all."""
    q = (text or "").strip().lower()
    holds = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q))
    return fonts.where(((F.col("group") == group) | F.lit(group == "All")) & (holds("name") | holds("key")))


def credit_lines(fonts: DataFrame) -> DataFrame:
    """name (the key where it is null or empty) and where the font and its licence lie, sorted by name."""
    named = F.when(F.col("name") != "", F.col("name")).otherwise(F.col("key"))
    return fonts.select("key", named.alias("name"), F.concat(F.lit("/fonts/bin/"), "key", F.lit(".embf")).alias("font_at"), F.concat(F.lit("/fonts/"), "key", F.lit(".LICENSE.txt")).alias("licence_at")).orderBy("name", "key")
