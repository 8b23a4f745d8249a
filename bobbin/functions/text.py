"""String functions of catalogue text: licences, colours, styles, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of licence names (any case), tried in this order after the restricted Creative Commons forms.
GPL, OFL, CC_ZERO = "GNU General Public License|GPL", "SIL Open Font License|OFL", "public domain|CC0"
CC_PARTS, NC, ND = r"CC[- ]BY((?:[- ](?:NC|ND|SA)\b){1,3})", r"\bNonCommercial\b", r"\bNoDerivat(?:ive|ion)s?\b|\bNoDerivs\b"
CC_VERSION = r"CC[- ]BY(?:[- ](?:NC|ND|SA))+[^0-9]{0,10}([0-9])\s*\.\s*([0-9])"
CC_SA, CC_SA_VERSION = r"CC[- ]BY[- ]SA", r"CC[- ]BY[- ]SA[^0-9]{0,10}([0-9]\.[0-9])"
CC_BY, CC_BY_VERSION = r"CC[- ]BY", r"CC[- ]BY[^0-9]{0,10}([0-9]\.[0-9])"
NO_LICENSE = "SEE-LICENSE-FILE"
#: Named colours.
NAMED = {"black": "000000", "white": "ffffff", "red": "ff0000", "green": "008000", "blue": "0000ff", "yellow": "ffff00", "gray": "808080", "grey": "808080", "orange": "ffa500", "purple": "800080"}


def license_id(text: Column) -> Column:
    """The licence that a text names: GPL and OFL first, then Creative Commons with NC or ND before SA before BY, then CC0."""
    t = F.coalesce(text, F.lit(""))
    holds = lambda p: t.rlike(f"(?i){p}")
    found = lambda p, k=1: F.regexp_extract(t, f"(?i){p}", k)
    parts = found(CC_PARTS)
    named = lambda x: parts.rlike(rf"(?i)\b{x}\b")
    nc, nd = holds(NC) | named("NC"), holds(ND) | named("ND")
    tag = lambda yes, x: F.when(yes, x).otherwise("")
    version = lambda v: F.when(v == "", "4.0").otherwise(v)
    spaced = F.when(found(CC_VERSION) == "", "").otherwise(F.concat_ws(".", found(CC_VERSION), found(CC_VERSION, 2)))
    restricted = F.concat(F.lit("CC-BY-"), tag(nc, "NC-"), tag(nd, "ND-"), tag(named("SA"), "SA-"), version(spaced))
    out = F.when(holds(GPL), "GPL-3.0").when(holds(OFL), "OFL-1.1").when(nc | nd, restricted)
    out = out.when(holds(CC_SA), F.concat(F.lit("CC-BY-SA-"), version(found(CC_SA_VERSION)))).when(holds(CC_BY), F.concat(F.lit("CC-BY-"), version(found(CC_BY_VERSION))))
    return out.when(holds(CC_ZERO), "CC0").otherwise(NO_LICENSE)


def strip_emails(text: Column) -> Column:
    """Text without addresses, bracketed ones first, and without the double spaces they leave."""
    t = F.regexp_replace(text, r"[(<][^()<> ]+@[^()<> ]+[)>]", "")
    t = F.regexp_replace(t, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "")
    return F.trim(F.regexp_replace(t, " {2,}", " "))


def first_paragraph(text: Column, separator: str = "\n\n") -> Column:
    return F.element_at(F.split(text, separator, -1), 1)


def fix_mojibake(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again; unchanged without the signature or if it isn't valid."""
    raw = F.encode(text, "ISO-8859-1")
    suspect = text.rlike(r"[ÂÃ][\u0080-¿]") & ~text.rlike(r"[^\u0000-ÿ]")
    return F.when(suspect, F.coalesce(F.try_validate_utf8(raw.cast("string")), text)).otherwise(text)


def parse_colour(text: Column) -> Column:
    """Struct r, g, b of #rgb, #rrggbb, rgb() or a name; null for none, transparent, url() and what isn't a colour."""
    t = F.lower(F.trim(text))
    named = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    short = F.regexp_extract(t, "^#([0-9a-f]{3})$", 1)
    hexa = F.when(t.rlike("^#[0-9a-f]{6}$"), F.substring(t, 2, 6)).when(t.rlike("^#[0-9a-f]{3}$"), F.regexp_replace(short, "(.)", "$1$1")).otherwise(F.try_element_at(named, t))
    rgb = [F.regexp_extract(t, r"^rgb\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)$", k).try_cast("int") for k in (1, 2, 3)]
    pick = lambda k: F.coalesce(F.conv(F.substring(hexa, 2 * k + 1, 2), 16, 10).cast("int"), rgb[k])
    return F.when(hexa.isNotNull() | rgb[0].isNotNull(), F.struct(*[pick(k).alias(c) for k, c in enumerate("rgb")]))


def style_prop(style: Column, prop: str) -> Column:
    """Value of one property of an inline style; null if absent."""
    v = F.trim(F.regexp_extract(style, rf"(?:^|;)\s*{prop}\s*:\s*([^;]+)", 1))
    return F.when(v != "", v)


def attr_map(tag: Column) -> Column:
    """Attributes of a tag, as a map; the last of a repeated name wins."""
    keys, values = (F.regexp_extract_all(tag, F.lit(r"([A-Za-z_:][\w:.-]*)\s*=\s*[\"']([^\"']*)[\"']"), F.lit(k)) for k in (1, 2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["k"]))
    return F.map_from_entries(last)


def safe_stem(label: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(label, "[^A-Za-z0-9._-]+", "_"), r"^[_.]+|[_.]+$", "")


def override(df: DataFrame, own: DataFrame, key: str, column: str) -> DataFrame:
    """`df` with the value that the lookup `own` (key, column) gives a key in place of its own."""
    return df.join(own.withColumnRenamed(column, "__own"), key, "left").withColumn(column, F.coalesce("__own", F.col(column))).drop("__own")
