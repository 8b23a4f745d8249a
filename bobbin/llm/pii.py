"""Personal data, in DataFrame functions only.

Regular expressions propose spans, checks confirm them (Luhn for cards, mod 97 for account numbers, ranges and
digit counts otherwise), and words near a span move its score. Positions come from the text between the matches:
split() by a pattern gives what regexp_extract_all() leaves out, so running lengths of both are the offsets, in
code points. Everything is an expression on one row: no shuffle, whatever the skew.

Patterns are written so that a scan stays linear on texts without white space: a run of characters is
tried from its start only, and repetitions do not give back.

Kinds. Base: email, ip, card, phone; all that pass their check stay. Added by the method: iban (mod 97), ssn
(three-two-four digits, valid ranges) and secret (key=value tokens), each only when its score with context reaches
MIN_SCORE. An added span never removes a base one.

Defined results: null counts as empty; a text without spans gives counts of 0 and empty strings; spans of
different kinds may overlap; repeated rows are scanned each; a null doc_id is carried; any number of spans in a text of any length
is found, in time that grows a little faster than the spans (by the root of their number); no rows give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order of kinds at one start.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "secret": r"(?i)(?<![A-Za-z0-9_])(?:api_?key|secret|token|password)['\"]?\x20?[=:]\x20?['\"]?[A-Za-z0-9_/+-]{16,}+",
}
#: A cheap test that a text must pass before the pattern is tried.
NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "iban": "[0-9]", "ssn": "[0-9]", "secret": "[=:]"}
#: Score of a confirmed span before context, by kind, and what words within CONTEXT_CHARS add or take away.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.4, "secret": 0.6}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|contact|write)\b", "ip": r"(?i)\b(?:ip|host|server|address)\b", "card": r"(?i)\b(?:card|visa|credit|payment)\b", "phone": r"(?i)\b(?:phone|tel|call|mobile)\b",
    "iban": r"(?i)\b(?:iban|account|bank)\b", "ssn": r"(?i)\b(?:ssn|social|security)\b", "secret": r"(?i)\b(?:key|secret|token|config)\b",
}
AGAINST = r"(?i)\b(?:example|sample|version|isbn|order)\b"
CONTEXT_CHARS, CONTEXT_GAIN, MIN_SCORE = 40, 0.3, 0.5


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number (spaces removed) leaves 1 modulo 97."""
    moved = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    step = lambda a, c: F.when(c.between("0", "9"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def confirmed(kind: str, s: Column) -> Column:
    d = _digits(s)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(s, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(d).between(10, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(s, " ", "")).between(15, 34) & mod97(F.regexp_replace(s, " ", ""))
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def spans_of(kind: str, text: Column) -> Column:
    """Confirmed spans of one kind: array of (start, k, kind, end, value, score), k being the kind's place.

    Matches and the gaps before them are paired and taken in stretches of about the root of their number, so that no list
    is copied on for each match: lengths of stretches first, running sums of these, then the spans of each stretch from its own
    part of the text."""
    k, pattern = KINDS.index(kind), PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    none = F.expr("cast(array() as array<struct<start:int,k:int,kind:string,end:int,value:string,score:double>>)")
    width = lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["value"]), F.lit(0))

    def span(around: Column, first: Column, start: Column, value: Column) -> Column:
        """`around` is the part of the text that begins at place `first`."""
        end, at = start + F.length(value), start - first
        near = F.concat(F.substring(around, F.greatest(F.lit(1), at - CONTEXT_CHARS + 1), F.least(at, F.lit(CONTEXT_CHARS))), F.lit(" "), F.substring(around, end - first + 1, F.lit(CONTEXT_CHARS)))
        gain = F.when(near.rlike(CONTEXT[kind]), CONTEXT_GAIN).otherwise(0.0) - F.when(near.rlike(AGAINST), CONTEXT_GAIN).otherwise(0.0)
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(SCORES[kind]) + gain))
        return F.struct(start.cast("int").alias("start"), F.lit(k).alias("k"), F.lit(kind).alias("kind"), end.cast("int").alias("end"), value.alias("value"), score.alias("score"))

    def stretch(own: Column, start: Column, size: Column) -> Column:
        first = F.greatest(F.lit(0), start - CONTEXT_CHARS)
        part = F.struct(first.alias("first"), F.substring(text, first + 1, start - first + size + CONTEXT_CHARS).alias("around"))

        def step(acc: Column, pair: Column, part: Column) -> Column:
            at = acc["at"] + F.length(pair["gap"])
            value = pair["value"]  # null beside the text after the last match
            kept = F.when(value.isNotNull() & confirmed(kind, value), F.array(span(part["around"], part["first"], at, value))).otherwise(none)
            return F.struct((acc["at"] + width(pair)).cast("int").alias("at"), F.concat(acc["out"], kept).alias("out"))

        zero = F.struct(start.cast("int").alias("at"), none.alias("out"))
        return _let(part, lambda part: F.aggregate(own, zero, lambda acc, pair: step(acc, pair, part), lambda acc: acc["out"]))

    def spans(pairs: Column, many: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.size(pairs), many), lambda i: F.slice(pairs, i, many))
        sized = F.transform(parts, lambda own: F.struct(own.alias("own"), F.aggregate(own, F.lit(0), lambda n, p: n + width(p)).alias("size")))

        def placed(sized: Column) -> Column:
            zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
            starts = F.aggregate(sized, zero, lambda acc, s: F.struct((acc["at"] + s["size"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
            return F.flatten(F.zip_with(sized, starts, lambda s, start: stretch(s["own"], start, s["size"])))

        return _let(sized, placed)

    pairs = F.zip_with(found, between, lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    out = _let(pairs, lambda p: spans(p, F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(p))).cast("int"))))
    out = out if kind in BASE else F.filter(out, lambda s: s["score"] >= MIN_SCORE)
    may = text.rlike(NEEDS[kind]) if kind in ("email", "phone") else text.rlike(NEEDS[kind]) & text.rlike(pattern)
    return F.when(may, out).otherwise(none)


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and `found`: all spans as (start, k, kind, end, value, score), by start, then kind."""
    raw = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    each = raw.select("doc_id", *[spans_of(k, F.col("text")).alias(k) for k in KINDS])
    return each.select("doc_id", F.array_sort(F.concat(*KINDS)).alias("found"))


def span_list(found: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

