"""Machine files as tables: DST records and files both ways, EXP records.

A stitch row gives a closed number of records, so a design is split with one explode and no loop. A file is one
binary value by its format; everything else stays a row a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Largest move of one record, header length, end record.
DST_MAX, EXP_MAX, HEADER, END = 121, 127, 512, "0000F3"
#: Axis, power of three, byte, bit when added, bit when subtracted.
BITS = (
    ("dx", 0, 0, 0x80, 0x40), ("dx", 1, 1, 0x80, 0x40), ("dx", 2, 0, 0x20, 0x10), ("dx", 3, 1, 0x20, 0x10), ("dx", 4, 2, 0x20, 0x10),
    ("dy", 0, 0, 0x01, 0x02), ("dy", 1, 1, 0x01, 0x02), ("dy", 2, 0, 0x04, 0x08), ("dy", 3, 1, 0x04, 0x08), ("dy", 4, 2, 0x04, 0x08),
)
#: Bits that every record has, and those of a colour change and a jump.
ALWAYS, COLOR, JUMP = 0x03, 0x40, 0x80


def _parts(rows: DataFrame, limit: int) -> Column:
    """Moves of at most the limit that the delta (dx, dy) takes."""
    return F.ceil(F.greatest(F.abs("dx"), F.abs("dy")) / limit).cast("int")


def _clamped(c: str, i: Column, limit: int) -> Column:
    return F.signum(c) * F.least(i * limit, F.abs(c))


def to_dst_records(df: DataFrame) -> DataFrame:
    """design_id, seq, part, kind, dx, dy: a far move is walked in jumps of at most the limit, a trim becomes three jumps or more with
    rounded equal shares. The first move starts at the origin."""
    w = Window.partitionBy("design_id").orderBy("seq")
    delta = lambda c: (F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0)))
    moved = df.select("design_id", "seq", "cmd", delta("x_u").alias("dx"), delta("y_u").alias("dy"))
    trim = F.col("cmd") == "trim"
    n = F.greatest(F.when(trim, 3).otherwise(1), _parts(moved, DST_MAX))
    split = moved.withColumn("n", n).withColumn("part", F.explode(F.sequence(F.lit(1), "n")))
    at = lambda c, i: F.when(trim, F.floor(F.col(c) * i / F.col("n") + 0.5)).otherwise(_clamped(c, i, DST_MAX))
    step = lambda c: (at(c, F.col("part")) - at(c, F.col("part") - 1)).cast("int").alias(c)
    kind = F.when(trim | (F.col("part") < F.col("n")), "jump").otherwise(F.col("cmd"))
    return split.select("design_id", "seq", "part", kind.alias("kind"), step("dx"), step("dy"))


def to_exp_records(df: DataFrame) -> DataFrame:
    """design_id, seq, part, kind, dx, dy of the other format: a colour change carries no move, so the next row makes up for it; a trim is a
    record of its own (part 0) before its jumps."""
    w = Window.partitionBy("design_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    color, trim = F.col("cmd") == "color", F.col("cmd") == "trim"
    delta = lambda c: F.when(color, 0).otherwise(F.col(c) - F.coalesce(F.last(F.when(~color, F.col(c)), ignorenulls=True).over(w), F.lit(0)))
    moved = df.select("design_id", "seq", "cmd", delta("x_u").alias("dx"), delta("y_u").alias("dy"))
    n = F.when(trim, _parts(moved, EXP_MAX)).otherwise(F.greatest(F.lit(1), _parts(moved, EXP_MAX)))
    split = moved.withColumn("n", n).withColumn("part", F.explode(F.sequence(F.when(trim, 0).otherwise(1), "n")))
    step = lambda c: F.when(F.col("part") == 0, 0).otherwise(_clamped(c, F.col("part"), EXP_MAX) - _clamped(c, F.col("part") - 1, EXP_MAX)).cast("int").alias(c)
    return split.select("design_id", "seq", "part", F.when(trim & (F.col("part") > 0), "jump").otherwise(F.col("cmd")).alias("kind"), step("dx"), step("dy"))


def _record_hex() -> Column:
    """The three bytes of a record as hex: every delta has one balanced ternary form."""
    digit = lambda axis, k: F.floor((F.col(axis) + DST_MAX) / 3**k) % 3
    flag = F.when(F.col("kind") == "jump", JUMP).when(F.col("kind") == "color", COLOR).otherwise(0)
    bits = [sum((F.when(digit(a, k) == 2, plus).when(digit(a, k) == 0, minus).otherwise(0) for a, k, at, plus, minus in BITS if at == b), F.lit(0)) for b in range(3)]
    bits[2] = bits[2] + ALWAYS + flag
    return F.concat(*[F.lpad(F.hex(b.cast("long")), 2, "0") for b in bits])


def dst_files(df: DataFrame) -> DataFrame:
    """design_id and content, one file a design. A design without rows has no file."""
    records = to_dst_records(df).select("design_id", F.struct("seq", "part", _record_hex().alias("h")).alias("r"))
    body = records.groupBy("design_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["h"]), "").alias("body"))
    plus = lambda c: F.greatest(F.lit(0), F.max(c)).alias(f"p_{c}")
    minus = lambda c: F.greatest(F.lit(0), -F.min(c)).alias(f"m_{c}")
    size = df.groupBy("design_id").agg(F.count("*").alias("n"), F.count_if(F.col("cmd") == "color").alias("c"), plus("x_u"), minus("x_u"), plus("y_u"), minus("y_u"))
    head = F.format_string("LA:%-16s\rST:%7d\rCO:%3d\r+X:%5d\r-X:%5d\r+Y:%5d\r-Y:%5d\rAX:+    0\rAY:+    0\rMX:+    0\rMY:+    0\rPD:******\r\x1a", F.col("design_id").cast("string"), "n", "c", "p_x_u", "m_x_u", "p_y_u", "m_y_u")
    return body.join(size, "design_id").select("design_id", F.unhex(F.concat(F.hex(F.rpad(head, HEADER, " ")), "body", F.lit(END))).alias("content"))


def dst_label(content: Column) -> Column:
    """What follows LA: in the header, up to the line's end. The header's counts are not trusted."""
    return F.trim(F.regexp_extract(F.decode(F.substring(content, 1, HEADER), "ISO-8859-1"), "LA:([^\r\n\x1a]*)", 1))


def decode_dst(files: DataFrame, key: str = "design_id") -> DataFrame:
    """key, rec, kind, x_u, y_u of files (key, content): absolute positions, up to the end record. A file without records gives no rows."""
    n = F.floor((F.length("content") - HEADER) / 3).cast("int")
    recs = files.where(n >= 1).select(key, F.hex("content").alias("h"), F.explode(F.sequence(F.lit(0), n - 1)).alias("rec"))
    byte = lambda b: F.conv(F.substr("h", F.col("rec") * 6 + 2 * HEADER + 1 + 2 * b, F.lit(2)), 16, 10).cast("int").alias(f"b{b}")
    raw = recs.select(key, "rec", byte(0), byte(1), byte(2))
    w = Window.partitionBy(key).orderBy("rec").rowsBetween(Window.unboundedPreceding, 0)
    ended = F.max(((F.col("b0") == 0) & (F.col("b1") == 0) & (F.col("b2") == 0xF3)).cast("int")).over(w)
    sign = lambda b, m: (F.col(f"b{b}").bitwiseAND(m) > 0).cast("int")
    delta = lambda axis: sum(((sign(b, plus) - sign(b, minus)) * 3**k for a, k, b, plus, minus in BITS if a == axis), F.lit(0))
    kind = F.when(sign(2, COLOR) == 1, "color").when(sign(2, JUMP) == 1, "jump").otherwise("stitch")
    return raw.withColumn("__end", ended).where("__end = 0").select(key, "rec", kind.alias("kind"), F.sum(delta("dx")).over(w).alias("x_u"), F.sum(delta("dy")).over(w).alias("y_u"))


def read_dst_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Records of all DST files under a path, with the file's path and label."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return decode_dst(files, "path").join(files.select("path", dst_label(F.col("content")).alias("label")), "path")
