"""Text sources: stitch CSV, thread charts and scorecards, from files or from columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CSV = "block LONG, run LONG, trim STRING, jump STRING, x_mm DOUBLE, y_mm DOUBLE"
#: What stands for yes, and commands that cut.
TRUE, CUTS = ("1", "true", "t", "yes"), ("TRIM", "COLOR_CHANGE", "STOP")
CHART = "id STRING, label STRING, threads ARRAY<STRUCT<number: STRING, name: STRING, rgb: ARRAY<INT>>>"
SCORE = "MAP<STRING, STRING>"
ENTRY = "score LONG, grade STRING, findings ARRAY<STRING>, metrics MAP<STRING, DOUBLE>"


def parse_stitch_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """`lines` with the fields of a stitch CSV line; trim is true for 1, true, t and yes, whatever the case."""
    f = lines.withColumn("__f", F.from_csv(line, CSV)).drop(line)
    return f.select("*", "__f.block", "__f.run", F.lower(F.trim("__f.trim")).isin(*TRUE).alias("trim"), F.lower(F.trim("__f.jump")).isin(*TRUE).alias("jump"), "__f.x_mm", "__f.y_mm").drop("__f")


def read_stitch_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of stitch CSV files with a header, with the file's path. A file has a trim column, or a cmd column whose TRIM, COLOR_CHANGE and STOP cut, or
    neither (trim is null, to be inferred)."""
    raw = spark.read.option("header", True).csv(path)
    cut = F.lit(None).cast("boolean")
    if "trim" in raw.columns:
        cut = F.lower(F.trim("trim")).isin(*TRUE)
    elif "cmd" in raw.columns:
        cut = F.upper(F.trim("cmd")).isin(*CUTS)
    run = F.col("run").cast("long") if "run" in raw.columns else F.lit(None).cast("long")
    return raw.select(F.input_file_name().alias("path"), F.col("block").cast("long").alias("block"), run.alias("run"), cut.alias("trim"), F.col("x_mm").cast("double").alias("x_mm"), F.col("y_mm").cast("double").alias("y_mm"))


def parse_charts(charts: DataFrame, text: str = "text") -> DataFrame:
    """Threads of chart texts (JSON), each with its place in its chart."""
    c = charts.select(F.from_json(text, CHART).alias("c"))
    t = c.select(F.col("c.id").alias("brand_id"), F.posexplode("c.threads").alias("idx", "t"))
    return t.select("brand_id", F.col("idx").cast("long").alias("idx"), "t.number", "t.name", *[F.col("t.rgb")[k].alias(c) for k, c in enumerate("rgb")])


def read_thread_charts(spark: SparkSession, path: str) -> DataFrame:
    """Threads of chart files, one JSON object a file, whose threads are [number, name, [r, g, b]]."""
    files = spark.read.text(path, wholetext=True)
    raw = files.select(F.from_json("value", "id STRING, label STRING, threads ARRAY<STRING>").alias("c"))
    t = raw.select(F.col("c.id").alias("brand_id"), F.posexplode("c.threads").alias("idx", "t"))
    parts = F.from_json("t", "ARRAY<STRING>")
    rgb = F.from_json(parts[2], "ARRAY<INT>")
    return t.select("brand_id", F.col("idx").cast("long").alias("idx"), parts[0].alias("number"), parts[1].alias("name"), *[rgb[k].alias(c) for k, c in enumerate("rgb")])


def parse_scorecards(files: DataFrame, text: str = "text") -> DataFrame:
    """Keys of scorecard texts with their entries; keys that start with _ are capture stamps, not rows."""
    rows = files.select(F.explode(F.from_json(text, SCORE)).alias("key", "body")).where(~F.col("key").startswith("_"))
    e = F.from_json("body", ENTRY)
    return rows.select("key", e["score"].alias("score"), e["grade"].alias("grade"), e["findings"].alias("findings"), e["metrics"].alias("metrics"))


def read_scorecards(spark: SparkSession, path: str) -> DataFrame:
    return parse_scorecards(spark.read.text(path, wholetext=True), "value")
