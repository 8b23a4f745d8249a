"""The folder that driver and executors share, and how rows are dealt to tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a part. A part holds all rows of its keys, so a giant key makes a larger one.
PART_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a temporary folder only where nothing does."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """`df` by its keys in parts of about PART_ROWS rows, so that a task's memory doesn't grow with the table; `rows` where they are counted already.

    The session's number of partitions is one for tables of any size, and what is merged by size merges rows that later grow."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-(df.count() if rows is None else rows) // PART_ROWS)), *keys)


def laid(df: DataFrame, key: str, by: str | None = None) -> DataFrame:
    """`df` written once to the shared folder, in buckets by `key` of about PART_ROWS rows, and read again; in folders by the column `by`, if there is one.

    What reads it many times neither makes it anew nor shuffles it for windows and groups by the key."""
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-df.count() // PART_ROWS))
    name = f"laid_{uuid.uuid4().hex}"
    out = df.repartition(parts, key).write.bucketBy(parts, key).option("path", fresh(spark, "laid"))
    (out.partitionBy(by) if by else out).saveAsTable(name, format="parquet")
    return spark.table(name)
