"""Shared pieces of the corpus operators: tables, shared folder, materialised steps, row order."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The sign that stands for each byte in byte-level vocabularies: printable Latin-1 signs stand for themselves, the others follow from 256 on.
_OWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
SIGNS = {b: chr(b) for b in _OWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _OWN)}
#: Rows in one Arrow batch; with texts of about 100 kB a batch stays near 50 MB.
ARROW_ROWS = 512
#: A key is hot if it holds more than this part of a table's rows; so at most HOT keys are.
HOT = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that reach Python workers, so long texts cannot pile up."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def give_back() -> None:
    """Hand memory that a task has freed back to the system; else its worker keeps it while it waits, beside the JVM's own."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Paths of the tables that keep() wrote.
_made: list[str] = []


def keep(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write `df` as Parquet in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    _made.append(path)
    return out


def sweep(spark: SparkSession, first: int, *but: DataFrame) -> None:
    """Delete what keep() wrote from its `first` table on, except `but`."""
    safe = {getattr(df, "_kept_at", None) for df in but}
    for path in [p for p in _made[first:] if p not in safe]:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _made.remove(path)


def made() -> int:
    """How many tables keep() has written that are still there."""
    return len(_made)


def forget(*kept: DataFrame | None) -> None:
    """Delete what keep() wrote and nothing reads any more."""
    for df in kept:
        path = getattr(df, "_kept_at", None)
        if path:
            jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
            if path in _made:
                _made.remove(path)


def hot_keys(rows: DataFrame, key: str, counts: DataFrame | None = None, total: int | None = None, hot: int = HOT) -> DataFrame | None:
    """key, salts: the keys that hold more than 1 / hot of the rows of `rows` (a kept table), and into how many parts each
    is to be dealt; None if there are none. They are `hot` at most, so this table may be collected and broadcast.

    `counts` (key, n) and `total` save counting where they are known."""
    total = rows.count() if total is None else total
    if total <= 2 * hot:
        return None
    counts = rows.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    share = total / hot
    over = [(r[0], int(r[1] // share) + 1) for r in counts.where((F.col("n") > share) & F.col(key).isNotNull()).select(key, "n").limit(hot).collect()]
    kind = counts.schema[key].dataType.simpleString()
    return rows.sparkSession.createDataFrame(over, f"`{key}` {kind}, __salts int") if over else None


def attach(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner", heavy: DataFrame | None = None, counted: bool = False) -> DataFrame:
    """`rows` (a kept table, unless `heavy` is given or counted) joined to `lookup` (unique by `key`), inner or left.

    No key's rows need to meet in one task: those of hot keys are dealt by a salt, and their one row of `lookup` is
    copied for each salt; that makes 2 * HOT more rows of it at most."""
    heavy = hot_keys(rows, key) if heavy is None and not counted else heavy
    if heavy is None:
        return rows.join(lookup, key, how)
    heavy = F.broadcast(heavy)
    mix = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    salted = rows.join(heavy, key, "left").withColumn("__salt", F.pmod(mix, F.when(F.col(f"`{key}`").isNull(), F.lit(1 << 30)).otherwise(F.coalesce("__salts", F.lit(1)))).cast("int")).drop("__salts")
    copies = lookup.join(heavy, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return salted.join(copies, [key, "__salt"], how).drop("__salt")


def spare(columns: Iterable[str], stem: str) -> str:
    """A column name that clashes with none of `columns`."""
    name, taken = stem, {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def crc_bucket(key: Column, n: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % n
