"""Connected components of a link table whose nodes may be of any comparable type."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: A key with more than this part of a table's rows is hot, so at most HOT keys are.
HOT = 1_000


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage: write `df` in the shared folder and read it again.

    A table and not checkpoint(), which carries on what the optimiser has inferred: that grows with every round of a loop."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def forget(*cuts: DataFrame) -> None:
    """Delete what checkpointed() wrote and nothing reads any more."""
    for df in cuts:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def looked_up(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """`rows` (a written table) joined to `lookup` (unique by key). Rows of hot keys are dealt by a salt, their row of `lookup` copied for each salt."""
    total = rows.count()
    if total <= 2 * HOT:
        return rows.hint("merge").join(lookup, key, how)
    share = total / HOT
    over = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > share).select(key, F.ceil(F.col("n") / share).cast("int").alias("__salts")).limit(HOT).collect()
    if not over:
        return rows.hint("merge").join(lookup, key, how)
    hot = F.broadcast(rows.sparkSession.createDataFrame(over, rows.select(key).schema.add("__salts", "integer")))
    salts = F.coalesce("__salts", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), salts).cast("int")).drop("__salts")
    copies = lookup.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return dealt.hint("merge").join(copies, [key, "__salt"], how).drop("__salt")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, root (smallest node that links reach). `nodes` has node; `links` has u and v, each link once.

    A round offers each end's root to the other end and to the other end's root, then every node takes its root's
    root; long chains so halve each round. Rounds end when no root changes. A node without links is its own root.
    Links of a hub and nodes of a giant component share a key; these are dealt over tasks.
    """
    both = checkpointed(links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    roots = checkpointed(nodes.select("node", F.col("node").alias("root")).distinct())
    while True:
        of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        # both directions are rows of `both`, so the other end's root is looked up on this side and met as v on the other
        near = checkpointed(looked_up(both, of("u"), "u"))
        met = checkpointed(looked_up(near, of("v"), "v").where("u_root < v_root"))
        if met.isEmpty():
            forget(both, near, met)
            return roots
        offers = met.select(F.col("v").alias("node"), F.col("u_root").alias("low")).union(met.select(F.col("v_root").alias("node"), F.col("u_root").alias("low")))
        best = offers.groupBy("node").agg(F.min("low").alias("low"))
        hooked = checkpointed(roots.hint("merge").join(best, "node", "left").select("node", F.coalesce("low", "root").alias("root")))
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = checkpointed(looked_up(hooked, up, "root").select("node", F.col("top").alias("root")))
        forget(near, met, hooked, roots)
        roots = jumped
