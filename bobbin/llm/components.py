"""Connected components of a link table, by smallest reachable node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, forget, keep


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (smallest node that links reach) for every node of `links`.

    Each round hooks the root of every component that a link leaves to the smallest root it meets, then lets
    every node jump to its root's root; links inside one component drop out. Rounds end when no link
    crosses, after about log(longest path) of them. Labels are written in the shared folder each round.
    Nodes of a giant component and links of a hub share a key; such hot keys are joined by a broadcast of
    their own few labels, so they stay spread over tasks.
    Nulls link with nothing; no links give no rows.
    """
    ends = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("u"), F.col(b).alias("v"))
    ends = keep(ends, "ends")
    first = ends.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("low"))
    labels = keep(first.union(first.select(F.col("low").alias("node"), "low")).groupBy("node").agg(F.min("low").alias("component")), "labels")
    old = [ends]
    while True:
        # flatten: a node's label becomes its label's label until nothing moves
        jumped = attach(labels, labels.select(F.col("node").alias("component"), F.col("component").alias("next")), "component")
        kept = keep(jumped.select("node", F.col("next").alias("component"), (F.col("component") != F.col("next")).alias("moved")), "labels")
        old.append(labels)
        labels = kept.drop("moved")
        labels._kept_at = kept._kept_at
        if kept.where("moved").limit(1).count():
            continue
        of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_root"))
        half = keep(attach(ends, of("u"), "u"), "ends")
        crossing = attach(half, of("v"), "v").where("u_root <> v_root").select(F.greatest("u_root", "v_root").alias("root"), F.least("u_root", "v_root").alias("low"))
        hooks = keep(crossing.groupBy("root").agg(F.min("low").alias("low")), "hooks")
        old += [half, hooks]
        if not hooks.limit(1).count():
            forget(*old)
            return labels
        hooked = keep(attach(labels, hooks.withColumnRenamed("root", "component"), "component", "left").select("node", F.coalesce("low", "component").alias("component")), "labels")
        old.append(labels)
        labels = hooked
