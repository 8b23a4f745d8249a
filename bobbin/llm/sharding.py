"""Contiguous byte-balanced shards that keep equal texts together.

Rows are ordered by (hash of the text, doc_id) over range partitions, so equal texts lie side by side. The byte
totals of the partitions, summed in partition order, give each partition its offset; running sums inside the
partitions then give every row its global prefix sum. Equal targets cut that line into shards.

A text whose rows hold more than 1 / FINE of a target is a large group; there are at most shards * FINE of them, a
table for the driver. These are laid out first, the largest first: each goes whole where the most room is; one with more bytes
than a target fills whole shards with what it has over, and one that would overfill its shard by more than SLACK is cut
there. The small groups then fill the rest of each shard, in order, each where its middle falls.

Law: bytes. Shards differ by about a 1 / FINE of a target or less, and by one row if a row is larger than that.
Equal texts share a shard unless they hold more than a target, or no shard has room for them.

Defined results: a null text counts no bytes and equals an empty one; null doc_ids come last among equal texts; repeated rows
get slots of their own, in any order; no rows give no rows; with fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, prepare

#: Added to each text's bytes.
ROW_BYTES = 16
#: Parts of a target from which a group is large; part of a target by which a shard may be overfilled to keep one whole.
FINE, SLACK = 50, 0.02


def lay_out(groups: list[tuple[int, int]], target: float, shards: int) -> tuple[list[tuple[int, float, float, int]], list[float]]:
    """(group, from byte, to byte, shard) for large groups (key, bytes), and the bytes left in each shard."""
    room, pieces = [target] * shards, []
    for key, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        done = 0.0
        while done < size:
            s = max(range(shards), key=lambda k: (room[k], -k))
            left = size - done
            took = left if left <= room[s] + SLACK * target else max(room[s], min(left, SLACK * target))
            pieces.append((key, done, done + took, s))
            room[s] -= took
            done += took
    return pieces, [max(0.0, r) for r in room]


def shard_by_bytes(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", row_bytes: int = ROW_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to shards - 1) and slot (place in the shard, from 0) of each row."""
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = prepare(docs.sparkSession)
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), (F.octet_length(raw) + row_bytes).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), F.xxhash64(raw).alias("h"))
    # the row number keeps rows that repeat a doc_id and its text from meeting in one task
    order = ["h", F.col("doc_id").asc_nulls_last(), "row"]
    ordered = narrow.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "size", "text_crc32", "h", "part"]

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            size = batch.column("size").to_numpy()
            ends = seen + np.cumsum(size)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(ends - size)], names=[*names, "before"])
            seen = int(ends[-1]) if len(ends) else seen

    summed = ordered.withColumn("part", F.spark_partition_id()).mapInArrow(running, f"doc_id {kind}, size long, text_crc32 long, h long, part int, before long")
    # written once: the sampled range bounds, and so the order, must not change between the passes below
    placed = keep(summed, "shards")
    totals = sorted((r["part"], r["b"]) for r in placed.groupBy("part").agg(F.sum("size").alias("b")).collect())
    total = sum(b for _, b in totals)
    offset = dict(zip((p for p, _ in totals), np.cumsum([0, *(b for _, b in totals)]).tolist(), strict=False))
    target = total / shards
    sums = placed.groupBy("h", "part").agg(F.sum("size").alias("b"), F.min("before").alias("a"))
    large: dict[int, list] = {}
    by_group = sums.groupBy("h").agg(F.sum("b").alias("b"), F.min(F.struct("part", "a")).alias("start")).where(F.col("b") > target / FINE)
    for r in by_group.collect():
        large[r["h"]] = [offset[r["start"]["part"]] + r["start"]["a"], r["b"]]
    pieces, room = lay_out([(h, b) for h, (_, b) in large.items()], target, shards)
    starts = np.array(sorted(s for s, _ in large.values()), dtype=np.float64)
    before_large = np.concatenate([[0], np.cumsum([b for _, b in sorted(large.values())])])
    # pieces on one line: group by group, each piece by its first byte
    at = sorted((large[h][0] + a, s) for h, a, _, s in pieces)
    lines = {"keys": np.array(sorted(large), dtype=np.int64), "starts": starts, "skip": before_large, "piece_at": np.array([x for x, _ in at]), "piece_shard": np.array([s for _, s in at], dtype=np.int32), "cuts": np.cumsum(room) * ((total - before_large[-1]) / max(sum(room), 1e-9)), "offset": offset}
    shared = spark.sparkContext.broadcast(lines)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shared.value
        for batch in batches:
            size, h, part, before = (batch.column(c).to_numpy() for c in ("size", "h", "part", "before"))
            middle = before + np.fromiter((x["offset"][p] for p in part.tolist()), dtype=np.float64, count=len(part)) + size / 2
            # small groups: their place among small groups only
            own = middle - x["skip"][np.searchsorted(x["starts"], middle, side="right")]
            shard = np.minimum(np.searchsorted(x["cuts"], own, side="right"), shards - 1).astype(np.int32)
            if len(x["keys"]):
                big = x["keys"][np.minimum(np.searchsorted(x["keys"], h), len(x["keys"]) - 1)] == h
                shard[big] = x["piece_shard"][np.searchsorted(x["piece_at"], middle[big], side="right") - 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), batch.column("before"), pa.array(shard)], names=[*names, "before", "shard"])

    rows = placed.mapInArrow(cut, f"doc_id {kind}, size long, text_crc32 long, h long, part int, before long, shard int")
    rows = keep(rows, "cut")
    big = F.col("h").isin(list(large)) if large else F.lit(False)
    # a cut falls into one small group at most, which then goes where more of it is
    halves = rows.where(~big).groupBy("h", "shard").agg(F.sum("size").alias("b")).groupBy("h").agg(F.count("*").alias("n"), F.max_by("shard", F.struct("b", -F.col("shard"))).alias("shard"))
    moved = {r["h"]: r["shard"] for r in halves.where("n > 1").collect()}
    for h, s in moved.items():
        rows = rows.withColumn("shard", F.when(F.col("h") == h, s).otherwise(F.col("shard")))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    first = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("first"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("before")) - 1
    return rows.withColumn("inside", inside).join(first, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("inside")).alias("slot"))
