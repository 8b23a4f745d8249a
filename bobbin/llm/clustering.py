"""Centroid clustering of integer vectors by scalar lookup tables.

A vector with exactly `dims` components, none null or not finite, becomes integers floor(scale * x); others are left out. Centroids
start as the k vectors with the smallest sha256 of "seed:vec_id". A round assigns every vector to its nearest centroid and
replaces each centroid that has vectors by the componentwise floor of their mean; after the rounds vectors are assigned once more.

Distances. For a block of at most BLOCK vectors, each dimension's occurring integer values are listed once, and the squared
difference of each to each centroid is tabulated; a vector's distances are then gathers from these tables, summed over the
dimensions. Tables hold at most BLOCK * k numbers, whatever the values, and nothing but the k centroids is broadcast. All arithmetic is on
64-bit integers.

A round is one pass over the integers (written once): tasks add up their vectors by cluster, so k rows leave each of them, and
k * dims sums reach the driver. The last assignment is written, then each row gets the totals of its cluster.

Defined results: ties go to the smaller centroid; among equal hashes (a repeated vec_id) the vector that is less by its stored bytes
comes first; a null vec_id hashes as the empty string; fewer than k vectors make fewer centroids; repeated rows count and
are returned each; no vector left gives no rows; other columns are not read. An integer beyond LARGEST, for which distances could
leave 64 bits, is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, keep, prepare

K, ROUNDS, SCALE, DIMS, SEED = 16, 3, 64, 64, 1
#: Vectors of a block, and the largest integer of a component.
BLOCK, LARGEST = 8192, 1 << 27


def integers(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept, their components as 32-bit integers) of a list column."""
    sizes = np.diff(column.offsets.to_numpy())
    good = (sizes == dims) & column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.values
    place = column.offsets.to_numpy()[:-1][good][:, None] + np.arange(dims)
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)[place] if good.any() else np.empty((0, dims))
    known = flat.is_valid().to_numpy(zero_copy_only=False)[place] if good.any() else np.empty((0, dims), bool)
    whole = (known & np.isfinite(x)).all(axis=1)
    scaled = np.floor(x[whole] * float(scale))
    if scaled.size and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"a component's integer is larger than {LARGEST}")
    return np.flatnonzero(good)[whole], scaled.astype("<i4")


def occurring(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that occur, ascending, and each entry's place among them."""
    low = int(column.min())
    span = int(column.max()) - low + 1
    if span > 8 * len(column) + 1024:
        return np.unique(column, return_inverse=True)
    seen = np.zeros(span, dtype=bool)
    seen[column - low] = True
    return np.flatnonzero(seen) + low, (np.cumsum(seen) - 1)[column - low]


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of vectors (rows) to centroids, from tables over the occurring values of each dimension."""
    out = np.zeros((len(x), len(centroids)), dtype=np.int64)
    for d in range(x.shape[1]):
        values, place = occurring(np.ascontiguousarray(x[:, d], dtype=np.int64))
        table = (values[:, None] - centroids[None, :, d]) ** 2
        out += table[place]
    return out


def blocks(batches: Iterator[pa.RecordBatch], dims: int, rows: int = BLOCK) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, integers) of the batches' rows, about `rows` at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield _joined(held, dims)
            held, n = [], 0
    if n:
        yield _joined(held, dims)


def _joined(held: list[pa.RecordBatch], dims: int) -> tuple[pa.Array, np.ndarray]:
    whole = pa.Table.from_batches(held).combine_chunks()
    data = b"".join(whole.column(1).to_pylist())
    return whole.column(0).chunk(0), np.frombuffer(data, "<i4").reshape(-1, dims)


def moved(sums: dict[int, tuple[int, list[int]]], centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: floor of the mean where there are vectors."""
    return np.array([[s // sums[c][0] for s in sums[c][1]] if c in sums else row for c, row in enumerate(centroids.tolist())], dtype=np.int64)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, seed: int = SEED, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared, to its centroid), cluster_inertia, inertia, centroid_sha256 of every vector kept."""
    spark = prepare(vectors.sparkSession)
    kind = vectors.schema[vec_id].dataType
    head = T.StructField("vec_id", kind)
    src = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").alias("x"))

    def to_integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = integers(batch.column(1), dims, scale)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "v"])

    kept = keep(src.mapInArrow(to_integers, T.StructType([head, T.StructField("v", T.BinaryType())])), "vectors")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select("v", hashed.alias("h")).orderBy("h", "v").limit(k).collect()
    centroids = np.array([np.frombuffer(r["v"], "<i4") for r in first], dtype=np.int64).reshape(-1, dims)
    out = T.StructType([head, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not len(centroids):
        totals = spark.createDataFrame([], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        return spark.createDataFrame([], out).join(totals, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centroids)

        def add_up(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            c = shared.value
            n, sums = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
            for _, x in blocks(batches, dims):
                own = distances(x, c).argmin(axis=1)
                order = np.argsort(own, kind="stable")
                here, at = np.unique(own[order], return_index=True)
                n[here] += np.diff([*at, len(own)])
                sums[here] += np.add.reduceat(x[order].astype(np.int64), at, axis=0)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

        part = kept.mapInArrow(add_up, "cluster int, n long, sums array<long>")
        total = part.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(dims)]).collect()
        centroids = moved({r["cluster"]: (r["n"], [r[f"s{d}"] for d in range(dims)]) for r in total}, centroids)

    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in blocks(batches, dims):
            far = distances(x, shared.value)
            own = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(own.astype(np.int32)), pa.array(far[np.arange(len(own)), own])], names=["vec_id", "cluster", "distance"])

    placed = keep(kept.mapInArrow(assign, out), "clusters")
    forget(kept)
    inertia = {r["cluster"]: r["i"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("i")).collect()}
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    totals = spark.createDataFrame([(c, i, sum(inertia.values()), digest[c]) for c, i in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
