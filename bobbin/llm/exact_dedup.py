"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its content says so: at the first sentence or line end after CHUNK_MIN characters, or at
CHUNK_MAX. Equal texts so have equal chunks, and an edit moves only the cuts near it. A chunk's identifier is
its 64-bit hash and length; each identifier is verified by its chunks' SHA-256 digests: over all chunks that carry it the
least and the greatest must be equal. A text's recipe is its ordered list of identifiers; texts are compared by
recipe. Identifiers and digests are moved, counted inside each task first; chunks and documents are not. Texts that
hold an identifier which fails (two chunks, one hash) are compared by the whole text's digest as well.

Groups are counted before they are shuffled, so a group of copies costs a row for each task. The keeper is
joined back by recipe; recipes that hold over a thousandth of all rows are joined by broadcast and stay spread over tasks.

Defined results: null counts as empty and empty texts are equal; the largest doc_id of a group stays, null
doc_ids are least; rows that repeat a doc_id and its text share one verdict, a doc_id on two texts has one for each; no rows give
no rows. drop_copies() leaves one row of each group: of repeated rows one, of a group without any doc_id one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, forget, keep, spare

CHUNK_MIN, CHUNK_MAX = 768, 3072


def chunks(text: Column, least: int = CHUNK_MIN, most: int = CHUNK_MAX) -> Column:
    """Content-defined chunks whose concatenation is the text; none for an empty text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most}}}?(?:(?<=[.!?\n])|\z)|.{{1,{most}}}"), F.lit(0))


def identifier(chunk: Column) -> Column:
    return F.concat_ws(":", F.hex(F.xxhash64(chunk)), F.length(chunk))


def recipe(parts: Column) -> Column:
    """Ordered identifiers of chunks, as one string."""
    return F.array_join(F.transform(parts, identifier), ",")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    raw = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    cut = raw.select("doc_id", "text", chunks(F.col("text")).alias("parts"))
    listed = keep(cut.select("doc_id", recipe(F.col("parts")).alias("recipe"), F.sha2("text", 256).alias("text_sha256")), "recipes")
    # identifiers verified on contents
    part = raw.select(F.explode(chunks(F.col("text"))).alias("part")).select(identifier(F.col("part")).alias("id"), F.sha2("part", 256).alias("digest"))
    failed = keep(part.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("id"), "failed")
    if failed.limit(1).count():
        odd = listed.select("recipe", F.explode(F.split("recipe", ",")).alias("id")).distinct().join(failed, "id", "left_semi").select("recipe").distinct().withColumn("odd", F.lit(True))
        # same recipe, unverified: the whole text's digest decides
        listed = keep(attach(listed, odd, "recipe", "left").withColumn("recipe", F.when(F.col("odd"), F.concat_ws("#", "recipe", "text_sha256")).otherwise(F.col("recipe"))).drop("odd"), "recipes")
    forget(failed)
    groups = listed.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return attach(listed, groups, "recipe").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of `docs` for each text: the one with the largest doc_id, any one of those that repeat it."""
    found = keep(exact_duplicates(docs, doc_id, text), "copies")
    sha, lost, of = (spare(docs.columns, c) for c in ("__sha", "__gone", "__of"))
    gone = found.where("not kept").select(F.col("doc_id").alias(lost), F.col("text_sha256").alias(of)).distinct()
    out = docs.withColumn(sha, F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256))
    if found.where("kept").groupBy("text_sha256").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates([doc_id, sha])  # joined inside each task before the shuffle
    return out.join(gone, F.col(f"`{doc_id}`").eqNullSafe(F.col(lost)) & (F.col(sha) == F.col(of)), "left_anti").drop(sha)
