"""A corpus through five stages: toxicity, exact dedup, near dedup, benchmark decontamination, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; run() writes each
result as Parquet in the shared folder and reads it as the next stage's docs. All but the last return the columns of
`documents`.

Defined results, for every stage: rows are told apart by doc_id and text, so a doc_id on two texts is judged for each and a null
doc_id like any other; null and empty texts are clean, equal to each other, near to nothing, hold no benchmark item and have
no tokens; of rows that repeat a doc_id and its text one is left by the exact stage; other columns are carried along; no rows give no
rows. Details stand in the operators' docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bobbin.llm import bpe, decontaminate, exact_dedup, near_dedup, toxicity
from bobbin.llm.common import crc_bucket, keep, made, spare, sweep, table

#: Documents whose toxicity score reaches this go.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on labelled documents outside the held-out fifth; documents that score as toxic go."""
    labels = table(spark, sf_dir, "labels").where(crc_bucket(F.col("doc_id"), 5) != 0)
    out = spare(docs.columns, "__score")
    return toxicity.score(docs, toxicity.fit(docs, labels), out=out).where(F.col(out) < TOXIC).drop(out)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 on five-word shingles, the smallest doc_id stays."""
    return near_dedup.drop_near_copies(docs, 0.8, 5)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, as a whole; rows are dropped where they are read."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, and decoded: whether the ids decode to the text's bytes."""
    import public_tokenizers as P

    coded = bpe.encode_documents(docs.select("doc_id", "text"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, decoded="__decoded")
    return coded.select("doc_id", "n_tokens", "token_ids", (F.coalesce("text", F.lit("")).cast("binary") == F.col("__decoded")).alias("decoded"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies), ("decontamination", drop_benchmark_passages), ("bpe", to_tokens)]

#: SQL can't state the learned, hashed and merged stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    first = made()
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
        sweep(spark, first, docs)  # what the stage wrote on its way, and its predecessor's result
    return docs
