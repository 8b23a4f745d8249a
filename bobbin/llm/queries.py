"""Registered queries of the corpus operators, and their DuckDB twins where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, clustering, decontaminate, exact_dedup, language, licences, near_dedup, packing, pii, sharding, toxicity, warc
from .common import crc_bucket, table

#: Rows of this remainder are held out of learning.
FOLDS = 5


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, digests=True).drop("text")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), 0.8, 4)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *[n(k) for k in pii.BASE], F.sha2(pii.span_list(base), 256).alias("base_sha256"), pii.span_list(F.col("found")).alias("spans"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_bucket(F.col("doc_id"), FOLDS) == 0
    model = language.fit(docs.where(~held_out))
    return language.predict(docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_bucket(F.col("doc_id"), FOLDS) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.score(docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.find_licences(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return packing.pack(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"), 4096, 2, digests=True)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return alignment.align(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def _clustering_sql(rounds: int = 3) -> str:
    """DuckDB text of the rounds, from vectors in long form."""
    steps = [f"""v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0)""",
        "d AS (SELECT rid, i, e[i] AS x FROM v, range(1, 65) AS r(i))",
        "s AS (SELECT rid, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM v QUALIFY c < 16)",
        "c0 AS (SELECT c, i, x FROM s JOIN d USING (rid))"]
    for k in range(rounds + 1):
        steps.append(f"a{k} AS (SELECT rid, d.i, d.x, c FROM d JOIN (SELECT rid, arg_min(c, (q, c)) AS c FROM (SELECT rid, c, sum((d.x - t.x) * (d.x - t.x)) AS q FROM d JOIN c{k} AS t USING (i) GROUP BY rid, c) GROUP BY rid) USING (rid))")
        if k < rounds:
            steps.append(f"c{k + 1} AS (SELECT o.c, o.i, coalesce(m.x, o.x) AS x FROM c{k} AS o LEFT JOIN (SELECT c, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM a{k} GROUP BY c, i) AS m USING (c, i))")
    return "WITH " + ",\n".join(steps) + f""",
f AS (SELECT rid, c, CAST(sum((a.x - t.x) * (a.x - t.x)) AS BIGINT) AS distance FROM a{rounds} AS a JOIN c{rounds} AS t USING (c, i) GROUP BY rid, c),
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INT) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM f JOIN v USING (rid) JOIN h USING (c)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe, op2_decontamination, op3_sharding, op4_near_dedup, op5_pii, op6_language, op7_toxicity, op8_licences, op9_exact_dedup, op10_warc, op11_packing, op12_alignment, op13_clustering)}

ORACLE_SQL: dict[str, str] = {
    "op9_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op10_warc": """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id <> min(page_id) OVER g THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id <> min(page_id) OVER g THEN min(page_id) OVER g END AS refers_to
FROM pages WINDOW g AS (PARTITION BY coalesce(html, ''))""",
    "op13_clustering": _clustering_sql(),
}
