"""The ten operators applied to their whole tables, with production parameters."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """ARCMESH_TOKENIZER, else the file of the installed public_tokenizers package."""
    if own := os.environ.get("ARCMESH_TOKENIZER"):
        return own
    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return public_tokenizers.path(name)
    return f"/opt/tokenizers/{name}"


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arcmesh.llm.lm import score_documents

    return score_documents(table(spark, sf_dir, "documents")).drop("rk")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arcmesh.llm.licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents")).drop("rk")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arcmesh.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arcmesh.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arcmesh.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arcmesh.llm.neardup import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"), width=4).select("doc_id", "n_shingles", "component_id", "kept")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arcmesh.llm.exactdup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arcmesh.llm.langid import language_id

    return language_id(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arcmesh.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("rk")


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arcmesh.llm.shards import training_order

    return training_order(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_lm_score, op2_license_scan, op3_source_mix, op4_bpe_round_trip, op5_exact_top_k, op6_near_dedup, op7_exact_dedup, op8_language_id, op9_quality, op10_training_order)}
ORACLE_SQL: dict[str, str] = {}
ORACLE_SQL["op5_exact_top_k"] = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
ORACLE_SQL["op7_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), w AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""
