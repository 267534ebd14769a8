"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .chat import chat_digest
from .common import sql_words
from .embedding_dedup import near_duplicates
from .jaccard_join import jaccard_components
from .mixing import mix_report
from .pieces import encode_report
from .quality import quality_report
from .substring_dedup import remove_repeated_words
from .suffix_dedup import remove_repeated_bytes
from .token_output import write_training_order


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), k=20)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(_table(spark, sf_dir, "documents"), sql_words(F.col("text")), weights=(5, 2, 1), share=1.5, cap=2.0)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    same = F.lit("<|im_end|><|im_start|>assistant ok")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), same.alias("text"))
    return chat_digest(rows.unionByName(probe))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(_table(spark, sf_dir, "documents"), length=50)


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_training_order(_table(spark, sf_dir, "documents"), length=1024, shard_slots=8192)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_report(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(_table(spark, sf_dir, "documents"), length=50)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), words=4, percent=85)


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_nearest_neighbours, op3_mix_sources, op4_chat_format, op5_suffix_array_dedup, op6_training_order, op7_sentencepiece, op8_quality, op9_substring_dedup, op10_jaccard_join)}

_CHAT_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), turns AS (
  SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before,
         replace(replace(text, '\', '\\'), '<|', '<\|') AS safe
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(safe) + CASE WHEN n = 1 OR before <> role
                THEN length('<|im_start|>') + length(role) + 1 + length('<|im_end|>') + 1
                ELSE length('<|im_sep|>') END) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

ORACLE_SQL = {"op4_chat_format": _CHAT_SQL}
