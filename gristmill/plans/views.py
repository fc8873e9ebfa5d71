"""Engine tables derived from the provided Parquet tables, once for Spark and once as oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

NOW = "2024-01-31 00:00:00"


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request telemetry from ``events``."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    sources = (
        F.when(kind == "view", F.array(F.lit("qdrant")))
        .when(kind == "click", F.array(F.lit("qdrant"), F.lit("reminder")))
        .when(kind == "purchase", F.array(F.lit("reminder")))
        .when(kind == "signup", F.array(F.lit("greeting")))
        .otherwise(F.array().cast("array<string>"))
    )
    return (
        table(spark, sf_dir, "events")
        .withColumn("k", k)
        .select(
            F.col("event_id").alias("id"),
            F.col("user_id").cast("string").alias("user_id"),
            F.col("ts").alias("created_at"),
            sources.alias("sources"),
            F.round(F.col("value") * 100).cast("bigint").alias("total_ms"),
            F.when(F.col("k") % 10 != 0, F.col("k")).cast("bigint").alias("router_ms"),
            F.lit(None).cast("bigint").alias("generation_ms"),
            ((kind == "error") & (F.col("k") < 30)).alias("timed_out"),
            F.when((kind == "error") & (F.col("k") >= 30), F.concat(F.lit("failure "), F.col("k").cast("string"))).alias("error"),
            (F.col("k") % 7 == 0).alias("reranker_fallback"),
        )
    )


METRICS_SQL = """
metrics AS (
  SELECT event_id AS id, CAST(user_id AS VARCHAR) AS user_id, ts AS created_at,
    CASE event_type WHEN 'view' THEN ['qdrant'] WHEN 'click' THEN ['qdrant','reminder']
      WHEN 'purchase' THEN ['reminder'] WHEN 'signup' THEN ['greeting'] ELSE CAST([] AS VARCHAR[]) END AS sources,
    CAST(round(value * 100) AS BIGINT) AS total_ms,
    CASE WHEN k % 10 <> 0 THEN CAST(k AS BIGINT) END AS router_ms,
    (event_type = 'error' AND k < 30) AS timed_out,
    CASE WHEN event_type = 'error' AND k >= 30 THEN 'failure ' || k END AS error,
    (k % 7 = 0) AS reranker_fallback
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)"""


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a conversation: title from its first turn, update order from its longest text."""
    talk = table(spark, sf_dir, "conversations")
    return talk.groupBy(F.col("conv_id").alias("chat_id")).agg(
        F.substring(F.min_by("text", "turn"), 1, 40).alias("title"),
        F.sum(F.length("text")).alias("updated_seq"),
        F.count(F.lit(1)).alias("messages"),
    ).withColumn("pinned", F.col("chat_id") % 9 == 0)


CHATS_SQL = """
chats AS (SELECT conv_id AS chat_id, substr(arg_min(text, turn), 1, 40) AS title, CAST(sum(length(text)) AS BIGINT) AS updated_seq,
  count(*) AS messages, conv_id % 9 = 0 AS pinned FROM conversations GROUP BY conv_id)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


MESSAGES_SQL = "messages AS (SELECT conv_id AS chat_id, turn AS seq, role, text AS content FROM conversations)"


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores from ``labels`` and ``documents``; NaN where the id is divisible by 11."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    score = F.when(F.col("doc_id") % 11 == 0, F.lit(float("nan"))).otherwise((F.col("quality") * 500 + F.col("n_chars") % 500) / 1000.0)
    return joined.select(
        F.col("doc_id").alias("id"),
        (F.col("doc_id") * 2).alias("metrics_id"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("question "), F.col("doc_id").cast("string"))).alias("query"),
        score.alias("faithfulness"),
        ((F.col("n_chars") % 997) / 997.0).alias("answer_relevancy"),
    )


EVALS_SQL = """
evals AS (SELECT l.doc_id AS id, l.doc_id * 2 AS metrics_id, CASE WHEN l.doc_id % 3 = 0 THEN 'question ' || l.doc_id END AS query,
  CASE WHEN l.doc_id % 11 = 0 THEN CAST('nan' AS DOUBLE) ELSE (quality * 500 + n_chars % 500) / CAST(1000 AS DOUBLE) END AS faithfulness,
  (n_chars % 997) / CAST(997 AS DOUBLE) AS answer_relevancy FROM labels l JOIN documents d USING (doc_id))"""
