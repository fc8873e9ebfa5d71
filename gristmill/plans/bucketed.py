"""Bucketed stores filled from the given tables: overwriting by id, cascading deletes, running refresh."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources.buckets import BucketStore
from ..sources.tables import table
from ..streaming import refresh


def _path(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def vector_upsert(spark, sf_dir):
    """All vectors, then a batch of new labels for every tenth and of copies under new ids."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<float>").alias("embedding"))
    store = BucketStore(spark, _path(spark, "vectors"))
    store.create("vectors", vectors.schema, ["vec_id"])
    store.upsert("vectors", vectors)
    tenth = vectors.filter("vec_id % 10 = 3")
    store.upsert("vectors", tenth.withColumn("label", F.col("label") + 1000).union(tenth.withColumn("vec_id", -F.col("vec_id") - 1)))
    return store.read("vectors").select("vec_id", "label", F.size("embedding").alias("width"))


def chat_cascade(spark, sf_dir):
    """Chats and their messages; each deletion names a chat and a user, and takes both only where the chat is that user's."""
    turns = table(spark, sf_dir, "conversations").withColumn("user_id", F.col("conv_id") % 11)
    store = BucketStore(spark, _path(spark, "chats"))
    messages = turns.select("conv_id", "user_id", "turn", "role").dropDuplicates(["conv_id", "turn"])
    chats = turns.select("conv_id", "user_id").distinct()
    store.create("chats", chats.schema, ["conv_id"])
    store.create("messages", messages.schema, ["conv_id", "turn"], ["conv_id"])
    store.upsert("chats", chats)
    store.upsert("messages", messages)
    asked = chats.filter("conv_id % 3 = 0").select("conv_id", F.when(F.col("conv_id") % 2 == 0, F.col("user_id")).otherwise(F.lit(99)).cast("bigint").alias("user_id"))
    store.delete(asked, {"chats": ["conv_id", "user_id"], "messages": ["conv_id", "user_id"]})
    left = store.read("chats").select(F.lit("chat").alias("side"), "conv_id", F.lit(1).cast("bigint").alias("n"))
    return left.union(store.read("messages").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("messages").alias("side"), "conv_id", "n"))


def _fetched(docs, round_):
    text = F.when((F.lit(round_) == 2) & (F.col("doc_id") % 5 == 0), F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    return docs.select(
        F.concat(F.lit("https://site/"), F.col("doc_id").cast("string")).alias("url"), text.alias("content"), "source", F.col("lang").alias("category"), F.lit(None).cast("string").alias("title"),
        F.timestamp_seconds(F.lit(round_ * 3600)).alias("fetched_at"),
    ).filter((F.lit(round_) == 2) | (F.col("url") != "https://site/7"))


def refresh_runs(spark, sf_dir):
    """Two runs over all documents as pages: one page is new in the second, every fifth has changed."""
    docs = f"{sf_dir.rstrip('/')}/document[s].parquet"  # a pattern: a stream takes a single file by nothing else
    path = _path(spark, "refresh")
    store = refresh.open_store(spark, f"{path}/store")
    for round_ in (1, 2):
        stream = spark.readStream.schema(table(spark, sf_dir, "documents").schema).option("maxFilesPerTrigger", 1000).parquet(docs)
        refresh.refresh_available(_fetched(stream, round_), store, f"{path}/checkpoint-{round_}", f"2024-01-0{round_} 00:00:00", source=f"round {round_}")
    chunks = store.read("chunks").groupBy("url").agg(F.array_sort(F.collect_list("chunk_id")).alias("stored"))
    same = F.array_sort(F.array_distinct("chunk_ids")) == F.coalesce("stored", F.array().cast("array<string>"))
    return store.read("history").join(chunks, "url", "left").select("url", "content_hash", "scrape_count", F.day("last_changed").alias("changed_in"), same.alias("chunks_agree"), "status")


QUERIES = {f.__name__: f for f in (vector_upsert, chat_cascade, refresh_runs)}

ORACLE = {
    "vector_upsert": """
SELECT vec_id, CASE WHEN vec_id % 10 = 3 THEN label + 1000 ELSE label END AS label, CAST(len(embedding) AS INTEGER) AS width FROM embeddings
UNION ALL SELECT -vec_id - 1, label, CAST(len(embedding) AS INTEGER) FROM embeddings WHERE vec_id % 10 = 3""",
    "chat_cascade": """
WITH l AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE NOT (conv_id % 3 = 0 AND conv_id % 2 = 0))
SELECT DISTINCT 'chat' AS side, conv_id, CAST(1 AS BIGINT) AS n FROM l UNION ALL SELECT 'messages', conv_id, count(*) FROM l GROUP BY conv_id""",
    "refresh_runs": """
SELECT 'https://site/' || doc_id AS url, sha256(CASE WHEN doc_id % 5 = 0 THEN text || ' changed' ELSE text END) AS content_hash, CAST(CASE WHEN doc_id = 7 THEN 1 ELSE 2 END AS INTEGER) AS scrape_count,
  CAST(CASE WHEN doc_id % 5 = 0 OR doc_id = 7 THEN 2 ELSE 1 END AS INTEGER) AS changed_in, true AS chunks_agree, 'ok' AS status FROM documents""",
}
