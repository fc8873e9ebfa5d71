"""Incremental page refresh: only new and changed pages of a micro-batch are chunked again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import changes, chunking


def refresh(batch: DataFrame, history: DataFrame, now_text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks to add, chunk ids to delete, new history) of a batch of fetched pages (url, content, source, category, title)."""
    found = changes.detect(batch, history)
    touched = found.filter(F.col("change") != changes.UNCHANGED)
    chunks = chunking.adaptive_chunks(batch.join(touched.select("url"), "url", "left_semi"))
    ids = chunks.groupBy("url").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))
    rows = found.join(batch.select("url", "source", "category"), "url").join(ids, "url", "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>")))
    stale = touched.select("url", F.explode("stale_chunk_ids").alias("chunk_id"))
    return chunks, stale, changes.apply(history, rows, F.to_timestamp(F.lit(now_text)))


def telemetry_windows(events: DataFrame, ts: str = "ts", width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Requests and total value of each window and type; works on streams and tables alike."""
    rows = events.withWatermark(ts, delay) if events.isStreaming else events
    return rows.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
