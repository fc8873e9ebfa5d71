"""Change detection between a corpus snapshot and its history, and the history's upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEW, UNCHANGED, MODIFIED = "new", "unchanged", "modified"


def detect(pages: DataFrame, history: DataFrame, text: str = "content", hashed: bool = False) -> DataFrame:
    """url, content_hash, change and the chunk ids to delete of every fetched page (one row a url); ``hashed`` pages bring content_hash instead of a text."""
    now = pages.select("url", "content_hash" if hashed else F.sha2(text, 256).alias("content_hash"))
    old = history.select("url", F.col("content_hash").alias("old_hash"), F.col("chunk_ids").alias("old_chunk_ids"))
    change = F.when(F.col("old_hash").isNull(), NEW).when(F.col("old_hash") == F.col("content_hash"), UNCHANGED).otherwise(MODIFIED)
    stale = F.when(F.col("change") == MODIFIED, F.col("old_chunk_ids")).otherwise(F.array().cast("array<string>"))
    return now.join(old, "url", "left").withColumn("change", change).select("url", "content_hash", "change", F.coalesce(stale, F.array().cast("array<string>")).alias("stale_chunk_ids"))


def apply(history: DataFrame, changes: DataFrame, now: Column, reset_status: bool = False) -> DataFrame:
    """History after a run. Unchanged pages count and move last_scraped; others get everything anew.

    ``changes``: url, content_hash, change, chunk_ids, source, category. A page keeps an error status while its content stays
    the same, unless ``reset_status``.
    """
    o, n = history.alias("o"), changes.alias("n")
    j = o.join(n, F.col("o.url") == F.col("n.url"), "full_outer")
    seen, written = F.col("n.url").isNotNull(), F.coalesce(F.col("n.change") != UNCHANGED, F.lit(False))

    def pick(name: str) -> Column:
        return F.when(written, F.col(f"n.{name}")).otherwise(F.col(f"o.{name}")).alias(name)

    reset = written | (seen & F.lit(reset_status))
    return j.select(
        F.coalesce("o.url", "n.url").alias("url"),
        pick("content_hash"),
        F.when(seen, now).otherwise(F.col("o.last_scraped")).alias("last_scraped"),
        F.when(written, now).otherwise(F.col("o.last_changed")).alias("last_changed"),
        (F.coalesce("o.scrape_count", F.lit(0)) + seen.cast("int")).alias("scrape_count"),
        pick("chunk_ids"),
        pick("source"),
        pick("category"),
        F.when(reset, F.lit("ok")).otherwise(F.col("o.status")).alias("status"),
    )


def mark_errors(history: DataFrame, failed: DataFrame, now: Column) -> DataFrame:
    """Failed urls get status error; a first-ever failure enters with an empty hash, others keep hash and chunks."""
    o, n = history.alias("o"), failed.select(F.col("url").alias("failed_url"), F.col("source").alias("f_source"), F.col("category").alias("f_category"))
    j = o.join(n, F.col("o.url") == F.col("failed_url"), "full_outer")
    bad, fresh = F.col("failed_url").isNotNull(), F.col("o.url").isNull()
    return j.select(
        F.coalesce("o.url", "failed_url").alias("url"),
        F.when(fresh, F.lit("")).otherwise(F.col("o.content_hash")).alias("content_hash"),
        F.when(bad, now).otherwise(F.col("o.last_scraped")).alias("last_scraped"),
        F.when(fresh, now).otherwise(F.col("o.last_changed")).alias("last_changed"),
        F.coalesce("o.scrape_count", F.lit(1)).alias("scrape_count"),
        F.coalesce("o.chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"),
        F.coalesce("o.source", "f_source").alias("source"),
        F.coalesce("o.category", "f_category").alias("category"),
        F.when(bad, F.lit("error")).otherwise(F.col("o.status")).alias("status"),
    )


def run_stats(outcomes: DataFrame) -> DataFrame:
    """Totals of a run from outcome (new, unchanged, modified, failed, no_chunks), chunks_added and stale chunk ids."""
    o = F.col("outcome")
    return outcomes.agg(
        F.count_if(o != "failed").alias("fetched"),
        F.count_if(o == NEW).alias("new"),
        F.count_if(o == MODIFIED).alias("changed"),
        F.count_if(o == UNCHANGED).alias("unchanged"),
        F.count_if(o == "failed").alias("failed"),
        F.coalesce(F.sum("chunks_added"), F.lit(0)).alias("chunks_added"),
        F.coalesce(F.sum(F.size("stale_chunk_ids")), F.lit(0)).cast("bigint").alias("chunks_deleted"),
    )


def latest_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key."""
    packed = F.max_by(F.struct(*rows.columns), order).alias("r")
    return rows.groupBy(key).agg(packed).select("r.*")


def merge_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """url -> items of both snapshots, the new one winning; pages without items go."""
    j = old.select("url", F.col("items").alias("o")).join(new.select("url", F.col("items").alias("n")), "url", "full_outer")
    return j.select("url", F.coalesce("n", "o").alias("items")).filter((F.coalesce("url", F.lit("")) != "") & (F.size("items") > 0))
