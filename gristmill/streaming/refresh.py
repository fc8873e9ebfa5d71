"""Running incremental refresh: fetched pages stream in, only new and changed ones are chunked, and each batch is one commit.

Texts are never stored in between: a batch's urls and content hashes are compared with the history first, then the texts of new and changed
pages are read once more and go through their chunks straight into the store's buckets. A batch's rows must be the same each time they are
read, as those of files are; a stream that fetches on its way writes its pages first.

A batch reads its urls' history from the store (a stream-static join), drops the old chunks of changed pages, adds the new ones and
updates the history under one manifest with the batch's number. So the store is a checkpoint after every batch: a run that is killed
before a commit has changed nothing, one that is killed after it is not applied again, and the stream goes on from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import changes, chunking
from ..session import few, reliable
from ..sources.buckets import BucketStore

HISTORY = "url string, content_hash string, last_scraped timestamp, last_changed timestamp, scrape_count int, chunk_ids array<string>, source string, category string, status string"
CHUNKS = "chunk_id string, url string, chunk_index int, content string"
SOURCE = "pages"


def open_store(spark, path: str, buckets: int = 64) -> BucketStore:
    """History by url, chunks by id and dealt by url."""
    store = BucketStore(spark, path, buckets)
    store.create("history", spark.createDataFrame([], HISTORY).schema, ["url"])
    store.create("chunks", spark.createDataFrame([], CHUNKS).schema, ["url", "chunk_id"], ["url"])
    return store


def latest_fetch(batch: DataFrame) -> DataFrame:
    """Of a url's fetches in one batch the latest, ties by content; pages without url go. Only pages of urls that come several times are sorted."""
    named = batch.filter("url is not null")
    several = reliable(named.groupBy("url").count().filter("count > 1").select("url"))
    if several.isEmpty():
        return named
    order = Window.partitionBy("url").orderBy(F.desc("fetched_at"), "content")
    if not few(several):
        return _first(named, order)
    return named.join(F.broadcast(several), "url", "left_anti").unionByName(_first(named.join(F.broadcast(several), "url", "left_semi").select(named.columns), order))


def _first(rows: DataFrame, order) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def apply_batch(store: BucketStore, batch: DataFrame, number: int, now_text: str, source: str = SOURCE) -> bool:
    """One batch of fetched pages (url, content, source, category, title, fetched_at) into the store; False if it is there already."""
    at = store.manifest()
    if store.applied(at, source, number):
        return False
    fetched = latest_fetch(batch)
    seen = reliable(fetched.select("url", F.sha2("content", 256).alias("content_hash"), "source", "category"))
    history = store.read("history", at=at).join(seen.select("url"), "url", "left_semi")
    found = reliable(changes.detect(seen, history, hashed=True).drop("stale_chunk_ids").join(seen.drop("content_hash"), "url"))
    touched = found.filter(F.col("change") != changes.UNCHANGED).select("url")
    texts = fetched.join(F.broadcast(touched) if few(touched) else touched, "url", "left_semi")
    chunks = store.stage("chunks", chunking.adaptive_chunks(texts).select("chunk_id", "url", "chunk_index", "content"), gone=touched, on=["url"], at=at, within=True)
    ids = store.read_staged(chunks, at).select("url", "chunk_id").join(touched, "url", "left_semi").groupBy("url").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))
    rows = found.join(ids, "url", "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>")))
    after = reliable(changes.apply(history, rows, F.to_timestamp(F.lit(now_text))))
    store.commit(chunks, store.stage("history", after, at=at), at=at, source=source, batch=number)
    return True


def refresh_available(fetched: DataFrame, store: BucketStore, checkpoint: str, now_text: str, source: str = SOURCE) -> None:
    """Take in all that the stream has, batch by batch, and return. Batches are counted by ``source``: one for each checkpoint."""

    def take(batch: DataFrame, number: int) -> None:
        apply_batch(store, batch, number, now_text, source)

    query = fetched.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
