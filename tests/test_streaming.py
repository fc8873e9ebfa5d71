import datetime as dt

from pyspark.sql import functions as F

from gristmill.streaming import pages, reminders

T0 = dt.datetime(2024, 1, 1)


def minute(n):
    return T0 + dt.timedelta(minutes=n)


def test_reminder_stream(spark, tmp_path):
    schema = "reminder_id long, ts timestamp, command string, notify_at timestamp, event_date timestamp"
    rows = [
        [(1, minute(0), "create", minute(10), minute(20)), (2, minute(0), "create", minute(10), minute(20)), (3, minute(0), "create", minute(5), minute(30))],
        [(2, minute(2), "cancel", None, None), (3, minute(3), "snooze", minute(12), None), (9, minute(60), "create", minute(200), minute(300))],
        [(9, minute(61), "snooze", minute(250), None)],
        [(9, minute(62), "snooze", minute(251), None)],
        [(9, minute(63), "snooze", minute(252), None)],
    ]
    source, outbox = f"{tmp_path}/in", f"{tmp_path}/out"
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{source}")
        if i == 0:
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
            query = reminders.reminder_actions(stream).writeStream.foreachBatch(reminders.dispatch_once(outbox)).option("checkpointLocation", f"{tmp_path}/ck").start()
        query.processAllAvailable()
    query.stop()
    got = sorted((r["reminder_id"], r["action"]) for r in spark.read.parquet(outbox).collect())
    assert got == [(1, "complete"), (1, "notify"), (2, "cancel"), (3, "complete"), (3, "notify")]


def test_outbox_is_idempotent(spark, tmp_path):
    batch = spark.createDataFrame([(1, "notify", T0), (1, "notify", T0)], "reminder_id long, action string, at timestamp")
    write = reminders.dispatch_once(f"{tmp_path}/outbox")
    write(batch, 0)
    write(batch, 0)
    assert spark.read.parquet(f"{tmp_path}/outbox").count() == 1


def test_refresh_twice_changes_only_counters(spark):
    fetched = spark.createDataFrame([("u1", "some words that are long enough to keep " * 30, "s", "events", "T"), ("u2", "short", "s", "law", None)], "url string, content string, source string, category string, title string")
    schema = "url string, content_hash string, last_scraped timestamp, last_changed timestamp, scrape_count int, chunk_ids array<string>, source string, category string, status string"
    chunks, stale, history = pages.refresh(fetched, spark.createDataFrame([], schema), "2024-01-01 00:00:00")
    assert chunks.count() > 1 and stale.count() == 0
    history = spark.createDataFrame(history.collect(), schema)
    again, stale, after = pages.refresh(fetched, history, "2024-01-02 00:00:00")
    assert again.count() == 0 and stale.count() == 0
    keep = ["url", "content_hash", "last_changed", "chunk_ids", "status"]
    assert sorted(map(tuple, history.select(keep).collect())) == sorted(map(tuple, after.select(keep).collect()))
    assert {r["scrape_count"] for r in after.collect()} == {2}


def test_windows_stream_equals_batch(spark, tmp_path):
    rows = [(minute(i * 7), "view" if i % 3 else "click") for i in range(60)]
    frame = spark.createDataFrame(rows, "ts timestamp, event_type string")
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    query = pages.telemetry_windows(stream).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, pages.telemetry_windows(frame).collect()))
    assert pages.telemetry_windows(frame).agg(F.sum("n")).first()[0] == 60
