import datetime as dt
import os
import random

import pytest
from pyspark.errors import PySparkException

from gristmill import session
from gristmill.session import shared_folder
from gristmill.sources.buckets import BucketStore, Conflict
from gristmill.streaming import refresh


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def make(spark, path, rows, buckets=8):
    store = BucketStore(spark, f"file://{path}", buckets)
    frame = spark.createDataFrame(rows, "id long, v string, extra int")
    store.create("t", frame.schema, ["id"])
    store.upsert("t", frame)
    return store


def test_ids_overwrite_and_only_touched_buckets_are_rewritten(spark, tmp_path):
    store = make(spark, f"{tmp_path}/s", [(i, "old", None) for i in range(100)] + [(None, "null id", 1)])
    before, files = store.manifest(), files_of(tmp_path)
    store.upsert("t", spark.createDataFrame([(5, "new", 1), (1000, "new", None)], "id long, v string, extra int"))
    after = store.manifest()
    changed = {b for b in after.tables["t"]["folders"] if after.tables["t"]["folders"][b] != before.tables["t"]["folders"].get(b)}
    assert 1 <= len(changed) <= 2 and after.version == before.version + 1
    assert files.items() <= files_of(tmp_path).items()
    got = {r["id"]: r["v"] for r in store.read("t").collect()}
    assert got == {i: "old" for i in range(100)} | {None: "null id", 5: "new", 1000: "new"}
    assert store.read("t", at=before).count() == 101
    store.upsert("t", spark.createDataFrame([], "id long, v string, extra int"))
    assert store.read("t").count() == 102


def test_second_writer_is_told(spark, tmp_path):
    store = make(spark, f"{tmp_path}/s", [(1, "a", None)])
    one, two = store.manifest(), store.manifest()
    rows = [spark.createDataFrame([(k, v, None)], "id long, v string, extra int") for k, v in ((2, "b"), (3, "c"))]
    first, second = store.stage("t", rows[0], at=one), store.stage("t", rows[1], at=two)
    store.commit(first, at=one)
    with pytest.raises(Conflict):
        store.commit(second, at=two)
    assert sorted(r["id"] for r in store.read("t").collect()) == [1, 2]


def test_cascade_is_scoped_and_all_at_once(spark, tmp_path):
    store = BucketStore(spark, f"file://{tmp_path}/c", 4)
    chats = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "chat long, user long")
    messages = spark.createDataFrame([(c, u, n) for c, u in ((1, 7), (2, 7), (3, 8)) for n in range(3)] + [(1, 9, 5)], "chat long, user long, n int")
    store.create("chats", chats.schema, ["chat"])
    store.create("messages", messages.schema, ["chat", "n"], ["chat"])
    store.upsert("chats", chats)
    store.upsert("messages", messages)
    version = store.manifest().version
    store.delete(spark.createDataFrame([(1, 7), (3, 7), (99, 7)], "chat long, user long"), {"chats": ["chat", "user"], "messages": ["chat", "user"]})
    assert store.manifest().version == version + 1
    assert sorted(r["chat"] for r in store.read("chats").collect()) == [2, 3]
    assert sorted(map(tuple, store.read("messages").select("chat", "n").collect())) == [(1, 5)] + [(c, n) for c in (2, 3) for n in range(3)]
    with pytest.raises(ValueError):
        store.delete(spark.createDataFrame([(7,)], "user long"), {"chats": ["user"]})


PAGES = "url string, content string, source string, category string, title string, fetched_at timestamp"


def page(name, words, hour=0):
    return (name, f"{words} " * 60, "s", "law", None, dt.datetime(2024, 1, 1, hour))


def state(store):
    chunks = sorted(map(tuple, store.read("chunks").collect()))
    history = sorted((r["url"], r["content_hash"], r["scrape_count"], tuple(r["chunk_ids"]), r["status"]) for r in store.read("history").collect())
    return chunks, history


def test_refresh_killed_half_way_ends_in_the_same_store(spark, tmp_path):
    """A run dies before its commit, another just after it; both are started anew and leave what a run without accident leaves."""
    batches = [[page("a", "one"), page("b", "two"), page("b", "two and more", 1)], [page("a", "one"), page("b", "three"), page("c", "four")]]

    def run(store, name, rows):
        spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
        refresh.refresh_available(spark.readStream.schema(PAGES).parquet(f"{tmp_path}/{name}/in"), store, f"{tmp_path}/{name}/ck", "2024-01-01 00:00:00")

    calm = refresh.open_store(spark, f"file://{tmp_path}/calm/store", 4)
    for rows in batches:
        run(calm, "calm", rows)

    class Dies(BucketStore):
        before = after = False

        def commit(self, *staged, **more):
            if self.before:
                raise RuntimeError("killed before the commit")
            super().commit(*staged, **more)
            if self.after:
                raise RuntimeError("killed after the commit")

    refresh.open_store(spark, f"file://{tmp_path}/rough/store", 4)
    rough = Dies(spark, f"file://{tmp_path}/rough/store", 4)
    for rows, flag in zip(batches, ("before", "after"), strict=True):
        setattr(rough, flag, True)
        with pytest.raises(PySparkException):
            run(rough, "rough", rows)
        setattr(rough, flag, False)
        refresh.refresh_available(spark.readStream.schema(PAGES).parquet(f"{tmp_path}/rough/in"), rough, f"{tmp_path}/rough/ck", "2024-01-01 00:00:00")
    assert state(rough) == state(calm)
    chunks, history = state(calm)
    assert {u: n for u, _, n, _, _ in history} == {"a": 2, "b": 2, "c": 1}
    assert {c[0] for c in chunks} == {i for _, _, _, ids, _ in history for i in ids} and any("three" in c[3] for c in chunks) and not any("two" in c[3] for c in chunks)


def test_batches_are_applied_once(spark, tmp_path):
    store = refresh.open_store(spark, f"file://{tmp_path}/store", 4)
    batch = spark.createDataFrame([page("a", "one")], PAGES)
    assert refresh.apply_batch(store, batch, 0, "2024-01-01 00:00:00")
    assert not refresh.apply_batch(store, batch, 0, "2024-01-01 00:00:00")
    assert store.read("history").first()["scrape_count"] == 1


def test_refresh_keeps_no_texts_between_its_steps(spark, tmp_path):
    """Texts go from the batch into the store's buckets: what lies in the shared folder besides is a small part of them."""
    rnd = random.Random(4)
    rows = [(f"u{i}", " ".join(f"{rnd.getrandbits(60):x}" for _ in range(400)), "s", "law", None, dt.datetime(2024, 1, 1)) for i in range(120)]
    spark.createDataFrame(rows, PAGES).write.parquet(f"{tmp_path}/in")
    store = refresh.open_store(spark, f"file://{tmp_path}/store", 4)
    shared_folder(spark)
    shared = spark.sparkContext.getCheckpointDir().removeprefix("file:")

    def held():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(shared) for f in names)

    before = held()
    refresh.apply_batch(store, spark.read.parquet(f"{tmp_path}/in"), 0, "2024-01-01 00:00:00")
    assert store.read("history").count() == 120 and held() - before < sum(len(r[1]) for r in rows) / 5


@pytest.mark.parametrize("limit", [0, 64, 64 << 20])
def test_refresh_with_and_without_broadcasts(spark, tmp_path, monkeypatch, limit):
    """Repeated, null, changed, blank and unchanged pages end alike, however many keys may be broadcast."""
    monkeypatch.setattr(session, "BROADCAST_BYTES", limit)
    store = refresh.open_store(spark, f"file://{tmp_path}/store", 4)
    one = [page("a", "one"), page("b", "two"), page("b", "zwei", 1), page("b", "drei", 1), page("c", "same"), page(None, "lost"), page("d", "goes")]
    two = [page("a", "one", 2), page("b", "four", 2), page("c", "older", 1), page("c", "same", 2), ("d", None, "s", "law", None, None), page("e", "new", 2)]
    for number, rows in enumerate((one, two)):
        assert refresh.apply_batch(store, spark.createDataFrame(rows, PAGES), number, f"2024-01-0{number + 1} 00:00:00")
    chunks, history = state(store)
    assert {u: (n, len(ids) > 0) for u, _, n, ids, _ in history} == {"a": (2, True), "b": (2, True), "c": (2, True), "d": (2, False), "e": (1, True)}
    assert sorted(c[0] for c in chunks) == sorted(i for _, _, _, ids, _ in history for i in ids)
    assert {(c[1], c[3].split()[0]) for c in chunks} == {("a", "one"), ("b", "four"), ("c", "same"), ("e", "new")}
    assert store.manifest().batches == {"pages": 1}
    with pytest.raises(ValueError):
        store.stage("chunks", store.read("chunks"), within=True)
