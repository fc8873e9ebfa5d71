import datetime as dt
import time

from gristmill.streaming import evaluation, reminders

T0 = dt.datetime(2024, 1, 1)
COMMANDS = "reminder_id long, ts timestamp, command string, notify_at timestamp, event_date timestamp, worker string"


def minute(n):
    return T0 + dt.timedelta(minutes=n)


def claim(reminder, n, worker):
    return (reminder, minute(n), "claim", None, None, worker)


def test_two_streams_compete_and_a_restart_keeps_the_winner(spark, tmp_path):
    """Claims of two workers arrive in two streams; the query is stopped and started anew from its checkpoint between them."""
    folders = [f"{tmp_path}/{w}" for w in ("one", "two")]

    def send(which, rows):
        spark.createDataFrame(rows, COMMANDS).coalesce(1).write.mode("append").parquet(folders[which])

    def run():
        both = [spark.readStream.schema(COMMANDS).parquet(f) for f in folders]
        query = reminders.reminder_actions(both[0].union(both[1])).writeStream.foreachBatch(reminders.dispatch_once(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/ck").start()
        query.processAllAvailable()
        query.stop()

    create = lambda i: (i, minute(0), "create", minute(500), minute(600), None)
    send(0, [create(1), create(2), create(3), create(4), claim(1, 2, "ann")])
    send(1, [claim(1, 1, "bob"), claim(2, 3, "bob"), claim(9, 1, "bob")])
    run()
    send(0, [claim(2, 4, "ann"), claim(3, 5, "ann"), (4, minute(5), "cancel", None, None, None)])
    send(1, [claim(3, 5, "bob"), claim(4, 6, "bob"), claim(1, 4, "bob"), claim(2, 0, "late")])
    run()
    run()
    got = sorted((r["reminder_id"], r["worker"] or "", r["action"], r["at"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [
        (1, "ann", "refused", minute(2)), (1, "bob", "claimed", minute(1)), (1, "bob", "refused", minute(4)),
        (2, "ann", "refused", minute(4)), (2, "bob", "claimed", minute(3)),
        (3, "ann", "claimed", minute(5)), (3, "bob", "refused", minute(5)),
        (4, "", "cancel", minute(5)), (4, "bob", "refused", minute(6)),
        (9, "bob", "refused", minute(1)),
    ]


def test_timers_survive_a_restart_and_claimed_reminders_have_none(spark, tmp_path):
    def send(rows):
        spark.createDataFrame(rows, COMMANDS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema(COMMANDS).parquet(f"{tmp_path}/in")
        query = reminders.reminder_actions(stream).writeStream.foreachBatch(reminders.dispatch_once(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/ck").start()
        query.processAllAvailable()
        query.stop()

    send([(1, minute(0), "create", minute(10), minute(20), None), (2, minute(0), "create", minute(10), minute(20), None), (3, minute(0), "create", None, minute(15), None)])
    run()
    send([claim(2, 1, "ann"), (1, minute(1), "snooze", minute(12), None, None)])
    run()
    send([(7, minute(100), "create", minute(900), minute(901), None)])
    run()
    send([(7, minute(101), "create", minute(1), minute(1), None)])
    run()
    got = sorted((r["reminder_id"], r["action"], r["at"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, "complete", minute(20)), (1, "notify", minute(12)), (2, "claimed", minute(1)), (3, "complete", minute(15))]


def test_state_expires(spark, tmp_path):
    """A key is refused within its time to live and accepted again after it, also by a query that was started anew."""
    schema = "state string, created_at timestamp"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        found = evaluation.fresh_states(stream, "state", ttl_seconds=25)
        query = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(once=True).start()
        assert query.awaitTermination(60)
        return sorted((r["state"], r["created_at"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    began = time.time()
    assert run([("a", minute(1)), ("a", minute(0)), ("b", minute(0))]) == [("a", minute(0)), ("b", minute(0))]
    accepted = time.time()
    got = run([("a", minute(2)), ("c", minute(2))])
    if time.time() - began < 25:
        assert got == [("a", minute(0)), ("b", minute(0)), ("c", minute(2))]
    time.sleep(max(0, accepted + 26 - time.time()))
    assert ("a", minute(3)) in run([("a", minute(3))])
