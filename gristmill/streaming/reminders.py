"""Reminders as a stream: a keyed processor with timers and exactly-one claims, and idempotent dispatch in micro-batches.

The processor needs the RocksDB state store, which ``build_session`` chooses. Its state and timers live in the query's checkpoint: a
restarted query goes on where the last committed batch ended, so a claim that was won stays won.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import reminders as ops

# Times in state and timers are milliseconds since 1970.
STATE = "status string, notify bigint, event bigint, worker string"
OUTPUT = "reminder_id bigint, action string, at bigint, worker string"


class ReminderProcessor(StatefulProcessor):
    """One reminder's life: create, snooze, cancel and claim commands in time order, and two event-time timers.

    Every transition is guarded by status pending. Of all claims the first in time order takes a pending reminder, ties by the
    worker's name; it is processing from then on and its timers are gone. Any other claim is refused and told so. A timer that
    was snoozed away or comes after the end of the reminder does nothing. A second create of a known reminder is ignored.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("reminder", STATE)

    def close(self) -> None:
        pass

    def _load(self) -> tuple:
        return self.state.get() if self.state.exists() else (None, None, None, None)

    def _wait(self, *times: int | None) -> None:
        """The timers are these times, no others."""
        wanted = {t for t in times if t is not None}
        for known in list(self.handle.listTimers()):
            if known in wanted:
                wanted.remove(known)
            else:
                self.handle.deleteTimer(known)
        for t in wanted:
            self.handle.registerTimer(t)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        status, notify, event, worker = self._load()
        for r in sorted(rows, key=lambda r: (r["at"], r["command"] == "claim", r["worker"] or "")):
            pending = status == "pending"
            if r["command"] == "create" and status is None:
                status, notify, event = "pending", r["notify"], r["event"]
            elif r["command"] == "snooze" and pending:
                notify = r["notify"]
            elif r["command"] == "cancel" and pending:
                status = "cancelled"
                yield Row(reminder_id=key[0], action="cancel", at=r["at"], worker=None)
            elif r["command"] == "claim":
                if pending:
                    status, worker = "processing", r["worker"]
                yield Row(reminder_id=key[0], action="claimed" if pending else "refused", at=r["at"], worker=r["worker"])
        if status is not None:
            self.state.update((status, notify, event, worker))
            self._wait(*((notify, event) if status == "pending" else ()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        status, notify, event, worker = self._load()
        now = expiredTimerInfo.getExpiryTimeInMs()
        if status != "pending":
            return
        if notify == now:
            yield Row(reminder_id=key[0], action="notify", at=notify, worker=None)
            notify = None
        if event == now:
            yield Row(reminder_id=key[0], action="complete", at=event, worker=None)
            status = "completed"
        self.state.update((status, notify, event, worker))


def reminder_actions(commands: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Stream of notify, complete, cancel, claimed and refused from commands (reminder_id, ts, command, notify_at, event_date, worker if there are claims).

    Commands that come later than ``delay`` behind the latest are dropped.
    """
    rows = commands if "worker" in commands.columns else commands.withColumn("worker", F.lit(None).cast("string"))
    times = [F.unix_millis(F.col(c)).alias(n) for c, n in (("ts", "at"), ("notify_at", "notify"), ("event_date", "event"))]
    watched = rows.withWatermark("ts", delay).select("reminder_id", "ts", "command", "worker", *times)
    found = watched.groupBy("reminder_id").transformWithState(ReminderProcessor(), OUTPUT, "append", "eventtime")
    return found.withColumn("at", F.timestamp_millis("at"))


def dispatch_once(outbox: str):
    """A foreachBatch function that writes every micro-batch's actions under its number: a repeated or broken-off batch replaces its own rows.

    Across batches the state machine emits an action once, so nothing that is in the outbox has to be read again.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["reminder_id", "action", "at"]).write.mode("overwrite").parquet(f"{outbox}/batch={number}")

    return write


def scheduler_tick(reminders: DataFrame, now_text: str) -> DataFrame:
    """The batch twin of one tick."""
    return ops.due(reminders, F.to_timestamp(F.lit(now_text))).select("reminder_id", "action", F.col("due_at").alias("at"))
