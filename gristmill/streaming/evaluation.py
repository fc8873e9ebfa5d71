"""Periodic work as incremental batches: sampled evaluation, calendar retries, interval schedules, activity sessions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import hooks
from ..operators.telemetry import evaluation_candidates, pick_sample

SAMPLE = 100
RETRY_LIMIT = 100


def evaluate_once(metrics: DataFrame, evaluated: DataFrame, judge: dict[str, Column], now: Column, source: str = "qdrant", n: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """(new evaluations, ids to mark): a sample of the rows that no run has judged yet; every row is judged once.

    Judging again after a failure sees the same rows, because only marked ids are left out.
    """
    fresh = evaluation_candidates(metrics, source).join(evaluated.select("id"), "id", "left_anti")
    picked = hooks.judged(pick_sample(fresh, n, "id"), judge)
    return picked.select("id", *judge), picked.select("id", now.alias("evaluated_at"))


def retry_due(flags: DataFrame, limit: int = RETRY_LIMIT) -> DataFrame:
    """Rows whose durable flag asks for another try, oldest first, a bounded number a tick."""
    return flags.filter(F.coalesce("retry", F.lit(False))).orderBy("requested_at", "id").limit(limit)


def interval_due(schedules: DataFrame, now: Column) -> DataFrame:
    """Schedules (name, minutes, last_run, running) due now; missed runs count as one, a running one isn't started again."""
    due = F.col("last_run").isNull() | (F.col("last_run") + F.make_dt_interval(mins=F.col("minutes")) <= now)
    return schedules.filter(due & ~F.coalesce("running", F.lit(False))).select("name", now.alias("started_at"))


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Activity sessions of every user: a pause of ``gap`` ends one. Works on streams and tables alike."""
    rows = events.withWatermark(ts, delay) if events.isStreaming else events
    found = rows.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class _FirstInTime(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at bigint", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        first = min(rows, key=lambda r: (r["__at"] is None, r["__at"]))
        if not self.seen.exists():
            self.seen.update((first["__at"],))
            yield first

    def close(self) -> None:
        pass


def fresh_states(states: DataFrame, key: str, ts: str = "created_at", ttl_seconds: float = 600) -> DataFrame:
    """Stream of state rows, each key once within its time to live: the state store forgets a key that long after it was accepted.

    Of a batch's rows with one key the earliest counts. Time is the engine's own; the RocksDB state store is needed.
    """
    rows = states.withColumn("__at", F.unix_millis(F.col(ts).cast("timestamp")))
    found = rows.groupBy(key).transformWithState(_FirstInTime(int(ttl_seconds * 1000)), rows.schema, "append", "processingtime")
    return found.drop("__at")
