"""Reminder queries over ``orders`` and ``customer``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reminders as rm
from ..sources.tables import table

NOW_TEXT = "1996-06-15 12:00:00"


def now():
    return F.to_timestamp(F.lit(NOW_TEXT))


def _requests(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    offsets = F.element_at(F.array(*map(F.lit, ["15m", "1h", " 1 D", "1w", "soon"])), F.substring("o_orderpriority", 1, 1).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") % 200).cast("string").alias("user_id"), F.format_string("Order  %d ", F.col("o_orderkey") % 5).alias("event_name"),
        F.col("o_orderdate").cast("timestamp").alias("event_date"), offsets.alias("offset"), F.element_at(F.array(*map(F.lit, ["in_app", "email", "both"])), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("notification_type"),
    )


def _reminders(spark, sf_dir):
    """Orders as reminders: status O/F/P reads pending/completed/cancelled."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "completed").otherwise("cancelled")
    event = F.col("o_orderdate").cast("timestamp")
    k = F.col("o_orderkey")
    stamp = F.to_timestamp(F.lit("1996-01-01 00:00:00"))
    return o.select(
        k.alias("reminder_id"), F.when(F.col("o_custkey") % 4 == 0, F.concat(F.col("o_custkey").cast("string"), F.lit("@x.example"))).otherwise(F.col("o_custkey").cast("string")).alias("user_id"),
        event.alias("event_date"), (event - F.make_dt_interval(days=F.lit(2))).alias("notify_at"), status.alias("status"),
        F.element_at(F.array(*map(F.lit, ["in_app", "email", "both"])), (k % 3 + 1).cast("int")).alias("notification_type"),
        F.when(k % 5 == 0, stamp).alias("notification_sent_at"), F.when(k % 7 == 0, stamp).alias("email_sent_at"), F.when(k % 11 == 0, stamp).alias("in_app_sent_at"), (k % 5).cast("int").alias("retry_count"),
    )


def _day(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)


def reminder_create(spark, sf_dir):
    existing = _requests(spark, sf_dir).filter("request_id % 4 = 0").select("user_id", rm.clean_name(F.col("event_name")).alias("event_name"), "event_date", F.when(F.col("request_id") % 8 == 0, "pending").otherwise("completed").alias("status"))
    made = rm.create(_requests(spark, sf_dir).filter("request_id % 4 <> 0"), existing, now())
    return made.select("request_id", "user_id", "event_name", _day("event_date"), "minutes", _day("notify_at"), "status")


def due_dispatch(spark, sf_dir):
    return rm.due(_reminders(spark, sf_dir), now()).select("reminder_id", "action", _day("due_at"))


def reminder_transitions(spark, sf_dir):
    r = _reminders(spark, sf_dir)
    events = r.filter("reminder_id % 2 = 0").select("reminder_id", F.element_at(F.array(*map(F.lit, ["complete", "cancel", "snooze"])), (F.col("reminder_id") % 3 + 1).cast("int")).alias("event"), (F.col("reminder_id") % 20000 - 50).alias("minutes"))
    return rm.transition(r, events, now()).select("reminder_id", "status", _day("notify_at"), F.col("notification_sent_at").isNotNull().alias("notified"), "applied")


def _outcomes(r):
    return r.select("reminder_id", (F.col("reminder_id") % 2 == 0).alias("in_app_ok"), (F.col("reminder_id") % 3 != 0).alias("email_ok"))


def reminder_channels(spark, sf_dir):
    r = _reminders(spark, sf_dir)
    return rm.deliver(r, _outcomes(r), now()).select("reminder_id", _day("in_app_sent_at"), _day("email_sent_at"), "delivery")


def reminder_retry(spark, sf_dir):
    r = _reminders(spark, sf_dir)
    return rm.process_with_retry(r, _outcomes(r), now()).select("reminder_id", "status", _day("notify_at"), "retry_count", "missed")


def claim_pending(spark, sf_dir):
    """Every order line is a worker that claims the order's reminder."""
    claims = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("reminder_id"), F.col("l_linenumber").alias("worker"), F.col("l_shipdate").alias("at"))
    return rm.claim(_reminders(spark, sf_dir).select("reminder_id", "status"), claims).select("reminder_id", "status", "claimed_by")


def upcoming_days_remaining(spark, sf_dir):
    return rm.upcoming(_reminders(spark, sf_dir), now()).select("reminder_id", "days_remaining")


def email_resolution(spark, sf_dir):
    preferences = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("user_id"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@mail.example"))).otherwise("").alias("email"))
    return rm.recipient(_reminders(spark, sf_dir).select("reminder_id", "user_id"), preferences).select("reminder_id", "email")


def reminder_display(spark, sf_dir):
    r = _reminders(spark, sf_dir)
    return r.select("reminder_id", rm.display_time(F.col("event_date")).alias("shown"), rm.relative_time(F.col("event_date"), now()).alias("ago"))


QUERIES = {f.__name__: f for f in (reminder_create, due_dispatch, reminder_transitions, reminder_channels, reminder_retry, claim_pending, upcoming_days_remaining, email_resolution, reminder_display)}

_NOW = f"TIMESTAMP '{NOW_TEXT}'"
_DAY = "strftime({0}, '%Y-%m-%d %H:%M') AS {0}"
_R = """
r AS (SELECT o_orderkey AS reminder_id, CASE WHEN o_custkey % 4 = 0 THEN o_custkey || '@x.example' ELSE CAST(o_custkey AS VARCHAR) END AS user_id, o_orderdate AS event_date,
  o_orderdate - INTERVAL 2 DAY AS notify_at, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'completed' ELSE 'cancelled' END AS status,
  ['in_app', 'email', 'both'][o_orderkey % 3 + 1] AS notification_type, CASE WHEN o_orderkey % 5 = 0 THEN TIMESTAMP '1996-01-01' END AS notification_sent_at,
  CASE WHEN o_orderkey % 7 = 0 THEN TIMESTAMP '1996-01-01' END AS email_sent_at, CASE WHEN o_orderkey % 11 = 0 THEN TIMESTAMP '1996-01-01' END AS in_app_sent_at,
  CAST(o_orderkey % 5 AS INTEGER) AS retry_count FROM orders),
o AS (SELECT *, reminder_id % 2 = 0 AS in_app_ok, reminder_id % 3 <> 0 AS email_ok, notification_type IN ('in_app', 'both') AS app, notification_type IN ('email', 'both') AS mail FROM r)"""

ORACLE = {
    "reminder_create": f"""
WITH q AS (SELECT o_orderkey AS request_id, CAST(o_custkey % 200 AS VARCHAR) AS user_id, 'Order ' || (o_orderkey % 5) AS event_name, o_orderdate AS event_date,
  [15, 60, 1440, 10080, NULL][CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS minutes FROM orders),
n AS (SELECT user_id, event_name, event_date, min(request_id) AS request_id, arg_min(minutes, request_id) AS minutes FROM q WHERE request_id % 4 <> 0 AND minutes IS NOT NULL GROUP BY ALL),
f AS (SELECT * FROM n ANTI JOIN (SELECT user_id, event_name, event_date FROM q WHERE request_id % 8 = 0) e USING (user_id, event_name, event_date))
SELECT request_id, user_id, event_name, {_DAY.format('event_date')}, CAST(minutes AS BIGINT) AS minutes,
  strftime(greatest(f.event_date - to_minutes(CAST(minutes AS BIGINT)), {_NOW}), '%Y-%m-%d %H:%M') AS notify_at, 'pending' AS status FROM f""",
    "due_dispatch": f"""
WITH {_R}, a AS (SELECT reminder_id, 'notify' AS action, notify_at AS due_at FROM r WHERE status = 'pending' AND notify_at <= {_NOW} AND notification_sent_at IS NULL
  UNION ALL SELECT reminder_id, 'complete', event_date FROM r WHERE status = 'pending' AND event_date <= {_NOW}
  UNION ALL SELECT reminder_id, 'mail_completion', event_date FROM r WHERE status = 'completed' AND email_sent_at IS NULL AND notification_type IN ('email', 'both'))
SELECT reminder_id, action, {_DAY.format('due_at')} FROM a QUALIFY row_number() OVER (PARTITION BY action ORDER BY a.due_at, reminder_id) <= 500""",
    "reminder_transitions": f"""
WITH {_R}, e AS (SELECT *, CASE WHEN reminder_id % 2 = 0 THEN ['complete', 'cancel', 'snooze'][reminder_id % 3 + 1] END AS event, least(10080, greatest(1, reminder_id % 20000 - 50)) AS minutes FROM r),
a AS (SELECT *, status = 'pending' AND event IS NOT NULL AS applied FROM e)
SELECT reminder_id, CASE WHEN applied AND event = 'complete' THEN 'completed' WHEN applied AND event = 'cancel' THEN 'cancelled' ELSE status END AS status,
  strftime(CASE WHEN applied AND event = 'snooze' THEN {_NOW} + to_minutes(CAST(minutes AS BIGINT)) ELSE a.notify_at END, '%Y-%m-%d %H:%M') AS notify_at,
  notification_sent_at IS NOT NULL AND NOT (applied AND event = 'snooze') AS notified, applied FROM a""",
    "reminder_channels": f"""
WITH {_R}, s AS (SELECT *, coalesce(in_app_sent_at, CASE WHEN app AND in_app_ok THEN {_NOW} END) AS a, coalesce(email_sent_at, CASE WHEN mail AND email_ok THEN {_NOW} END) AS m FROM o)
SELECT reminder_id, strftime(a, '%Y-%m-%d %H:%M') AS in_app_sent_at, strftime(m, '%Y-%m-%d %H:%M') AS email_sent_at,
  CASE WHEN (NOT app OR a IS NOT NULL) AND (NOT mail OR m IS NOT NULL) THEN 'sent' ELSE 'partial' END AS delivery FROM s""",
    "reminder_retry": f"""
WITH {_R}, d AS (SELECT *, status = 'pending' AND notify_at <= {_NOW} AS due, CAST(app AND in_app_ok AS INTEGER) + CAST(mail AND email_ok AS INTEGER) AS good, CAST(app AS INTEGER) + CAST(mail AS INTEGER) AS asked FROM o),
x AS (SELECT *, due AND event_date < {_NOW} AS late, CASE WHEN good >= asked THEN 'sent' WHEN good > 0 THEN 'partially_sent' ELSE 'failed' END AS result FROM d),
y AS (SELECT *, result <> 'sent' AND retry_count < 3 AS again FROM x)
SELECT reminder_id, CASE WHEN late THEN 'completed' WHEN due AND again THEN 'pending' WHEN due THEN result ELSE status END AS status,
  strftime(CASE WHEN due AND NOT late AND again THEN {_NOW} + INTERVAL 15 MINUTE ELSE y.notify_at END, '%Y-%m-%d %H:%M') AS notify_at,
  retry_count + CAST(due AND NOT late AND again AS INTEGER) AS retry_count, late AS missed FROM y""",
    "claim_pending": f"""
WITH {_R}, c AS (SELECT l_orderkey AS reminder_id, l_linenumber AS worker FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) = 1)
SELECT reminder_id, CASE WHEN status = 'pending' AND worker IS NOT NULL THEN 'processing' ELSE status END AS status, CASE WHEN status = 'pending' THEN worker END AS claimed_by FROM r LEFT JOIN c USING (reminder_id)""",
    "upcoming_days_remaining": f"""WITH {_R} SELECT reminder_id, CAST(date_diff('day', DATE '1996-06-15', CAST(event_date AS DATE)) AS INTEGER) AS days_remaining
FROM r WHERE status = 'pending' ORDER BY event_date, reminder_id LIMIT 100""",
    "email_resolution": f"""
WITH {_R} SELECT reminder_id, coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'c' || c_custkey || '@mail.example' END, CASE WHEN contains(user_id, '@') THEN user_id END) AS email
FROM r LEFT JOIN customer c ON r.user_id = CAST(c_custkey AS VARCHAR)""",
    "reminder_display": f"""
WITH {_R}, s AS (SELECT *, CAST(epoch({_NOW}) - epoch(event_date) AS BIGINT) AS s FROM r)
SELECT reminder_id, strftime(event_date + INTERVAL 330 MINUTE, '%d %b %Y, %I:%M %p') || ' IST' AS shown,
  CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS ago FROM s""",
}
