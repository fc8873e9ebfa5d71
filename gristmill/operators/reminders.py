"""Reminders: parsing, creation, and the state machine as guarded set transitions. ``now`` is always given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# Minutes of the offset units, offsets that mean the event itself, and the channels of each notification type.
UNIT_MINUTES = {"m": 1, "h": 60, "d": 1440, "w": 10080}
NO_OFFSET = ["", "0", "none", "at_event"]
IN_APP = ["in_app", "both", "all", "in_app_email", "in_app+email"]
EMAIL = ["email", "both", "all", "in_app_email", "in_app+email"]
BATCH = 500
RETRIES, RETRY_MINUTES = 3, 15


def offset_minutes(offset: Column) -> Column:
    """Minutes of 15m, 1h, 1d, 1w; 0 for the event itself; null if invalid."""
    o = F.lower(tx.strip(offset))
    number = F.nullif(F.regexp_extract(o, r"^(\d+)\s*[mhdw]$", 1), F.lit("")).cast("bigint")
    unit = F.regexp_extract(o, r"^\d+\s*([mhdw])$", 1)
    minutes = F.lit(None).cast("bigint")
    for u, n in UNIT_MINUTES.items():
        minutes = F.when(unit == u, number * n).otherwise(minutes)
    return F.when(o.isin(NO_OFFSET), F.lit(0).cast("bigint")).otherwise(minutes)


def event_time(text: Column, zone: str = "Asia/Kolkata") -> Column:
    """ISO text to UTC; text without a zone is local time of ``zone``."""
    aware = tx.strip(text).rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2})$")
    return F.when(aware, F.try_to_timestamp(text)).otherwise(F.to_utc_timestamp(F.try_to_timestamp(text), zone))


# Forms that a date may have where it is no ISO text; of an ambiguous day and month the month comes first.
DATE_FORMS = [
    "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "yyyy/M/d", "d.M.yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy", "yyyyMMdd",
]
TIME_FORMS = "[ h:mm a][, h:mm a][ H:mm[:ss]]"
CUSTOM_OFFSET_FALLBACK = 1440


def lenient_event_time(text: Column, zone: str = "Asia/Kolkata", fallback: Column | None = None) -> Column:
    """ISO text, or one of ``DATE_FORMS`` with a time or without, as local time of ``zone``; else ``fallback``, null by default."""
    plain = tx.collapse(text)
    local = F.coalesce(*(F.try_to_timestamp(plain, F.lit(d + TIME_FORMS)) for d in DATE_FORMS))
    found = F.coalesce(event_time(text, zone), F.to_utc_timestamp(local, zone))
    return found if fallback is None else F.coalesce(found, fallback)


def custom_offset_minutes(event: Column, offset: Column, zone: str = "Asia/Kolkata") -> Column:
    """Minutes before an event: 1h, 1d, 3d, or a moment of its own, at least 0; a day where the offset is unreadable."""
    named = F.create_map(F.lit("1h"), F.lit(60), F.lit("1d"), F.lit(1440), F.lit("3d"), F.lit(4320))
    moment = lenient_event_time(offset, zone)
    before = F.when(moment.isNotNull(), F.greatest(F.lit(0), F.floor((F.unix_timestamp(event) - F.unix_timestamp(moment)) / 60)))
    return F.coalesce(F.try_element_at(named, offset).cast("bigint"), before.cast("bigint"), F.lit(CUSTOM_OFFSET_FALLBACK).cast("bigint"))


def notify_at(event: Column, minutes: Column, now: Column) -> Column:
    return F.greatest(event - F.make_dt_interval(mins=minutes.cast("int")), now)


def display_time(ts: Column, zone: str = "Asia/Kolkata", label: str = "IST") -> Column:
    return F.concat(F.date_format(F.from_utc_timestamp(ts, zone), "dd MMM yyyy, hh:mm a"), F.lit(f" {label}"))


def clean_name(name: Column, limit: int = 500) -> Column:
    """Collapsed and cut; null where nothing is left."""
    return tx.blank_to_null(F.substring(tx.collapse(name), 1, limit))


def create(requests: DataFrame, existing: DataFrame, now: Column) -> DataFrame:
    """Valid requests become pending reminders, one for each user, name and date that is not pending yet.

    ``requests``: request_id, user_id, event_name, event_date, offset, notification_type. The earliest request of equal ones wins.
    """
    rows = requests.select(
        "request_id", "user_id", clean_name(F.col("event_name")).alias("event_name"), "event_date", offset_minutes(F.col("offset")).alias("minutes"), "notification_type"
    ).filter("event_name is not null and event_date is not null and minutes is not null")
    key = ["user_id", "event_name", "event_date"]
    firsts = rows.groupBy(*key).agg(F.min_by(F.struct("request_id", "minutes", "notification_type"), "request_id").alias("r")).select(*key, "r.*")
    fresh = firsts.join(existing.filter("status = 'pending'").select(*key).distinct(), key, "left_anti")
    return fresh.withColumn("notify_at", notify_at(F.col("event_date"), F.col("minutes"), now)).withColumn("status", F.lit("pending"))


def due(reminders: DataFrame, now: Column, batch: int = BATCH) -> DataFrame:
    """What a scheduler tick has to do: notify, complete, mail_completion; each ordered by due time and bounded."""
    pending = F.col("status") == "pending"
    actions = F.array_compact(
        F.array(
            F.when(pending & (F.col("notify_at") <= now) & F.col("notification_sent_at").isNull(), F.struct(F.lit("notify").alias("action"), F.col("notify_at").alias("due_at"))),
            F.when(pending & (F.col("event_date") <= now), F.struct(F.lit("complete").alias("action"), F.col("event_date").alias("due_at"))),
            F.when((F.col("status") == "completed") & F.col("email_sent_at").isNull() & F.col("notification_type").isin("email", "both"), F.struct(F.lit("mail_completion").alias("action"), F.col("event_date").alias("due_at"))),
        )
    )
    rows = reminders.select("reminder_id", F.inline(actions))
    order = Window.partitionBy("action").orderBy("due_at", "reminder_id")
    return rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= batch)


def transition(reminders: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """One event for each reminder (complete, cancel, snooze with minutes), applied only while the reminder is pending."""
    j = reminders.join(events.select("reminder_id", "event", "minutes"), "reminder_id", "left")
    ok = F.coalesce((F.col("status") == "pending") & F.col("event").isNotNull(), F.lit(False))
    snooze = ok & (F.col("event") == "snooze")
    status = F.when(ok & (F.col("event") == "complete"), "completed").when(ok & (F.col("event") == "cancel"), "cancelled").otherwise(F.col("status"))
    minutes = F.least(F.lit(10080), F.greatest(F.lit(1), F.col("minutes"))).cast("int")
    return j.select(
        "reminder_id", status.alias("status"), F.when(snooze, now + F.make_dt_interval(mins=minutes)).otherwise(F.col("notify_at")).alias("notify_at"),
        F.when(snooze, F.lit(None)).otherwise(F.col("notification_sent_at")).alias("notification_sent_at"), ok.alias("applied"),
    )


def claim(rows: DataFrame, claims: DataFrame, key: str = "reminder_id") -> DataFrame:
    """Compare and set: of each pending row's claims (key, worker, at) the earliest wins, ties by worker; other rows keep their state.

    A second run finds the row claimed and gives it to nobody else.
    """
    first = claims.groupBy(key).agg(F.min(F.struct("at", "worker")).alias("__c"))
    won = (F.col("status") == "pending") & F.col("__c").isNotNull()
    joined = rows.join(first, key, "left").withColumn("claimed_by", F.when(won, F.col("__c.worker")))
    return joined.withColumn("status", F.when(won, "processing").otherwise(F.col("status"))).drop("__c")


def deliver(reminders: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Stamp each enabled channel that succeeded and wasn't stamped; sent once all enabled channels are, else partial.

    ``outcomes``: reminder_id, in_app_ok, email_ok. Running it again changes nothing that is stamped.
    """
    j = reminders.join(outcomes, "reminder_id", "left")
    app, mail = F.col("notification_type").isin(IN_APP), F.col("notification_type").isin(EMAIL)
    app_at = F.coalesce("in_app_sent_at", F.when(app & F.col("in_app_ok"), now))
    mail_at = F.coalesce("email_sent_at", F.when(mail & F.col("email_ok"), now))
    done = (~app | app_at.isNotNull()) & (~mail | mail_at.isNotNull())
    return j.select("reminder_id", app_at.alias("in_app_sent_at"), mail_at.alias("email_sent_at"), F.when(done, "sent").otherwise("partial").alias("delivery"))


def process_with_retry(reminders: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """The retrying variant: late ones are reported as missed, failures come back up to three times, sent ones complete in time."""
    j = reminders.join(outcomes, "reminder_id", "left")
    due_now = (F.col("status") == "pending") & (F.col("notify_at") <= now)
    late = due_now & (F.col("event_date") < now)
    app, mail = F.col("notification_type").isin(IN_APP), F.col("notification_type").isin(EMAIL)
    good = (app & F.col("in_app_ok")).cast("int") + (mail & F.col("email_ok")).cast("int")
    asked = app.cast("int") + mail.cast("int")
    result = F.when(good >= asked, "sent").when(good > 0, "partially_sent").otherwise("failed")
    again = (result != "sent") & (F.col("retry_count") < RETRIES)
    status = F.when(late, "completed").when(due_now & again, "pending").when(due_now, result).when((F.col("status") == "sent") & (F.col("event_date") < now), "completed").otherwise(F.col("status"))
    tried = due_now & ~late & again
    return j.select(
        "reminder_id", status.alias("status"), F.when(tried, now + F.make_dt_interval(mins=F.lit(RETRY_MINUTES))).otherwise(F.col("notify_at")).alias("notify_at"),
        (F.col("retry_count") + tried.cast("int")).alias("retry_count"), late.alias("missed"),
    )


def upcoming(reminders: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    """Pending reminders by event date, with the days that remain."""
    days = F.datediff(F.to_date("event_date"), F.to_date(now))
    return reminders.filter("status = 'pending'").withColumn("days_remaining", days).orderBy("event_date", "reminder_id").limit(limit)


def recipient(reminders: DataFrame, preferences: DataFrame) -> DataFrame:
    """The preferred address, else the user id if it is one."""
    j = reminders.join(preferences.select("user_id", F.col("email").alias("__email")), "user_id", "left")
    return j.withColumn("email", F.coalesce(tx.blank_to_null("__email"), F.when(F.col("user_id").contains("@"), F.col("user_id")))).drop("__email")


def relative_time(ts: Column, now: Column) -> Column:
    s = F.unix_timestamp(now) - F.unix_timestamp(ts)
    return (
        F.when(s < 60, "just now")
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m ago")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit("d ago")))
    )
