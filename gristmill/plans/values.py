"""Values, guards and small stores: dates, offsets, languages, id lists, headings, message lists, JSON files, expiry."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chat, chunking, reminders as rm, store
from ..session import shared_folder
from ..sources import files
from ..sources.tables import table

NOW = "1996-06-15 12:00:00"
FORMS = ["yyyy-MM-dd", "M/d/yyyy", "d MMM yyyy", "MMMM d, yyyy H:mm", "d.M.yyyy"]


def lenient_dates(spark, sf_dir):
    """Order dates written in five ways and one that is no date."""
    texts = [F.date_format("o_orderdate", f) for f in FORMS] + [F.lit("some day")]
    shown = F.element_at(F.array(*texts), (F.col("o_orderkey") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("shown"))
    found = rm.lenient_event_time(F.col("shown"), "Asia/Kolkata")
    return rows.select("o_orderkey", "shown", F.date_format(found, "yyyy-MM-dd HH:mm").alias("at_utc"))


def custom_offsets(spark, sf_dir):
    """Minutes before order dates: named offsets, moments before and after, and an unreadable one."""
    day = F.col("o_orderdate").cast("timestamp")
    offsets = [F.lit("1h"), F.lit("3d"), F.date_format(day - F.expr("INTERVAL 90 MINUTES"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(day + F.expr("INTERVAL 5 MINUTES"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("soon")]
    offset = F.element_at(F.array(*offsets), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", rm.custom_offset_minutes(day, offset).alias("minutes"))


def language_codes(spark, sf_dir):
    names = F.element_at(F.array(*map(F.lit, ["English", " Tamil ", "hi", "klingon"])), (F.col("doc_id") % 4 + 1).cast("int"))
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" தமி"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", chat.language_code(names, text).alias("code"))


def source_lists(spark, sf_dir):
    given = F.array(F.concat(F.lit(" "), F.upper("source")), F.lit("  "), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(chat.normal_sources(given), ",").alias("sources"))


def id_lists(spark, sf_dir):
    """Ids written as JSON text and read again; every fifth text is no list."""
    ids = F.array(F.col("doc_id").cast("string"), F.col("source"))
    text = F.when(F.col("doc_id") % 5 == 0, F.lit("{}")).otherwise(chat.dump_ids(ids))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("dumped"), F.size(chat.load_ids(text)).alias("n"))


def unwrapped_answers(spark, sf_dir):
    """Answers of which every third is an object with an answer of its own."""
    wrapped = F.to_json(F.struct(F.col("text").alias("answer"), F.lit(1).alias("x")))
    answer = F.when(F.col("doc_id") % 3 == 0, wrapped).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(chat.unwrap_answer(answer)).alias("answer_md5"))


def durations(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.duration_text(F.col("o_orderkey") % 3000).alias("shown"))


def passages_by_heading(spark, sf_dir):
    """Lines of every text under the headings that their numbers give; every fourth has none."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    path = F.when(F.col("pos") % 4 == 3, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("part "), (F.col("pos") % 4).cast("string")), F.lit(" "), F.lit("lines")))
    found = chunking.by_heading(rows.withColumn("path", path), "doc_id")
    return found.select("doc_id", "place", "heading", F.size("texts").alias("n"), F.md5(F.array_join("texts", "\n")).alias("texts_md5"))


def listed_messages(spark, sf_dir):
    found = chat.first_messages(table(spark, sf_dir, "conversations").dropDuplicates(["conv_id", "turn"]), "conv_id", "turn")
    return found.select("conv_id", "turn", "place")


def guarded_update(spark, sf_dir):
    """Open orders before a day are closed; nothing else changes."""
    late = (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < F.lit(NOW).cast("timestamp_ntz"))
    return store.update_where(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), late, {"o_orderstatus": F.lit("F")}).select("o_orderkey", "o_orderstatus", "matched")


def unexpired_rows(spark, sf_dir):
    expires = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", expires.alias("expires_at"))
    return store.unexpired(rows, F.lit(NOW).cast("timestamp_ntz")).select("o_orderkey")


def json_files(spark, sf_dir):
    """Documents written as JSON lines and read back with the engine's reader."""
    path = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}"
    files.write_objects(table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang")), path)
    found = spark.read.schema("doc_id long, text string, lang string").json(path)
    return found.select("doc_id", F.md5("text").alias("text_md5"), "lang")


QUERIES = {
    f.__name__: f
    for f in (lenient_dates, custom_offsets, language_codes, source_lists, id_lists, unwrapped_answers, durations, passages_by_heading, listed_messages, guarded_update, unexpired_rows, json_files)
}

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

ORACLE = {
    "lenient_dates": """
WITH s AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS d, o_orderkey % 6 AS k FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%-m/%-d/%Y') WHEN 2 THEN strftime(d, '%-d %b %Y') WHEN 3 THEN strftime(d, '%B %-d, %Y %-H:%M') WHEN 4 THEN strftime(d, '%-d.%-m.%Y') ELSE 'some day' END AS shown,
  CASE WHEN k < 5 THEN strftime(CASE WHEN k = 3 THEN date_trunc('minute', d) ELSE date_trunc('day', d) END - INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M') END AS at_utc FROM s""",
    "custom_offsets": "SELECT o_orderkey, CAST([60, 4320, 90, 0, 1440][o_orderkey % 5 + 1] AS BIGINT) AS minutes FROM orders",
    "language_codes": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'ta' ELSE ['en', 'ta', 'hi', 'en'][doc_id % 4 + 1] END AS code FROM documents",
    "source_lists": "SELECT doc_id, lower(source) || ',' || lang AS sources FROM documents",
    "id_lists": """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '{}' ELSE '["' || doc_id || '","' || source || '"]' END AS dumped, CAST(CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 2 END AS INTEGER) AS n FROM documents""",
    "unwrapped_answers": "SELECT doc_id, md5(text) AS answer_md5 FROM documents",
    "durations": """
WITH m AS (SELECT o_orderkey, o_orderkey % 3000 AS m FROM orders)
SELECT o_orderkey, CASE WHEN m >= 1000 THEN printf('%d.%02d', (m + 5) // 1000, (m + 5) % 1000 // 10) || 's' ELSE m || 'ms' END AS shown FROM m""",
    "passages_by_heading": f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
h AS (SELECT doc_id, pos, CASE WHEN pos % 4 = 3 THEN 'PDF Content' ELSE 'part ' || (pos % 4) || ' > lines' END AS heading, {_STRIP.format("line")} AS t FROM l),
g AS (SELECT doc_id, heading, min(pos) AS first, CAST(count(*) AS INTEGER) AS n, md5(string_agg(t, chr(10) ORDER BY pos)) AS texts_md5 FROM h WHERE t <> '' GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first) AS INTEGER) AS place, heading, n, texts_md5 FROM g""",
    "listed_messages": """
WITH d AS (SELECT DISTINCT conv_id, turn FROM conversations)
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS place FROM d QUALIFY place <= 100""",
    "guarded_update": f"""
WITH m AS (SELECT *, o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '{NOW}' AS matched FROM orders)
SELECT o_orderkey, CASE WHEN matched THEN 'F' ELSE o_orderstatus END AS o_orderstatus, matched FROM m""",
    "unexpired_rows": f"SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 OR o_orderdate >= TIMESTAMP '{NOW}'",
    "json_files": "SELECT doc_id, md5(text) AS text_md5, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang FROM documents",
}
