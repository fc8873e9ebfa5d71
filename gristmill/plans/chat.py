"""Chat queries over ``conversations`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chat
from ..sources.tables import table
from .views import MESSAGES_SQL, messages


def recent_history_window(spark, sf_dir):
    rows = chat.recent_messages(messages(spark, sf_dir), F.col("chat_id") % 2 == 0)
    return rows.select("chat_id", "position", "role", F.md5("content").alias("content_md5"))


def router_history(spark, sf_dir):
    return chat.router_history(messages(spark, sf_dir)).select("chat_id", F.md5("history").alias("history_md5"), F.length("history").alias("n"))


def meta_intents(spark, sf_dir):
    asked = F.concat(F.element_at(F.array(*map(F.lit, ["Which Languages do you speak?", "HELP me", "Who are you", "what can i ask", "the fee"])), (F.col("seq") % 5 + 1).cast("int")), F.lit(" "), F.col("content"))
    return messages(spark, sf_dir).select("chat_id", "seq", chat.meta_intent(asked).alias("intent"))


def _sources(spark, sf_dir):
    m = messages(spark, sf_dir)
    names = F.array(*map(F.lit, ["qdrant", "reminder", "meta", "greeting", "bogus"]))
    picks = lambda a, b: F.array_compact(F.array(F.try_element_at(names, ((F.col("chat_id") + a) % 6 + 1).cast("int")), F.try_element_at(names, ((F.col("seq") + b) % 6 + 1).cast("int"))))
    return m.select("chat_id", "seq", chat.router_result(picks(0, 0), picks(1, 2)).alias("sources"))


def routing_decision(spark, sf_dir):
    return _sources(spark, sf_dir).select("chat_id", "seq", F.array_join("sources", ",").alias("sources"), chat.route(F.col("sources")).alias("route"))


def llm_response_parse(spark, sf_dir):
    m = messages(spark, sf_dir)
    body = F.to_json(F.struct(F.col("content").alias("answer")))
    raw = F.when(F.col("seq") % 4 == 0, body).when(F.col("seq") % 4 == 1, F.concat(F.lit("<think>x {</think>```json\n"), body, F.lit("\n```"))).when(F.col("seq") % 4 == 2, F.concat(F.lit("Sure: "), body, F.lit(" done"))).otherwise(F.col("content"))
    parsed = chat.parse_responses(m.withColumn("raw", raw), "raw", "p")
    return parsed.select("chat_id", "seq", F.md5("p.answer").alias("answer_md5"), "p.form")


def entity_action_match(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("Event-"), (F.col("o_orderkey") % 11).cast("string"))
    rows = o.select(
        "o_orderkey",
        F.array(F.struct(name.alias("name"), F.lit("exam").alias("type"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("date"))).alias("entities"),
        F.array(F.struct(F.when(F.col("o_orderkey") % 2 == 0, "set_reminder").otherwise("none").alias("type"), F.lower(F.replace(name, F.lit("-"), F.lit("  "))).alias("entity")), F.struct(F.lit("set_reminder").alias("type"), F.lit("event3").alias("entity"))).alias("actions"),
    )
    found = chat.reminder_entities(rows, F.to_timestamp(F.lit("1996-01-01 00:00:00")), "o_orderkey")
    return found.select("o_orderkey", "name", "type", F.date_format("event_at", "yyyy-MM-dd").alias("event_at"))


def translate_memo(spark, sf_dir):
    rows = messages(spark, sf_dir).select("chat_id", "seq", F.col("content").alias("piece"), F.lit("en").alias("target"))
    return chat.with_memo(rows, ["piece", "target"], "translated", F.concat_ws(":", "target", F.reverse("piece")))


QUERIES = {f.__name__: f for f in (recent_history_window, router_history, meta_intents, routing_decision, llm_response_parse, entity_action_match, translate_memo)}

_PICKS = "list_filter([names[(chat_id + {a}) % 6 + 1], names[(seq + {b}) % 6 + 1]], lambda x: x IS NOT NULL)"
_VALID = "(len({s}) > 0 AND len(list_distinct({s})) = len({s}) AND NOT list_contains({s}, 'bogus'))"

ORACLE = {
    "recent_history_window": rf"""
WITH {MESSAGES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY seq DESC) AS n FROM messages)
SELECT chat_id, CAST(row_number() OVER (PARTITION BY chat_id ORDER BY seq) AS INTEGER) AS position, role, md5(content) AS content_md5 FROM n
WHERE n <= CASE WHEN chat_id % 2 = 0 THEN 6 ELSE 12 END AND regexp_replace(content, '\s', '', 'g') <> ''""",
    "router_history": f"""
WITH {MESSAGES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY seq DESC) AS n FROM messages),
h AS (SELECT chat_id, right(string_agg(upper(role) || ': ' || content, chr(10) ORDER BY seq), 3000) AS h FROM n WHERE n <= 6 GROUP BY chat_id)
SELECT chat_id, md5(h) AS history_md5, CAST(length(h) AS INTEGER) AS n FROM h""",
    "meta_intents": f"""
WITH {MESSAGES_SQL}, q AS (SELECT chat_id, seq, lower(['Which Languages do you speak?', 'HELP me', 'Who are you', 'what can i ask', 'the fee'][seq % 5 + 1] || ' ' || content) AS q FROM messages)
SELECT chat_id, seq, CASE WHEN regexp_matches(q, 'language|speak|talk|understand') THEN 'language' WHEN regexp_matches(q, 'what can you do|help|capabilities') THEN 'help'
  WHEN regexp_matches(q, 'who are you|what are you|about you') THEN 'identity' WHEN regexp_matches(q, 'what questions can i ask|what can i ask|domains') THEN 'domains' ELSE 'general' END AS intent FROM q""",
    "routing_decision": f"""
WITH {MESSAGES_SQL}, m AS (SELECT chat_id, seq, ['qdrant', 'reminder', 'meta', 'greeting', 'bogus'] AS names FROM messages),
p AS (SELECT chat_id, seq, {_PICKS.format(a=0, b=0)} AS f, {_PICKS.format(a=1, b=2)} AS s FROM m),
r AS (SELECT chat_id, seq, CASE WHEN {_VALID.format(s='f')} THEN f WHEN {_VALID.format(s='s')} THEN s ELSE ['qdrant'] END AS src FROM p)
SELECT chat_id, seq, array_to_string(src, ',') AS sources, CASE WHEN list_contains(src, 'meta') THEN 'meta' WHEN list_contains(src, 'greeting') THEN 'greeting'
  WHEN list_contains(src, 'qdrant') AND list_contains(src, 'reminder') THEN 'qdrant+reminder' WHEN list_contains(src, 'qdrant') THEN 'qdrant' ELSE 'reminder' END AS route FROM r""",
    "llm_response_parse": rf"""
WITH {MESSAGES_SQL} SELECT chat_id, seq, md5(CASE WHEN seq % 4 = 3 THEN regexp_replace(content, '^\s+|\s+$', '', 'g') ELSE content END) AS answer_md5,
  CASE seq % 4 WHEN 2 THEN 'braces' WHEN 3 THEN 'text' ELSE 'whole' END AS form FROM messages""",
    "entity_action_match": """
SELECT o_orderkey, 'Event-' || (o_orderkey % 11) AS name, 'exam' AS type, strftime(o_orderdate, '%Y-%m-%d') AS event_at FROM orders
WHERE o_orderdate > TIMESTAMP '1996-01-01 00:00:00' AND o_orderkey % 11 = 3""",
    "translate_memo": f"WITH {MESSAGES_SQL} SELECT chat_id, seq, content AS piece, 'en' AS target, 'en:' || reverse(content) AS translated FROM messages",
}
