"""Chat transforms: history windows, routing decisions, response parsing, entity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# Turns kept with and without a summary, turns and characters given to the router.
WITH_SUMMARY, WITHOUT_SUMMARY, ROUTER_TURNS, ROUTER_CHARS = 6, 12, 6, 3000

# Words that mark each kind of question about the assistant itself, first match wins.
META_WORDS = [
    ("language", ["language", "speak", "talk", "understand"]),
    ("help", ["what can you do", "help", "capabilities"]),
    ("identity", ["who are you", "what are you", "about you"]),
    ("domains", ["what questions can i ask", "what can i ask", "domains"]),
]

# Routing sources in the order in which they decide.
ROUTE_ORDER = ["clarify", "meta", "greeting", "irrelevant", "qdrant", "reminder"]
ROUTABLE = ["qdrant", "reminder", "meta", "greeting"]

ANSWER_SCHEMA = "struct<answer:string,entities:array<struct<name:string,type:string,date:string>>,actions:array<struct<type:string,entity:string>>>"


def recent_messages(messages: DataFrame, has_summary: Column, chat: str = "chat_id", seq: str = "seq") -> DataFrame:
    """The last turns of each chat (fewer with a summary), blank ones dropped after the limit, oldest first."""
    order = Window.partitionBy(chat).orderBy(F.desc(seq))
    limit = F.when(has_summary, WITH_SUMMARY).otherwise(WITHOUT_SUMMARY)
    kept = messages.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= WITHOUT_SUMMARY).filter(F.col("__n") <= limit)
    return kept.filter(tx.strip("content") != "").withColumn("position", F.row_number().over(Window.partitionBy(chat).orderBy(seq))).drop("__n")


# Fixed value: messages of a chat that are listed.
LISTED = 100


def first_messages(messages: DataFrame, chat: str = "chat_id", seq: str = "seq", limit: int = LISTED) -> DataFrame:
    """The first messages of each chat in their own order, with their place."""
    order = Window.partitionBy(chat).orderBy(seq)
    return messages.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def router_history(messages: DataFrame, chat: str = "chat_id", seq: str = "seq") -> DataFrame:
    """``ROLE: content`` lines of each chat's last turns, cut to the last characters."""
    order = Window.partitionBy(chat).orderBy(F.desc(seq))
    kept = messages.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= ROUTER_TURNS)
    lines = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.concat(F.upper("role"), F.lit(": "), F.col("content")).alias("line"))))
    joined = kept.groupBy(chat).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("history"))
    return joined.withColumn("history", F.when(F.length("history") > ROUTER_CHARS, F.substring("history", -ROUTER_CHARS, ROUTER_CHARS)).otherwise(F.col("history")))


def meta_intent(question: Column) -> Column:
    q = F.lower(question)
    out = F.lit("general")
    for name, words in reversed(META_WORDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | q.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def route(sources: Column) -> Column:
    """The branch that the chosen sources lead to; retrieval wins over reminders and is the fallback."""
    out = F.lit("qdrant")
    for s in reversed(ROUTE_ORDER):
        out = F.when(F.array_contains(sources, s), F.lit(s)).otherwise(out)
    both = F.array_contains(sources, "qdrant") & F.array_contains(sources, "reminder")
    return F.when((out == "qdrant") & both, "qdrant+reminder").otherwise(out)


def valid_sources(sources: Column) -> Column:
    """Non-empty, known and without repeats."""
    known = F.forall(sources, lambda s: s.isin(*ROUTABLE))
    return F.coalesce((F.size(sources) > 0) & known & (F.size(F.array_distinct(sources)) == F.size(sources)), F.lit(False))


def router_result(first: Column, second: Column) -> Column:
    """The first valid of two router attempts, else retrieval."""
    return F.when(valid_sources(first), first).when(valid_sources(second), second).otherwise(F.array(F.lit("qdrant")))


def parse_responses(rows: DataFrame, raw: str, out: str = "parsed") -> DataFrame:
    """A struct column: answer, entities, actions of a model's reply and where they were found (whole, braces or text).

    Thinking goes first (all of it from an unclosed mark on), then a fenced object takes the reply's place. An object counts if it
    has an answer, even a null one; without any, what is left of the reply is the answer. Missing lists read as empty.
    The steps are columns of their own, so each is evaluated once.
    """
    t, closed = F.col("__t"), "(?s)<think>.*?</think>"
    rows = rows.withColumn("__t", tx.strip(raw))
    rows = rows.withColumn("__t", F.when(t.contains("<think>"), tx.strip(F.substring_index(tx.strip(F.regexp_replace(t, closed, "")), "<think>", 1))).otherwise(t))
    rows = rows.withColumn("__f", F.when(t.contains("```"), tx.strip(F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1))))
    rows = rows.withColumn("__t", F.coalesce(tx.blank_to_null("__f"), t)).withColumn("__b", tx.blank_to_null(F.regexp_extract(t, r"(?s)\{.*\}", 0)))
    for name, source in (("__w", t), ("__i", F.col("__b"))):
        alone = F.json_array_length(F.concat(F.lit("["), source, F.lit("]"))) == 1  # valid, and nothing behind it
        keys = F.when(alone & source.startswith("{"), F.json_object_keys(source))
        rows = rows.withColumn(name, F.array_contains(keys, "answer"))
        if name == "__w":
            rows = rows.withColumn("__w", F.coalesce("__w", F.lit(False)))
    inside = ~F.col("__w") & F.coalesce("__i", F.lit(False))
    rows = rows.withColumn("__j", F.when(F.col("__w"), t).when(inside, F.col("__b"))).withColumn("__p", F.from_json("__j", ANSWER_SCHEMA)).withColumn("__k", F.json_object_keys("__j"))
    empty = F.from_json(F.lit('{"answer":"","entities":[],"actions":[]}'), ANSWER_SCHEMA)
    lists = [F.when(F.coalesce(F.array_contains("__k", c), F.lit(False)), F.col("__p")[c]).otherwise(empty[c]).alias(c) for c in ("entities", "actions")]
    parsed = F.struct(
        F.when(F.col("__j").isNull(), t).otherwise(F.col("__p.answer")).alias("answer"), *lists, F.when(F.col("__w"), "whole").when(inside, "braces").otherwise("text").alias("form")
    )
    return rows.withColumn(out, parsed).drop("__t", "__f", "__b", "__w", "__i", "__j", "__p", "__k")


def unwrap_answer(answer: Column) -> Column:
    """The inner answer where a model put a JSON object with one into its answer."""
    inner = F.get_json_object(answer, "$.answer")
    return F.coalesce(F.when(tx.strip(answer).startswith("{"), inner), answer)


# Names of languages and what they stand for.
LANGUAGE_ALIASES = {"english": "en", "tamil": "ta", "hindi": "hi", "telugu": "te", "kannada": "kn", "malayalam": "ml"}


def language_code(name: Column, text: Column, default: str = "en") -> Column:
    """A two-letter code from a model's language name or code; the script of the text overrides it, unknown ones are the default."""
    given = F.lower(tx.strip(name))
    alias = F.create_map(*(F.lit(x) for pair in LANGUAGE_ALIASES.items() for x in pair))
    known = F.when(given.isin(*LANGUAGE_ALIASES.values()), given).otherwise(F.try_element_at(alias, given))
    script = tx.script_language(text)
    return F.when(script != "en", script).otherwise(F.coalesce(known, F.lit(default)))


def normal_sources(sources: Column) -> Column:
    """Trimmed, lower-cased, without blanks."""
    return F.filter(F.transform(sources, lambda s: F.lower(tx.strip(s))), lambda s: s != "")


def dump_ids(ids: Column) -> Column:
    """An id list as JSON text."""
    return F.to_json(F.coalesce(ids, F.array().cast("array<string>")))


def load_ids(text: Column) -> Column:
    """JSON text as an id list; whatever is no list reads as empty."""
    return F.coalesce(F.when(F.trim(text).startswith("["), F.from_json(text, "array<string>")), F.array().cast("array<string>"))


def entity_key(name: Column) -> Column:
    """Names match without case, punctuation and spacing."""
    return tx.collapse(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}\s]", ""))


def reminder_entities(rows: DataFrame, now: Column, key: str, entities: str = "entities", actions: str = "actions") -> DataFrame:
    """Future entities (name, type, date) of each row with a set_reminder action of the same name, in entity order."""
    e = rows.select(key, F.posexplode(entities).alias("pos", "e"), F.col(actions).alias("a"))
    when = F.try_to_timestamp(F.col("e.date"))
    names = F.transform(F.filter("a", lambda a: a["type"] == "set_reminder"), lambda a: entity_key(a["entity"]))
    kept = e.filter(when.isNotNull() & (when > now) & F.array_contains(names, entity_key(F.col("e.name"))))
    return kept.select(key, "pos", F.col("e.name").alias("name"), F.col("e.type").alias("type"), when.alias("event_at"))


def with_memo(rows: DataFrame, inputs: list[str], out: str, model: Column) -> DataFrame:
    """A costly column computed once for each distinct input and joined back."""
    memo = rows.select(*inputs).distinct().withColumn(out, model)
    return rows.join(memo, inputs, "left")
