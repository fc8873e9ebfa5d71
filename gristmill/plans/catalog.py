"""All registered queries and their oracle SQL, merged from the topic modules."""

from __future__ import annotations

from . import bucketed, chat, corpus, ingest, markdown, reminders, retrieval, stores, telemetry, texts, values

_TOPICS = (telemetry, texts, stores, retrieval, chat, reminders, corpus, ingest, markdown, bucketed, values)


def queries() -> dict:
    return {name: fn for topic in _TOPICS for name, fn in topic.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for topic in _TOPICS for name, sql in topic.ORACLE.items()}
