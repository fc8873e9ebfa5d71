"""Ingest, lookup and hook queries over ``documents``, ``orders``, ``embeddings``, ``pages`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import changes as ch
from ..operators import chunking, hooks, ingest, pages, store, telemetry
from ..operators import retrieval as rt
from ..sources.tables import table
from ..streaming import evaluation
from .retrieval import _SPARSE as SPARSE_SQL
from .retrieval import _sparse, _text_queries
from .stores import CHUNKS_SQL, NOW, _history, chunks
from .stores import _CHANGES as HISTORY_SQL
from .views import METRICS_SQL, metrics


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _parts(spark, sf_dir):
    """Page parts of every value type: lines, named values, plain text, questions."""
    lines, kind = F.split("text", "\n"), F.col("doc_id") % 4
    value = F.when(kind == 1, F.to_json(F.struct(F.element_at(lines, 1).alias("first"), F.element_at(lines, -1).alias("last")))).when(kind == 2, F.to_json(F.array("text"))).otherwise(F.to_json(lines))
    parsed = F.parse_json(value)
    value = F.when(kind == 2, F.variant_get(parsed, "$[0]", "variant")).otherwise(parsed)
    heading = F.element_at(F.array(*map(F.lit, ["Lines", "Names", "Text", "Frequently Asked Questions"])), (kind + 1).cast("int"))
    return _docs(spark, sf_dir).select(F.format_string("https://x.example/d-%d", "doc_id").alias("source"), heading.alias("heading"), value.alias("value"))


def _entities(spark, sf_dir):
    return ingest.semantic_entities(_parts(spark, sf_dir))


def semantic_entities(spark, sf_dir):
    return _entities(spark, sf_dir).select("source", "title", "heading", "type", "subcontent", F.md5("content").alias("content_md5"))


def entity_leaves(spark, sf_dir):
    """Sizes, numbers and ids of every entity's leaves."""
    made = ingest.leaves(_entities(spark, sf_dir))
    return made.groupBy("parent_id", "child_id", "type").agg(F.count(F.lit(1)).alias("leaves"), F.countDistinct("grandchild_id").alias("ids"), F.max(F.length("content")).alias("longest"))


def entity_embedding_text(spark, sf_dir):
    d = _docs(spark, sf_dir)
    names = F.array_join(F.transform(F.slice(F.split("text", " "), 1, 4), lambda w: F.concat(F.lit("N"), w)), ",")
    content = F.when(F.col("doc_id") % 2 == 0, names).otherwise(F.col("text"))
    made = ingest.entity_embedding_text(F.col("lang"), F.when(F.col("doc_id") % 3 == 0, F.upper("lang")).otherwise(F.col("source")), F.when(F.col("doc_id") % 5 == 0, "sub").otherwise(""), F.when(F.col("doc_id") % 2 == 0, "list").otherwise("section"), content)
    return d.select("doc_id", F.md5(made).alias("text_md5"))


def leaf_validation(spark, sf_dir):
    d = _docs(spark, sf_dir).select(
        F.format_string("g%d", "doc_id").alias("grandchild_id"), F.when(F.col("doc_id") % 7 > 0, F.col("source")).alias("parent_id"), "source", F.lit("t").alias("title"), F.lit("h").alias("heading"),
        F.lit("section").alias("type"), F.when(F.col("doc_id") % 5 == 0, "  ").otherwise(F.col("text")).alias("content"), F.when(F.col("doc_id") % 3 == 0, "").otherwise("e").alias("embedding_text"),
    )
    return ingest.validated(d).select("grandchild_id", "violation")


def chunk_records(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    made = ingest.chunk_records(lines.withColumn("name", F.concat_ws("/", "source", "doc_id")), "name", "i", "line")
    return made.select("id", "characters", "tokens")


def flat_records(spark, sf_dir):
    p = _docs(spark, sf_dir).select(F.format_string("d%d", "doc_id").alias("parent_id"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), "lang")).otherwise(" ").alias("title"), F.col("text").alias("content"))
    return ingest.flat_records(p, F.split("content", "\n")).select("id", "child_id", "heading", "level", F.md5("content").alias("content_md5"))


def _sections(spark, sf_dir):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), F.concat(F.lit(" h"), (i % 3).cast("string")).alias("heading"), F.parse_json(F.to_json(F.array(x, F.lit(" ")))).alias("value")))
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("page_id"), F.inline(lines))


def structure_preview(spark, sf_dir):
    return ingest.normal_structure(_sections(spark, sf_dir)).select("page_id", "heading", F.size("items").alias("n"), F.md5(F.array_join("items", "|")).alias("items_md5"))


def review_text(spark, sf_dir):
    s = _docs(spark, sf_dir).select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    s = s.select("page_id", "pos", F.concat(F.lit("h"), F.col("pos").cast("string")).alias("heading"), F.array("line").alias("items"))
    return ingest.review_text(s).select("page_id", F.md5("text").alias("text_md5"), F.length("text").alias("n"))


def new_chunks(spark, sf_dir):
    d = _docs(spark, sf_dir)
    known = d.filter("source = 'src1'").select(F.sha2("text", 256).alias("content_hash"))
    return ingest.new_content(d.filter("source <> 'src1'"), known, "text").select("doc_id")


def cross_file_urls(spark, sf_dir):
    return ingest.in_several_files(_docs(spark, sf_dir).select(F.md5("text").alias("url"), "source"), "url", "source").select("url", F.array_join("files", ",").alias("files"))


def positional_zip(spark, sf_dir):
    words = F.split("text", " ")
    scores = F.transform(F.when(F.col("doc_id") % 3 == 0, F.slice(words, 1, 2)).otherwise(words), F.length)
    z = _docs(spark, sf_dir).select("doc_id", ingest.zipped(words, scores).alias("z"))
    return z.select("doc_id", F.col("z").isNotNull().alias("whole"), F.aggregate("z", F.lit(0), lambda a, x: a + x["score"]).alias("total"))


def signal_silence(spark, sf_dir):
    scaled = F.transform("embedding", lambda x: F.round(x * 1000).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", telemetry.silent(scaled, 95.0).alias("silent"), F.round(telemetry.root_mean_square(scaled), 6).alias("rms"))


def point_lookup(spark, sf_dir):
    return ingest.find_one(table(spark, sf_dir, "orders"), F.col("o_custkey") == 7, "o_orderkey").select("o_orderkey", "o_custkey", "o_orderstatus")


def history_by_url(spark, sf_dir):
    return _history(spark, sf_dir).filter("url = 'https://x.example/d/42'").select("url", "content_hash", "status")


def history_ordered(spark, sf_dir):
    rows = _history(spark, sf_dir).filter("source = 'src2'")
    return ingest.placed(rows, F.desc("last_scraped"), F.col("url")).select("place", "url", "scrape_count")


def history_chunk_ids(spark, sf_dir):
    return _history(spark, sf_dir).filter("url = 'https://x.example/d/44'").select(F.explode("chunk_ids").alias("chunk_id"))


def ingestion_history(spark, sf_dir):
    return ingest.recent(table(spark, sf_dir, "events"), "ts", "event_id", 900).select("event_id", "event_type")


def notification_lists(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    shown = e.filter(ingest.differs(F.col("event_type"), "error")).orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", F.lit("stack").alias("list"))
    return shown.union(e.filter("event_type = 'signup'").orderBy("ts", "event_id").limit(20).select("event_id", F.lit("popup").alias("list")))


def sorted_ids(spark, sf_dir):
    first = chunks(spark, sf_dir).select("parent_id").filter("parent_id is not null").distinct().orderBy("parent_id").limit(100)
    return first.agg(F.array_join(F.array_sort(F.collect_list("parent_id")), ",").alias("ids"))


def targets_by_tier(spark, sf_dir):
    """Pages as a registry of targets: their hosts as sources, every third one on the fast tier."""
    schedule = F.when(F.col("page_id") % 3 == 0, "fast").otherwise("slow")
    registry = table(spark, sf_dir, "pages").select("url", F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("source"), F.lit("page").alias("category"), schedule.alias("schedule"))
    return ingest.targets_of(registry, "fast").select("url", "source")


def robots_gate(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = p.select(F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host")).distinct().filter(F.length("host") % 2 == 0).withColumn("disallow", F.array(F.lit("/de"), F.lit("")))
    return ingest.robots_allowed(p, rules).select("page_id", "allowed")


def substring_blocklist(spark, sf_dir):
    return _docs(spark, sf_dir).filter(~ingest.contains_any(F.col("text"), ["LICENSE", "Re", "und "])).select("doc_id")


def faq_pairs(spark, sf_dir):
    """Headings as questions, the next paragraph as the answer."""
    blocks = pages.page_blocks(table(spark, sf_dir, "pages")).withColumn("cls", F.when(F.col("tag").rlike("^h[1-6]$"), "title").when(F.col("tag") == "p", "content").otherwise(""))
    return pages.faq_pairs(blocks).select("page_id", "q_pos", F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"))


def upsert_rows(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "lang", "source")
    changed = d.filter("doc_id % 3 = 0").select((F.col("doc_id") + 5).alias("doc_id"), F.upper("lang").alias("lang"), F.lit("changed").alias("source"))
    return store.upsert(d, changed, ["doc_id"], ["source"])


def insert_absent_rows(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "lang")
    return store.insert_absent(d.filter("doc_id % 2 = 0"), d.withColumn("lang", F.upper("lang")), ["doc_id"])


def consume_states(spark, sf_dir):
    states = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("expires_at"), "event_type")
    taken, left = store.consume_once(states, F.col("event_type") == "signup", F.to_timestamp(F.lit("2024-01-10 00:00:00")))
    return taken.agg(F.lit("taken").alias("part"), F.count(F.lit(1)).alias("n")).union(left.agg(F.lit("left"), F.count(F.lit(1))))


def snapshot_merge(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.format_string("u%d", "doc_id").alias("url"), F.split("text", "\n").alias("items"), "doc_id")
    old, new = d.filter("doc_id % 2 = 0"), d.filter("doc_id % 3 = 0").withColumn("items", F.when(F.col("doc_id") % 9 > 0, F.array("url")).otherwise(F.array().cast("array<string>")))
    return ch.merge_snapshots(old, new).select("url", F.md5(F.array_join("items", "|")).alias("items_md5"))


def latest_rows(spark, sf_dir):
    return ch.latest_by(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("at")), "user_id", "at").select("user_id", "event_id", "event_type")


def section_paths(spark, sf_dir):
    path = tx.section_path(F.concat_ws(" > ", "source", F.lit(" "), "lang"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(chunking.content_template(F.element_at(path, 1), path, F.col("text"))).alias("content_md5"), F.md5(chunking.embedding_text("query", rt.search_text(F.when(F.col("doc_id") % 2 == 0, " ").otherwise(F.col("lang")), F.col("text")))).alias("query_md5"))


def lexical_rerank(spark, sf_dir):
    hits = rt.with_columns_of(_sparse(spark, sf_dir, 20).select("query_id", "doc_id", "rank"), _docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    scored = hooks.rerank(hits.join(_text_queries(spark, sf_dir).withColumnRenamed("text", "question"), "query_id"), "question", "text")
    return rt.rerank_filter(scored).select("query_id", "doc_id", "position", "score", "docs_kept")


def evaluator_run(spark, sf_dir):
    m = metrics(spark, sf_dir)
    done = m.filter("id % 3 = 0").select("id")
    judge = {"faithfulness": F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).otherwise((F.col("total_ms") % 100) / 100.0), "answer_relevancy": (F.col("id") % 10) / 10.0}
    return evaluation.evaluate_once(m, done, judge, F.to_timestamp(F.lit(NOW)))[0]


def retry_queue(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("requested_at"), F.when(F.col("event_type") != "view", F.col("event_type") == "error").alias("retry"))
    return evaluation.retry_due(e).select("id")


def interval_schedule(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    plans = o.select(F.col("o_orderkey").alias("name"), F.when(F.col("o_orderkey") % 2 == 0, 30).otherwise(360).alias("minutes"), F.when(F.col("o_orderkey") % 5 > 0, F.to_timestamp(F.lit("2024-01-31 20:00:00"))).alias("last_run"), (F.col("o_orderkey") % 7 == 0).alias("running"))
    return evaluation.interval_due(plans, F.to_timestamp(F.lit(NOW))).select("name")


def activity_sessions(spark, sf_dir):
    found = evaluation.sessions(table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), gap="6 hours")
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


QUERIES = {
    f.__name__: f
    for f in (
        semantic_entities, entity_leaves, entity_embedding_text, leaf_validation, chunk_records, flat_records, structure_preview, review_text, new_chunks, cross_file_urls, positional_zip, signal_silence,
        point_lookup, history_by_url, history_ordered, history_chunk_ids, ingestion_history, notification_lists, sorted_ids, targets_by_tier, robots_gate, substring_blocklist, faq_pairs, upsert_rows,
        insert_absent_rows, consume_states, snapshot_merge, latest_rows, section_paths, lexical_rerank, evaluator_run, retry_queue, interval_schedule, activity_sessions,
    )
}

_WORDS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_NL = "chr(10)"
_ENT = rf"""
d AS (SELECT doc_id, 'https://x.example/d-' || doc_id AS source, 'D ' || doc_id AS title, text, string_split(text, {_NL}) AS l FROM documents),
ent AS (SELECT source, title, 'Lines' AS heading, 'section' AS type, NULL AS subcontent, text || {_NL} AS content FROM d WHERE doc_id % 4 = 0
  UNION ALL SELECT source, title, 'Names', 'section', 'first', l[1] FROM d WHERE doc_id % 4 = 1 UNION ALL SELECT source, title, 'Names', 'section', 'last', l[-1] FROM d WHERE doc_id % 4 = 1
  UNION ALL SELECT source, title, 'Names list', 'list', 'all names', 'first, last' FROM d WHERE doc_id % 4 = 1
  UNION ALL SELECT source, title, 'Text', 'section', NULL, text FROM d WHERE doc_id % 4 = 2
  UNION ALL SELECT source, title, 'Frequently Asked Questions', 'faq', NULL, unnest(l) FROM d WHERE doc_id % 4 = 3)"""
_EMB = r"""
e AS (SELECT doc_id, lang AS title, CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE source END AS heading, CASE WHEN doc_id % 5 = 0 THEN 'sub' END AS sub, doc_id % 2 = 0 AS list,
  CASE WHEN doc_id % 2 = 0 THEN array_to_string(list_transform(string_split(text, ' ')[1:4], lambda w: 'N' || w), ',') ELSE text END AS content FROM documents),
n AS (SELECT *, list_filter(list_transform(string_split(content, ','), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS i FROM e),
m AS (SELECT *, list AND len(i) >= 3 AND len(list_filter(i, lambda x: regexp_matches(x, '^\p{Lu}'))) >= len(i) * 0.7
  AND len(list_filter(i, lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) <= 6)) >= len(i) * 0.8 AS names FROM n)"""

ORACLE = {
    "semantic_entities": f"WITH {_ENT} SELECT source, title, heading, type, subcontent, md5(content) AS content_md5 FROM ent",
    "entity_embedding_text": rf"""
WITH {_EMB} SELECT doc_id, md5(CASE WHEN names THEN CASE WHEN lower(title) <> lower(heading) THEN title || ' — ' || heading ELSE heading END || ' — full list of names in this category: ' || content
  ELSE CASE WHEN lower(title) = lower(heading) THEN title ELSE title || ' — ' || heading END || CASE WHEN sub IS NOT NULL THEN ' — sub' ELSE '' END || {_NL} || {_NL} || content END) AS text_md5 FROM m""",
    "leaf_validation": r"""
SELECT 'g' || doc_id AS grandchild_id, CASE WHEN doc_id % 7 = 0 THEN 'missing parent_id' WHEN doc_id % 5 = 0 OR regexp_replace(text, '\s', '', 'g') = '' THEN 'empty content' WHEN doc_id % 3 = 0 THEN 'empty embedding_text' END AS violation FROM documents""",
    "chunk_records": rf"""
WITH l AS (SELECT source || '/' || doc_id AS s, string_split(text, {_NL}) AS l FROM documents), x AS (SELECT s, unnest(range(len(l))) AS i, unnest(l) AS line FROM l)
SELECT printf('%s#chunk_%04d', s, i) AS id, CAST(length(line) AS INTEGER) AS characters, CAST(len(list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '')) AS INTEGER) AS tokens FROM x""",
    "flat_records": f"""
WITH p AS (SELECT 'd' || doc_id AS p, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'Document' END AS heading, text, string_split(text, {_NL}) AS l FROM documents)
SELECT p || '::gc::' || unnest(range(len(l))) AS id, p || '::child::0' AS child_id, heading, 'grandchild' AS level, md5(unnest(l)) AS content_md5 FROM p
UNION ALL SELECT p || '::child::0', NULL, heading, 'child', md5(text) FROM p""",
    "structure_preview": rf"""
WITH l AS (SELECT doc_id, string_split(text, {_NL}) AS l FROM documents), x AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM l),
c AS (SELECT doc_id, 'h' || (pos % 3) AS heading, pos, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM x)
SELECT doc_id AS page_id, heading, 1 AS n, md5(arg_max(line, pos)) AS items_md5 FROM c WHERE line <> '' GROUP BY doc_id, heading""",
    "review_text": rf"""
WITH l AS (SELECT doc_id, string_split(text, {_NL}) AS l FROM documents), x AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM l),
t AS (SELECT doc_id, substr(regexp_replace(string_agg('## h' || pos || {_NL} || '- ' || line || {_NL}, {_NL} ORDER BY pos), '^\s+|\s+$', '', 'g'), 1, 60000) AS t FROM x GROUP BY doc_id)
SELECT doc_id AS page_id, md5(t) AS text_md5, CAST(length(t) AS INTEGER) AS n FROM t""",
    "new_chunks": "SELECT doc_id FROM documents WHERE source <> 'src1' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src1' AND text IS NOT NULL)",
    "cross_file_urls": "SELECT md5(text) AS url, string_agg(DISTINCT source, ',' ORDER BY source) AS files FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1",
    "positional_zip": """
WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), k AS (SELECT *, doc_id % 3 > 0 OR len(w) <= 2 AS whole FROM w)
SELECT doc_id, whole, CASE WHEN whole THEN CAST(list_sum(list_transform(w, lambda x: length(x))) AS INTEGER) END AS total FROM k""",
    "signal_silence": """
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS s FROM embeddings)
SELECT vec_id, list_sum(list_transform(s, lambda x: abs(x))) / CAST(len(s) AS DOUBLE) < 95 AS silent, round(sqrt(list_sum(list_transform(s, lambda x: x * x)) / CAST(len(s) AS DOUBLE)), 6) AS rms FROM s""",
    "point_lookup": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey = 7 ORDER BY o_orderkey LIMIT 1",
    "history_by_url": f"WITH {HISTORY_SQL} SELECT url, content_hash, status FROM hist WHERE url = 'https://x.example/d/42'",
    "history_ordered": f"WITH {HISTORY_SQL} SELECT CAST(row_number() OVER (ORDER BY last_scraped DESC, url) AS INTEGER) AS place, url, CAST(scrape_count AS INTEGER) AS scrape_count FROM hist WHERE source = 'src2'",
    "history_chunk_ids": "SELECT 'https://x.example/d/44#' || unnest(range(doc_id % 3 + 1)) AS chunk_id FROM documents WHERE doc_id = 44",
    "ingestion_history": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500",
    "notification_lists": """
SELECT event_id, 'stack' AS list FROM (SELECT event_id FROM events WHERE event_type IS DISTINCT FROM 'error' ORDER BY ts DESC, event_id DESC LIMIT 100)
UNION ALL SELECT event_id, 'popup' FROM (SELECT event_id FROM events WHERE event_type = 'signup' ORDER BY ts, event_id LIMIT 20)""",
    "sorted_ids": f"WITH {CHUNKS_SQL}, p AS (SELECT DISTINCT parent_id FROM chunks ORDER BY parent_id LIMIT 100) SELECT string_agg(parent_id, ',' ORDER BY parent_id) AS ids FROM p",
    "targets_by_tier": "SELECT url, min(lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]*)', 1))) AS source FROM pages WHERE page_id % 3 = 0 GROUP BY url",
    "robots_gate": r"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]*)', 1)) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, NOT (length(host) % 2 = 0 AND starts_with(path, '/de')) AS allowed FROM p""",
    "substring_blocklist": "SELECT doc_id FROM documents WHERE NOT (contains(lower(text), 'license') OR contains(lower(text), 're') OR contains(lower(text), 'und '))",
    "upsert_rows": """
WITH c AS (SELECT doc_id + 5 AS doc_id, upper(lang) AS lang FROM documents WHERE doc_id % 3 = 0)
SELECT coalesce(d.doc_id, c.doc_id) AS doc_id, coalesce(c.lang, d.lang) AS lang, coalesce(d.source, 'changed') AS source FROM documents d FULL JOIN c ON d.doc_id = c.doc_id""",
    "insert_absent_rows": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE upper(lang) END AS lang FROM documents",
    "consume_states": """
WITH t AS (SELECT event_type = 'signup' AND ts > TIMESTAMP '2024-01-10' AS t FROM events)
SELECT 'taken' AS part, count(*) FILTER (t) AS n FROM t UNION ALL SELECT 'left', count(*) FILTER (NOT t) FROM t""",
    "snapshot_merge": f"""
WITH m AS (SELECT 'u' || doc_id AS url, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'u' || doc_id ELSE replace(text, {_NL}, '|') END AS t FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0)
SELECT url, md5(t) AS items_md5 FROM m WHERE t IS NOT NULL""",
    "latest_rows": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "section_paths": f"""
SELECT doc_id, md5('Heading: ' || source || {_NL} || 'Subheading: ' || source || ' > ' || lang || {_NL} || 'Content:' || {_NL} || text) AS content_md5,
  md5('query: ' || CASE WHEN doc_id % 2 = 0 THEN text ELSE lang END) AS query_md5 FROM documents""",
    "lexical_rerank": f"""
WITH {SPARSE_SQL}, q AS (SELECT item_id AS query_id, list_distinct({_WORDS.format('text')}) AS q FROM benchmark), t AS (SELECT doc_id, list_distinct({_WORDS.format('text')}) AS t FROM documents),
s2 AS (SELECT query_id, doc_id, rank, CASE WHEN len(q) = 0 THEN 0 ELSE round(len(list_intersect(q, t)) / CAST(len(q) AS DOUBLE), 6) END AS score FROM sparse JOIN q USING (query_id) JOIN t USING (doc_id) WHERE rank <= 20),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS position, max(score) OVER (PARTITION BY query_id) AS top FROM s2),
a AS (SELECT *, count(*) FILTER (score >= greatest(CAST(0.2 AS DOUBLE), top - CAST(0.12 AS DOUBLE))) OVER (PARTITION BY query_id) AS above FROM p),
k AS (SELECT * FROM a WHERE position <= least(8, greatest(above, 3)))
SELECT query_id, doc_id, CAST(position AS INTEGER) AS position, score, count(*) OVER (PARTITION BY query_id) AS docs_kept FROM k""",
    "evaluator_run": f"""
WITH {METRICS_SQL}, c AS (SELECT * FROM metrics WHERE list_contains(sources, 'qdrant') AND error IS NULL AND id % 3 <> 0 ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT 100)
SELECT id, CASE WHEN id % 5 <> 0 THEN (total_ms % 100) / CAST(100 AS DOUBLE) END AS faithfulness, (id % 10) / CAST(10 AS DOUBLE) AS answer_relevancy FROM c""",
    "retry_queue": "SELECT event_id AS id FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 100",
    "interval_schedule": """
SELECT o_orderkey AS name FROM orders WHERE o_orderkey % 7 <> 0 AND (o_orderkey % 5 = 0 OR TIMESTAMP '2024-01-31 20:00:00' + to_minutes(CASE WHEN o_orderkey % 2 = 0 THEN 30 ELSE 360 END) <= TIMESTAMP '2024-02-01 00:00:00')""",
    "activity_sessions": """
WITH g AS (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new, ts FROM events),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id""",
}
