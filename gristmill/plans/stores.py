"""Store-consistency and change-detection queries over ``documents``, ``labels``, ``lineitem``, ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as ch
from ..operators import store
from ..sources.tables import table

NOW = "2024-02-01 00:00:00"


def chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    level = F.when(F.col("doc_id") % 4 == 0, "grandchild").when(F.col("doc_id") % 4 == 1, "child").when(F.col("doc_id") % 4 == 2, "flat")
    return d.select(
        F.format_string("c%08d", "doc_id").alias("chunk_id"), F.concat_ws("/", "source", "lang").alias("parent_id"), level.alias("level"),
        "source", "lang", (F.col("doc_id") % 37).cast("string").alias("child_id"), F.col("text").alias("content"), "doc_id",
    )


CHUNKS_SQL = """
chunks AS (SELECT printf('c%08d', doc_id) AS chunk_id, source || '/' || lang AS parent_id,
  CASE doc_id % 4 WHEN 0 THEN 'grandchild' WHEN 1 THEN 'child' WHEN 2 THEN 'flat' END AS level, source, lang,
  CAST(doc_id % 37 AS VARCHAR) AS child_id, text AS content, doc_id FROM documents)"""


def parents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    known = d.filter(F.col("source") != "src3").select(F.concat_ws("/", "source", "lang").alias("parent_id")).distinct()
    return known.union(spark.createDataFrame([("gone/xx",)], "parent_id string"))


PARENTS_SQL = """
parents AS (SELECT DISTINCT source || '/' || lang AS parent_id FROM documents WHERE source <> 'src3' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
  UNION ALL SELECT 'gone/xx')"""


def vectordb_stats(spark, sf_dir):
    return store.counters(chunks(spark, sf_dir), ["level", "source", "lang"])


def vectordb_sources(spark, sf_dir):
    return store.by_parent(chunks(spark, sf_dir), parents(spark, sf_dir), limit=50)


def vectordb_orphans(spark, sf_dir):
    return store.orphans(chunks(spark, sf_dir), parents(spark, sf_dir))


def vectordb_matched(spark, sf_dir):
    return store.shared_keys(chunks(spark, sf_dir), parents(spark, sf_dir)).agg(F.count(F.lit(1)).alias("matched"))


def vectordb_duplicates(spark, sf_dir):
    return store.duplicates(chunks(spark, sf_dir), "child_id")


def point_preview(spark, sf_dir):
    return store.preview(chunks(spark, sf_dir), F.lit("src1/en"), "parent_id", "content")


def ref_integrity(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    return store.dangling(items, "l_orderkey", orders, "o_orderkey").agg(F.count(F.lit(1)).alias("dangling"), F.countDistinct("l_orderkey").alias("orders"))


def stale_delete_counts(spark, sf_dir):
    gone = store.orphans(chunks(spark, sf_dir), parents(spark, sf_dir)).filter("side = 'chunks'")
    return store.purge_counts(chunks(spark, sf_dir), gone)


def purge(spark, sf_dir):
    gone = store.orphans(chunks(spark, sf_dir), parents(spark, sf_dir)).filter("side = 'chunks'")
    left = store.delete_matching(chunks(spark, sf_dir), gone, ["parent_id"])
    return left.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"))


def _url(c="doc_id"):
    return F.format_string("https://x.example/d/%d", c)


def _history(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.col("doc_id") % 5 != 0)
    return d.select(
        _url().alias("url"), F.sha2("text", 256).alias("content_hash"), F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("last_scraped"),
        F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("last_changed"), F.lit(1).alias("scrape_count"),
        F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int")), lambda i: F.concat_ws("#", _url(), i.cast("string"))).alias("chunk_ids"),
        "source", F.col("lang").alias("category"), F.when(F.col("doc_id") % 17 == 0, "error").otherwise("ok").alias("status"),
    )


def _fetched(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.col("doc_id") % 11 != 0)
    return d.select(_url().alias("url"), F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")).alias("content"), "source", "lang", "doc_id")


def _changes(spark, sf_dir):
    return ch.detect(_fetched(spark, sf_dir), _history(spark, sf_dir))


def change_detect(spark, sf_dir):
    return _changes(spark, sf_dir).select("url", "change", F.size("stale_chunk_ids").alias("stale"))


def change_run_stats(spark, sf_dir):
    outcome = _changes(spark, sf_dir).select(F.col("change").alias("outcome"), F.when(F.col("change") != "unchanged", 2).otherwise(0).alias("chunks_added"), "stale_chunk_ids")
    return ch.run_stats(outcome)


def page_history_upsert(spark, sf_dir):
    found = _changes(spark, sf_dir).join(_fetched(spark, sf_dir).select("url", "source", F.col("lang").alias("category")), "url")
    found = found.withColumn("chunk_ids", F.array(F.concat_ws("#", "url", F.lit("n"))))
    after = ch.apply(_history(spark, sf_dir), found, F.to_timestamp(F.lit(NOW)))
    failed = table(spark, sf_dir, "documents").filter(F.col("doc_id") % 55 == 0).select(_url().alias("url"), "source", F.col("lang").alias("category"))
    after = ch.mark_errors(after, failed, F.to_timestamp(F.lit(NOW)))
    shown = [F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("last_scraped", "last_changed")]
    return after.select("url", "content_hash", *shown, "scrape_count", F.size("chunk_ids").alias("chunks"), "source", "category", "status")


def history_scans(spark, sf_dir):
    h = _history(spark, sf_dir)
    return h.filter("status <> 'ok'").orderBy(F.desc("last_scraped"), "url").select("url", "status")


QUERIES = {
    f.__name__: f
    for f in (
        vectordb_stats, vectordb_sources, vectordb_orphans, vectordb_matched, vectordb_duplicates, point_preview, ref_integrity,
        stale_delete_counts, purge, change_detect, change_run_stats, page_history_upsert, history_scans,
    )
}

_BASE = f"{CHUNKS_SQL}, {PARENTS_SQL}"
_GONE = "gone AS (SELECT DISTINCT parent_id FROM chunks WHERE parent_id NOT IN (SELECT parent_id FROM parents))"
_CHANGES = """
hist AS (SELECT 'https://x.example/d/' || doc_id AS url, sha256(text) AS content_hash, '2024-01-01' AS last_scraped, '2024-01-01' AS last_changed,
  1 AS scrape_count, doc_id % 3 + 1 AS chunks, source, lang AS category, CASE WHEN doc_id % 17 = 0 THEN 'error' ELSE 'ok' END AS status
  FROM documents WHERE doc_id % 5 <> 0),
got AS (SELECT doc_id, 'https://x.example/d/' || doc_id AS url, sha256(CASE WHEN doc_id % 7 = 0 THEN text || ' edited' ELSE text END) AS content_hash, source, lang
  FROM documents WHERE doc_id % 11 <> 0),
chg AS (SELECT g.url, g.content_hash, g.source, g.lang, CASE WHEN h.url IS NULL THEN 'new' WHEN h.content_hash = g.content_hash THEN 'unchanged' ELSE 'modified' END AS change,
  CASE WHEN h.content_hash <> g.content_hash THEN h.chunks ELSE 0 END AS stale FROM got g LEFT JOIN hist h ON g.url = h.url)"""

ORACLE = {
    "vectordb_stats": f"""
WITH {CHUNKS_SQL}, l AS (SELECT unnest(['level', 'source', 'lang']) AS counter, unnest([coalesce(level, 'unknown'), source, lang]) AS value FROM chunks),
c AS (SELECT counter, value, count(*) AS n FROM l GROUP BY ALL)
SELECT counter, value, n FROM c QUALIFY row_number() OVER (PARTITION BY counter ORDER BY n DESC, value) <= 20""",
    "vectordb_sources": f"""
WITH {_BASE} SELECT parent_id AS parent, count(*) FILTER (level = 'grandchild') AS grandchild, count(*) FILTER (level = 'child') AS child,
  count(*) FILTER (level = 'flat') AS flat, count(*) FILTER (level IS NULL) AS other, count(*) AS total,
  parent_id IN (SELECT parent_id FROM parents) AS has_parent_doc FROM chunks GROUP BY parent_id ORDER BY total DESC, parent LIMIT 50""",
    "vectordb_orphans": f"""WITH {_BASE}, {_GONE} SELECT parent_id, 'chunks' AS side FROM gone
UNION ALL SELECT parent_id, 'parents' FROM parents WHERE parent_id NOT IN (SELECT parent_id FROM chunks)""",
    "vectordb_matched": f"WITH {_BASE} SELECT count(*) AS matched FROM (SELECT parent_id FROM chunks INTERSECT SELECT parent_id FROM parents)",
    "vectordb_duplicates": f"WITH {CHUNKS_SQL} SELECT child_id, count(*) AS n FROM chunks GROUP BY child_id HAVING count(*) > 1",
    "point_preview": f"WITH {CHUNKS_SQL} SELECT chunk_id, substr(content, 1, 200) AS preview FROM chunks WHERE parent_id = 'src1/en' ORDER BY chunk_id LIMIT 1000",
    "ref_integrity": """SELECT count(*) AS dangling, count(DISTINCT l_orderkey) AS orders FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""",
    "stale_delete_counts": f"WITH {_BASE}, {_GONE} SELECT parent_id, count(*) AS removed FROM chunks WHERE level IN ('grandchild', 'child') AND parent_id IN (SELECT parent_id FROM gone) GROUP BY parent_id",
    "purge": f"WITH {_BASE}, {_GONE} SELECT parent_id, count(*) AS n FROM chunks WHERE parent_id NOT IN (SELECT parent_id FROM gone) GROUP BY parent_id",
    "change_detect": f"WITH {_CHANGES} SELECT url, change, CAST(stale AS INTEGER) AS stale FROM chg",
    "change_run_stats": f"""WITH {_CHANGES} SELECT count(*) AS fetched, count(*) FILTER (change = 'new') AS new, count(*) FILTER (change = 'modified') AS changed,
count(*) FILTER (change = 'unchanged') AS unchanged, CAST(0 AS BIGINT) AS failed, CAST(sum(CASE WHEN change <> 'unchanged' THEN 2 ELSE 0 END) AS BIGINT) AS chunks_added, CAST(sum(stale) AS BIGINT) AS chunks_deleted FROM chg""",
    "page_history_upsert": f"""
WITH {_CHANGES}, a AS (SELECT coalesce(h.url, c.url) AS url, CASE WHEN c.change IN ('new', 'modified') THEN c.content_hash ELSE h.content_hash END AS content_hash,
  CASE WHEN c.url IS NOT NULL THEN '2024-02-01' ELSE h.last_scraped END AS last_scraped, CASE WHEN c.change IN ('new', 'modified') THEN '2024-02-01' ELSE h.last_changed END AS last_changed,
  coalesce(h.scrape_count, 0) + CASE WHEN c.url IS NULL THEN 0 ELSE 1 END AS scrape_count, CASE WHEN c.change IN ('new', 'modified') THEN 1 ELSE h.chunks END AS chunks,
  CASE WHEN c.change IN ('new', 'modified') THEN c.source ELSE h.source END AS source, CASE WHEN c.change IN ('new', 'modified') THEN c.lang ELSE h.category END AS category,
  CASE WHEN c.change IN ('new', 'modified') THEN 'ok' ELSE h.status END AS status FROM hist h FULL JOIN chg c ON h.url = c.url),
f AS (SELECT 'https://x.example/d/' || doc_id AS url, source, lang FROM documents WHERE doc_id % 55 = 0)
SELECT coalesce(a.url, f.url) AS url, coalesce(a.content_hash, '') AS content_hash, CASE WHEN f.url IS NOT NULL THEN '2024-02-01' ELSE a.last_scraped END AS last_scraped,
  coalesce(a.last_changed, '2024-02-01') AS last_changed, CAST(coalesce(a.scrape_count, 1) AS INTEGER) AS scrape_count, CAST(coalesce(a.chunks, 0) AS INTEGER) AS chunks,
  coalesce(a.source, f.source) AS source, coalesce(a.category, f.lang) AS category, CASE WHEN f.url IS NOT NULL THEN 'error' ELSE a.status END AS status
FROM a FULL JOIN f ON a.url = f.url""",
    "history_scans": f"WITH {_CHANGES} SELECT url, status FROM hist WHERE status <> 'ok'",
}
