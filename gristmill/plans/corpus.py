"""Chunking and page queries over ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables
from ..functions import text as tx
from ..functions.html import html_title as html_title_of
from ..functions.urls import crawl_key
from ..operators import chunking, pages as pg
from ..sources.tables import table


def _pages(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.format_string("https://x.example/d/%d", "doc_id").alias("url"), F.col("text").alias("content"), "source", F.when(F.col("doc_id") % 2 == 0, "events").otherwise("law").alias("category"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("Title "), F.col("doc_id").cast("string"))).alias("title"))


def adaptive_chunks(spark, sf_dir):
    made = chunking.adaptive_chunks(_pages(spark, sf_dir), {"src1": "First - {}"})
    return made.select("url", "chunk_index", "total_chunks", "chunk_id", F.length("content").alias("n"))


def chunk_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", chunking.chunk_id(F.format_string("https://x.example/d/%d", "doc_id"), (F.col("doc_id") % 5).cast("int"), F.col("text")).alias("chunk_id"))


def greedy_pack(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", chunking.greedy_pack(F.split("text", "\n")).alias("p"))
    return d.select("doc_id", F.size("p").alias("pieces"), F.array_max(F.transform("p", F.length)).alias("longest"), F.md5(F.array_join("p", "\u001e")).alias("packed_md5"))


def merge_tiny(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", chunking.merge_tiny(F.split("text", "\n")).alias("p"))
    return d.select("doc_id", F.size("p").alias("bodies"), F.md5(F.array_join("p", "\u001e")).alias("merged_md5"))


def _structured(spark, sf_dir):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), F.when(i % 4 == 3, "  ").otherwise(F.concat(F.lit("h"), i.cast("string"))).alias("heading"), F.split(x, r"\. ").alias("items")))
    return table(spark, sf_dir, "documents").select(F.format_string("d%d", "doc_id").alias("url"), lines.alias("sections"))


def hierarchy_children(spark, sf_dir):
    return chunking.hierarchy_children(_structured(spark, sf_dir)).select("child_id", "parent_id", F.md5("content").alias("content_md5"))


def hierarchy_parents(spark, sf_dir):
    made = chunking.hierarchy_parents(chunking.hierarchy_children(_structured(spark, sf_dir)))
    return made.select("parent_id", F.md5("content").alias("content_md5"), "child_count")


def hierarchy_leaves(spark, sf_dir):
    return chunking.hierarchy_leaves(_structured(spark, sf_dir)).groupBy("parent_id").agg(F.count(F.lit(1)).alias("leaves"), F.countDistinct("grandchild_id").alias("ids"))


def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html_title_of("html").alias("title"))


def html_text(spark, sf_dir):
    return pg.page_text(table(spark, sf_dir, "pages")).select("page_id", F.length("text").alias("n"), F.md5("text").alias("text_md5"))


def html_sections(spark, sf_dir):
    return pg.sections(table(spark, sf_dir, "pages")).select("page_id", "heading", "pos", F.size("items").alias("items"))


def flat_sections(spark, sf_dir):
    """Pages by the older layout: three levels of headings, blocked ones by equality, flattened to one text."""
    found = pg.sections(table(spark, sf_dir, "pages"), blocked=["Quick Links"], headings=("h1", "h2", "h3"), equal=True, blocked_lines=("all rights reserved",))
    return pg.flattened(found).select("page_id", F.length("text").alias("n"), F.md5("text").alias("text_md5"))


def crawl_frontier(spark, sf_dir):
    """From every page along its links."""
    p = table(spark, sf_dir, "pages")
    return pg.crawl(pg.link_edges(p), p.select(crawl_key("url").alias("url")), pages=1_000_000)


def crawl_same_host(spark, sf_dir):
    """From the pages with even ids along links that stay on their host and lead to no junk."""
    p = table(spark, sf_dir, "pages")
    return pg.crawl(pg.link_edges(p, same_host=True, junk=pg.JUNK), p.filter("page_id % 2 = 0").select(crawl_key("url").alias("url")), pages=1_000_000)


def split_in_sql(spark, sf_dir):
    """Chunks of every text by the table function."""
    tables.register(spark)
    docs = table(spark, sf_dir, "documents")
    return spark.sql("SELECT d.doc_id, c.chunk_index, md5(c.chunk) AS chunk_md5 FROM {docs} d, LATERAL recursive_split(d.text, 500, 75) c", docs=docs)


def blocks_in_sql(spark, sf_dir):
    """Block elements of every page by the table function."""
    tables.register(spark)
    p = table(spark, sf_dir, "pages")
    return spark.sql("SELECT p.page_id, b.pos, b.tag, md5(b.text) AS text_md5, size(b.links) AS links FROM {p} p, LATERAL html_blocks(p.html, p.url) b", p=p)


def card_list(spark, sf_dir):
    return pg.cards(table(spark, sf_dir, "documents").withColumn("k", F.col("source")), "k", "text", "doc_id").groupBy("k").agg(F.count(F.lit(1)).alias("names"), F.sum(F.length("description")).alias("chars"))


def name_lists(spark, sf_dir):
    items = F.filter(F.transform(F.split("text", r"[.,\n]"), tx.strip), lambda x: x != "")
    d = table(spark, sf_dir, "documents").select("doc_id", items.alias("items"))
    return d.select("doc_id", tx.is_name_list("items").alias("name_list"), F.size(tx.adjacent_distinct("items")).alias("items"))


QUERIES = {f.__name__: f for f in (adaptive_chunks, chunk_ids, greedy_pack, merge_tiny, hierarchy_children, hierarchy_parents, hierarchy_leaves, html_title, html_text, html_sections, flat_sections, crawl_frontier, crawl_same_host, split_in_sql, blocks_in_sql, card_list, name_lists)}

_CHILD = r"""
s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
c AS (SELECT 'd' || doc_id AS parent_id, i - 1 AS pos, 'h' || (i - 1) AS heading, array_to_string(string_split(l[i], '. '), ' ') AS content
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM s) WHERE (i - 1) % 4 <> 3)"""

_CLEAN = r"list_filter(list_transform({}, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
# s(k, l): keyed item lists; f(k, p): their packed pieces.
_PACK = """
w AS (SELECT k, l, 1 AS i, CAST([] AS VARCHAR[]) AS done, CAST(NULL AS VARCHAR) AS held, 0 AS n FROM s
  UNION ALL SELECT k, l, i + 1,
    CASE WHEN length(l[i]) > 500 THEN list_concat(CASE WHEN held IS NULL THEN done ELSE list_append(done, held) END, list_transform(range(CAST((length(l[i]) - 1) // 500 + 1 AS BIGINT)), lambda j: substr(l[i], j * 500 + 1, 500)))
      WHEN held IS NOT NULL AND n + length(l[i]) + 1 > 500 THEN list_append(done, held) ELSE done END,
    CASE WHEN length(l[i]) > 500 THEN NULL WHEN held IS NOT NULL AND n + length(l[i]) + 1 > 500 THEN l[i] WHEN held IS NULL THEN l[i] ELSE held || ' ' || l[i] END,
    CASE WHEN length(l[i]) > 500 THEN 0 WHEN held IS NOT NULL AND n + length(l[i]) + 1 > 500 THEN length(l[i]) + 1 ELSE n + length(l[i]) + 1 END
  FROM w WHERE i <= len(l)),
f AS (SELECT k, CASE WHEN held IS NOT NULL THEN list_append(done, held) WHEN len(done) = 0 THEN [''] ELSE done END AS p FROM w WHERE i = len(l) + 1)"""

ORACLE = {
    "greedy_pack": f"""
WITH RECURSIVE s AS (SELECT doc_id AS k, {_CLEAN.format("string_split(text, chr(10))")} AS l FROM documents), {_PACK}
SELECT k AS doc_id, CAST(len(p) AS INTEGER) AS pieces, CAST(list_max(list_transform(p, lambda x: length(x))) AS INTEGER) AS longest, md5(array_to_string(p, chr(30))) AS packed_md5 FROM f""",
    "hierarchy_leaves": f"""
WITH RECURSIVE x AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
s AS (SELECT struct_pack(d := doc_id, p := pos) AS k, {_CLEAN.format("string_split(line, '. ')")} AS l FROM x WHERE pos % 4 <> 3), {_PACK}
SELECT 'd' || k.d AS parent_id, CAST(sum(len(p)) AS BIGINT) AS leaves, CAST(sum(len(p)) AS BIGINT) AS ids FROM f GROUP BY 1""",
    "merge_tiny": r"""
WITH RECURSIVE s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, l, 1 AS i, CAST([] AS VARCHAR[]) AS done, CAST(NULL AS VARCHAR) AS held FROM s
  UNION ALL SELECT doc_id, l, i + 1, CASE WHEN tiny THEN done ELSE list_append(done, body) END, CASE WHEN tiny THEN body END
  FROM (SELECT *, i < len(l) AND len(list_filter(regexp_split_to_array(body, '\s+'), lambda v: v <> '')) < 40 AS tiny
    FROM (SELECT *, CASE WHEN held IS NULL THEN l[i] ELSE held || chr(10) || chr(10) || l[i] END AS body FROM w WHERE i <= len(l))))
SELECT doc_id, CAST(len(done) AS INTEGER) AS bodies, md5(array_to_string(done, chr(30))) AS merged_md5 FROM w WHERE i = len(l) + 1""",
    "chunk_ids": "SELECT doc_id, substr(sha256('https://x.example/d/' || doc_id || '::chunk_' || (doc_id % 5) || '::' || substr(sha256(text), 1, 16)), 1, 32) AS chunk_id FROM documents",
    "hierarchy_children": f"WITH {_CHILD} SELECT parent_id || '::' || heading AS child_id, parent_id, md5(content) AS content_md5 FROM c",
    "hierarchy_parents": f"""WITH {_CHILD} SELECT parent_id, md5(string_agg('Heading:' || chr(10) || heading || chr(10) || chr(10) || 'Content:' || chr(10) || content, chr(10) || chr(10) ORDER BY pos)) AS content_md5,
count(*) AS child_count FROM c GROUP BY parent_id""",
    "html_title": "SELECT page_id, replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&') AS title FROM pages",
    "crawl_frontier": r"""
WITH RECURSIVE l AS (SELECT url, regexp_extract(url, '^[A-Za-z]+://[^/?#]*') AS root, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages),
t AS (SELECT url, CASE WHEN starts_with(href, '/') AND NOT starts_with(href, '//') THEN root || href WHEN regexp_matches(href, '^https?://') THEN href END AS target FROM l),
e AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS source, regexp_replace(regexp_replace(target, '[?#].*$', ''), '/+$', '') AS target FROM t WHERE target IS NOT NULL),
w AS (SELECT regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS url, 0 AS depth FROM pages UNION SELECT target, depth + 1 FROM w JOIN e ON w.url = e.source WHERE depth < 3)
SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY url""",
    "crawl_same_host": r"""
WITH RECURSIVE l AS (SELECT url, regexp_extract(url, '^[A-Za-z]+://[^/?#]*') AS root, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages),
t AS (SELECT url, root, CASE WHEN starts_with(href, '/') AND NOT starts_with(href, '//') THEN root || href WHEN regexp_matches(href, '^https?://') THEN href END AS target FROM l),
e AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS source, regexp_replace(regexp_replace(target, '[?#].*$', ''), '/+$', '') AS target FROM t
  WHERE target IS NOT NULL AND lower(regexp_extract(target, '^[A-Za-z]+://[^/?#]*')) = lower(root)),
k AS (SELECT * FROM e WHERE NOT regexp_matches(target, 'mailto:|tel:|[.]jpg|[.]png|[.]jpeg|[.]zip|login|signup|[.]webp|[.]mp4')),
w AS (SELECT regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS url, 0 AS depth FROM pages WHERE page_id % 2 = 0 UNION SELECT target, depth + 1 FROM w JOIN k ON w.url = k.source WHERE depth < 3)
SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY url""",
    "card_list": r"""
WITH p AS (SELECT source AS k, doc_id, trim(CASE WHEN contains(text, chr(10)) THEN substr(text, 1, strpos(text, chr(10)) - 1) ELSE text END) AS name,
  regexp_replace(CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END, '^\s+|\s+$', '', 'g') AS d FROM documents),
l AS (SELECT k, name, arg_max(d, doc_id) AS d FROM p WHERE name <> '' GROUP BY k, name)
SELECT k, count(*) AS names, CAST(sum(length(d)) AS BIGINT) AS chars FROM l GROUP BY k""",
    "name_lists": r"""
WITH i AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.,\n]'), lambda x: trim(x)), lambda x: x <> '') AS i FROM documents)
SELECT doc_id, len(i) >= 3 AND len(list_filter(i, lambda x: regexp_matches(x, '^\p{Lu}'))) >= len(i) * 0.7
  AND len(list_filter(i, lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) <= 6)) >= len(i) * 0.8 AS name_list,
  CAST(len(list_filter(i, lambda x, n: n = 1 OR lower(x) <> lower(i[n - 1]))) AS INTEGER) AS items FROM i""",
}
