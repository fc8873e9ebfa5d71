"""Cleaning and quality queries over ``documents``, ``conversations`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..operators import dedup
from ..sources.tables import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def script_language_detect(spark, sf_dir):
    texts = _docs(spark, sf_dir).select("text").union(table(spark, sf_dir, "conversations").select("text"))
    return texts.groupBy(tx.script_language("text").alias("language")).agg(F.count(F.lit(1)).alias("n"))


def clean_text_lines(spark, sf_dir):
    cleaned = _docs(spark, sf_dir).select("doc_id", tx.clean_lines(tx.nfc("text")).alias("t"))
    return cleaned.select("doc_id", F.md5("t").alias("cleaned_md5"), F.length("t").alias("n"))


def markdown_clean(spark, sf_dir):
    marked = F.concat(F.lit("# "), F.replace("text", F.lit(". "), F.lit("** ")))
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.clean_markdown(marked)).alias("cleaned_md5"))


def pdf_text_clean(spark, sf_dir):
    spread = F.replace(F.replace("text", F.lit("\n"), F.lit("\n\n\n\n")), F.lit(", "), F.lit(",   "))
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.clean_extracted(spread)).alias("cleaned_md5"))


def wording_rewrite(spark, sf_dir):
    said = F.concat(F.lit("Your event is scheduled for noon. I HAVE NOTED this down; reminder set, added to Calendar. "), F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", tx.rewrite_wording(said).alias("said"))


def normalized_dedup(spark, sf_dir):
    return dedup.keep_first(_docs(spark, sf_dir), "text", "doc_id").select("doc_id")


def dupes_by_source(spark, sf_dir):
    return dedup.removed_by_source(_docs(spark, sf_dir), "text", "doc_id", "source")


def placeholder_filter(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.filter(tx.is_placeholder("line")).select("doc_id", "pos", "line")


def smashed_words(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.split_smashed(F.replace("text", F.lit(" "), F.lit("")))).alias("repaired_md5"))


def ui_boilerplate(spark, sf_dir):
    """Lines of every text that are no interface labels; every fifth line reads as a label that its number picks."""
    labels = F.array(*(F.lit(p) for p in ["Read More", " view all ", "Coming soon", "real text"]))
    line = lambda x, i: F.when(i % 5 == 4, F.element_at(labels, (F.size(F.split(x, " ")) % 4 + 1).cast("int"))).otherwise(x)
    kept = F.filter(F.transform(F.split("text", "\n"), line), lambda x: ~tx.is_interface_phrase(x))
    return _docs(spark, sf_dir).select("doc_id", F.size(kept).alias("lines"), F.md5(F.array_join(kept, "\n")).alias("kept_md5"))


def text_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(F.split("text", "\n")).alias("sections"), tx.word_count("text").alias("words"))


def _nav_items(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), 1)
    crumb = F.array_join(F.transform(links, lambda h: F.concat(F.regexp_replace(h, "^/", ""), F.lit(" (https://x.example"), h, F.lit(")"))), " | ")
    source = F.concat(F.lit("site"), (F.col("page_id") % 7).cast("string"))
    body = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    rows = pages.select("page_id", source.alias("source"), crumb.alias("content"))
    return rows.union(pages.filter(F.col("page_id") % 7 != 3).select("page_id", source, body))


def breadcrumb_filter(spark, sf_dir):
    return _nav_items(spark, sf_dir).groupBy("source").agg(F.count_if(tx.is_breadcrumb("content")).alias("breadcrumbs"), F.count(F.lit(1)).alias("items"))


def breadcrumb_restore(spark, sf_dir):
    kept = dedup.filter_breadcrumbs(_nav_items(spark, sf_dir), "content", "source")
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("kept"), F.count_if("restored").alias("restored"))


def crawl_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.crawl_key("url").alias("url"), urls.is_web_url("url").alias("web"))


def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize_url("url").alias("url"))


def url_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.title_from_url("url").alias("title"))


QUERIES = {
    f.__name__: f
    for f in (
        script_language_detect, clean_text_lines, markdown_clean, pdf_text_clean, wording_rewrite, normalized_dedup, dupes_by_source, placeholder_filter,
        smashed_words, ui_boilerplate, text_counts, breadcrumb_filter, breadcrumb_restore, crawl_normalize, url_normalize, url_title,
    )
}

_KEY = r"sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))))"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_REWRITE = "concat('Your event is scheduled for noon. I HAVE NOTED this down; reminder set, added to Calendar. ', text)"
for _old, _new in tx.WORDING:
    _REWRITE = rf"regexp_replace({_REWRITE}, '\b{_old}\b', '{_new}', 'gi')"
_NAV = r"""nav AS (
  SELECT page_id, 'site' || (page_id % 7) AS source, array_to_string(list_transform(regexp_extract_all(html, '<a href="([^"]*)">', 1),
    lambda h: concat(regexp_replace(h, '^/', ''), ' (https://x.example', h, ')')), ' | ') AS content FROM pages
  UNION ALL SELECT page_id, 'site' || (page_id % 7), regexp_extract(html, '<title>([^<]*)</title>', 1) FROM pages WHERE page_id % 7 <> 3),
parts AS (SELECT *, list_filter(list_transform(string_split(content, '|'), lambda p: trim(p)), lambda p: p <> '') AS p FROM nav),
crumbs AS (SELECT *, len(p) >= 2 AND len(list_filter(p, lambda x: regexp_matches(x, '\(https?://\S+\)\s*$'))) >= len(p) * 0.6
  AND list_sum(list_transform(p, lambda x: length(trim(regexp_replace(x, '\(https?://\S+\)\s*$', ''))))) <= len(p) * 30 AS crumb FROM parts)"""

ORACLE = {
    "script_language_detect": r"""
SELECT CASE WHEN regexp_matches(text, '[\x{0B80}-\x{0BFF}]') THEN 'ta' WHEN regexp_matches(text, '[\x{0900}-\x{097F}]') THEN 'hi'
  WHEN regexp_matches(text, '[\x{0C00}-\x{0C7F}]') THEN 'te' WHEN regexp_matches(text, '[\x{0C80}-\x{0CFF}]') THEN 'kn'
  WHEN regexp_matches(text, '[\x{0D00}-\x{0D7F}]') THEN 'ml' ELSE 'en' END AS language, count(*) AS n
FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations) GROUP BY 1""",
    "clean_text_lines": rf"""
WITH l AS (SELECT doc_id, list_transform(string_split(nfc_normalize(text), chr(10)), lambda x: {_STRIP.format('x')}) AS l FROM documents),
k AS (SELECT doc_id, list_filter(l, lambda x: length(x) >= 3 AND NOT regexp_matches(x, '(?i)^(?:{"|".join(tx.BOILERPLATE)})$')) AS l FROM l),
d AS (SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM k),
t AS (SELECT doc_id, regexp_replace(regexp_replace({_STRIP.format("coalesce(array_to_string(l, chr(10)), '')")}, '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g') AS t FROM d)
SELECT doc_id, md5(t) AS cleaned_md5, CAST(length(t) AS INTEGER) AS n FROM t""",
    "markdown_clean": r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace('# ' || replace(text, '. ', '** '), '**', ''), '(^|\n)\s*#([^#]|$)', '\1\2', 'g'), '^\s+|\s+$', '', 'g'), '^\s+', '')) AS cleaned_md5 FROM documents""",
    "pdf_text_clean": r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(text, chr(10), repeat(chr(10), 4)), ', ', ',' || chr(160) || '  '), chr(160), ' '),
  '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS cleaned_md5 FROM documents""",
    "wording_rewrite": f"SELECT doc_id, {_REWRITE} AS said FROM documents",
    "normalized_dedup": f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {_KEY}",
    "dupes_by_source": f"""
WITH k AS (SELECT source, row_number() OVER (PARTITION BY {_KEY} ORDER BY doc_id) AS rn FROM documents)
SELECT source, count(*) AS removed FROM k WHERE rn > 1 GROUP BY source ORDER BY removed DESC, source LIMIT 10""",
    "placeholder_filter": """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
x AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS line FROM l)
SELECT doc_id, pos, line FROM x WHERE NOT regexp_matches(line, '[a-zA-Z0-9]{2,}')""",
    "smashed_words": r"SELECT doc_id, md5(regexp_replace(replace(text, ' ', ''), '([a-z0-9])([A-Z])', '\1 \2', 'g')) AS repaired_md5 FROM documents",
    "ui_boilerplate": r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
s AS (SELECT doc_id, list_transform(l, lambda x, i: CASE WHEN i % 5 = 0 THEN ['Read More', ' view all ', 'Coming soon', 'real text'][len(string_split(x, ' ')) % 4 + 1] ELSE x END) AS l FROM l),
k AS (SELECT doc_id, list_filter(l, lambda x: lower(regexp_replace(x, '^\s+|\s+$', '', 'g')) NOT IN ('upcoming event past event', 'read more', 'view all', 'click here', 'know more', 'coming soon', 'no data found', 'no results found')) AS l FROM s)
SELECT doc_id, CAST(len(l) AS INTEGER) AS lines, md5(array_to_string(l, chr(10))) AS kept_md5 FROM k""",
    "text_counts": r"""SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS sections,
CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS INTEGER) AS words FROM documents""",
    "breadcrumb_filter": f"WITH {_NAV} SELECT source, count(*) FILTER (crumb) AS breadcrumbs, count(*) AS items FROM crumbs GROUP BY source",
    "breadcrumb_restore": rf"""
WITH {_NAV}, w AS (SELECT *, crumb AND list_sum(list_transform(p, lambda x: len(list_filter(regexp_split_to_array(regexp_replace(x, '\(https?://\S+\)\s*$', ''), '\s+'), lambda v: v <> '')))) >= 20 AS says FROM crumbs),
s AS (SELECT source, count(*) FILTER (NOT crumb) > 0 AS survives FROM w GROUP BY source)
SELECT source, count(*) AS kept, count(*) FILTER (crumb) AS restored FROM w JOIN s USING (source) WHERE NOT crumb OR (NOT survives AND says) GROUP BY source""",
    "crawl_normalize": r"SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS url, regexp_matches(url, '^(?i:https?)://[^/?#]+') AS web FROM pages",
    "url_normalize": r"""
WITH u AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host,
  regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages),
q AS (SELECT *, list_sort(list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END)) AS pairs FROM u)
SELECT page_id, scheme || '://' || host || CASE WHEN path = '/' THEN path ELSE regexp_replace(path, '/+$', '') END || CASE WHEN len(pairs) > 0 THEN '?' || array_to_string(pairs, '&') ELSE '' END AS url FROM q""",
    "url_title": r"""
WITH s AS (SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z]+://[^/]*', ''), '[?#].*$', ''), '/+$', ''), '/')[-1] AS s FROM pages),
t AS (SELECT page_id, array_to_string(list_transform(list_filter(regexp_split_to_array(s, '[-_]'), lambda w: w <> ''), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS t FROM s)
SELECT page_id, CASE WHEN t = '' OR t IS NULL THEN 'Home' ELSE t END AS title FROM t""",
}
