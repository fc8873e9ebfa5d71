"""Token-budget chunks of ``documents`` read as markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import markdown
from ..sources.tables import table


def as_markdown(docs):
    """Every seventh line a heading of level 1 to 3, three table rows of which the second is the rule, and a blank line; the others as they are."""
    lines = F.split("text", "\n")

    def shown(line, i):
        kind = i % 7
        return (
            F.when(kind == 0, F.concat(F.repeat(F.lit("#"), 1 + i % 3), F.lit(" "), line))
            .when(kind.isin(2, 4), F.concat(F.lit("| "), F.replace(line, F.lit(" "), F.lit(" | ")), F.lit(" |")))
            .when(kind == 3, "|---|---|").when(kind == 5, "").otherwise(line)
        )

    return docs.select("doc_id", F.array_join(F.transform(lines, shown), "\n").alias("text"))


def token_chunks(spark, sf_dir):
    found = markdown.token_chunks(as_markdown(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.col("index").alias("chunk"), F.array_join("headings", " > ").alias("path"), F.col("tokens").cast("bigint").alias("tokens"), F.sha2("content", 256).alias("content_sha256"))


QUERIES = {"token_chunks": token_chunks}

_COUNT = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> ''))"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

ORACLE = {
    "token_chunks": rf"""
WITH RECURSIVE raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
md AS (SELECT doc_id, i, regexp_replace(CASE i % 7 WHEN 0 THEN repeat('#', CAST(1 + i % 3 AS INT)) || ' ' || line WHEN 2 THEN '| ' || replace(line, ' ', ' | ') || ' |' WHEN 4 THEN '| ' || replace(line, ' ', ' | ') || ' |'
  WHEN 3 THEN '|---|---|' WHEN 5 THEN '' ELSE line END, '\r$', '') AS line FROM raw),
fe AS (SELECT *, regexp_matches(line, '^ {{0,3}}```') AS fence, length(regexp_extract(line, '^ {{0,3}}(#{{1,6}})[ \t]', 1)) AS l FROM md),
fi AS (SELECT *, coalesce(sum(CAST(fence AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM fe),
kd AS (SELECT *, CASE WHEN fence OR inside THEN 'text' WHEN l > 0 THEN 'heading' WHEN regexp_matches(line, '^[ \t]*\|') THEN 'table' WHEN {_STRIP.format("line")} = '' THEN 'blank' ELSE 'text' END AS kind FROM fi),
bn AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM (SELECT *, CASE WHEN kind = 'heading' OR kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS b FROM kd)),
bl AS (SELECT doc_id, block, kind, max(CASE WHEN kind = 'heading' THEN l END) AS level, list(line ORDER BY i) AS lines FROM bn WHERE kind <> 'blank' GROUP BY ALL),
ti AS (SELECT *, CASE WHEN kind = 'heading' THEN {_STRIP.format("regexp_replace(replace(trim(regexp_replace(regexp_replace(lines[1], '^ {0,3}#{1,6}[ \\t]+|[ \\t]+#*[ \\t]*$', '', 'g'), '\\s+', ' ', 'g')), ' .', '.'), ':+$', '')")} END AS title FROM bl),
hd AS (SELECT b.doc_id, b.block, h.level, arg_max(h.title, h.block) AS title, max(h.block) AS at FROM ti b JOIN ti h ON h.doc_id = b.doc_id AND h.block < b.block AND h.kind = 'heading' WHERE b.kind <> 'heading' GROUP BY ALL),
ok AS (SELECT x.doc_id, x.block, x.level, x.title FROM hd x WHERE NOT EXISTS (FROM hd y WHERE y.doc_id = x.doc_id AND y.block = x.block AND y.level < x.level AND y.at > x.at)
  AND x.title <> '' AND {_COUNT.format("x.title")} <= 20 AND NOT regexp_matches(x.title, '[,;]$') AND NOT (x.title LIKE '%.' AND {_COUNT.format("x.title")} > 6)),
ph AS (SELECT doc_id, block, list(title ORDER BY level) AS p FROM (SELECT doc_id, block, title, min(level) AS level FROM ok GROUP BY ALL) GROUP BY ALL),
bd AS (SELECT t.doc_id, t.block, t.kind, t.lines, coalesce(p, []) AS p FROM ti t LEFT JOIN ph USING (doc_id, block) WHERE kind <> 'heading'),
sc AS (SELECT *, sum(m) OVER (PARTITION BY doc_id ORDER BY block) AS section FROM (SELECT *, CASE WHEN p IS DISTINCT FROM lag(p) OVER (PARTITION BY doc_id ORDER BY block) THEN 1 ELSE 0 END AS m FROM bd)),
hr AS (SELECT *, CASE WHEN len(lines) > 1 AND regexp_matches(lines[2], '^[ \t]*\|[ \t:|-]*-[ \t:|-]*$') THEN 2 ELSE 1 END AS bare, {_STRIP.format("array_to_string(lines, chr(10))")} AS whole FROM sc),
he AS (SELECT *, CASE WHEN kind = 'table' AND len(lines) > bare THEN array_to_string(lines[1:bare], chr(10)) ELSE '' END AS header, list_filter(regexp_split_to_array(whole, '\s+'), lambda w: w <> '') AS w FROM hr),
sp AS (SELECT doc_id, section, p, block, kind = 'table' AS tab, header, unnest(u) AS text, generate_subscripts(u, 1) AS n FROM (SELECT *, CASE WHEN kind = 'table' AND header <> '' THEN lines[bare + 1:] WHEN kind = 'table' THEN [array_to_string(lines, chr(10))]
  WHEN len(w) <= 256 THEN [whole] ELSE list_transform(range(CAST((len(w) - 1) // 256 + 1 AS BIGINT)), lambda g: array_to_string(w[g * 256 + 1:g * 256 + 256], ' ')) END AS u FROM he)),
it AS MATERIALIZED (SELECT *, {_COUNT.format("text")} AS c, {_COUNT.format("header")} AS hc, row_number() OVER (PARTITION BY doc_id, section ORDER BY block, n) AS rn FROM sp),
pk AS (SELECT doc_id, section, rn, CAST(0 AS BIGINT) AS chunk, CAST(hc + c AS BIGINT) AS used, block, CASE WHEN header = '' THEN text ELSE header || chr(10) || text END AS piece, CAST(hc + c AS BIGINT) AS cost FROM it WHERE rn = 1
  UNION ALL SELECT i.doc_id, i.section, i.rn, CAST(CASE WHEN full_ THEN chunk + 1 ELSE chunk END AS BIGINT), CAST(CASE WHEN full_ THEN hc + c ELSE used + here END AS BIGINT), i.block,
    CASE WHEN NOT full_ AND goes THEN chr(10) || text WHEN full_ THEN headed ELSE chr(10) || chr(10) || headed END, CAST(CASE WHEN full_ THEN hc + c ELSE here END AS BIGINT)
  FROM (SELECT i.*, k.chunk, k.used, k.block = i.block AND i.tab AS goes, CASE WHEN k.block = i.block AND i.tab THEN c ELSE hc + c END AS here, k.used > 0 AND k.used + CASE WHEN k.block = i.block AND i.tab THEN c ELSE hc + c END > 256 AS full_,
    CASE WHEN i.header = '' THEN i.text ELSE i.header || chr(10) || i.text END AS headed FROM pk k JOIN it i ON i.doc_id = k.doc_id AND i.section = k.section AND i.rn = k.rn + 1) i),
ch AS (SELECT pk.doc_id, pk.section, chunk, any_value(p) AS p, string_agg(piece, '' ORDER BY rn) AS body, sum(cost) AS t FROM pk JOIN (SELECT doc_id, section, any_value(p) AS p FROM it GROUP BY ALL) USING (doc_id, section) GROUP BY ALL),
cn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section, chunk) AS rn FROM ch),
tn AS (SELECT doc_id, rn, CAST(0 AS BIGINT) AS ix, CAST(t AS BIGINT) AS acc FROM cn WHERE rn = 1
  UNION ALL SELECT c.doc_id, c.rn, CASE WHEN n.acc < 40 THEN n.ix ELSE n.ix + 1 END, CAST(CASE WHEN n.acc < 40 THEN n.acc + c.t ELSE c.t END AS BIGINT) FROM tn n JOIN cn c ON c.doc_id = n.doc_id AND c.rn = n.rn + 1),
jo AS (SELECT doc_id, ix, coalesce((list(p ORDER BY rn) FILTER (len(p) > 0))[1], []) AS p, string_agg(body, chr(10) || chr(10) ORDER BY rn) AS body, CAST(sum(t) AS BIGINT) AS tokens FROM tn JOIN cn USING (doc_id, rn) GROUP BY ALL)
SELECT doc_id, ix AS chunk, array_to_string(p, ' > ') AS path, tokens, sha256(CASE WHEN len(p) = 0 THEN '' ELSE 'Heading:' || chr(10) || p[1] || CASE WHEN len(p) > 1 THEN chr(10) || chr(10) || 'Subheading:' || chr(10) || array_to_string(p[2:], ' > ') ELSE '' END || chr(10) || chr(10) END
  || 'Content:' || chr(10) || body) AS content_sha256 FROM jo""",
}
