"""op12: the phrases of ``documents`` whose words belong together, per language."""

from __future__ import annotations

from .collocations import collocations
from .common import table

NAME = "op12_collocations"


def query(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?' || chr(10) || chr(11) || chr(12) || chr(13) || chr(9),
  'abcdefghijklmnopqrstuvwxyz' || repeat(chr(10), 10) || ' '), chr(10))) AS piece FROM documents),
d AS (SELECT lang, row_number() OVER () AS id, list_filter(string_split(piece, ' '), lambda x: x <> '') AS w FROM p),
w AS (SELECT lang, id, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM d),
x AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY id ORDER BY i)),
g AS (SELECT lang, 1 AS k, w1 AS phrase FROM x UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM x WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM x WHERE w3 IS NOT NULL UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM x WHERE w4 IS NOT NULL),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
c AS MATERIALIZED (SELECT * FROM f WHERE k >= 2 AND a >= 30),
cut AS MATERIALIZED (SELECT lang, k, phrase, a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j, string_split(phrase, ' ') AS w FROM c)),
s AS (SELECT cut.lang, cut.phrase, cut.k, cut.a, j, l.a AS l, r.a AS r, CAST(CAST(2000000 AS HUGEINT) * cut.a // (l.a + r.a) AS BIGINT) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = x JOIN f r ON r.lang = cut.lang AND r.phrase = y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
m AS (SELECT lang, array_to_string(w[i:i + z - 1], ' ') AS phrase, max(a) AS most FROM (SELECT *, unnest(range(1, k - z + 2)) AS i
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS z FROM c)) GROUP BY ALL),
t AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank FROM b LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase
  WHERE m.most IS NULL OR CAST(100 AS HUGEINT) * m.most < CAST(80 AS HUGEINT) * b.a)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang) WHERE rank <= 2000"""
