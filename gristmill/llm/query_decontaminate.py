"""op10: benchmark passages in ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table
from .decontaminate import contaminated_spans

NAME = "op10_benchmark_decontamination"


def query(spark, sf_dir):
    found = contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH bw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 10) AS l FROM bw WHERE len(w) > 0),
bwin AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS s
  FROM (SELECT item_id, w, l, unnest(range(1, CAST(len(w) - l + 2 AS BIGINT))) AS i FROM bi)),
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
lens AS (SELECT DISTINCT l FROM bwin),
dwin AS (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS s
  FROM (SELECT doc_id, w, l, unnest(range(1, CAST(len(w) - l + 2 AS BIGINT))) AS i FROM dw, lens WHERE len(w) >= l)),
hits AS (SELECT d.doc_id, d.i, d.l, b.item_id FROM dwin d JOIN bwin b ON d.l = b.l AND d.s = b.s),
nh AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(nh.n, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(nh.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id)"""
