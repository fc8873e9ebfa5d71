"""op11: periodic runs in ``documents``, a tenth of them made periodic by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table
from .runs import periodic_runs, strongest

NAME = "op11_periodic_runs"


def made_periodic(docs):
    """doc_id and text; where h % 10 = 0 for h = crc32 of the id, the words from place a on repeat the first p of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.filter(F.split(F.coalesce("text", F.lit("")), "[ \t-\r]+"), lambda w: w != ""))
    own = docs.select("doc_id", "text", words.alias("w"), F.floor(h / 10).alias("g")).withColumn("n", F.size("w").cast("bigint"))
    own = own.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    own = own.withColumn("p", 1 + F.expr("(n - a) div (3 + g % 8)"))
    tail = F.expr("slice(flatten(array_repeat(slice(w, int(a + 1), int(p)), int((n - a - 1) div p + 1))), 1, int(n - a))")
    text = F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail), " ")).otherwise(F.col("text"))
    return own.select("doc_id", text.alias("text"))


def query(spark, sf_dir):
    found = periodic_runs(made_periodic(table(spark, sf_dir, "documents")), ["doc_id"]).withColumn("top", strongest())
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

SQL = rf"""
WITH raw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_CRC} AS h FROM documents),
cut AS (SELECT *, len(w) AS n, h // 10 AS g, h % 10 = 0 AND len(w) > 0 AS made, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM raw),
per AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM cut),
doc AS (SELECT doc_id, n, CASE WHEN made THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM per),
gram AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + 5], ' ') AS s FROM (SELECT *, unnest(range(n - 4)) AS i FROM doc WHERE n >= 6)),
cell AS (SELECT y.doc_id, y.i, y.i - x.i AS q FROM gram x JOIN gram y ON x.doc_id = y.doc_id AND x.s = y.s AND y.i > x.i AND 4 * (y.i - x.i) <= y.n),
streak AS (SELECT doc_id, q, min(i) AS i, count(*) + 4 AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM cell) GROUP BY doc_id, q, k),
long AS (SELECT doc_id, i - q AS s, m + q AS l, q FROM streak WHERE m + q >= greatest(6, 4 * q)),
run AS (SELECT * FROM long x WHERE NOT EXISTS (FROM long y WHERE y.doc_id = x.doc_id AND y.q < x.q AND x.q % y.q = 0 AND y.s <= x.s AND y.s + y.l >= x.s + x.l)),
gone AS (SELECT doc_id, list(DISTINCT i) AS i FROM (SELECT doc_id, unnest(range(s + q, s + l)) AS i FROM run) GROUP BY doc_id),
kept AS (SELECT doc.doc_id, sha256(array_to_string(CASE WHEN gone.i IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(gone.i, k - 1)) END, ' ')) AS c
  FROM doc LEFT JOIN gone USING (doc_id)),
best AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q)) AS r FROM run GROUP BY doc_id),
top AS (SELECT doc_id, s, l, q FROM run x WHERE NOT EXISTS (FROM run y WHERE y.doc_id = x.doc_id AND (y.l * x.q > x.l * y.q OR y.l * x.q = x.l * y.q AND (y.s < x.s OR y.s = x.s AND y.q < x.q))))
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, 1000 * l // q AS exponent_milli, coalesce(r, sha256('')) AS runs_sha256, c AS collapsed_sha256
FROM kept LEFT JOIN best USING (doc_id) LEFT JOIN top USING (doc_id)"""
