"""Retrieval queries over ``embeddings``, ``benchmark`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as rt
from ..sources.tables import table

K = 8


def _vector_queries(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vector"))


def dense_topk(spark, sf_dir):
    found = rt.dense_top_k(table(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir), K)
    return found.select("query_id", "vec_id", "rank", "score")


def _text_queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _sparse(spark, sf_dir, k):
    return rt.sparse_top_k(table(spark, sf_dir, "documents"), _text_queries(spark, sf_dir), k, "doc_id")


def sparse_bm25_topk(spark, sf_dir):
    return _sparse(spark, sf_dir, K).select("query_id", "doc_id", "rank", "score")


STOP_WORDS = ("the", "of", "and", "in", "to")


def sparse_idf_topk(spark, sf_dir):
    found = rt.sparse_top_k(table(spark, sf_dir, "documents"), _text_queries(spark, sf_dir), K, "doc_id", stop_words=STOP_WORDS, use_idf=True)
    return found.select("query_id", "doc_id", "rank", "score")


def _dense_of_items(spark, sf_dir, k):
    """Dense neighbours of every benchmark item that has a vector: documents and vectors share their ids."""
    vectors = table(spark, sf_dir, "embeddings")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))
    asked = vectors.join(items, "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vector"))
    return rt.dense_top_k(vectors, asked, k).withColumnRenamed("vec_id", "doc_id")


def hybrid_rrf(spark, sf_dir):
    return rt.fuse(_dense_of_items(spark, sf_dir, 20), _sparse(spark, sf_dir, 20), K, "doc_id").select("query_id", "doc_id", "rank", "score")


def candidate_widening(spark, sf_dir):
    return rt.widen(_sparse(spark, sf_dir, 220)).groupBy("query_id", "attempts").agg(F.count(F.lit(1)).alias("n"))


def rerank_filter(spark, sf_dir):
    found = rt.dense_top_k(table(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir), 12)
    return rt.rerank_filter(found).select("query_id", "vec_id", "position", "top_score", "docs_kept")


def rerank_plain(spark, sf_dir):
    found = rt.dense_top_k(table(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir), 12)
    return rt.unfiltered_top(found).select("query_id", "vec_id", "position")


def parent_context(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("parent_id", F.concat_ws("/", "source", "lang"))
    parents = docs.groupBy("parent_id").agg(F.concat(F.lit("documents: "), F.count(F.lit(1)).cast("string")).alias("content"))
    hits = rt.with_columns_of(_sparse(spark, sf_dir, K), docs.select("doc_id", "parent_id"), "doc_id")
    return rt.parent_context(hits, parents).select("query_id", "doc_id", "rank", "parent_id", "parent_content")


def candidate_dedup(spark, sf_dir):
    hits = rt.with_columns_of(_sparse(spark, sf_dir, 20), table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return rt.dedup_candidates(hits, "text").select("query_id", "doc_id", "rank")


ANSWERS = {"en": "No information was found.", "de": "Keine Angaben gefunden.", "fr": "Aucune information."}


def no_info_answer(spark, sf_dir):
    questions = table(spark, sf_dir, "documents").select("doc_id", F.upper("lang").alias("language"))
    return rt.no_answer(questions, ANSWERS).select("doc_id", "answer")


def contact_text_search(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category"), F.col("text").alias("name"), F.col("source").alias("_source"))
    return rt.text_search(rows, "The erat and of", ["category", "name"], "doc_id")


QUERIES = {
    f.__name__: f
    for f in (dense_topk, sparse_bm25_topk, sparse_idf_topk, hybrid_rrf, candidate_widening, rerank_filter, rerank_plain, parent_context, candidate_dedup, no_info_answer, contact_text_search)
}

_DENSE = """
q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 25 = 0),
sc AS (SELECT query_id, vec_id, round(list_cosine_similarity(q, CAST(embedding AS DOUBLE[])), 6) AS score FROM q, embeddings),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sc)"""
_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
_SPARSE = f"""
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
post AS (SELECT term, doc_id, l, count(*) AS tf FROM (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM dw) GROUP BY ALL),
qt AS (SELECT DISTINCT item_id AS query_id, unnest({_WORDS}) AS term FROM benchmark),
ss AS (SELECT query_id, doc_id, CAST(round(sum(CAST(round(tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * l / 256)), 9) AS DECIMAL(18, 9))), 6) AS DOUBLE) AS score
  FROM post JOIN qt USING (term) GROUP BY ALL),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ss)"""
_ITEMS = """
iq AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)),
isc AS (SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(q, CAST(embedding AS DOUBLE[])), 6) AS score FROM iq, embeddings),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM isc)"""
_KEY = r"sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))))"
_FILTER = f"""
WITH {_DENSE}, d AS (SELECT * FROM dense WHERE rank <= 12),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS position, max(score) OVER (PARTITION BY query_id) AS top_score FROM d),
a AS (SELECT *, count(*) FILTER (score >= greatest(CAST(0.2 AS DOUBLE), top_score - CAST(0.12 AS DOUBLE))) OVER (PARTITION BY query_id) AS above FROM p)"""

ORACLE = {
    "dense_topk": f"WITH {_DENSE} SELECT query_id, vec_id, rank, score FROM dense WHERE rank <= {K}",
    "sparse_bm25_topk": f"WITH {_SPARSE} SELECT query_id, doc_id, rank, score FROM sparse WHERE rank <= {K}",
    "sparse_idf_topk": f"""
WITH {_SPARSE}, qs AS (SELECT * FROM qt WHERE term NOT IN {STOP_WORDS}), df AS (SELECT term, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / CAST(count(*) + 0.5 AS DOUBLE)) AS idf FROM post GROUP BY term),
si AS (SELECT query_id, doc_id, CAST(round(sum(CAST(round(idf * (tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * l / 256))), 9) AS DECIMAL(18, 9))), 6) AS DOUBLE) AS score
  FROM post JOIN qs USING (term) JOIN df USING (term) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM si)
SELECT query_id, doc_id, rank, score FROM r WHERE rank <= {K}""",
    "hybrid_rrf": f"""
WITH {_SPARSE}, {_ITEMS}, s AS (SELECT query_id, doc_id, CAST(1 AS DOUBLE) / (1 + rank) AS s FROM sparse WHERE rank <= 20),
d AS (SELECT query_id, doc_id, CAST(1 AS DOUBLE) / (1 + rank) AS d FROM near WHERE rank <= 20),
f AS (SELECT query_id, doc_id, round(coalesce(d, 0) + coalesce(s, 0), 9) AS score FROM d FULL JOIN s USING (query_id, doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f)
SELECT query_id, doc_id, rank, score FROM r WHERE rank <= {K}""",
    "candidate_widening": f"""
WITH {_SPARSE}, c AS (SELECT * FROM sparse WHERE rank <= 220),
f AS (SELECT *, min(rank) OVER (PARTITION BY query_id) AS first FROM c),
a AS (SELECT *, CASE WHEN first <= 80 THEN 1 WHEN first <= 140 THEN 2 WHEN first <= 220 THEN 3 END AS attempts FROM f)
SELECT query_id, CAST(attempts AS INTEGER) AS attempts, count(*) AS n FROM a WHERE rank <= [80, 140, 220][attempts] GROUP BY ALL""",
    "rerank_filter": f"{_FILTER} SELECT query_id, vec_id, position, top_score, count(*) OVER (PARTITION BY query_id) AS docs_kept FROM a WHERE position <= least(8, greatest(above, 3))",
    "rerank_plain": f"{_FILTER} SELECT query_id, vec_id, position FROM a WHERE position <= 8",
    "parent_context": f"""
WITH {_SPARSE}, h AS (SELECT query_id, doc_id, rank, source || '/' || lang AS parent_id FROM sparse JOIN documents USING (doc_id) WHERE rank <= {K}),
c AS (SELECT source || '/' || lang AS parent_id, 'documents: ' || count(*) AS content FROM documents GROUP BY 1),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank) AS n FROM h)
SELECT query_id, doc_id, rank, parent_id, CASE WHEN n = 1 THEN content END AS parent_content FROM n LEFT JOIN c USING (parent_id)""",
    "candidate_dedup": f"""
WITH {_SPARSE}, h AS (SELECT query_id, doc_id, rank, {_KEY} AS k FROM sparse JOIN documents USING (doc_id) WHERE rank <= 20)
SELECT query_id, doc_id, rank FROM h QUALIFY row_number() OVER (PARTITION BY query_id, k ORDER BY rank) = 1""",
    "no_info_answer": """SELECT doc_id, CASE lang WHEN 'de' THEN 'Keine Angaben gefunden.' WHEN 'fr' THEN 'Aucune information.' ELSE 'No information was found.' END AS answer FROM documents""",
    "contact_text_search": rf"""
WITH r AS (SELECT doc_id, lang, text AS name FROM documents),
s AS (SELECT *, CAST(len(list_filter(regexp_split_to_array(lower(lang || ' ' || name), '[^\p{{L}}\p{{N}}]+'), lambda w: w IN ('the', 'erat', 'and', 'of'))) AS INTEGER) AS score FROM r)
SELECT doc_id, score, 'category: ' || lang || ' | name: ' || CASE WHEN length(name) > 500 THEN substr(name, 1, 500) || '…' ELSE name END AS rendered
FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 5""",
}
