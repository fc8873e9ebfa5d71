"""A training-data pipeline over ``documents``: toxicity filter, near-duplicates, decontamination, redaction, token ids.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes each stage's rows as
Parquet to the shared folder and reads them again as the next one's ``docs``.

Defined cases: null and empty texts pass every filter as texts without words, count as copies of each other and get no tokens; a
null text stays null until it is encoded. Rows that share an id stand or fall together as near copies, otherwise each for itself;
null ids are one id. Of equally good rows the smallest id stays. Texts of any length are read whole. Without toxic labels nothing
is toxic, without benchmark items nothing is cut; an empty table stays empty through all stages. Columns beyond those of
``documents`` are carried to the last stage but one.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import bpe, decontaminate, near_copies, pii, toxicity
from gristmill.llm.common import shared_dir, table

TOXIC_FROM = 0.3


def _recount(docs: DataFrame) -> DataFrame:
    """n_chars after a stage that changes texts."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of toxicity stays below ``TOXIC_FROM``, learnt from all labels of documents still here."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit_from_labels(docs, labels, lambda i: i.isNotNull())
    scored = toxicity.score(docs, model, out="__toxic")
    return scored.filter(F.col("__toxic") < TOXIC_FROM).drop("__toxic")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id."""
    return near_copies.keep_one(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, benchmark passages cut out of their texts."""
    return _recount(decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark")))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets."""
    return _recount(pii.redact(docs))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token ids and whether the ids decode to the text again."""
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(docs.withColumn("__text_sha", F.sha2(F.coalesce("text", F.lit("")), 256)), vocabulary, keep=["doc_id", "lang", "source", "__text_sha"])
    decoded = bpe.decode(encoded, vocabulary)
    return decoded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("__text_sha")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", cut_benchmark),
    ("pii_redaction", redact_pii),
    ("byte_bpe", encode_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
