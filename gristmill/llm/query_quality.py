"""op6: quality of ``documents`` as ``labels.quality`` marks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import quality
from .common import table
from .samples import fold

NAME = "op6_quality_classifier"
SQL = None
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    known = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    model = quality.fit(docs, known.select("doc_id", F.col("quality").alias("label")))
    return quality.score(docs, model).select(
        "doc_id",
        (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
