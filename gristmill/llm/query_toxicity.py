"""op9: toxicity of ``documents`` as ``labels.toxic`` marks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import toxicity
from .common import table
from .samples import fold

NAME = "op9_toxicity_nnpu"
SQL = None
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_from_labels(docs, table(spark, sf_dir, "labels"), lambda i: fold(i, FOLDS) != HELD_OUT)
    return toxicity.score(docs, model, ["doc_id"]).select(
        "doc_id",
        (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
