"""op7: language of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import language
from .common import table
from .samples import fold

NAME = "op7_language_id"
SQL = None
FOLDS, HELD_OUT = 5, 0


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    return language.predict(docs, model).select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
