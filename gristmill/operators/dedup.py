"""Content dedup and the quality filters that run before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def first_of_content(rows: DataFrame, text: str, order: str) -> DataFrame:
    """key and the smallest ``order`` value of every distinct normalised text.

    A grouped minimum with partial aggregation, so a text that very many rows share costs one row a task.
    """
    return rows.select(tx.normal_key(text).alias("key"), order).groupBy("key").agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies"))


def keep_first(rows: DataFrame, text: str, order: str) -> DataFrame:
    """One row for each distinct normalised text: the first in ``order`` (a unique column)."""
    return rows.join(first_of_content(rows, text, order).select(order), order, "left_semi")


def removed_by_source(rows: DataFrame, text: str, order: str, source: str, limit: int = 10) -> DataFrame:
    """How many rows dedup removes from each source, most first."""
    gone = rows.select(order, source).join(first_of_content(rows, text, order).select(order), order, "left_anti")
    return gone.groupBy(source).agg(F.count(F.lit(1)).alias("removed")).orderBy(F.desc("removed"), source).limit(limit)


def filter_breadcrumbs(rows: DataFrame, text: str, source: str, least_words: int = 20) -> DataFrame:
    """Drop breadcrumb rows; a source that would keep nothing gets back those whose own labels have enough words."""
    marked = rows.withColumn("__crumb", tx.is_breadcrumb(text)).withColumn("__says", F.col("__crumb") & (tx.breadcrumb_words(text) >= least_words))
    survives = marked.filter(~F.col("__crumb")).select(source).distinct().withColumn("__survives", F.lit(True))
    judged = marked.join(survives, source, "left")
    kept = ~F.col("__crumb") | (F.col("__survives").isNull() & F.col("__says"))
    return judged.filter(kept).withColumn("restored", F.col("__crumb")).drop("__crumb", "__says", "__survives")
