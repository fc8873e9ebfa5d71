"""Bounded, deterministic training samples: ids in hash order, independent of partitioning and file layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def hash_sample(ids: DataFrame, limit: int, seed: int) -> DataFrame:
    """At most ``limit`` rows of a frame with a ``doc_id``, the first in the order of a seeded hash."""
    return ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(limit)


def texts_of_sample(docs: DataFrame, sample: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of a sample whose size ``hash_sample`` bounds: the sample's columns and text, a row for each row of the sample that has a document.

    The sample's rows differ. Of documents that share an id the least text stands for all, so repeated ids never multiply the sample.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return slim.join(F.broadcast(sample), "doc_id").groupBy(*sample.columns).agg(F.min("text").alias("text"))
