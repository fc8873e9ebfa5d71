"""op1: nearest neighbours in ``embeddings``; the queries are the rows whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import functions as F

from .ann import nearest
from .common import table

NAME = "op1_ann_ivfpq"
SQL = None


def query(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))
