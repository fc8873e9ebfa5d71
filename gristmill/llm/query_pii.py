"""op2: personal data in ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import pii
from .common import table

NAME = "op2_pii_crf"
SQL = None


def query(spark, sf_dir):
    found = pii.find_spans(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", *map(_count, pii.KINDS[:4]), F.sha2(pii.joined("base_spans"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


def _count(kind: str):
    return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
