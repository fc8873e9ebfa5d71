"""op3: near-duplicate components of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table
from .simhash import components

NAME = "op3_simhash_near_dedup"
SQL = None


def query(spark, sf_dir):
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
