"""op8: words of ``documents`` outside windows that start earlier elsewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table
from .substring import remove_repeats

NAME = "op8_substring_dedup"
SQL = None


def query(spark, sf_dir):
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
