"""op4: byte-level BPE ids of ``documents`` and their decoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe
from .common import table

NAME = "op4_byte_bpe"
SQL = None


def query(spark, sf_dir, vocabulary=None):
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), vocabulary, keep=["doc_id"], offsets=True)
    decoded = bpe.decode(encoded, vocabulary)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        bpe.digest_of_ids().alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ids_end", F.lit(-1)), F.lit(0)).cast("bigint").alias("chars_covered"),
    )
