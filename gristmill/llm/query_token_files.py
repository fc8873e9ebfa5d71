"""op5: ``documents`` as token files, read back."""

from __future__ import annotations

import uuid

import public_tokenizers

from . import token_files
from .common import shared_dir, table

NAME = "op5_token_files"
SQL = None


def query(spark, sf_dir, vocabulary=None):
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary)
    return token_files.with_crc32(token_files.read_tokens(spark, path))
