"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from . import query_ann, query_bpe, query_collocations, query_decontaminate, query_language, query_pii, query_quality, query_runs, query_simhash, query_substring, query_token_files, query_toxicity, query_warc

_MODULES = (query_ann, query_pii, query_simhash, query_bpe, query_token_files, query_substring, query_quality, query_language, query_toxicity, query_decontaminate, query_runs, query_collocations, query_warc)


def queries() -> dict:
    return {m.NAME: m.query for m in _MODULES}


def oracle_sql() -> dict:
    return {m.NAME: m.SQL for m in _MODULES if m.SQL}
