"""op13: ``pages`` as WARC records, read back."""

from __future__ import annotations

import uuid

from . import warc
from .common import shared_dir, table

NAME = "op13_warc"


def query(spark, sf_dir):
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_pages(table(spark, sf_dir, "pages"), path)
    found = warc.read_records(spark, path, "record_id string, record_type string, refers_to string, payload_digest string, payload_bytes bigint")
    return found.select(warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("refers_to"))


_DIGITS = "list_transform(range(8), lambda g: CAST('0x' || h[5 * g + 1:5 * g + 5] AS BIGINT))"
_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> {}) & 31 AS BIGINT) + 1, 1)"

SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
s AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, min(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform({_DIGITS}, lambda v: {" || ".join(_LETTER.format(x) for x in (15, 10, 5, 0))}), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM s"""
