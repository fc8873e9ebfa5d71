"""Table functions for SQL: ``FROM pages p, LATERAL html_blocks(p.html, p.url)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .html import blocks_of
from .splitting import split_text


@udtf(returnType="pos int, tag string, cls string, text string, links array<struct<label:string,href:string>>")
class HtmlBlocks:
    """The block elements of a page in document order; null html has none."""

    def eval(self, html: str, url: str) -> Iterator[tuple]:
        for b in blocks_of(html, url):
            yield b["pos"], b["tag"], b["cls"], b["text"], [(x["label"], x["href"]) for x in b["links"]]


@udtf(returnType="chunk_index int, chunk string")
class RecursiveSplit:
    """Chunks of at most ``size`` characters, cut at the coarsest separators that do, with ``overlap`` carried over; null text has none."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        for i, chunk in enumerate(split_text(text, size, overlap) if text is not None else ()):
            yield i, chunk


def register(spark: SparkSession) -> None:
    """Make ``html_blocks`` and ``recursive_split`` known to this session's SQL."""
    spark.udtf.register("html_blocks", HtmlBlocks)
    spark.udtf.register("recursive_split", RecursiveSplit)
