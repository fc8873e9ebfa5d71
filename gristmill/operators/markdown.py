"""Markdown to chunks within a token budget: blocks by windows, greedy packing of a section's items, tiny chunks joined to the next.

Everything is a window over a document's lines or a fold over a section's items; nothing leaves the JVM. A document's lines are
sorted within its own group, so a long document is one group, never more than that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# Tokens of a chunk at most and at least.
MOST_TOKENS, LEAST_TOKENS = 256, 40

LEVELS = 6
_SEPARATOR = r"^[ \t]*\|[ \t:|-]*-[ \t:|-]*$"


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, block, kind (heading, table, text), level and lines of every block in order; lines within fences are text."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\r?\n")).alias("pos", "line"))
    order = Window.partitionBy(key).orderBy("pos")
    fence = F.col("line").rlike("^ {0,3}```")
    before = F.coalesce(F.sum(fence.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = F.length(F.regexp_extract("line", r"^ {0,3}(#{1,6})[ \t]", 1))
    kind = (
        F.when(fence | (before % 2 == 1), "text").when(level > 0, "heading").when(F.col("line").rlike(r"^[ \t]*\|"), "table").when(tx.strip("line") == "", "blank").otherwise("text")
    )
    marked = lines.withColumn("kind", kind).withColumn("level", F.when(F.col("kind") == "heading", level))
    begins = (F.col("kind") == "heading") | ~F.col("kind").eqNullSafe(F.lag("kind").over(order))
    numbered = marked.withColumn("block", F.sum(begins.cast("int")).over(order)).filter("kind <> 'blank'")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return numbered.groupBy(key, "block", "kind").agg(F.max("level").alias("level"), ordered.alias("lines"))


def sectioned(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Body blocks with the path of plausible headings above them, and the number of the section: neighbours with one path share it."""
    order = Window.partitionBy(key).orderBy("block")
    title = tx.clean_heading(F.regexp_replace(F.col("lines")[0], r"^ {0,3}#{1,6}[ \t]+|[ \t]+#*[ \t]*$", ""))
    last = [F.last(F.when(F.col("level") == n, F.struct("block", title.alias("title"))), ignorenulls=True).over(order).alias(f"h{n}") for n in range(1, LEVELS + 1)]
    rows = found.select("*", *last)
    above, shown = F.lit(0).cast("bigint"), []
    for n in range(1, LEVELS + 1):
        at = F.coalesce(F.col(f"h{n}.block"), F.lit(0))
        shown.append(F.when(at > above, F.col(f"h{n}.title")))
        above = F.greatest(above, at)
    path = F.array_distinct(F.filter(F.array_compact(F.array(*shown)), tx.plausible_heading))
    body = rows.select(key, "block", "kind", "lines", path.alias("headings")).filter("kind <> 'heading'")
    moved = ~F.col("headings").eqNullSafe(F.lag("headings").over(order))
    return body.withColumn("section", F.sum(moved.cast("int")).over(order))


def items(body: DataFrame, tokens: Callable[[Column], Column], most: int, key: str = "doc_id") -> DataFrame:
    """What is packed: paragraphs, cut by words where they exceed the budget, and table rows, each with its table's header."""
    lines = F.col("lines")
    ruled = (F.size("lines") > 1) & F.coalesce(F.try_element_at("lines", F.lit(2)).rlike(_SEPARATOR), F.lit(False))
    bare = F.when(ruled, 2).otherwise(1)
    table = F.col("kind") == "table"
    header = F.when(table & (F.size("lines") > bare), F.array_join(F.slice("lines", 1, bare), "\n")).otherwise("")
    text = tx.strip(F.array_join("lines", "\n"))
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / most).cast("int")), lambda i: F.array_join(F.slice(words, i * most + 1, most), " "))
    whole = F.when(tokens(text) <= most, F.array(text)).otherwise(cut)
    rows = F.when(header != "", F.slice("lines", bare + 1, F.size("lines"))).otherwise(F.array(F.array_join(lines, "\n")))
    spread = body.select(key, "section", "headings", "block", table.alias("table"), header.alias("header"), F.posexplode(F.when(table, rows).otherwise(whole)).alias("n", "text"))
    return spread.withColumn("cost", tokens(F.col("text"))).withColumn("header_cost", tokens(F.col("header")))


def _number(cell: str) -> Column:
    return F.lit(0).cast("bigint").alias(cell)


def packed(spread: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """Chunks of each section, as many items as the budget holds in order; a table that goes on in the next chunk repeats its header there."""
    item = F.struct("block", "n", "table", "header", "header_cost", "text", "cost")
    grouped = spread.groupBy(key, "section").agg(F.first("headings").alias("headings"), F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(_number("chunk"), _number("used"), _number("block"), F.array().cast("array<struct<chunk:bigint,text:string,cost:bigint>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        goes_on = (a["block"] == x["block"]) & x["table"]
        here = F.when(goes_on, x["cost"]).otherwise(x["header_cost"] + x["cost"])
        full = (a["used"] > 0) & (a["used"] + here > most)
        headed = F.when(x["header"] == "", x["text"]).otherwise(F.concat(x["header"], F.lit("\n"), x["text"]))
        chunk = a["chunk"] + F.when(full, 1).otherwise(0)
        piece = F.when(full | (a["used"] == 0), headed).when(goes_on, F.concat(F.lit("\n"), x["text"])).otherwise(F.concat(F.lit("\n\n"), headed))
        cost = F.when(full, x["header_cost"] + x["cost"]).otherwise(here)
        used = F.when(full, cost).otherwise(a["used"] + cost)
        return F.struct(chunk.cast("bigint").alias("chunk"), used.cast("bigint").alias("used"), x["block"].cast("bigint").alias("block"), F.array_append(a["out"], F.struct(chunk.cast("bigint").alias("chunk"), piece.alias("text"), cost.cast("bigint").alias("cost"))).alias("out"))

    placed = grouped.select(key, "section", "headings", F.posexplode(F.aggregate("items", start, step, lambda a: a["out"])).alias("pos", "p"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("p.text").alias("text")))), lambda x: x["text"])
    return placed.groupBy(key, "section", F.col("p.chunk").alias("chunk")).agg(F.first("headings").alias("headings"), F.array_join(ordered, "").alias("body"), F.sum("p.cost").alias("tokens"))


def joined_tiny(chunks: DataFrame, least: int, key: str = "doc_id") -> DataFrame:
    """key, index, headings, body, tokens: a chunk of under ``least`` tokens goes in front of the next; the first headings of what is joined count."""
    part = F.struct("section", "chunk", "headings", "body", "tokens")
    grouped = chunks.groupBy(key).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    start = F.struct(_number("index"), _number("held"), F.array().cast("array<bigint>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        sum_ = a["held"] + x["tokens"]
        wait = sum_ < least
        return F.struct((a["index"] + F.when(wait, 0).otherwise(1)).cast("bigint").alias("index"), F.when(wait, sum_).otherwise(0).cast("bigint").alias("held"), F.array_append(a["out"], a["index"]).alias("out"))

    numbered = grouped.select(key, F.arrays_zip(F.aggregate("parts", start, step, lambda a: a["out"]).alias("index"), F.col("parts").alias("part")).alias("z")).select(key, F.posexplode("z").alias("pos", "z"))
    rows = numbered.select(key, F.col("z.index").alias("index"), "pos", "z.part.*")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "headings", "body")))
    named = F.filter(F.transform(ordered, lambda x: x["headings"]), lambda h: F.size(h) > 0)
    return rows.groupBy(key, "index").agg(
        F.coalesce(F.try_element_at(named, F.lit(1)), F.array().cast("array<string>")).alias("headings"), F.array_join(F.transform(ordered, lambda x: x["body"]), "\n\n").alias("body"), F.sum("tokens").alias("tokens")
    )


def content(headings: Column, body: Column) -> Column:
    """The text to embed: heading, path of subheadings, body."""
    sub = F.concat(F.lit("\n\nSubheading:\n"), F.array_join(F.slice(headings, 2, F.greatest(F.size(headings) - 1, F.lit(1))), " > "))
    head = F.concat(F.lit("Heading:\n"), F.try_element_at(headings, F.lit(1)), F.when(F.size(headings) > 1, sub).otherwise(""), F.lit("\n\n"))
    return F.concat(F.when(F.size(headings) > 0, head).otherwise(""), F.lit("Content:\n"), body)


def token_chunks(docs: DataFrame, most: int = MOST_TOKENS, least: int = LEAST_TOKENS, tokens: Callable[[Column], Column] = tx.word_count, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, index (from 0), headings, body, tokens, content of every markdown document's chunks.

    A section's items are packed up to ``most`` tokens; a single table row with its header may exceed it. ``tokens`` counts a text's
    tokens, words by default. Null and empty documents, and those of headings alone, have no chunks; rows of one key are one document.
    """
    spread = items(sectioned(blocks(docs, key, text), key), tokens, most, key)
    merged = joined_tiny(packed(spread, most, key), least, key)
    return merged.withColumn("content", content(F.col("headings"), F.col("body")))
