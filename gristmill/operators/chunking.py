"""Chunks: adaptive splitting with stable ids, greedy packing, tiny-chunk merging, three-level hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.splitting import recursive_split

# Categories of short items, (size, overlap) for these and for all others, least content, packing limit.
EVENT_CATEGORIES = [
    "events", "announcements", "faq", "merch", "team", "adventure_sports", "art_drama", "cyber_engage", "dance",
    "informal", "music", "premium", "quiz_words_worth", "sports", "workshop", "general",
]
EVENT_SIZE, OTHER_SIZE = (500, 75), (1000, 150)
LEAST_CONTENT = 30
PACK_SIZE = 500
TINY_TOKENS = 40


def chunk_id(url: Column, index: Column, text: Column) -> Column:
    """Stable id of a chunk: place and content."""
    return F.substring(F.sha2(F.concat_ws("::", url, F.concat(F.lit("chunk_"), index.cast("string")), F.substring(F.sha2(text, 256), 1, 16)), 256), 1, 32)


def adaptive_chunks(pages: DataFrame, titles: dict[str, str] | None = None, event_categories: list[str] = EVENT_CATEGORIES) -> DataFrame:
    """Chunks of pages (url, content, source, category, title): size by category, title in front, index before blanks go.

    ``titles`` gives a source's title line with ``{}`` for the title; a site adds its own names to ``event_categories``.
    """
    event = F.col("category").isin(event_categories)
    size, overlap = (F.when(event, a).otherwise(b) for a, b in zip(EVENT_SIZE, OTHER_SIZE, strict=True))
    line = F.col("title")
    for source, form in (titles or {}).items():
        before, after = form.split("{}")
        line = F.when(F.col("source") == source, F.concat(F.lit(before), F.col("title"), F.lit(after))).otherwise(line)
    prefix = F.when(F.coalesce("title", F.lit("")) != "", F.concat(line, F.lit("\n\n"))).otherwise("")
    whole = pages.filter(F.length(tx.strip("content")) >= LEAST_CONTENT)
    split = whole.withColumn("chunks", recursive_split(F.concat(prefix, F.col("content")), size, overlap))
    rows = split.select("url", "source", "category", "title", F.size("chunks").alias("total_chunks"), F.posexplode("chunks").alias("chunk_index", "piece"))
    rows = rows.withColumn("content", tx.strip("piece")).filter("content <> ''").drop("piece")
    return rows.withColumn("chunk_id", chunk_id(F.col("url"), F.col("chunk_index"), F.col("content")))


def greedy_pack(items: Column, size: int = PACK_SIZE) -> Column:
    """Items packed with single spaces into pieces of at most ``size``; longer items are cut by themselves; nothing gives one empty piece."""
    clean = F.filter(F.transform(items, tx.strip), lambda x: x != "")

    def state(done: Column, held: Column, length: Column) -> Column:
        return F.struct(done.alias("done"), held.alias("held"), length.alias("length"))

    empty = F.lit(None).cast("string")

    def step(a: Column, x: Column) -> Column:
        n = F.length(x)
        flushed = F.concat(a["done"], F.when(a["held"].isNotNull(), F.array(a["held"])).otherwise(F.array().cast("array<string>")))
        cuts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.substring(x, i * size + 1, F.lit(size)))
        full = a["held"].isNotNull() & (a["length"] + n + 1 > size)
        return (
            F.when(n > size, state(F.concat(flushed, cuts), empty, F.lit(0)))
            .when(full, state(flushed, x, n + 1))
            .otherwise(state(a["done"], F.when(a["held"].isNull(), x).otherwise(F.concat(a["held"], F.lit(" "), x)), a["length"] + n + 1))
        )

    def finish(a: Column) -> Column:
        out = F.concat(a["done"], F.when(a["held"].isNotNull(), F.array(a["held"])).otherwise(F.array().cast("array<string>")))
        return F.when(F.size(out) == 0, F.array(F.lit(""))).otherwise(out)

    return F.aggregate(clean, state(F.array().cast("array<string>"), empty, F.lit(0)), step, finish)


def merge_tiny(bodies: Column, least: int = TINY_TOKENS) -> Column:
    """Bodies below ``least`` words go in front of the next one; the last stands as it is."""
    last = F.size(bodies) - 1
    indexed = F.transform(bodies, lambda b, i: F.struct(b.alias("b"), i.alias("i")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("held"))

    def step(a: Column, x: Column) -> Column:
        body = F.when(a["held"].isNull(), x["b"]).otherwise(F.concat(a["held"], F.lit("\n\n"), x["b"]))
        wait = (tx.word_count(body) < least) & (x["i"] < last)
        return F.struct(F.when(wait, a["done"]).otherwise(F.concat(a["done"], F.array(body))).alias("done"), F.when(wait, body).alias("held"))

    return F.aggregate(indexed, start, step, lambda a: a["done"])


def hierarchy_leaves(pages: DataFrame, size: int = PACK_SIZE) -> DataFrame:
    """Leaves of structured pages (url, sections: pos, heading, items), ids by place and content instead of random ones."""
    rows = pages.select("url", F.inline("sections")).filter(tx.strip("heading") != "")
    packed = rows.select("url", "pos", "heading", F.posexplode(greedy_pack(F.col("items"), size)).alias("piece_no", "content"))
    child = F.concat_ws("::", "url", "heading")
    leaf = F.sha2(F.concat_ws("\u001f", "url", F.col("pos").cast("string"), F.col("piece_no").cast("string"), "content"), 256)
    return packed.select(leaf.alias("grandchild_id"), child.alias("child_id"), F.col("url").alias("parent_id"), "heading", "pos", "piece_no", "content")


def hierarchy_children(pages: DataFrame) -> DataFrame:
    """One child for each non-blank heading: its items joined by spaces."""
    rows = pages.select("url", F.inline("sections")).filter(tx.strip("heading") != "")
    return rows.select(F.concat_ws("::", "url", "heading").alias("child_id"), F.col("url").alias("parent_id"), "heading", "pos", F.array_join("items", " ").alias("content"))


def hierarchy_parents(children: DataFrame) -> DataFrame:
    """Each parent's headings and contents in order."""
    block = F.concat(F.lit("Heading:\n"), "heading", F.lit("\n\nContent:\n"), "content")
    ordered = F.array_sort(F.collect_list(F.struct("pos", block.alias("b"))))
    return children.groupBy("parent_id").agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "\n\n").alias("content"), F.count(F.lit(1)).alias("child_count"))


# Fixed value: the heading of passages without one.
NO_HEADING = "PDF Content"


def by_heading(passages: DataFrame, key: str, pos: str = "pos", path: str = "path", text: str = "text", default: str = NO_HEADING) -> DataFrame:
    """key, heading, place (of headings in the order in which they are first seen) and texts in order; blank texts go.

    A heading is its path's parts joined by `` > ``, or the default where there are none.
    """
    heading = F.coalesce(tx.blank_to_null(F.array_join(F.filter(path, lambda p: tx.strip(p) != ""), " > ")), F.lit(default))
    rows = passages.select(key, F.col(pos).alias("__pos"), heading.alias("heading"), tx.strip(text).alias("__text")).filter("__text <> ''")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__text"))), lambda x: x["__text"])
    grouped = rows.groupBy(key, "heading").agg(F.min("__pos").alias("__first"), ordered.alias("texts"))
    return grouped.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("__first", "heading"))).select(key, "place", "heading", "texts")


def embedding_text(kind: str, text: Column) -> Column:
    """Text as the embedder wants it: kind is passage or query."""
    return F.concat(F.lit(f"{kind}: "), text)


def content_template(heading: Column, path: Column, content: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("Heading: "), heading), F.concat(F.lit("Subheading: "), F.array_join(path, " > ")), F.lit("Content:"), content)
