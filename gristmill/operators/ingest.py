"""From structured pages to records for the chunk store: entities by value type, leaves, embedding texts, ids, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import reliable
from ..functions import urls
from ..functions.splitting import recursive_split

# What marks a page part of questions and answers, the length kept whole, size and overlap of longer ones.
FAQ_MARK = "frequently asked questions"
WHOLE, LEAF_SIZE, LEAF_OVERLAP = 700, 500, 100
REQUIRED = ("grandchild_id", "parent_id", "source", "title", "heading", "type", "content", "embedding_text")
NOT_EMPTY = ("grandchild_id", "parent_id", "content", "embedding_text")


def _shown(v: Column) -> Column:
    """A JSON value as text; null reads as empty."""
    return F.coalesce(v.cast("string"), F.lit(""))


def semantic_entities(parts: DataFrame, all_names: str = "all names") -> DataFrame:
    """Entities of page parts (source, heading, value as a variant): source, title, heading, type, subcontent, content.

    Under a question heading every item is an entity; an object gives one for each key and a list of all its keys; an array is one
    text, a line for each item; a text stands as it is. Other values give nothing.
    """
    kind = F.schema_of_variant("value")
    items, pairs = F.try_variant_get("value", "$", "array<variant>"), F.try_variant_get("value", "$", "map<string,variant>")
    heading = F.coalesce("heading", F.lit(""))
    entity = "array<struct<type:string,heading:string,subcontent:string,content:string>>"

    def row(kind: str, head: Column, sub: Column | None, content: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), head.alias("heading"), (F.lit(None).cast("string") if sub is None else sub).alias("subcontent"), content.alias("content"))

    faq = F.transform(F.coalesce(items, F.transform(F.map_keys(pairs), lambda k: k.cast("variant"))), lambda x: row("faq", heading, None, _shown(x)))
    named = F.concat(
        F.transform(F.map_entries(pairs), lambda e: row("section", heading, e["key"], _shown(e["value"]))),
        F.array(row("list", F.concat(heading, F.lit(" list")), F.lit(all_names), F.array_join(F.map_keys(pairs), ", "))),
    )
    lines = F.array(row("section", heading, None, F.array_join(F.transform(items, lambda x: F.concat(_shown(x), F.lit("\n"))), "")))
    plain = F.array(row("section", heading, None, _shown(F.col("value"))))
    found = (
        F.when(F.lower(heading).contains(FAQ_MARK) & (items.isNotNull() | pairs.isNotNull()), faq)
        .when(pairs.isNotNull(), named)
        .when(items.isNotNull(), lines)
        .when(kind == "STRING", plain)
        .otherwise(F.array().cast(entity))
    )
    return parts.select("source", urls.title_from_url("source").alias("title"), F.inline(found)).select("source", "title", "heading", "type", "subcontent", "content")


def child_id(source: Column, heading: Column, subcontent: Column) -> Column:
    return F.concat_ws("::", source, heading, tx.blank_to_null(subcontent))


def entity_embedding_text(title: Column, heading: Column, subcontent: Column, kind: Column, content: Column) -> Column:
    """What is embedded for an entity: its place in words, then its content; a list of names says that it is one."""
    items = F.filter(F.transform(F.split(content, ","), tx.strip), lambda x: x != "")
    place = F.when((F.coalesce(title, F.lit("")) != "") & (F.lower(title) != F.lower(heading)), F.concat(title, F.lit(" — "), heading)).otherwise(heading)
    parts = F.filter(F.array(title, heading, subcontent), lambda p: F.coalesce(p, F.lit("")) != "")
    return F.when((kind == "list") & tx.is_name_list(items), F.concat(place, F.lit(" — full list of names in this category: "), content)).otherwise(
        F.concat(F.array_join(tx.adjacent_distinct(parts), " — "), F.lit("\n\n"), content)
    )


def leaves(entities: DataFrame, whole: int = WHOLE, size: int = LEAF_SIZE, overlap: int = LEAF_OVERLAP) -> DataFrame:
    """Leaves of entities: lists and short contents stay whole, longer ones are split; every leaf is embedded by the full content.

    Ids come from place and content, so a repeated run gives the same ones.
    """
    rows = entities.withColumn("content", tx.strip("content")).filter("content <> ''").withColumn("subcontent", F.coalesce("subcontent", F.lit("")))
    rows = rows.withColumn("embedding_text", entity_embedding_text(F.col("title"), F.col("heading"), F.col("subcontent"), F.col("type"), F.col("content")))
    keep = (F.col("type") == "list") | (F.length("content") <= whole)
    pieces = F.when(keep, F.array("content")).otherwise(recursive_split(F.when(~keep, F.col("content")), size, overlap))
    cut = rows.withColumn("pieces", pieces).select("*", F.posexplode("pieces").alias("piece_no", "piece"))
    place = F.concat_ws("\u001f", "source", "heading", "subcontent", F.col("piece_no").cast("string"), "piece")
    return cut.select(
        F.sha2(place, 256).alias("grandchild_id"), child_id(F.col("source"), F.col("heading"), F.col("subcontent")).alias("child_id"), F.col("source").alias("parent_id"),
        "source", "title", "heading", "subcontent", "type", "piece_no", F.col("piece").alias("content"), "embedding_text",
    )


def validated(rows: DataFrame, required: tuple[str, ...] = REQUIRED, not_empty: tuple[str, ...] = NOT_EMPTY) -> DataFrame:
    """The rows with their first violation in ``violation`` (null: valid): a quarantine column instead of an abort."""
    missing = [c for c in required if c not in rows.columns]
    if missing:
        return rows.withColumn("violation", F.lit(f"missing fields: {', '.join(missing)}"))
    checks = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required] + [F.when(tx.strip(F.col(c).cast("string")) == "", F.lit(f"empty {c}")) for c in not_empty]
    return rows.withColumn("violation", F.coalesce(*checks))


def chunk_records(chunks: DataFrame, source: str, index: str, content: str, tokens: Column | None = None) -> DataFrame:
    """id (source#chunk_0000), content, characters and tokens of numbered chunks; ``tokens`` counts words unless given."""
    return chunks.select(
        F.format_string("%s#chunk_%04d", source, index).alias("id"), F.col(source).alias("source"), F.col(content).alias("content"),
        F.length(content).alias("characters"), (tx.word_count(content) if tokens is None else tokens).alias("tokens"),
    )


def flat_records(pages: DataFrame, pieces: Column, default: str = "Document") -> DataFrame:
    """Text-first pages (parent_id, title, content) as one child and numbered leaves, without headings of their own."""
    heading = F.coalesce(tx.blank_to_null(tx.strip("title")), F.lit(default))
    rows = pages.select("parent_id", heading.alias("heading"), "content", F.posexplode(pieces).alias("i", "piece"))
    leaf = rows.select(
        F.concat_ws("::", "parent_id", F.lit("gc"), F.col("i").cast("string")).alias("id"), F.concat(F.col("parent_id"), F.lit("::child::0")).alias("child_id"), "parent_id", "heading", F.lit("grandchild").alias("level"), F.col("piece").alias("content")
    )
    child = pages.select(
        F.concat(F.col("parent_id"), F.lit("::child::0")).alias("id"), F.lit(None).cast("string").alias("child_id"), "parent_id", heading.alias("heading"), F.lit("child").alias("level"), "content"
    )
    return leaf.union(child)


def normal_structure(sections: DataFrame) -> DataFrame:
    """Edited structures (page_id, pos, heading, value as a variant) as heading and items: a text is one item, blanks and other values go.

    Headings that are equal once trimmed collide; the last one wins.
    """
    items = F.coalesce(F.try_variant_get("value", "$", "array<string>"), F.when(F.schema_of_variant("value") == "STRING", F.array(F.col("value").cast("string"))))
    clean = F.filter(F.transform(F.array_compact(items), tx.strip), lambda x: x != "")
    rows = sections.select("page_id", "pos", tx.strip("heading").alias("heading"), clean.alias("items")).filter("heading <> '' and size(items) > 0")
    return rows.groupBy("page_id", "heading").agg(F.max_by("items", "pos").alias("items"), F.min("pos").alias("pos"))


def review_text(sections: DataFrame, limit: int = 60_000) -> DataFrame:
    """page_id and the sections (pos, heading, items) as ``## heading`` and ``- item`` lines, cut for display."""
    block = F.concat(F.lit("## "), "heading", F.lit("\n"), F.array_join(F.transform("items", lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), ""))
    ordered = F.array_sort(F.collect_list(F.struct("pos", block.alias("b"))))
    return sections.groupBy("page_id").agg(F.substring(tx.strip(F.array_join(F.transform(ordered, lambda x: x["b"]), "\n")), 1, limit).alias("text"))


def new_content(rows: DataFrame, known: DataFrame, text: str) -> DataFrame:
    """Rows whose content hash the store doesn't hold."""
    return rows.withColumn("content_hash", F.sha2(text, 256)).join(known.select("content_hash").distinct(), "content_hash", "left_anti")


def zipped(items: Column, scores: Column) -> Column:
    """Items with the scores at their places; null where the lengths differ, which the caller treats as a failed scoring."""
    return F.when(F.size(items) == F.size(scores), F.zip_with(items, scores, lambda a, b: F.struct(a.alias("item"), b.alias("score"))))


def in_several_files(rows: DataFrame, url: str, file: str) -> DataFrame:
    """Urls that more than one file holds, with the files' names."""
    return rows.groupBy(url).agg(F.array_sort(F.collect_set(file)).alias("files")).filter(F.size("files") > 1)


def robots_allowed(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``allowed`` for every url by its host's rules (host, disallow: path prefixes); hosts without rules allow everything."""
    hosted = pages.withColumn("host", F.lower(F.try_parse_url(url, F.lit("HOST")))).withColumn("__path", F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("/")))
    joined = hosted.join(rules.select("host", "disallow"), "host", "left")
    blocked = F.exists("disallow", lambda p: (p != "") & F.col("__path").startswith(p))
    return joined.withColumn("allowed", ~F.coalesce(blocked, F.lit(False))).drop("disallow", "__path")


def targets_of(registry: DataFrame, schedule: str) -> DataFrame:
    """The entries of a registry (url, source, category, schedule) with a schedule tier, one a url: the first by source."""
    tier = registry.filter(F.col("schedule") == schedule)
    return tier.groupBy("url").agg(F.min(F.struct("source", "category")).alias("t")).select("url", "t.*")


def placed(rows: DataFrame, *order: Column, place: str = "place") -> DataFrame:
    """Rows with their place (from 1) in a total order, without gathering them in one task.

    Rows are dealt by ranges of the order; each part numbers its own and adds how many the parts before it hold.
    """
    dealt = reliable(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").count()  # a row for each part
    before = sizes.select("__part", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn(place, (F.col("__own") + F.col("__before")).cast("int")).drop("__part", "__own", "__before")


def differs(c: Column, value) -> Column:
    """Not equal; missing counts as different."""
    return ~c.eqNullSafe(F.lit(value))


def contains_any(c: Column, words: list[str]) -> Column:
    """Whether a text holds one of the words, case ignored."""
    return F.exists(F.array(*(F.lit(w.lower()) for w in words)), lambda w: F.contains(F.lower(c), w))


def find_one(rows: DataFrame, condition: Column, order: str) -> DataFrame:
    """The first matching row in the order of a column."""
    return rows.filter(condition).orderBy(order).limit(1)


def recent(rows: DataFrame, ts: str, key: str, limit: int, least: int = 1, most: int = 500) -> DataFrame:
    """The latest rows, a clamped number of them."""
    return rows.orderBy(F.desc(ts), F.desc(key)).limit(max(least, min(most, limit)))
