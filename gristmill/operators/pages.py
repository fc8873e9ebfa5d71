"""Pages: block text, heading sections, question-answer pairs, cards, and breadth-first crawl order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.html import DROPPED, FURNITURE, HEADINGS, html_blocks, html_links
from ..functions.urls import crawl_key, is_web_url
from ..session import reliable

# Substrings of addresses that a crawl leaves out, and the heading of questions and answers.
JUNK = ("mailto:", "tel:", ".jpg", ".png", ".jpeg", ".zip", "login", "signup", ".webp", ".mp4")
QUESTIONS = "Frequently Asked Questions"

BLOCKED_HEADINGS = ["quick links", "follow us", "contact us", "related links"]
LEAST_BLOCK = 8


def page_blocks(pages: DataFrame, furniture: tuple[str, ...] = FURNITURE, dropped: set[str] = DROPPED) -> DataFrame:
    """page_id, url and one row for each block element: pos, tag, cls, text, links."""
    return pages.select("page_id", "url", F.inline(html_blocks("html", "url", furniture, dropped)))


def question_lines(blocks: DataFrame, question: str, answer: str, every: bool = False) -> DataFrame:
    """page_id, q_pos, pos and line, ``Q: question | A: answer``, of every pair whose texts are not blank."""
    found = faq_pairs(blocks, question, answer, every).filter("question <> '' and answer <> ''")
    return found.select("page_id", "q_pos", "pos", F.concat(F.lit("Q: "), "question", F.lit(" | A: "), "answer").alias("line"))


def page_text(pages: DataFrame, question: str | None = None, answer: str | None = None) -> DataFrame:
    """Cleaned text of every page: block texts of more than two characters in document order, boilerplate and repeats gone.

    With class words for questions and answers, their pairs follow as lines of their own.
    """
    blocks = page_blocks(pages, ())
    rows = blocks.select("page_id", F.lit(0).alias("part"), "pos", F.when(F.length("text") > 2, F.col("text")).alias("text"))
    if question and answer:
        rows = rows.union(question_lines(blocks, question, answer).select("page_id", F.lit(1), "pos", "line"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("part", "pos", "text"))))
    joined = rows.groupBy("page_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("t"))
    return pages.select("page_id").join(joined, "page_id", "left").select("page_id", tx.clean_lines(tx.nfc(F.coalesce("t", F.lit("")))).alias("text"))


def sections(
    pages: DataFrame, blocked: list[str] = BLOCKED_HEADINGS, least: int = LEAST_BLOCK, question: str | None = None, answer: str | None = None, blocked_lines: tuple[str, ...] = (),
    headings: tuple[str, ...] = HEADINGS, equal: bool = False, furniture: tuple[str, ...] = FURNITURE, dropped: set[str] = DROPPED,
) -> DataFrame:
    """page_id, pos, heading, items: text under each heading with its links, headings of the same name merged.

    Text before the first heading goes under ``<last path segment> - Introduction``; short and repeated items go, and so do those that
    hold one of ``blocked_lines`` in any case, and headings that hold one of ``blocked`` in any case or, with ``equal``, are one.
    With class words for questions and answers, every answer is paired with the question before it in a section of its own at the end.
    ``headings``, ``furniture`` and ``dropped`` are the tags and class words that a site's layout asks for.
    """
    blocks = page_blocks(pages, furniture, dropped)
    rows = blocks.filter(F.col("tag").isin(*headings, "p", "table", "ul", "ol"))
    heading = F.when(F.col("tag").isin(*headings) & (F.col("text") != ""), F.col("text"))
    order = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    intro = F.concat(F.element_at(F.split(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/+$", ""), "/"), -1), F.lit(" - Introduction"))
    filled = rows.withColumn("heading", F.coalesce(F.last(heading, ignorenulls=True).over(order), intro))
    links = F.array_join(F.transform("links", lambda x: F.concat(F.lit(" | "), x["label"], F.lit(" ("), x["href"], F.lit(")"))), "")
    body = filled.filter(~F.col("tag").isin(*headings) & (F.length("text") >= least)).withColumn("item", F.concat("text", links))
    gone = F.col("heading").isin(*blocked) if equal else F.lower("heading").rlike("|".join(blocked))
    named = body.filter(~gone).select("page_id", "heading", "pos", "item") if blocked else body.select("page_id", "heading", "pos", "item")
    if question and answer:
        lines = question_lines(blocks, question, answer, every=True)
        named = named.union(lines.select("page_id", F.lit(QUESTIONS), F.lit(1 << 30) + F.col("pos"), "line"))
    for word in blocked_lines:
        named = named.filter(~F.contains(F.lower("item"), F.lit(word.lower())))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "item")))
    return named.groupBy("page_id", "heading").agg(F.min("pos").alias("pos"), F.array_distinct(F.transform(ordered, lambda x: x["item"])).alias("items"))


def flattened(found: DataFrame) -> DataFrame:
    """page_id and text: of each page's sections in order ``heading: items`` and a blank line."""
    line = F.concat("heading", F.lit(": "), F.array_join("items", " "), F.lit("\n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"])
    return found.groupBy("page_id").agg(F.array_join(ordered, "\n").alias("text"))


def faq_pairs(blocks: DataFrame, question: str = "title", answer: str = "content", every: bool = False) -> DataFrame:
    """page_id, q_pos, question, pos, answer: each question (a block whose class holds ``question``) with the first answer block after it
    and before the next question, or with ``every`` such answer."""
    q = F.col("cls").contains(question)
    a = F.col("cls").contains(answer) & ~q
    rows = blocks.filter(q | a).withColumn("is_q", q)
    order = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    asked = F.last(F.when(F.col("is_q"), F.struct(F.col("pos").alias("q_pos"), F.col("text").alias("question"))), ignorenulls=True).over(order)
    pairs = rows.withColumn("asked", asked).filter("not is_q and asked is not null").select("page_id", "asked.*", "pos", F.col("text").alias("answer"))
    if every:
        return pairs
    first = F.row_number().over(Window.partitionBy("page_id", "q_pos").orderBy("pos"))
    return pairs.withColumn("n", first).filter("n = 1").drop("n")


def cards(rows: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """name and description of card texts, cut at the first line end; the last of equal names wins."""
    parts = F.split(text, "\n", 2)
    named = rows.select(key, order, tx.strip(parts[0]).alias("name"), tx.strip(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))).alias("description")).filter("name <> ''")
    return named.groupBy(key, "name").agg(F.max_by("description", order).alias("description"))


def crawl(edges: DataFrame, start: DataFrame, depth: int = 3, pages: int = 2500) -> DataFrame:
    """url and least depth of what a breadth-first crawl visits: every round joins the frontier with the edges and leaves out the visited.

    At most ``pages`` urls, shallow ones first, then by name. Every frontier is written to reliable storage, so a round reads the
    edges once and its plan doesn't grow with the depth.
    """
    seen = frontier = reliable(start.select("url").distinct().withColumn("depth", F.lit(0)))
    for d in range(1, depth + 1):
        found = edges.join(frontier.select(F.col("url").alias("source")), "source", "left_semi").select(F.col("target").alias("url")).distinct()
        frontier = reliable(found.join(seen, "url", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen.orderBy("depth", "url").limit(pages)


def link_edges(pages: DataFrame, same_host: bool = False, junk: tuple[str, ...] = ()) -> DataFrame:
    """source and target of every page's links to web pages, as crawl keys.

    Links are those of the parsed page, joined to its address. ``same_host`` leaves out other hosts than the page's own, ``junk``
    addresses that hold one of these substrings.
    """
    links = pages.select("url", F.explode(html_links("html", "url")).alias("href")).filter(is_web_url(F.col("href")))
    if same_host:
        host = lambda c: F.lower(F.try_parse_url(F.col(c), F.lit("HOST")))
        links = links.filter(host("href") == host("url"))
    edges = links.select(crawl_key("url").alias("source"), crawl_key("href").alias("target"))
    for word in junk:
        edges = edges.filter(~F.contains("target", F.lit(word)))
    return edges.distinct()
