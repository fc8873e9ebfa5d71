import os
import tracemalloc

import pyarrow as pa

from pyspark.sql import functions as F

from gristmill.functions import tables
from gristmill.functions.html import blocks_of, blocks_of_batch, html_blocks, links_of, title_of
from gristmill.functions.splitting import recursive_split
from gristmill.operators import pages as pg
from gristmill.sources import files


def pages(spark, *rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")


def test_links_of_parsed_pages():
    html = """<a href='../a'>x</a><A HREF="b/c?q=1#f">y</A><a class=z href=/d/>z</a><a href="//other.org/p">o</a><a href="mailto:x@y">m</a>
      <a href="javascript:go()">j</a><!-- <a href="no">n</a> --><a name="n">n</a><a href="http://[bad">b</a><a href=" e&amp;f ">e</a>"""
    assert links_of(html, "https://h.org/x/y") == ["https://h.org/a", "https://h.org/x/b/c?q=1#f", "https://h.org/d/", "https://other.org/p", "mailto:x@y", "javascript:go()", "https://h.org/x/e&f"]
    assert links_of('<base href="/deep/"><a href="k">k</a>', "https://h.org/") == ["https://h.org/deep/k"] and links_of(None, None) == []


def test_blocks_of_a_batch_stay_compact():
    """Python objects of a few pages at a time, whatever the size of the batch."""
    html = "<div><h1>h</h1>" + "<p>some <a href='x'>text</a></p>" * 40 + "</div>"
    peaks = []
    for n in (300, 3000):
        h, u = pa.array([html] * (n - 1) + [None]), pa.array(["http://h/"] * n)
        tracemalloc.start()
        found = blocks_of_batch(h, u)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert len(found) == n and found[0].as_py() == blocks_of(html, "http://h/") and found[n - 1].as_py() == []
    assert peaks[1] < 2 * peaks[0]


def test_titles_decode_whole_references():
    titles = {"cut&amp;&amp": "cut&&amp", "a&am": "a&am", "&lt;b&gt; &#65;&#x42; &eacute;": "<b> AB é", "R&D &copy 1 &nosuch; &notit;": "R&D &copy 1 &nosuch; &notit;", "x & y&": "x & y&"}
    assert {t: title_of(f"<html><head><title>{t}</title></head><p>&amp</p>") for t in titles} == titles and title_of(None) == ""


def test_crawl_stays_on_its_host(spark):
    p = pages(
        spark,
        ("https://h.org/x/y", """<a href='../a'>1</a><a href="b/c/">2</a><a href='https://OTHER.org/p'>3</a><a href="/login">4</a><a href="pic.jpg">5</a><a href="tel:12">6</a>"""),
        ("https://h.org/a", "<a href='HTTPS://H.ORG/x/y?again#top'>back</a><a href='d'>d</a>"),
        (None, "<a href='k'>k</a>"),
        ("https://h.org/n", None),
    )
    edges = sorted(map(tuple, pg.link_edges(p, same_host=True, junk=pg.JUNK).collect()))
    assert ("https://h.org/x/y", "https://h.org/a") in edges and ("https://h.org/x/y", "https://h.org/x/b/c") in edges and ("https://h.org/a", "https://h.org/d") in edges
    assert len(edges) == 4 and not any(w in t for _, t in edges for w in ("OTHER", "login", "jpg", "tel"))
    start = spark.createDataFrame([("https://h.org/x/y",)], "url string")
    got = {r["url"]: r["depth"] for r in pg.crawl(pg.link_edges(p, True, pg.JUNK), start).collect()}
    assert got == {"https://h.org/x/y": 0, "https://h.org/a": 1, "https://h.org/x/b/c": 1, "https://h.org/d": 2, "HTTPS://H.ORG/x/y": 2} or got == {"https://h.org/x/y": 0, "https://h.org/a": 1, "https://h.org/x/b/c": 1, "https://h.org/d": 2, "https://H.ORG/x/y": 2}
    assert any(t == "https://OTHER.org/p" for _, t in map(tuple, pg.link_edges(p).collect()))


FAQ = """<h1>Main heading</h1><p>Some body text here.</p><div class="tab-title">How?</div><div class="tab-content">Like this.</div><div class="tab-content">Or like that.</div>
  <div class="tab-content"></div><div class="tab-title">Open question</div><div class="tab-title">Why?</div><div class="tab-content">Because Quick Links.</div>"""


def test_questions_and_answers_in_text_and_sections(spark):
    p = pages(spark, ("https://h.org/", FAQ), ("https://h.org/none", "<p>nothing asked here</p>"), ("https://h.org/orphan", "<div class='tab-content'>orphan answer</div>"))
    text = {r["page_id"]: r["text"].split("\n") for r in pg.page_text(p, "tab-title", "tab-content").collect()}
    assert text[0][-2:] == ["Q: How? | A: Like this.", "Q: Why? | A: Because Quick Links."] and "Some body text here." in text[0]
    assert text[1] == ["nothing asked here"] and text[2] == ["orphan answer"]
    found = {(r["page_id"], r["heading"]): r["items"] for r in pg.sections(p, question="tab-title", answer="tab-content", blocked_lines=("quick links",)).collect()}
    assert found[0, pg.QUESTIONS] == ["Q: How? | A: Like this.", "Q: How? | A: Or like that."] and found[0, "Main heading"] == ["Some body text here."]
    assert (1, pg.QUESTIONS) not in found and (2, pg.QUESTIONS) not in found
    plain = pg.sections(p).select("page_id", "heading", "items").exceptAll(pg.sections(p, question="zz", answer="yy").select("page_id", "heading", "items"))
    assert plain.count() == 0


def test_table_functions_equal_column_functions(spark):
    tables.register(spark)
    p = pages(spark, ("https://h.org/", FAQ + "<ul><li>one <a href='x'>link</a></li></ul>"), ("https://h.org/n", None), (None, "<p>text</p>"))
    p.createOrReplaceTempView("udtf_pages")
    sql = spark.sql("SELECT page_id, b.* FROM udtf_pages p, LATERAL html_blocks(p.html, p.url) b")
    frame = p.select("page_id", F.inline(html_blocks("html", "url")))
    assert sorted(map(repr, sql.collect())) == sorted(map(repr, frame.collect())) and sql.count() > 5
    docs = spark.createDataFrame([(1, "One. Two three.\n\nFour " * 40), (2, ""), (3, None)], "doc_id long, text string")
    docs.createOrReplaceTempView("udtf_docs")
    sql = spark.sql("SELECT doc_id, c.chunk_index, c.chunk FROM udtf_docs d, LATERAL recursive_split(d.text, 100, 20) c")
    frame = docs.select("doc_id", F.posexplode(recursive_split(F.col("text"), 100, 20)))
    assert sorted(map(tuple, sql.collect())) == sorted(map(tuple, frame.collect())) and sql.count() > 5


def test_documents_by_service_or_locally(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in/sub")
    for name, data in (("good.md", b"good"), ("slow.md", b"slow"), ("blank.md", b"blank"), ("sub/bad.md", b"\xff"), ("skip.txt", b"no")):
        with open(f"{tmp_path}/in/{name}", "wb") as f:
            f.write(data)

    def remote(path, content):
        if content in (b"slow", b"\xff"):
            raise TimeoutError("service")
        return "  " if content == b"blank" else "R:" + content.decode()

    local = lambda path, content: "L:" + content.decode()
    got = {os.path.basename(r["path"]): (r["text"], r["engine"], r["error"]) for r in files.read_documents(spark, f"{tmp_path}/in", remote, local, "*.md").collect()}
    assert got["good.md"] == ("R:good", "remote", None)
    assert got["slow.md"] == ("L:slow", "local", "remote: TimeoutError: service") and got["blank.md"] == ("L:blank", "local", "remote: no text")
    assert got["bad.md"] == (None, None, "remote: TimeoutError: service") and set(got) == {"good.md", "slow.md", "blank.md", "bad.md"}
    alone = files.read_documents(spark, f"{tmp_path}/in", None, local, "*.md").filter("engine is null").collect()
    assert len(alone) == 1 and alone[0]["error"].startswith("local: UnicodeDecodeError")


def test_older_layout_flattened(spark):
    html = """<div class="announcement">ad text of some length</div><p>before any heading</p><h1>Quick Links</h1><p>blocked section</p><h2>Quick Links Extra</h2><p>kept, not equal</p>
      <h4>no heading here</h4><h3>Last</h3><ul><li>item text <a href="/x">go</a></li></ul><p>kept, not equal</p><p>ALL RIGHTS reserved 2020</p><form><p>form text stays</p></form>"""
    p = pages(spark, ("https://h.org/a/b", html))
    found = pg.sections(p, blocked=["Quick Links"], headings=("h1", "h2", "h3"), equal=True, blocked_lines=("all rights reserved",), furniture=("announcement",), dropped={"nav"})
    assert pg.flattened(found).first()["text"] == "b - Introduction: before any heading\n\nQuick Links Extra: kept, not equal\n\nLast: item text go | go (https://h.org/x) kept, not equal form text stays\n"
