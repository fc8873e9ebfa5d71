"""Ingest, files, hooks and periodic work on literal rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gristmill.functions.splitting import split_text
from gristmill.operators import chunking, hooks, ingest, pages
from gristmill.sources import files
from gristmill.streaming import evaluation

PAGE = {
    "https://x.example/clubs/art-room": {"Clubs": {"Chess": "board games", "Band": None}, "FREQUENTLY asked questions": ["Q1 A1", 2], "Intro": "plain text", "Odd": 5, "Items": ["a", None, "b"]},
    "https://x.example/bad": "no sections",
}


def parts(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(PAGE, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "two.json").write_text("[1, 2", encoding="utf-8")
    return files.read_keyed(spark, str(tmp_path))


def test_keyed_files_and_entities(spark, tmp_path):
    found = parts(spark, tmp_path)
    assert {(r["file"], r["source"], r["heading"]) for r in found.select("file", "source", "heading").collect()} == {("one.json", "https://x.example/clubs/art-room", h) for h in PAGE["https://x.example/clubs/art-room"]}
    got = sorted((r["type"], r["heading"], r["subcontent"] or "", r["content"], r["title"]) for r in ingest.semantic_entities(found).collect())
    assert got == sorted(
        (*x, "Art Room")
        for x in [
            ("section", "Clubs", "Chess", "board games"), ("section", "Clubs", "Band", ""), ("list", "Clubs list", "all names", "Band, Chess"), ("faq", "FREQUENTLY asked questions", "", "Q1 A1"),
            ("faq", "FREQUENTLY asked questions", "", "2"), ("section", "Intro", "", "plain text"), ("section", "Items", "", "a\n\nb\n"),
        ]
    )


def test_leaves(spark):
    long = " ".join(f"word{i}." for i in range(200))
    rows = [("s", "T", "H", "section", None, long), ("s", "T", "t", "list", "all names", long), ("s", "T", "H", "section", "sub", " short "), ("s", "T", "H", "faq", None, " ")]
    frame = spark.createDataFrame(rows, "source string, title string, heading string, type string, subcontent string, content string")
    got = ingest.leaves(frame).orderBy("child_id", "piece_no").collect()
    by_child = {}
    for r in got:
        by_child.setdefault(r["child_id"], []).append(r)
    assert [r["content"] for r in by_child["s::H"]] == split_text(long, 500, 100)
    assert all(r["embedding_text"] == "T — H\n\n" + long for r in by_child["s::H"])
    assert [r["content"] for r in by_child["s::t::all names"]] == [long] and [r["content"] for r in by_child["s::H::sub"]] == ["short"]
    assert len({r["grandchild_id"] for r in got}) == len(got) and all(r["violation"] is None for r in ingest.validated(ingest.leaves(frame)).collect())
    assert sorted(map(tuple, ingest.leaves(frame.repartition(3)).collect())) == sorted(map(tuple, got))


def test_validation_names_the_first_violation(spark):
    assert ingest.validated(spark.range(1)).first()["violation"].startswith("missing fields: grandchild_id")


def test_objects_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "é", None), (2, "b", "x")], "a long, b string, c string")
    files.write_objects(rows, f"{tmp_path}/out", 1)
    back = spark.read.schema("a long, b string, c string").json(f"{tmp_path}/out")
    assert sorted(map(tuple, back.collect())) == [(1, "é", None), (2, "b", "x")]
    (tmp_path / "in").mkdir()
    for name in ("x", "y"):
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps([{"url": "u1", "n": 1}, {"url": name, "n": 2}], indent=1))
    found = files.read_objects(spark, f"{tmp_path}/in", "url string, n int")
    assert [tuple(r) for r in ingest.in_several_files(found, "url", "file").collect()] == [("u1", ["x.json", "y.json"])]
    (tmp_path / "urls.txt").write_text("u1\n\n u2 \nu1\n")
    assert sorted(r[0] for r in files.read_lines(spark, f"{tmp_path}/urls.txt").collect()) == ["u1", "u2"]


def test_hooks(spark):
    calls = []

    def embed(texts):
        calls.append(len(texts))
        assert len(texts) <= 2 and all(len(t) <= 3 for t in texts)
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([(1, "abcdef"), (2, None), (3, "a"), (4, "")], "i int, t string").coalesce(1)
    got = {r["i"]: r["v"] for r in rows.select("i", hooks.embed_column(F.col("t"), embed, batch=2, limit=3).alias("v")).collect()}
    assert got == {1: [3.0, 1.0], 2: None, 3: [1.0, 1.0], 4: [0.0, 1.0]}
    pairs = spark.createDataFrame([("red stone", "a red house"), ("", "x"), ("Ünder", "ünder way")], "q string, t string")
    assert [r["score"] for r in hooks.rerank(pairs, "q", "t").collect()] == [0.5, 0.0, 1.0]
    assert [r["score"] for r in hooks.rerank(pairs, "q", "t", lambda q, t: [len(a) + len(b) for a, b in zip(q, t)]).collect()] == [20.0, 1.0, 14.0]
    wrong = rows.filter("i = 1").select(hooks.embed_column(F.col("t"), lambda texts: [], batch=2))
    with pytest.raises(Exception, match="0 vectors for 1 texts"):
        wrong.collect()
    bad = hooks.judged(spark.range(1), {"s": F.lit(float("nan"))})
    assert bad.first()["s"] is None


def test_evaluator_judges_every_row_once(spark):
    rows = [(i, ["qdrant"], None if i % 4 else "broken", 10 * i) for i in range(20)]
    metrics = spark.createDataFrame(rows, "id long, sources array<string>, error string, total_ms long")
    done = spark.createDataFrame([], "id long")
    seen = []
    for _ in range(4):
        new, marks = evaluation.evaluate_once(metrics, done, {"faithfulness": F.col("total_ms") / 100}, F.to_timestamp(F.lit("2024-01-01")), n=6)
        seen += [r["id"] for r in new.collect()]
        done = spark.createDataFrame(done.collect() + marks.select("id").collect(), "id long")
    assert sorted(seen) == [i for i in range(20) if i % 4]


def test_schedules_and_retries(spark):
    now = F.to_timestamp(F.lit("2024-01-01 12:00:00"))
    rows = [("fresh", 30, dt.datetime(2024, 1, 1, 11, 45), False), ("due", 30, dt.datetime(2024, 1, 1, 8, 0), False), ("busy", 30, dt.datetime(2024, 1, 1, 8, 0), True), ("first", 360, None, None)]
    plans = spark.createDataFrame(rows, "name string, minutes int, last_run timestamp, running boolean")
    assert sorted(r["name"] for r in evaluation.interval_due(plans, now).collect()) == ["due", "first"]
    flags = spark.createDataFrame([(1, 3, True), (2, 1, True), (3, 2, False), (4, 0, None)], "id int, requested_at int, retry boolean")
    assert [r["id"] for r in evaluation.retry_due(flags).collect()] == [2, 1]


def test_sessions_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(u, t0 + dt.timedelta(minutes=m)) for u in (1, 2) for m in (0, 5, 20, 90, 95, 600)]
    frame = spark.createDataFrame(rows, "user_id int, ts timestamp")
    batch = sorted(map(tuple, evaluation.sessions(frame).collect()))
    assert [r[3] for r in batch] == [3, 2, 1] * 2
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = evaluation.sessions(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("sessions").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("sessions").collect())) == batch


def test_crawl_is_breadth_first(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("b", "a")], "source string, target string")
    start = spark.createDataFrame([("a",)], "url string")
    assert sorted(map(tuple, pages.crawl(edges, start).collect())) == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)]
    assert [r["url"] for r in pages.crawl(edges, start, pages=2).collect()] == ["a", "b"]


def test_zip_robots_and_blocklists(spark):
    row = spark.range(1).select(ingest.zipped(F.array(F.lit("a")), F.array(F.lit(1), F.lit(2))).alias("bad"), ingest.zipped(F.array(F.lit("a")), F.array(F.lit(1))).alias("good"), ingest.differs(F.lit(None).cast("string"), "x").alias("d"), ingest.contains_any(F.lit("My HOME page"), ["home"]).alias("c")).first()
    assert row["bad"] is None and row["good"][0]["score"] == 1 and row["d"] and row["c"]
    urls = spark.createDataFrame([(1, "https://A.example/x/1"), (2, "https://a.example/y"), (3, "https://b.example/x"), (4, "https://a.example")], "i int, url string")
    rules = spark.createDataFrame([("a.example", ["/x", ""])], "host string, disallow array<string>")
    assert {r["i"]: r["allowed"] for r in ingest.robots_allowed(urls, rules).collect()} == {1: False, 2: True, 3: True, 4: True}


def test_adaptive_chunks_of_literal_pages(spark):
    body = " ".join(f"Sentence number {i} stands here." for i in range(120))
    rows = [("u1", body, "s1", "events", "T"), ("u2", body, "s2", "law", None), ("u3", "too short", "s1", "law", "T"), ("u4", body, "s1", "own_kind", "T")]
    frame = spark.createDataFrame(rows, "url string, content string, source string, category string, title string")
    got = {}
    for r in chunking.adaptive_chunks(frame, {"s1": "First - {}"}, [*chunking.EVENT_CATEGORIES, "own_kind"]).orderBy("url", "chunk_index").collect():
        got.setdefault(r["url"], []).append(r)
    want = {"u1": split_text("First - T\n\n" + body, 500, 75), "u2": split_text(body, 1000, 150), "u4": split_text("First - T\n\n" + body, 500, 75)}
    assert {u: [r["content"] for r in v] for u, v in got.items()} == {u: [c.strip() for c in v if c.strip()] for u, v in want.items()}
    assert all(r["total_chunks"] == len(want[u]) for u, v in got.items() for r in v)
    assert len({r["chunk_id"] for v in got.values() for r in v}) == sum(map(len, got.values()))


def test_page_text_and_sections_of_literal_pages(spark):
    html = """<html><head><title>x</title><script>var a = "<p>no</p>";</script></head><body><nav><ul><li>Menu entry here</li></ul></nav>
<p>Words before any heading.</p><h2>First part</h2><p>A paragraph of the first part.</p><p>tiny</p><h2>Quick Links</h2><p>Not to be kept anywhere.</p>
<h2>First part</h2><p>More of it with <a href="/more">a link</a>.</p></body></html>"""
    page = spark.createDataFrame([(1, "https://x.example/a/topic", html)], "page_id int, url string, html string")
    text = pages.page_text(page).first()["text"].split("\n")
    assert "A paragraph of the first part." in text and "Words before any heading." in text and not any("var a" in t for t in text)
    got = {r["heading"]: r["items"] for r in pages.sections(page).collect()}
    assert got["topic - Introduction"] == ["Words before any heading."]
    assert got["First part"][0] == "A paragraph of the first part." and got["First part"][1].startswith("More of it with a link") and "(https://x.example/more)" in got["First part"][1]
    assert "Quick Links" not in got
