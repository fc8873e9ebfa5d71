"""Literal rows for the algorithms that the tables don't exercise."""

import datetime as dt
import time

from pyspark.sql import functions as F

from gristmill.functions import text as tx
from gristmill.functions import urls
from gristmill.functions.html import blocks_of
from gristmill.functions.splitting import split_text
from gristmill.operators import changes, chat, chunking, dedup, pages, reminders, retrieval, store, telemetry


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def of(spark, rows, schema, *columns):
    return [tuple(r) if len(r) > 1 else r[0] for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_scripts(spark):
    rows = [("தமிழ்",), ("हिन्दी",), ("తెలుగు",), ("ಕನ್ನಡ",), ("മലയാളം",), ("Namaste",), ("हिन्दी தமிழ்",), (None,)]
    assert of(spark, rows, "t string", tx.script_language("t")) == ["ta", "hi", "te", "kn", "ml", "en", "ta", "en"]


def test_cleaning(spark):
    raw = " keep this  line \n\nab\nHome\nSKIP to content\nkeep this  line\nkeep this line\nAll rights reserved 2020\n"
    assert one(spark, tx.clean_lines(F.lit(raw)))[0] == "keep this line\nkeep this line"
    assert one(spark, tx.clean_markdown(F.lit("# Title **bold**\n## Two\n  # three")))[0] == "Title bold\n## Two\nthree"
    assert one(spark, tx.collapse(F.lit(" a \t b\n")))[0] == "a b"
    assert of(spark, [("é",)], "t string", tx.nfc("t")) == ["é"]
    assert one(spark, tx.rewrite_wording(F.lit("It Is Scheduled For May, scheduled for June")))[0] == "It takes place on May, on June"
    assert of(spark, [("Hello",), ("--",), ("தமிழ்",)], "t string", tx.is_placeholder("t"), tx.is_placeholder("t", True)) == [(False, False), (True, True), (True, False)]
    assert one(spark, tx.split_smashed(F.lit("helloWorld9Big")))[0] == "hello World9 Big"
    assert one(spark, tx.strip_fenced_code(F.lit("a```x\ny```b")), tx.truncate(F.lit("abcdef"), 3)) == ("ab", "abc…")
    assert of(spark, [("A title",), ("ends with,",), ("one two three four five six seven.",), ("",)], "t string", tx.plausible_heading("t")) == [True, False, False, False]


def test_breadcrumbs(spark):
    link = lambda s: f"{s} (https://x.example/a)"
    rows = [(link("Home") + " | " + link("News"),), (link("Home"),), (link("a") + "|b|" + link("c") + "|d|e",), (link("a") + "|b|" + link("c") + "|d|" + link("e"),), ("x" * 31 + " (https://x.example)|" + link("y" * 31),)]
    assert of(spark, rows, "t string", tx.is_breadcrumb("t")) == [True, False, False, True, False]
    words = " | ".join(link("one two three four five six") for _ in range(4))
    frame = spark.createDataFrame([(1, "a", words), (2, "b", words), (3, "b", "real content"), (4, "c", link("x") + "|" + link("y"))], "id int, source string, text string")
    assert sorted((r["id"], r["restored"]) for r in dedup.filter_breadcrumbs(frame, "text", "source").collect()) == [(1, True), (3, False)]


def test_urls(spark):
    rows = [("HTTP://X.Example/a/b//?b=2&a=1&a=3&c=#frag",), ("https://x.example/",), ("https://x.example",), (None,)]
    assert of(spark, rows, "u string", urls.normalize_url("u")) == ["http://x.example/a/b?a=%5B%271%27%2C+%273%27%5D&b=2&c=", "https://x.example/", "https://x.example", None]
    rows = [("https://x.example/a/new-page_two/?q=1",), ("https://x.example/",), ("ftp://x.example/a",)]
    assert of(spark, rows, "u string", urls.title_from_url("u"), urls.is_web_url("u")) == [("New Page Two", True), ("Home", True), ("A", False)]
    assert of(spark, [("https://x.example/a/b", "../c")], "b string, h string", urls.url_join("b", "h")) == ["https://x.example/c"]


def test_percentile_and_rounding(spark):
    for n, want in ((1, 1), (19, 19), (20, 20), (21, 20)):
        assert one(spark, telemetry.array_percentile(F.sequence(F.lit(1), F.lit(n)), 0.95))[0] == want
    assert one(spark, telemetry.rate(F.lit(1), F.lit(0)), telemetry.rate(F.lit(1), F.lit(3))) == (0.0, 0.3333)
    empty = spark.createDataFrame([], "id int, created_at timestamp, a_ms bigint")
    assert [tuple(r) for r in telemetry.stage_stats(empty, ["a_ms"]).collect()] == [("a_ms", None, None, None, 0)]


def test_splitter():
    assert split_text("abc def", 100, 10) == ["abc def"]
    assert split_text("a" * 25, 10, 0) == ["a" * 10, "a" * 10, "a" * 5]
    assert split_text("one two three four", 9, 0) == ["one two", "three", "four"]
    overlapped = split_text("aa bb cc dd ee", 6, 3)
    assert overlapped == ["aa bb", "bb cc", "cc dd", "dd ee"]
    assert split_text("p1 x\n\np2 y", 6, 0) == ["p1 x", "p2 y"]
    assert all(len(c) <= 20 for c in split_text("👍 " * 100, 20, 5))
    text = "word " * 400
    assert "".join(split_text(text, 50, 0)).replace(" ", "") == text.replace(" ", "")


def test_packing_and_merging(spark):
    pack = lambda items: one(spark, chunking.greedy_pack(F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")))[0]
    assert pack([]) == [""] and pack([" ", ""]) == [""]
    assert pack(["a" * 500]) == ["a" * 500]
    assert pack(["a" * 501, "b"]) == ["a" * 500, "a", "b"]
    assert pack(["x", "a" * 1200]) == ["x", "a" * 500, "a" * 500, "a" * 200]
    assert pack(["a" * 250, "b" * 248]) == ["a" * 250 + " " + "b" * 248]
    assert pack(["a" * 250, "b" * 249]) == ["a" * 250, "b" * 249]
    merge = lambda items: one(spark, chunking.merge_tiny(F.array(*map(F.lit, items)), 3))[0]
    assert merge(["a", "b", "c d e", "f"]) == ["a\n\nb\n\nc d e", "f"]


def test_rerank_rule(spark):
    def kept(scores):
        frame = spark.createDataFrame([(1, i + 1, s) for i, s in enumerate(scores)], "query_id int, rank int, score double")
        return [r["rank"] for r in retrieval.rerank_filter(frame).orderBy("position").collect()]

    assert kept([0.9, 0.85, 0.79, 0.77]) == [1, 2, 3]
    assert kept([0.15, 0.1]) == [1, 2]
    assert kept([0.9] * 10) == list(range(1, 9))
    assert kept([0.1, 0.9, 0.05, 0.04]) == [2, 1, 3]
    assert kept([]) == []


def test_responses(spark):
    rows = [
        ('{"answer": "hi", "entities": [{"name": "n", "type": "t", "date": "d"}]}', "hi", "whole"),
        ('<think>{"answer": "no"}</think>\n```json\n{"answer": "yes"}\n```', "yes", "whole"),
        ('<think>never closed {"answer": "x"}', '', "text"),
        ('Sure! {"answer": "mid"} bye', "mid", "braces"),
        ("plain words", "plain words", "text"),
        ('{"other": 1}', '{"other": 1}', "text"),
    ]
    frame = chat.parse_responses(spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string"), "t", "p")
    got = [(r["p"]["answer"], r["p"]["form"]) for r in frame.orderBy("i").collect()]
    assert got == [(r[1], r[2]) for r in rows]


def test_routing(spark):
    rows = [(["qdrant", "reminder"], None), (["bogus"], ["meta"]), (["meta", "meta"], []), ([], ["reminder"])]
    frame = spark.createDataFrame(rows, "a array<string>, b array<string>")
    result = chat.router_result(F.col("a"), F.col("b"))
    assert [r[0] for r in frame.select(chat.route(result)).collect()] == ["qdrant+reminder", "meta", "qdrant", "reminder"]


def test_reminder_parsing(spark):
    rows = [("15m",), (" 2 H ",), ("1d",), ("1w",), ("at_event",), ("",), ("soon",), ("1.5h",)]
    assert of(spark, rows, "o string", reminders.offset_minutes(F.col("o"))) == [15, 120, 1440, 10080, 0, 0, None, None]
    rows = [("2026-06-20T10:00:00",), ("2026-06-20T10:00:00Z",), ("2026-06-20 14:30:00",), ("bad",)]
    shown = F.date_format(reminders.event_time(F.col("t")), "yyyy-MM-dd HH:mm")
    assert of(spark, rows, "t string", shown) == ["2026-06-20 04:30", "2026-06-20 10:00", "2026-06-20 09:00", None]


def test_delivery_is_idempotent(spark):
    schema = "reminder_id int, notification_type string, in_app_sent_at timestamp, email_sent_at timestamp"
    base = spark.createDataFrame([(1, "both", None, None), (2, "in_app", None, None)], schema)
    half = spark.createDataFrame([(1, True, False), (2, True, False)], "reminder_id int, in_app_ok boolean, email_ok boolean")
    full = spark.createDataFrame([(1, True, True), (2, True, True)], half.schema)
    now = lambda s: F.to_timestamp(F.lit(s))
    first = reminders.deliver(base, half, now("2024-01-01 00:00:00"))
    assert sorted((r["reminder_id"], r["delivery"]) for r in first.collect()) == [(1, "partial"), (2, "sent")]
    again = reminders.deliver(base.select("reminder_id", "notification_type").join(first.drop("delivery"), "reminder_id"), full, now("2024-01-02 00:00:00"))
    rows = {r["reminder_id"]: r for r in again.collect()}
    assert rows[1]["in_app_sent_at"] == dt.datetime(2024, 1, 1) and rows[1]["email_sent_at"] == dt.datetime(2024, 1, 2) and rows[1]["delivery"] == "sent"
    assert rows[2]["email_sent_at"] is None


def test_change_cycle(spark):
    schema = "url string, content_hash string, last_scraped timestamp, last_changed timestamp, scrape_count int, chunk_ids array<string>, source string, category string, status string"
    history = changes.mark_errors(spark.createDataFrame([], schema), spark.createDataFrame([("u", "s", "c")], "url string, source string, category string"), F.to_timestamp(F.lit("2024-01-01")))
    row = history.first()
    assert (row["content_hash"], row["status"], row["scrape_count"]) == ("", "error", 1)
    found = changes.detect(spark.createDataFrame([("u", "text")], "url string, content string"), history)
    assert found.first()["change"] == "modified"


def test_store_rewrites(spark):
    target = spark.createDataFrame([(1, "a", "old"), (2, "b", "old")], "id int, v string, created string")
    got = store.upsert(target, spark.createDataFrame([(2, "B", "new"), (3, "C", "new")], target.schema), ["id"], ["created"])
    assert sorted(map(tuple, got.collect())) == [(1, "a", "old"), (2, "B", "old"), (3, "C", "new")]
    assert store.insert_absent(target, spark.createDataFrame([(2, "x", "n"), (4, "y", "n"), (4, "z", "n")], target.schema), ["id"]).count() == 3
    updated = store.update_where(target, F.col("id") == 1, {"v": F.lit("z")})
    assert sorted((r["id"], r["v"], r["matched"]) for r in updated.collect()) == [(1, "z", True), (2, "b", False)]
    states = spark.createDataFrame([("k", dt.datetime(2024, 1, 2)), ("old", dt.datetime(2023, 1, 1))], "key string, expires_at timestamp")
    taken, left = store.consume_once(states, F.col("key") == "k", F.to_timestamp(F.lit("2024-01-01")))
    assert taken.count() == 1 and [r["key"] for r in left.collect()] == ["old"]


def test_html(spark):
    html = '<h1>Top</h1><p>first <b>para<p>second para <a href="/x">link</a> <a href="javascript:no()">bad</a></p><nav><p>menu</p></nav><div class="side-menu"><p>hidden</p></div><ul><li>item one<li>item two</ul>'
    blocks = blocks_of(html, "https://x.example/a")
    assert [(b["tag"], b["text"]) for b in blocks] == [("h1", "Top"), ("p", "first para"), ("p", "second para link bad"), ("ul", "item oneitem two"), ("li", "item one"), ("li", "item two")]
    assert blocks[2]["links"] == [{"label": "link", "href": "https://x.example/x"}]
    assert blocks_of(None) == []
    frame = spark.createDataFrame([(1, "https://x.example/dir/page?x=1", "<p>before any heading</p><h2>A</h2><p>text of the first</p><h2>B</h2><p>text of b here</p><h2>A</h2><p>more text of A</p><p>text of the first</p>")], "page_id int, url string, html string")
    got = {r["heading"]: r["items"] for r in pages.sections(frame).collect()}
    assert got == {"page - Introduction": ["before any heading"], "A": ["text of the first", "more text of A"], "B": ["text of b here"]}
    faq = '<div class="q-content">orphan</div><div class="q-title">Q1</div><div class="q-content">A1</div><div class="q-content">A1b</div><div class="q-title">Q2</div>'
    blocks = pages.page_blocks(spark.createDataFrame([(1, "u", faq)], "page_id int, url string, html string"))
    assert [(r["question"], r["answer"]) for r in pages.faq_pairs(blocks).collect()] == [("Q1", "A1")]


def test_response_rules(spark):
    rows = [
        ('```json\n{"note": "no reply here"}\n```', '{"note": "no reply here"}', "text"), ('{"answer": null}', None, "whole"), ('text {"answer": null} more', None, "braces"),
        ('{"a": {"answer": "in"}}', '{"a": {"answer": "in"}}', "text"), ('[{"answer": "listed"}]', "listed", "braces"), ('<think>never closed {"answer": "x"}', "", "text"), ("", "", "text"),
        ('{"answer": "a", "entities": [{"name": "n", "type": "t", "date": "d"}]}', "a", "whole"), ('{"answer": "a"} trailing {"answer": "b"}', '{"answer": "a"} trailing {"answer": "b"}', "text"),
    ]
    frame = chat.parse_responses(spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string"), "t", "p")
    got = frame.orderBy("i").collect()
    assert [(r["p"]["answer"], r["p"]["form"]) for r in got] == [r[1:] for r in rows]
    assert got[7]["p"]["entities"][0]["name"] == "n" and got[7]["p"]["actions"] == [] and got[0]["p"]["entities"] == []
    assert len(frame._jdf.queryExecution().toString()) < 60_000


def test_breadcrumb_rules(spark):
    long = " | ".join(f"one two three four {i} (https://x.y/{i})" for i in range(4))
    rows = [("a", f"w1 w2 w3 w4 w5 w{i} (https://x.y/p) | Home (https://x.y/h)") for i in range(5)]
    rows += [("b", "Home (https://x.y/a_(b)) | About (https://x.y/c)"), ("b", "real text here"), ("c", long), ("c", "Home (https://x.y/) | Up (https://x.y/u)"), ("d", "one | two")]
    frame = spark.createDataFrame(rows, "source string, content string")
    assert [r[0] for r in frame.filter("source = 'b'").select(tx.is_breadcrumb("content")).collect()] == [True, False]
    kept = sorted((r["source"], r["content"], r["restored"]) for r in dedup.filter_breadcrumbs(frame, "content", "source").collect())
    assert kept == [("b", "real text here", False), ("c", long, True), ("d", "one | two", False)]


def test_heading_rules(spark):
    rows = ["Plain heading", "a b c,:", "a b c ;", "one two three four five six seven.", "six words end with stop .", "Title:", "::", " ", " ".join(["w"] * 21)]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").orderBy("i")
    assert [r[0] for r in frame.select(tx.plausible_heading("t")).collect()] == [True, False, False, False, True, True, False, False, False]
    assert frame.select(tx.clean_heading("t")).collect()[4][0] == "six words end with stop."


def test_small_column_functions(spark):
    row = spark.createDataFrame([("Tamil", "hello", " {\"answer\": \"in\"}", [3, -4], "[\"a\",\"b\"]", "\ufb01n")], "l string, t string, a string, s array<int>, ids string, k string").select(
        chat.language_code(F.col("l"), F.col("t")).alias("code"), chat.language_code(F.col("l"), F.lit("\u0905")).alias("script"), chat.language_code(F.lit("xx"), F.col("t")).alias("unknown"),
        chat.unwrap_answer(F.col("a")).alias("inner"), telemetry.silent(F.col("s")).alias("silent"), telemetry.root_mean_square(F.col("s")).alias("rms"), telemetry.silent(F.array().cast("array<int>")).alias("nothing"),
        chat.load_ids(F.col("ids")).alias("ids"), chat.load_ids(F.lit("oops")).alias("bad"), chat.dump_ids(chat.load_ids(F.col("ids"))).alias("dumped"), tx.nfkc("k").alias("k"), tx.percent_text(F.lit(0.1234)).alias("p"),
    ).first()
    assert tuple(row) == ("ta", "hi", "en", "in", True, 12.5**0.5, True, ["a", "b"], [], '["a","b"]', "fin", "12.3%")


def test_adjacent_distinct_takes_time_in_proportion(spark):
    made = spark.range(1).select(F.split(F.repeat(F.lit("b,B,a,"), 10_000), ",").alias("t"))
    started = time.monotonic()
    assert made.select(F.size(tx.adjacent_distinct(F.transform("t", tx.strip)))).first()[0] == 20_001 and time.monotonic() - started < 60
    rows = [([],), (["A"],), (["a", "A", "b", "a"],), (None,), ([None, "a", None],)]
    assert of(spark, rows, "t array<string>", tx.adjacent_distinct("t")) == [[], ["A"], ["a", "b", "a"], None, [None]]
