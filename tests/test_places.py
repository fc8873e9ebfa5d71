from pyspark.sql import functions as F

from gristmill.functions import text as tx
from gristmill.functions import urls
from gristmill.functions.html import title_of
from gristmill.operators import chat, ingest, retrieval


def test_places_without_one_task(spark):
    rows = spark.createDataFrame([(i * 7919 % 1000, i) for i in range(1000)], "a int, b int").repartition(5)
    found = ingest.placed(rows, F.desc("a"), F.col("b"))
    assert [r["a"] for r in found.orderBy("place").collect()] == sorted((i * 7919 % 1000 for i in range(1000)), reverse=True)
    assert sorted(r["place"] for r in found.collect()) == list(range(1, 1001)) and ingest.placed(rows.limit(0), F.col("a")).count() == 0


def test_targets_of_a_table(spark):
    registry = spark.createDataFrame([("u", "b", "c", "fast"), ("u", "a", "d", "fast"), ("v", "a", "c", "slow"), (None, "z", "c", None)], "url string, source string, category string, schedule string")
    assert [tuple(r) for r in ingest.targets_of(registry, "fast").collect()] == [("u", "a", "d")]


def test_dense_scorer_takes_the_queries_width(spark):
    vectors = [(0, [1.0])] + [(i, [1.0, float(i)]) for i in range(1, 50)] + [(90, None), (91, [0.0, 0.0]), (92, [float("nan"), 1.0]), (93, []), (94, [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").coalesce(1)
    asked = frame.filter("vec_id in (1, 2, 30)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vector"))
    found = retrieval.dense_top_k(frame, asked, 3)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in found.collect()}
    assert got[1, 1] == 1 and got[2, 1] == 2 and got[30, 1] in (29, 30, 31) and len(got) == 9
    assert retrieval.dense_top_k(frame, asked.limit(0), 3).count() == 0


def test_dense_scorer_in_small_blocks_and_passes(spark, monkeypatch):
    rows = [(i, [float(i % 13), float(i % 7) - 3, 1.0]) for i in range(200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = frame.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vector"))
    whole = sorted(map(tuple, retrieval.dense_top_k(frame, asked, 5).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 16)
    monkeypatch.setattr(retrieval, "CELLS", 100)
    monkeypatch.setattr(retrieval, "PASS_BYTES", 2000)
    assert sorted(map(tuple, retrieval.dense_top_k(frame, asked, 5).collect())) == whole and len(whole) == 1000


def test_urls_titles_sources_and_durations(spark):
    cases = {
        "HTTP://Ex.org/A/?b=2&a=1&&c#f": "http://ex.org/A?a=1&b=2&c=", "https://ex.org/": "https://ex.org/", "https://ex.org//": "https://ex.org", "https://ex.org?x=%41%2B+b": "https://ex.org?x=A%2B+b",
        "https://ex.org/p?q=~*": "https://ex.org/p?q=~%2A", "no scheme/": "no scheme",
    }
    frame = spark.createDataFrame([(k,) for k in [*cases, None]], "u string")
    got = {r["u"]: r["n"] for r in frame.select("u", urls.normalize_url("u").alias("n")).collect()}
    assert got == {**cases, None: None}
    assert title_of("<svg><title>a &amp; b</title></svg><title>c</title>") == "a & b" and title_of("<title>x") == "x" and title_of(None) == ""
    one = spark.createDataFrame([("ﬁx",), ("plain",), (None,)], "k string").select(tx.nfkc("k").alias("k")).collect()
    assert [r["k"] for r in one] == ["fix", "plain", None]


def test_lenient_dates(spark):
    import datetime as dt

    from gristmill.operators import reminders as rm

    cases = {
        "2024-03-01T10:00:00Z": dt.datetime(2024, 3, 1, 10), "2024-03-01 10:00": dt.datetime(2024, 3, 1, 4, 30), "3/4/2024": dt.datetime(2024, 3, 3, 18, 30), "25/12/2024 18:00": dt.datetime(2024, 12, 25, 12, 30),
        "  4 Mar 2024  5:30 PM ": dt.datetime(2024, 3, 4, 12), "March 4, 2024, 5:30 AM": dt.datetime(2024, 3, 4), "4.3.2024 00:30:15": dt.datetime(2024, 3, 3, 19, 0, 15), "tomorrow": None, "": None,
    }
    frame = spark.createDataFrame([(k,) for k in [*cases, None]], "t string")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    rows = {r["t"]: (r["at"], r["f"]) for r in frame.select("t", rm.lenient_event_time(F.col("t")).alias("at"), rm.lenient_event_time(F.col("t"), fallback=now).alias("f")).collect()}
    assert {k: v[0] for k, v in rows.items()} == {**cases, None: None}
    assert rows["tomorrow"][1] == dt.datetime(2024, 1, 1) and rows["3/4/2024"][1] == cases["3/4/2024"]


def test_normal_sources_and_durations(spark):
    row = spark.createDataFrame([([" A ", "", "b\n", None],)], "s array<string>").select(chat.normal_sources(F.col("s")).alias("s")).first()
    assert row["s"] == ["a", "b"]
    shown = spark.createDataFrame([(0,), (999,), (1000,), (1239,), (60_000,)], "m long").select(tx.duration_text(F.col("m")).alias("d")).collect()
    assert [r["d"] for r in shown] == ["0ms", "999ms", "1.00s", "1.24s", "60.00s"]
