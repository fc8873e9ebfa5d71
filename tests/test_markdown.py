from gristmill.operators import markdown
from gristmill.functions import text as tx


def chunked(spark, text, **limits):
    docs = spark.createDataFrame([(1, text, "clash")], "doc_id long, text string, headings string")
    return [(r["headings"], r["body"], r["tokens"]) for r in markdown.token_chunks(docs, **limits).orderBy("index").collect()]


def test_headings_paths_and_peers(spark):
    text = "intro words\n\n# One:\nfirst\n\nsecond line\nthird\n## Two .x\nbody two\n### This is a sentence of many more than six words.\nunder it\n# Three\nlast"
    assert chunked(spark, text, least=0) == [
        ([], "intro words", 2),
        (["One"], "first\n\nsecond line\nthird", 4),
        (["One", "Two.x"], "body two\n\nunder it", 4),
        (["Three"], "last", 1),
    ]


def test_budget_splits_and_table_headers_repeat(spark):
    rows = "\n".join(f"| r{i} | v{i} |" for i in range(5))
    text = f"# T\nbefore it\n| a | b |\n|---|---|\n{rows}\nafter the table"
    got = chunked(spark, text, most=18, least=0)
    head = "| a | b |\n|---|---|\n"
    assert [b for _, b, _ in got] == [
        f"before it\n\n{head}| r0 | v0 |\n| r1 | v1 |",
        f"{head}| r2 | v2 |\n| r3 | v3 |",
        f"{head}| r4 | v4 |\n\nafter the table",
    ]
    assert [t for _, _, t in got] == [18, 16, 14] and all(h == ["T"] for h, _, _ in got)


def test_long_paragraphs_and_rows(spark):
    text = " ".join(f"w{i}" for i in range(25)) + "\n\n| a |\n| " + " ".join(f"c{i}" for i in range(30)) + " |"
    got = chunked(spark, text, most=10, least=0)
    assert [t for _, _, t in got] == [10, 10, 5, 35] and got[0][1] == " ".join(f"w{i}" for i in range(10))


def test_tiny_chunks_join_the_next(spark):
    text = "# A\none two\n# B\n" + "x " * 50 + "\n# C\nend"
    got = chunked(spark, text)
    assert [(h, t) for h, _, t in got] == [(["A"], 52), (["C"], 1)] and got[0][1].startswith("one two\n\nx x")
    assert chunked(spark, "tiny\n# A\nalone", least=40) == [(["A"], "tiny\n\nalone", 2)]


def test_fences_and_nothing(spark):
    assert chunked(spark, "```\n# no heading\n| no table |\n```\n# H\ntext", least=0) == [([], "```\n# no heading\n| no table |\n```", 9), (["H"], "text", 1)]
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "# only\n## headings"), (4, " \n\n ")], "doc_id long, text string")
    assert markdown.token_chunks(docs).count() == 0 and markdown.token_chunks(docs.limit(0)).count() == 0


def test_own_token_counter_and_content(spark):
    docs = spark.createDataFrame([(1, "# A\n## B\nabcdef ghi")], "doc_id long, text string")
    row = markdown.token_chunks(docs, most=100, tokens=lambda c: tx.F.length(c)).first()
    assert row["tokens"] == 10 and row["content"] == "Heading:\nA\n\nSubheading:\nB\n\nContent:\nabcdef ghi"


def test_no_python_and_no_cross_join_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "# A\nb")], "doc_id long, text string")
    plan = markdown.token_chunks(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Join" not in plan
