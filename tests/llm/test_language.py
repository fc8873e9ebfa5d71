import random
import zlib

import numpy as np

from gristmill.llm import language, query_language

SYLLABLES = {"aa": "the of and ing tion er ly", "bb": "der die und ung keit sch ver", "cc": "ción que los ado mente ez"}


def test_held_out_and_und(spark, tmp_path):
    rnd = random.Random(1)
    docs = []
    for i in range(300):
        lang = rnd.choice(list(SYLLABLES))
        parts = SYLLABLES[lang].split()
        docs.append((i, " ".join("".join(rnd.choices(parts, k=rnd.randint(1, 3))) for _ in range(rnd.randint(3, 60))), lang, "s"))
    docs += [(300, None, "aa", "s"), (301, "12 !? \n", "aa", "s"), (302, "", None, "s"), (303, "The of AND ing " * 30_000, None, "s"), (304, "q", None, "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in query_language.query(spark, str(tmp_path)).collect()}
    assert len(rows) == len(docs)
    held = [d for d in docs[:300] if zlib.crc32(str(d[0]).encode()) % 5 == 0]
    assert all(rows[d[0]]["held_out"] for d in held) and all(0 <= r["score"] <= 1 for r in rows.values())
    assert sum(rows[d[0]]["lang_pred"] == d[2] for d in held) / len(held) > 0.97
    assert [rows[i]["lang_pred"] for i in (300, 301, 302, 303)] == ["und"] * 3 + ["aa"]
    assert rows[304]["lang_pred"] in SYLLABLES


def naive_kernel(a, b):
    """From the definition: sets of byte strings."""
    total = 0
    for n in language.SPECTRUM:
        sets = []
        for text in (a, b):
            raw = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in text.lower().encode())
            raw = b" " + b" ".join(raw.split()) + b" "
            sets.append({raw[i : i + n] for i in range(len(raw) - n + 1)})
        total += len(sets[0] & sets[1]) / np.sqrt(max(1, len(sets[0])) * max(1, len(sets[1])))
    return total / len(language.SPECTRUM)


TEXTS = ["the river", "the stone, the the", "die Tür und", "año 12 niño", "x", "日本 語", "the river", "der river the stone niño"]


def test_kernel_equals_its_definition():
    postings = language.Postings(TEXTS[:5])
    found = postings.kernel(TEXTS)
    assert np.allclose(found, [[naive_kernel(a, b) for b in TEXTS[:5]] for a in TEXTS])


def test_batched_product_equals_single_texts_and_dense_form():
    rng = np.random.default_rng(0)
    postings = language.Postings(TEXTS[:6])
    weights = rng.normal(size=(6, 3))
    model = language.Model(["a", "b", "c"], postings.vocabulary, postings.spread(weights))
    assert np.allclose(model.scores(TEXTS), postings.kernel(TEXTS) @ weights)
    assert np.allclose(np.concatenate([model.scores([t]) for t in TEXTS]), model.scores(TEXTS))


def test_regression_equals_one_solved_in_one_place(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choices(SYLLABLES[g].split(), k=9)), g) for i, g in enumerate(rnd.choices(list(SYLLABLES), k=60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    model = language.fit(docs, docs.select("doc_id", "lang"))
    ordered = sorted(rows, key=lambda r: (r[2], r[0]))
    postings = language.Postings([t for _, t, _ in ordered])
    k = postings.kernel([t for _, t, _ in ordered])
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    y = np.array([[g == name for name in sorted(SYLLABLES)] for _, _, g in ordered], float)
    w = (len(rows) / 3 / y.sum(0))[y.argmax(1)][:, None]
    z = k @ root
    want = k @ root @ np.linalg.solve((z * w).T @ z + language.RIDGE * np.eye(len(rows)), (z * w).T @ y)
    assert model.languages == sorted(SYLLABLES)
    assert np.allclose(model.scores([t for _, t, _ in ordered]), want, atol=1e-6)


def test_many_languages_ties_and_repeated_rows(spark):
    rows = [(i, f"w{chr(97 + i % 26)}{chr(97 + i // 26)} " * 3, f"l{i:03d}") for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, "same text", "tie_b"), (901, "same text", "tie_a"), (902, "same text", None), (902, "same text", None)], "doc_id long, text string, lang string")
    model = language.fit(docs, docs.select("doc_id", "lang"))
    assert len(model.languages) == 302
    found = [tuple(r) for r in language.predict(docs.filter("doc_id >= 900"), model).collect()]
    assert len({r[1:] for r in found}) == 1 and found[0][1] == "tie_a"
    assert language.predict(docs.limit(0), model).count() == 0


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = language.fit(docs, docs.select("doc_id", "lang"))
    assert language.predict(docs, model).collect()[0]["lang_pred"] == "und"


def test_repeated_ids_and_rows_lose_no_language(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choices(SYLLABLES["aa"].split(), k=9)), "aa") for i in range(300)]
    rows += [(7_000_000, " ".join(rnd.choices(SYLLABLES["bb"].split(), k=9)) if k % 2 else "der die und", "bb") for k in range(8000)]
    rows += [(8_000_000, "ción que los mente", "cc")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    for model in (language.fit(docs), language.fit(docs, docs.select("doc_id", "lang"))):
        assert model.languages == ["aa", "bb", "cc"]
        found = model.scores(["the river of and the", "die Tür und der", "ción que los"])
        assert found.argmax(1).tolist() == [0, 1, 2]
    known = language._different(docs)
    counts = known.groupBy("lang").count()
    assert counts.filter("lang = 'cc'").first()["count"] == 1
    sample = language._per_language(known, counts, 50, 1000, 6)
    drawn = language._texts(docs, sample).groupBy("lang").count()
    assert {r["lang"]: r["count"] for r in drawn.collect()} == {"aa": 50, "bb": 50, "cc": 1}


def test_every_language_has_a_landmark(spark):
    """Repeated ids take no other language's place among the landmarks."""
    rows = [(1, f"only {i} first words", "aa") for i in range(2000)] + [(2, "zz yy xx", "zz")]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["aa", "zz"] and model.scores(["zz yy xx"]).argmax() == 1
