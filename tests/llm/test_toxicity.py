import random
import zlib

import numpy as np

from gristmill.llm import query_toxicity, toxicity


def test_held_out(spark, tmp_path):
    rnd = random.Random(4)
    words = ["alpha", "river", "stone", "green", "walk", "letter", "window", "paper", "light", "seven"]
    docs, marks = [], []
    for i in range(600):
        bad = rnd.random() < 0.15
        body = [rnd.choice(words) + rnd.choice("abcdefgh") for _ in range(rnd.randint(20, 200))]
        for _ in range(3 * bad):
            body.insert(rnd.randrange(len(body)), "nastyword" + rnd.choice(["", "s", "ly", "!"]))
        docs.append((i, " ".join(body), "s", 1))
        if i % 3:
            marks.append((i, 1, int(bad)))
    truth = {i: t for i, _, t in marks}
    docs += [(600, None, None, 1), (601, "", "s", 1), (602, "alpha " * 50_000, "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, score int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks + marks[:5], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = {r["doc_id"]: r for r in query_toxicity.query(spark, str(tmp_path)).collect()}
    assert len(rows) == 603 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert sum(rows[i]["predicted"] == truth[i] for i in truth if rows[i]["held_out"]) / sum(rows[i]["held_out"] for i in truth) > 0.97
    assert not any(rows[i]["predicted"] for i in (600, 601, 602))


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit_from_labels(docs, labels, lambda i: i.isNotNull())
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == 2 and len({r["score"] for r in scored}) == 1


def test_risk_steps_separate():
    rnd = np.random.default_rng(0)
    x = np.zeros((900, 2), np.float32)
    x[:100, 0] = 1
    x[100:180, 0] = 1
    x[:, 1] = rnd.random(900) < 0.5
    positive = np.arange(900) < 100
    weights, bias = toxicity.train_nnpu(x, positive, 0.1)
    assert bias + weights[0] > 0 > bias + weights[1]


def test_words_whole_and_unspaced_scripts():
    assert toxicity.word_features("(Nasty!)".lower()) == ["=nasty", "nas", "nast", "nasty"]
    long, other = "a" * 200, "a" * 199 + "b"
    assert toxicity.word_features(long)[0] != toxicity.word_features(other)[0]
    assert "~悪い" in toxicity.word_features("とても悪い人") and toxicity.word_features("a") == ["=a"] and toxicity.word_features("--") == []


def test_learns_from_unspaced_text(spark):
    rnd = random.Random(6)
    plain = "山川花木空海風雨雪月"
    rows = []
    for i in range(400):
        body = "".join(rnd.choices(plain, k=60))
        rows.append((i, body[:30] + "悪罵" * (i % 8 == 0) + body[30:]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(400) if i % 3], "doc_id long, toxic int")
    model = toxicity.fit_from_labels(docs, labels, lambda i: i.isNotNull())
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert min(s for i, s in found.items() if i % 8 == 0) > max(s for i, s in found.items() if i % 8)


def test_risk_gradient_by_differences():
    """One step from zero moments moves every weight against the sign of the numerical gradient of the corrected risk."""
    rng = np.random.default_rng(5)
    x = (rng.random((60, 4)) < 0.4).astype(float)
    positive, prior = np.arange(60) < 25, 0.2

    def risk(w):
        z = np.column_stack((x, np.ones(60))) @ w
        p, u = z[positive], z[~positive]
        return prior * np.logaddexp(0, -p).mean() + max(0, np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean())

    start = np.append(np.zeros(4), np.log(prior / (1 - prior)))
    weights, bias = toxicity.train_nnpu(x, positive, prior, rounds=1, rate=1e-6, ridge=0.0)
    moved = np.append(weights, bias) - start
    slope = np.array([(risk(start + d) - risk(start - d)) / 2e-5 for d in np.eye(5) * 1e-5])
    assert (np.sign(moved) == -np.sign(slope)).all()


def test_empty_table_clashing_names_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 7.0), (1, "a b", 7.0)], "doc_id long, text string, score double")
    model = toxicity.fit_from_labels(docs, spark.createDataFrame([(1, 1), (1, 1)], "doc_id long, toxic int"), lambda i: i.isNotNull())
    scored = toxicity.score(docs, model)
    assert scored.columns == ["doc_id", "text", "score_kept", "score"] and len(set(scored.collect())) == 1
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_repeated_ids_stay_within_bounds(spark, monkeypatch):
    taken = []
    kept = toxicity.checkpointed
    monkeypatch.setattr(toxicity, "checkpointed", lambda df: taken.append(kept(df)) or taken[-1])
    rows = [(i, "you vile scum go" if i % 4 == 0 else "a calm day %d" % i) for i in range(200)]
    docs = spark.createDataFrame(rows + [rows[1]] * 10_000 + [rows[4]] * 10_000, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100)] + [(4, 1)] * 10_000, "doc_id long, toxic int")
    toxicity.fit_from_labels(docs, labels, lambda i: i.isNotNull())
    assert {r["positive"]: r["count"] for r in taken[0].groupBy("positive").count().collect()} == {0: 200, 1: 25}
