import random
import zlib

import numpy as np

from gristmill.llm import quality, query_quality


def make(spark, tmp_path, n=400, labels=True):
    rnd = random.Random(2)
    words = ["alpha", "river", "stone", "green", "walk", "letter", "window", "paper", "light", "seven"]
    docs, marks = [], []
    for i in range(n):
        good = rnd.random() < 0.8
        body = [rnd.choice(words) + rnd.choice(["", "s", "ed"]) for _ in range(rnd.randint(30, 300))]
        docs.append((i, " ".join(body) if good else " ".join(w.upper() + "!!" for w in body), "src", 0.0))
        if labels:
            marks.append((i, int(good), 0))
    docs += [(n, None, None, 0.0), (n + 1, "", "x", 0.0), (n + 2, "alpha river " * 20_000, "x", 0.0)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return {d[0]: m[1] for d, m in zip(docs, marks)}


def test_held_out_accuracy(spark, tmp_path):
    truth = make(spark, tmp_path)
    rows = {r["doc_id"]: r for r in query_quality.query(spark, str(tmp_path)).collect()}
    assert len(rows) == 403 and all(0 <= r["score"] <= 1 for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    held = [i for i in truth if rows[i]["held_out"]]
    assert sum(rows[i]["predicted"] == truth[i] for i in held) / len(held) > 0.95


def test_without_labels(spark, tmp_path):
    make(spark, tmp_path, 20, labels=False)
    assert {r["score"] for r in query_quality.query(spark, str(tmp_path)).collect()} == {0.5}


def test_sizes_equal_plain_compression():
    import zstandard

    rnd = random.Random(3)
    pieces = [[(" ".join(rnd.choices(words, k=60))).encode() for _ in range(200)] for words in (["alpha", "stone", "river"], ["BUY!!", "NOW$$", "free"])]
    made = [quality.build_dictionary(p, 4096) for p in pieces]
    for text in ("", "alpha river", "é" * 3000, "BUY!! NOW$$ " * 400):
        raw, sizes = text.encode(), []
        for d in [*made, None]:
            blocks = [raw[i : i + quality.BLOCK] for i in range(0, max(1, len(raw)), quality.BLOCK)]
            plain = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(plain.compress(b)) for b in blocks))
        found = quality.size_features(text, *(quality.compressor(m) for m in [*made, b""]))
        want = [(sizes[x] - sizes[y]) / (sizes[x] + sizes[y]) for x, y in ((1, 0), (2, 0), (2, 1))]
        assert np.allclose(found, want, atol=1e-12)


def test_logistic_calibration_is_a_minimum():
    rng = np.random.default_rng(1)
    x = quality.expand(rng.normal(size=(200, 2)))
    y = (rng.random(200) < 0.3).astype(float)
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ x @ w + 0.5 * 1e-2 * (w[1:] ** 2).sum() + 0.5e-9 * w[0] ** 2
    w = quality.fit_logistic(x, y)
    assert all(loss(w) <= loss(w + d) + 1e-9 for d in rng.normal(scale=1e-3, size=(50, x.shape[1])))


def test_repeated_rows_labels_ties_and_empty_table(spark, tmp_path):
    truth = make(spark, tmp_path, 120)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, q) for i, q in truth.items()] * 2 + [(0, 1), (0, 0), (5, None), (None, 1), (99_999, 1)], "doc_id long, label int")
    model = quality.fit(docs.union(docs.filter("doc_id < 9")), labels)
    found = {}
    for r in quality.score(docs.union(docs), model).collect():
        found.setdefault(r["doc_id"], set()).add(r["score"])
    assert all(len(v) == 1 for v in found.values()) and len(found) == 123
    assert quality.score(docs.limit(0), model).count() == 0


def test_repeated_labels_and_documents_stay_within_bounds(spark):
    from gristmill.llm.samples import texts_of_sample

    docs = spark.createDataFrame([(1, "a")] * 300 + [(1, "b")] * 200 + [(i, "x") for i in range(2, 50)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1)] * 130 + [(1, 0)] + [(2, 0)] * 9, "doc_id long, label int").distinct()
    got = sorted((r["doc_id"], r["label"], r["text"]) for r in texts_of_sample(docs, labels).collect())
    assert got == [(1, 0, "a"), (1, 1, "a"), (2, 0, "x")]
    rows = [(i, ("good plain words %d " % i if i % 2 else "junk @@ %d ## " % (i * 7)) * 20) for i in range(200)]
    docs = spark.createDataFrame(rows + [rows[5]] * 10_000, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(5, 1)] * 10_000, "doc_id long, label int")
    model = quality.fit(docs, labels)
    assert model.prior == 0.5 and len(model.weights) > 0
