import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import ann, query_ann


def brute(rows, queries, k=5):
    out = {}
    good = {i: np.array(v, float) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == 8}
    for q in queries:
        if q in good:
            cos = sorted((-float((good[i] * good[q]).sum() / (np.sqrt((good[i] ** 2).sum()) * np.sqrt((good[q] ** 2).sum()))), i) for i in good if i != q)
            out[q] = [(i, -s) for s, i in cos[:k]]
    return out


def run(spark, tmp_path, rows):
    spark.createDataFrame([(i, v, 0, 0.0) for i, v in rows], "vec_id long, embedding array<float>, label int, score double").repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in sorted(query_ann.query(spark, str(tmp_path)).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def f32(v):
    return [float(np.float32(x)) for x in v]


def test_small_table_is_exact(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, f32(rng.normal(size=8))) for i in range(300)]
    rows += [(400 + i, rows[50][1]) for i in range(40)]
    rows += [(500, None), (550, [0.0] * 8), (600, [1.0, None] + [0.0] * 6), (650, [float("nan")] + [1.0] * 7), (700, [float("inf")] + [1.0] * 7), (750, [1.0, 2.0])]
    got, want = run(spark, tmp_path, rows), brute(rows, [i for i, _ in rows if i % 50 == 0])
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-9 for q in want for a, b in zip(got[q], want[q], strict=True))


def test_few_and_no_candidates(spark, tmp_path):
    assert run(spark, tmp_path, [(0, f32([1] * 8)), (7, f32([2] * 8))])[0][0][0] == 7
    assert run(spark, tmp_path, [(0, f32([1] * 8))]) == {}
    assert run(spark, tmp_path, []) == {}


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_recall(spark, spread, monkeypatch):
    monkeypatch.setattr(ann, "ROWS_A_LIST", 50)
    monkeypatch.setattr(ann, "TILE_ROWS", 100)
    monkeypatch.setattr(ann, "TILE_QUERIES", 16)
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(20, 8))[rng.integers(0, 20, 3000)] + spread * rng.normal(size=(3000, 8))).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(frame, frame.filter(F.col("vec_id") % 50 == 0)).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute(rows, range(0, 3000, 50))
    assert sum(len(got[q] & {i for i, _ in v}) for q, v in want.items()) / sum(map(len, want.values())) >= 0.9


def test_repeated_rows_do_not_displace_other_ids(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, f32(rng.normal(size=8))) for i in range(100)]
    same = f32(rng.normal(size=8))
    rows += [(150, same)] * 9 + [(200 + i, same) for i in range(1, 8)]
    got, want = run(spark, tmp_path, rows), brute(rows, [0, 50, 150])
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


@pytest.mark.parametrize("clusters", [1, 40])
def test_recall_in_64_dimensions(spark, clusters):
    rng = np.random.default_rng(6)
    x = (3 * rng.normal(size=(clusters, 64))[rng.integers(0, clusters, 4000)] * (clusters > 1) + rng.normal(size=(4000, 64))).astype(np.float32)
    frame = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(frame, frame.filter(F.col("vec_id") % 50 == 0)).collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 4000, 50):
        cos = unit @ unit[q]
        cos[q] = -2
        hits += len({i for i, _ in got[q]} & set(np.argsort(-cos)[:5].tolist()))
        assert all(abs(s - cos[i]) < 1e-12 for i, s in got[q])
    assert hits / 400 >= 0.9


def test_double_vectors_and_many_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS_A_LIST", 5)
    rng = np.random.default_rng(8)
    rows = [(i, [float(c) for c in rng.normal(size=8)]) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, range(0, 400, 50))
    got = {}
    for r in ann.nearest(frame, frame.filter(F.col("vec_id") % 50 == 0)).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert sum(len(set(got[q]) & {i for i, _ in v}) for q, v in want.items()) / 40 >= 0.9


def test_lists_follow_the_rows():
    assert [ann.list_count(n) for n in (0, 399, 4000, 1_000_000, 4_000_000, 1_000_000_000)] == [1, 1, 10, 2500, 4096, 31622]


def test_copies_are_limited_before_they_meet(spark):
    """One vector in thousands of rows: no task gets more of them than k + 1 from each of the others."""
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(3000)] + [(i % 7, [1.0, 2.0, 0.5]) for i in range(3000)] + [(10_000 + i, [float(i), 1.0, -1.0]) for i in range(50)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8)
    found = ann.nearest(vectors, vectors.filter("vec_id in (0, 2999, 10007)"))
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in found.collect()}
    assert [got[0, k] for k in range(1, 6)] == [1, 2, 3, 4, 5] and [got[2999, k] for k in range(1, 6)] == [0, 1, 2, 3, 4]
    assert len([1 for q, _ in got if q == 10_007]) == 5
    different = ann.usable(vectors).distinct()
    ranked = different.withColumn("copy", ann.F.row_number().over(ann.Window.partitionBy("v").orderBy("vec_id"))).filter("copy <= 6")
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().toString()
