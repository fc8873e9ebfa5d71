import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.llm import query_runs, runs


def brute_runs(words):
    """Every lag's matching stretches, then the smallest period of each."""
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            first = i
            while i < n and words[i] == words[i - q]:
                i += 1
            start, length = first - q, i - first + q
            stretch = words[start : start + length]
            if i > first and length >= max(6, 4 * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                found.append((start, length, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    milli = 1000 * top[1] // top[2] if found else None
    return (len(found), *top, milli, sha("".join("%d,%d,%d\n" % r for r in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def random_text(rnd, least=0, most=120):
    words = []
    while len(words) < rnd.randint(least, most):
        unit = [rnd.choice("abcé") + rnd.choice(["", "x"]) for _ in range(rnd.randint(1, 12))]
        words += unit * rnd.randint(1, 9) + unit[: rnd.randint(0, len(unit))]
    return rnd.choice([" ", "\n", "\t\r\x0b", "  "]).join(words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", max_size=60).map(lambda s: " ".join(s)), max_size=6))
def test_small_alphabets(texts):
    got = runs.runs_of([t.encode() for t in texts])
    assert [r for _, r, _ in got] == [brute_runs(t.split()) for t in texts]


def test_random_repeats():
    rnd = random.Random(3)
    for _ in range(60):
        texts = [random_text(rnd) for _ in range(5)]
        got = runs.runs_of([t.encode() for t in texts])
        assert [r for _, r, _ in got] == [brute_runs(t.encode().split()) for t in texts]


def test_query_equals_brute_force(spark, tmp_path):
    rnd = random.Random(1)
    docs = {i: random_text(rnd) for i in range(300)}
    docs |= {i: " ".join(str(k) for k in range(i % 97)) for i in range(300, 500)}
    docs |= {1000: None, 1001: "", 1002: " \t\n", 1003: "a " * 5, 1004: "a " * 6, 1005: "a b " * 4, 1006: "a b " * 3 + "a", 1007: docs[5], 1008: "  " * 7}
    rows = [(i, t, "clash", 1) for i, t in docs.items()] + [(7, docs[7], "x", 2), (None, "z " * 9, "x", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = sorted(((r["doc_id"], *(r[n] for n in names)) for r in query_runs.query(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(((i, *expected(i, t)) for i, t, _, _ in rows), key=repr)


def test_ties_of_the_strongest_run(spark):
    text = "a b " * 4 + "x y z " * 4 + "c d " * 4 + "q"
    row = runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"]).withColumn("top", runs.strongest()).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 8, 2), (8, 12, 3), (20, 8, 2)] and tuple(row["top"]) == (0, 8, 2)


def test_long_repetitive_texts_stay_cheap(monkeypatch):
    """Each scale names a place once: the most repetitive text costs places x scales, not their square."""
    named = []
    paired = runs.paired
    monkeypatch.setattr(runs, "paired", lambda names, at, step: named.append(len(at)) or paired(names, at, step))
    n = 200_000
    found = runs.find_runs(np.zeros(n, np.int64), np.zeros(n, np.int64), n)
    assert found == [(0, n, 1)] and sum(named) <= 20 * n
    words = np.arange(n) % 1000
    assert runs.find_runs(words, np.zeros(n, np.int64), n) == [(0, n, 1000)]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert query_runs.query(spark, str(tmp_path)).count() == 0
