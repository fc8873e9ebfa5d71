import hashlib
import random

import numpy as np
import pytest

from gristmill.llm import query_substring, substring


def brute(docs):
    seen, out = set(), {}
    for i in sorted(docs):
        words = (docs[i] or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            w = tuple(words[s : s + 20])
            if w in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(w)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("chunk", "shard", "hot"), [(1 << 20, 1 << 16, 4096), (200, 100, 4096), (200, 1 << 16, 2)])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, chunk, shard, hot):
    """Also with tiny chunks and shards, and with nearly every anchor hot."""
    monkeypatch.setattr(substring, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(substring, "SHARD_WORDS", shard)
    monkeypatch.setattr(substring, "HOT_PLACES", hot)
    rnd = random.Random(6)
    vocab = ["w%d" % i for i in range(60)]
    passages = [[rnd.choice(vocab) for _ in range(rnd.randint(15, 70))] for _ in range(12)]
    docs = {}
    for i in range(80):
        body = []
        for _ in range(rnd.randint(0, 5)):
            body += [rnd.choice(vocab) for _ in range(rnd.randint(0, 40))]
            p = rnd.choice(passages)
            body += p[rnd.randint(0, 5) :] if rnd.random() < 0.5 else p
        docs[i * 7 % 601] = rnd.choice([" ", "\n", "\t "]).join(body)
    docs |= {700: docs[0], 701: docs[0], 702: None, 703: "", 704: "a " * 3000, 705: "a b " * 50, 706: " ".join(["x"] * 19), 707: " ".join(["x"] * 20), 708: " ".join(["x"] * 20), 709: "é a " * 11}
    spark.createDataFrame([(i, t, "clash") for i, t in docs.items()], "doc_id long, text string, kept string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in query_substring.query(spark, str(tmp_path)).collect()}
    assert got == brute(docs)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert query_substring.query(spark, str(tmp_path)).count() == 0


def test_automaton_matching_statistics():
    rnd = random.Random(2)
    for _ in range(200):
        passages = [[rnd.choice("abc") for _ in range(rnd.randint(1, 25))] for _ in range(rnd.randint(1, 5))]
        text = [rnd.choice("abcd") for _ in range(40)]
        automaton = substring.SuffixAutomaton()
        for p in passages:
            automaton.add(p)
        strings = ["".join(p) for p in passages]
        want = [max(k for k in range(i + 2) if any("".join(text[i + 1 - k : i + 1]) in s for s in strings)) for i in range(len(text))]
        assert automaton.matching(text).tolist() == want


def test_earlier_windows_against_naive_search():
    rnd = random.Random(4)
    for _ in range(60):
        passages = list({tuple(rnd.choice("ab") if rnd.random() < 0.2 else "cdefghijklmnopqrstuvwxyzcdefgh"[j % 30] for j in range(o, o + rnd.randint(20, 35))) for o in (rnd.randint(0, 9) for _ in range(rnd.randint(1, 8)))})
        places = [(rnd.randint(0, 5), rnd.randint(0, 60)) for _ in passages]
        windows = [(p[i : i + 20], (doc, start + i)) for p, (doc, start) in zip(passages, places) for i in range(len(p) - 19)]
        for p, (doc, start), gone in zip(passages, places, substring.earlier_windows([list(p) for p in passages], places)):
            assert gone.tolist() == [any(w == p[i : i + 20] and at < (doc, start + i) for w, at in windows) for i in range(len(p) - 19)]


def test_repeated_and_null_ids(spark, tmp_path):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, one), (5, two), (5, one + " tail"), (5, two), (9, "x " + two), (None, one), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in query_substring.query(spark, str(tmp_path)).collect())
    assert got == [(0, 0, 0), (0, 30, 0), (1, 30, 0), (5, 30, 0), (5, 30, 0), (5, 31, 30), (9, 31, 30)]


def test_equal_windows_share_their_anchor():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 50, 400).astype(np.uint64)
    g = substring.gram_hashes(h, substring.GRAM)
    assert substring.sliding_least(g, 16).tolist() == [i + int(g[i : i + 16].argmin()) for i in range(len(g) - 15)]


def test_hot_anchors_in_many_documents_and_no_table_left(spark):
    """A passage in a hundred documents, hot from the third place on, between words of their own."""
    line = " ".join(f"p{i}" for i in range(45))
    docs = {i: " ".join([f"d{i}a{j}" for j in range(i % 9)] + [line] + [f"e{i}b{j}" for j in range(i % 5)]) for i in range(100)}
    before = {t.name for t in spark.catalog.listTables()}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(6)
    kept = substring.HOT_PLACES
    try:
        substring.HOT_PLACES = 3
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in substring.remove_repeats(frame).collect()}
    finally:
        substring.HOT_PLACES = kept
    assert got == brute(docs) and {t.name for t in spark.catalog.listTables()} == before
