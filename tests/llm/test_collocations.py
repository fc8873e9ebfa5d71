import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from gristmill.llm import collocations as C
from gristmill.llm import query_collocations

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, least=30, longest=4, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    kept = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, p), a in kept.items():
        if any(b * 100 >= 80 * a for (other, q), b in kept.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for lang, found in out.items() for i, (score, a, p, left, right) in enumerate(sorted(found)[:top]))


def made(seed, docs=150):
    rnd = random.Random(seed)
    vocab = ["new", "york", "city", "É", "éa", "the", "of", "a\xa0b", "\0", *("w%d" % i for i in range(60))]
    idioms = [["new", "york", "city"], ["New", "York"], ["out", "of", "the", "blue"], ["the", "the", "the", "the"], ["of", "the"]]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(rnd.randint(0, 60)):
            words += rnd.choice(idioms) if rnd.random() < 0.4 else [rnd.choice(vocab)]
            words += [rnd.choice([".", "\n", "?!", "\t", "\r"])] if rnd.random() < 0.1 else []
        rows.append((rnd.choice(["en", "de", None, "und"]), rnd.choice([" ", "  ", "\t"]).join(words)))
    return rows + [("en", None), (None, ""), ("fr", " . "), ("en", "x" * 5000), ("zz", "ha " * 4000)]


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def test_query_equals_brute_force(spark, tmp_path):
    rows = made(1)
    frame = [(i // 2, t, lang, "clash", 1) for i, (lang, t) in enumerate(rows)]
    spark.createDataFrame(frame, "doc_id long, text string, lang string, phrase string, key int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = query_collocations.query(spark, str(tmp_path)).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == brute(rows)


@pytest.mark.parametrize("least", [2, 7])
def test_small_summaries_lose_nothing(spark, monkeypatch, least):
    """Tiny flushes, capacities and filters: more candidates pass, the counts stay exact."""
    monkeypatch.setattr(C, "FLUSH_KEYS", 50)
    monkeypatch.setattr(C, "KEYS_A_ROW", 7)
    rows = made(2, 60)
    docs = spark.createDataFrame([(t, lang) for lang, t in rows], "text string, lang string").repartition(4)
    got = C.collocations(docs, least=least, top=50, capacity=1, mass_a_part=100).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == brute(rows, least, top=50)


def test_summary_keeps_every_frequent_key_and_merges():
    rnd = np.random.default_rng(5)
    for least in (3, 10, 30):
        stream = (rnd.zipf(1.3, 20_000) % 5000).astype(np.uint64)
        true = Counter(stream.tolist())
        halves = []
        for part in np.array_split(stream, 7):
            half = C.Summary(least, 16)
            for piece in np.array_split(part, 20):
                half.merge(*np.unique(piece, return_counts=True))
            half.settle()
            assert half.error < least
            halves.append(half)
        whole = C.Summary(10**9, 16)
        whole.least = least
        for piece in np.array_split(stream, 100):
            whole.merge(*np.unique(piece, return_counts=True))
        found = set(whole.survivors().tolist())
        assert {k for k, a in true.items() if a >= least} <= found and len(whole.keys) <= whole.capacity
        enough = C.Summary(least, len(stream) // least)
        for piece in np.array_split(stream, 100):
            enough.merge(*np.unique(piece, return_counts=True))
        assert {k for k, a in true.items() if a >= least} <= set(enough.survivors().tolist())
        assert enough.capacity == len(stream) // least and enough.error < least
        held = dict(zip(whole.keys.tolist(), whole.counts.tolist(), strict=True))
        assert all(true[k] - whole.error <= c <= true[k] for k, c in held.items())
        merged = C.Summary(least * 8, 64)
        for half in halves:
            merged.merge(half.keys, half.counts, half.error)
        merged.settle()
        assert all(true[k] <= merged.error for k in true if k not in set(merged.keys.tolist()))


def test_equal_keys_of_different_phrases(spark, monkeypatch):
    """All words share one key: filters and summaries see one n-gram of each length, counts are still of phrases."""
    monkeypatch.setattr(C.Words, "hashes", lambda self: np.ones(len(self.spelt), np.uint64))
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": [b"a b a b c d"]})
    everything = SimpleNamespace(value=SimpleNamespace(has=lambda k: np.ones(len(k), bool)))
    run = C._phrase_counts(everything, everything, 2)
    out = [r for b in run(iter([batch])) for r in b.to_pylist()]
    assert {(r["phrase"], r["a"]) for r in out} == {(b"a b", 2), (b"b a", 1), (b"b c", 1), (b"c d", 1)}


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000_000_000
    counts = spark.createDataFrame([("en", "a", 1, big * 2), ("en", "b", 1, big), ("en", "a b", 2, big)], "lang string, phrase string, words int, a long")
    assert C.weakest_cuts(counts).first()["score"] == 2_000_000 * big // (3 * big)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert query_collocations.query(spark, str(tmp_path)).count() == 0
