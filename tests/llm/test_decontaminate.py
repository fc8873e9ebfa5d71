import random
import re

import duckdb
import numpy as np
import pytest

from gristmill.llm import decontaminate as dc
from gristmill.llm import query_decontaminate


def naive_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def naive(docs, items, window=10):
    """n_words, hit word places and items of every (doc_id, text)."""
    phrases = []
    for item, text in items:
        words = naive_words(text) if item is not None and text is not None else []
        for i in range(max(1, len(words) - window + 1) if words else 0):
            phrases.append((str(item), words[i : i + window]))
    out = []
    for doc, text in docs:
        words, hit, found = naive_words(text), set(), set()
        for item, p in phrases:
            for i in range(len(words) - len(p) + 1):
                if words[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    found.add(item)
        out.append((doc, len(words), len(hit), sorted(found)))
    return out


def cases(seed, docs=40, vocabulary=6):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh"[:vocabulary]) * rnd.randint(1, 2)
    items = [(i, " ".join(word() for _ in range(rnd.randint(1, 16)))) for i in range(12)]
    items += [(20, None), (None, "a b"), (21, "!!!"), (22, items[3][1].upper()), (22, items[3][1])]
    texts = []
    for _ in range(docs):
        body = [word() for _ in range(rnd.randint(0, 40))]
        if rnd.random() < 0.6:
            body += rnd.choice(items[:12])[1].split()
        texts.append(rnd.choice([" ", "\n", ", ", "--"]).join(body))
    return [(i, t) for i, t in enumerate([*texts, None, "", "?!", texts[0], texts[1] + " \u00e9\u65e5 A1"])], items


@pytest.mark.parametrize("seed", range(4))
def test_index_against_naive_search(seed):
    rng = np.random.default_rng(seed)
    seq = rng.integers(1, 5, 300)
    seq[rng.integers(0, 300, 12)] = 0
    seq[[150, 299]] = 0
    seq[200:250] = seq[100:150]
    index = dc.FmIndex(seq, 5, sample=3)
    suffixes = sorted(range(300), key=lambda i: [(v > 0, v if v else i + j) for j, v in enumerate(seq[i:].tolist())])
    assert index.first.tolist() == [int((seq < s).sum()) for s in range(6)]
    assert dc.FmIndex._suffix_order(seq).tolist() == suffixes
    bwt = seq[np.array(suffixes) - 1]
    symbols, upto = rng.integers(0, 5, 60), rng.integers(0, 301, 60)
    assert index.rank(symbols, upto).tolist() == [int((bwt[:u] == s).sum()) for s, u in zip(symbols, upto)]
    words = rng.integers(1, 5, (40, 4))
    lengths = rng.integers(1, 5, 40)
    low, high = index.search(words, lengths)
    for w, n, a, b in zip(words, lengths, low, high):
        want = [i for i in range(300 - n + 1) if seq[i : i + n].tolist() == w[:n].tolist()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("vocabulary", [2, 6])
def test_shards_against_naive_search(vocabulary):
    docs, items = cases(vocabulary, vocabulary=vocabulary)
    phrases = dc.Phrases([(str(i), t) for i, t in items if i is not None and t is not None])
    found = dc.search_shard([t or "" for _, t in docs], phrases)
    assert [(i, x[0], x[1], x[3]) for (i, _), x in zip(docs, found)] == naive(docs, items)
    for (_, text), (_, hits, spans, _) in zip(docs, found):
        assert dc.count_hit_words(text or "", spans) == hits
        assert all(not text[a - 1 : a].isalnum() and not text[b : b + 1].isalnum() for a, b in spans)


@pytest.mark.parametrize(("block_bytes", "shard_words"), [(1 << 20, 1 << 20), (20, 50)])
def test_blocks_shards_and_clashing_names(spark, block_bytes, shard_words):
    docs, items = cases(9)
    frame = spark.createDataFrame([(i, t, f"k{i}", i) for i, t in docs], "doc_id long, text string, items string, n_hit long").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = dc.contaminated_spans(frame, benchmark, ["doc_id", "items", "n_hit"], block_bytes=block_bytes, shard_words=shard_words)
    assert found.columns == ["doc_id", "items_kept", "n_hit_kept", "text", "n_words", "n_hit", "spans", "items"]
    rows = sorted(found.collect())
    assert [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in rows] == naive(docs, items)
    assert all(r["items_kept"] == f"k{r['doc_id']}" and r["n_hit_kept"] == r["doc_id"] for r in rows)


def test_cut_texts(spark):
    passage = " ".join(f"w{i}" for i in range(14))
    docs = [(1, f"\u00e9 before, {passage}! after \U0001f600"), (2, passage.upper()), (3, "clean text"), (4, None), (5, f"{passage} mid {passage}")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, spans string")
    out = {r["doc_id"]: r for r in dc.remove_spans(frame, spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()}
    assert {i: r["text"] for i, r in out.items()} == {1: "\u00e9 before, ! after \U0001f600", 2: "", 3: "clean text", 4: None, 5: " mid "}
    assert all(r["spans"] == "x" for r in out.values())


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in dc.contaminated_spans(docs, items, ["doc_id"]).collect()] == [(1, "a b", 2, 0, [], [])]
    assert dc.contaminated_spans(docs.limit(0), items, ["doc_id"]).count() == 0


def test_query_equals_its_sql(spark, tmp_path):
    docs, items = cases(5, docs=60)
    docs += [(900, "a " * 30_000 + items[0][1]), (901, docs[2][1])]
    items = [(i, t) for i, t in items if i is not None]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = sorted(tuple(r[n] for n in names) for r in query_decontaminate.query(spark, str(tmp_path)).collect())
    with duckdb.connect() as db:
        for name in ("documents", "benchmark"):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        assert sorted(db.execute(f"SELECT {', '.join(names)} FROM ({query_decontaminate.SQL})").fetchall()) == got
