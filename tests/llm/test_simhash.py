import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from gristmill.llm import query_simhash, simhash


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_query_equals_brute_force(spark, tmp_path):
    rnd = random.Random(3)
    vocab = ["w%d" % i for i in range(40)] + ["É", "ABC", "ß"]
    texts = [None, "", "  \t", "one", "one two", "One two three", "one two three four"]
    for _ in range(60):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(3, 300))]
        texts += [" ".join(base)] * rnd.choice([1, 1, 3])
        for _ in range(rnd.randint(0, 4)):
            other = base[:]
            other[rnd.randrange(len(other))] = "changed"
            texts.append("\n".join(other))
    docs = {i * 3 + 1: t for i, t in enumerate(texts)}
    spark.createDataFrame([(i, t, 0) for i, t in docs.items()], "doc_id long, text string, fp int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in query_simhash.query(spark, str(tmp_path)).collect()}
    fps = {i: plain_fingerprint(t) for i, t in docs.items()}
    want = plain_components(fps)
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: "%016x" % f for i, f in fps.items()}
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_links_keep_every_component(spark):
    rnd = random.Random(7)
    values = set()
    for _ in range(30):
        center = rnd.getrandbits(64)
        for _ in range(25):
            x = center
            for _ in range(rnd.randint(0, 4)):
                x ^= 1 << rnd.randrange(64)
            values.add(x)
    fps = {x: x for x in values}
    frame = spark.createDataFrame([(simhash._signed(x),) for x in values], "fp long")
    found = simhash.star_components(simhash.links(frame)).collect()
    root = {x: x for x in values}
    for r in found:
        root[r["node"] % 2**64] = r["root"] % 2**64
    want = plain_components(fps)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups(root) == groups(want)


def test_large_bucket_is_exact(monkeypatch):
    monkeypatch.setattr(simhash, "PAIRWISE", 8)
    rnd = random.Random(1)
    mask = simhash._kept_masks()[0]
    variant = rnd.getrandbits(64) & mask
    dropped = [rnd.getrandbits(21) for _ in range(6)]
    fps = np.array(sorted({variant ^ rnd.choice([0, 1 << rnd.randrange(21, 64)]) | rnd.choice(dropped) for _ in range(120)}), np.uint64)
    small = simhash.canonical_links(0, variant, fps)
    monkeypatch.setattr(simhash, "PAIRWISE", 1000)
    large = simhash.canonical_links(0, variant, fps)
    assert sorted(b for _, b in small) == sorted(b for _, b in large)


def test_keep_one_and_empty(spark):
    docs = spark.createDataFrame([(2, "a b c d", "x"), (1, "a b c d", "y"), (3, "q r s t u", "z"), (4, None, "n"), (5, "", "n")], "doc_id long, text string, source string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [1, 3, 4]
    assert simhash.components(docs.filter(F.lit(False))).count() == 0


def test_long_texts_ties_and_repeated_ids(spark):
    long = "stone river " * 60_000
    rows = [(9, long), (4, long), (4, "a b c d"), (7, "a b c d"), (None, "q r s t u"), (8, "q r s t u"), (2, " \n "), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r["doc_id"] or -1), r["fp"], r["component_id"]) for r in simhash.components(docs).collect())
    assert len(found) == len(rows)
    by_fp = {}
    for _, fp, component in found:
        by_fp.setdefault(fp, set()).add(component)
    assert all(len(v) == 1 for v in by_fp.values())
    assert by_fp[simhash._signed(simhash.fingerprint(long))] == {4} and by_fp[0] == {2}
    assert by_fp[simhash._signed(simhash.fingerprint("q r s t u"))] == {8}
