import random

import numpy as np
import pytest

from gristmill.llm import near_copies

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def plain_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def plain_kept(docs):
    sets = {i: plain_set(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            common = len(sets[i] & sets[j])
            if i < j and 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted({find(i) for i in ids})


def test_stage_equals_brute_force(spark):
    rnd = random.Random(11)
    vocab = ["w%d" % i for i in range(3000)]
    texts = [None, "", " \t", "one", "One", "one two three four", "one two three four five", "a b c d e f g h", "a b c d e f g i"]
    licence = [rnd.choice(vocab) for _ in range(60)]
    for _ in range(50):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([5, 8, 9, 12, 20, 40, 150, 600]))] + (licence if rnd.random() < 0.3 else [])
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 4)):
            other = base[:]
            for _ in range(rnd.randint(1, 1 + len(base) // 30)):
                other[rnd.randrange(len(other))] = "changed"
            texts.append("\n".join(other + ["tail"] * rnd.randint(0, 1)))
    docs = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    want = plain_kept(docs)
    assert len(want) < len(docs) - 20
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()) == want


def test_near_copy_far_apart_in_fingerprints(spark):
    rnd = random.Random(2)
    body = [rnd.choice("abcdefgh") + str(rnd.randrange(900)) for _ in range(200)]
    docs = [(2, " ".join(body + ["x%d" % i for i in range(40)])), (1, " ".join(body)), (3, " ".join(body[100:] + body[:100][::-1]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()) == [1, 3]


def test_ball_hashing_finds_copies_without_the_smallest_hashes(spark, monkeypatch):
    """The stage's SimHash balls alone link what differs in three bits, and links are verified."""
    monkeypatch.setattr(near_copies, "_pairs", lambda batches: iter(()))
    rnd = random.Random(3)
    docs = []
    for i in range(40):
        body = ["w%d" % rnd.randrange(5000) for _ in range(400)]
        docs += [(3 * i, " ".join(body)), (3 * i + 1, " ".join(body + ["tail"])), (3 * i + 2, " ".join(reversed(body)))]
    fps = {d: int(np.frombuffer(near_copies.wide_fingerprint(near_copies.shingle_set(t)), "<u8")[0]) for d, t in docs}
    close = [3 * i + 1 for i in range(40) if (fps[3 * i] ^ fps[3 * i + 1]).bit_count() <= 3]
    assert len(close) > 20
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in near_copies.keep_one(frame).collect()) == [d for d, _ in docs if d not in close]


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert corpus_pipeline.drop_near_duplicates(spark, frame, "").count() == 0


def test_fingerprints_stay_within_the_radius():
    rnd = np.random.default_rng(5)
    for n in (64, 65, 100, 1000):
        for _ in range(200):
            both = rnd.integers(0, 1 << 63, n, dtype=np.uint64)
            cut = n - n // 9
            a, b = (np.frombuffer(near_copies.wide_fingerprint(x), np.uint64) for x in (both[:cut], both[n - cut :]))
            assert np.bitwise_count(a ^ b).sum() <= near_copies.RADIUS


@pytest.mark.parametrize("tile", [4, 1024])
def test_large_families_and_tiles_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(near_copies, "TILE", tile)
    monkeypatch.setattr(near_copies, "COLUMNS", 64)
    rnd = random.Random(21)
    vocab = ["w%d" % i for i in range(2000)]
    base = [rnd.choice(vocab) for _ in range(120)]
    texts = []
    for i in range(90):
        other = base[:]
        for _ in range(rnd.choice([1, 2, 3, 5, 9])):
            other[rnd.randrange(len(other))] = rnd.choice(vocab)
        texts.append(" ".join(other))
    drift = base[:]
    for i in range(12):  # a chain whose ends have little in common
        drift[8 * i : 8 * i + 3] = [f"d{i}a", f"d{i}b", f"d{i}c"]
        texts.append(" ".join(["z%d" % k for k in range(90)] + drift))
    docs = [(rnd.randrange(10**6) * 200 + i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert sorted(r["doc_id"] for r in near_copies.keep_one(frame).collect()) == plain_kept(docs)


def test_tile_forest_equals_all_pairs():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 40))).astype(np.uint64) for _ in range(60)]
    for left in (np.ones(60, bool), np.arange(60) < 25):
        found = near_copies.tile_forest(list(range(60)), sets, left)
        root = list(range(60))

        def joined(pairs):
            label = list(range(60))
            for a, b in pairs:
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
            return label

        plain = []
        for i in range(60):
            for j in range(i):
                common = len(np.intersect1d(sets[i], sets[j]))
                if 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common) and (left.all() or left[i] != left[j]):
                    plain.append((i, j))
        assert joined(found) == joined(plain) and len(found) < 60 and set(found) <= {(a, b) for p in plain for a, b in (p, p[::-1])} and root
