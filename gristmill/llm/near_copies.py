"""Near copies by word shingles: documents whose five-word shingle sets have a Jaccard similarity of 0.8 or more.

Candidates come from two sides, and whatever they find is verified on all shingles. ``simhash``'s meet-in-the-middle ball hashing links
64-bit fingerprints of the sets that differ in three bits at most. These balls alone cannot serve the bound: at similarity 0.8 two
fingerprints differ in ten bits on average, and balls wide enough to meet hold nearly all pairs. So what lies farther apart meets in
the smallest XXH64 values of its shingles, and wider fingerprints only thin out the pairs that collide:

1. Equal shingle sets are one set from here on, named by the XXH64 of their sorted hashes. Their 64-bit fingerprints link by balls.
2. Besides, a set of n shingles emits its ``KEYS`` smallest hashes, fewer if n - ceil(0.8 n) + 1 are fewer: no similar pair's first
   common hash lies behind that many. In a similar pair at least 0.8 of the union is common, so the chance that none of the
   union's ``KEYS`` smallest hashes is common is at most 0.2 ** KEYS (7e-12); shorter sets are met with certainty.
3. Pairs that share a hash are candidates if sizes allow the similarity, if the hash can be among the union's ``KEYS`` smallest,
   and if 256-bit SimHash fingerprints differ in at most ``RADIUS`` bits. A similar pair differs in 39 on average with a deviation
   of 6, and in more than 64 with a chance of 5e-6; sets under ``FEW`` shingles pass up to ``WIDE`` bits, under ``TINY`` all.
   A bucket passes on a spanning forest of its candidates, never all pairs; their components hold every similar pair.
4. Whole shingle sets travel once, to their component. Within it all pairs are verified exactly by matrix products over the
   shingles that sets share, and again only a forest of the links is passed on. A component of more than ``TILE`` sets is dealt in
   tiles, each of two blocks, so none is held in one place.

Texts under five words are one shingle; null and word-less texts have the empty set and count as copies of each other. Copies
of copies belong to one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_batches, written
from .simhash import SEED, shingle_hashes, star_components
from .simhash import links as ball_links

SIZE = 5
KEYS = 16
RADIUS, WIDE = 64, 80
FEW, TINY = 64, 24
TILE = 1024
COLUMNS = 4096


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles."""
    return np.unique(shingle_hashes(text, SIZE))


def digest(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED)


def prefix_length(n: int) -> int:
    """How many of the smallest hashes of a set of n must be looked up."""
    return min(KEYS, n - -(-4 * n // 5) + 1) if n else 0


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """256 SimHash bits of a set: its hashes and three remixed forms of them."""
    counts = np.zeros(256, np.int64)
    for start in range(0, len(hashes), 1 << 14):
        x = hashes[start : start + (1 << 14)]
        forms = [x]
        for _ in range(3):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
            forms.append(x)
        rows = np.stack(forms, axis=1).astype("<u8").view(np.uint8)
        counts += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * counts > len(hashes), bitorder="little").tobytes()


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, set (digest of the shingle set), n, fp, its first 64 bits and keys of every document."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, fps, keys = [], [], [], []
            for x in batch.column(1):
                own = shingle_set(x.as_py() or "")
                names.append(digest(own))
                sizes.append(len(own))
                fps.append(wide_fingerprint(own))
                keys.append(own[: prefix_length(len(own))].view(np.int64))
            columns = [batch.column(0), pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(fps, pa.binary()), pa.array(np.frombuffer(b"".join(fps), "<i8")[::4]), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "set", "n", "fp", "fp64", "keys"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, set bigint, n bigint, fp binary, fp64 bigint, keys array<bigint>")


def bucket_forest(sets: np.ndarray, n: np.ndarray, pos: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """A spanning forest of the candidate pairs of one hash's sets (sorted by n): sizes, positions and fingerprints let them through."""
    ends = np.searchsorted(n, 5 * n // 4, side="right")
    label, out = np.arange(len(sets)), []
    for i, end in enumerate(ends.tolist()):
        j = np.arange(i + 1, end)
        j = j[(pos[i] + pos[j] < KEYS) & (label[j] != label[i])]
        if n[i] >= TINY:
            j = j[np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1) <= (RADIUS if n[i] >= FEW else WIDE)]
        if len(j):
            others, at = np.unique(label[j], return_index=True)
            out += [(sets[i], sets[k]) for k in j[at].tolist()]
            label[np.isin(label, others)] = label[i]
    return np.array(out, np.int64).reshape(-1, 2)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and n in, pairs out. One bucket is held at a time."""
    key, held = None, []

    def close() -> Iterator[pa.RecordBatch]:
        if sum(len(h[0]) for h in held) > 1:
            found = bucket_forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            for i in range(0, len(found), 100_000):
                yield emit([found[i : i + 100_000]])

    def emit(found: list[np.ndarray]) -> pa.RecordBatch:
        both = np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, sets, n, pos = (batch.column(i).to_numpy() for i in range(4))
        fps = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(-1, 4)
        bounds = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        shared = np.flatnonzero(np.diff(bounds) > 1)
        for g in sorted({0, len(bounds) - 2, *shared.tolist()}):  # keys of one row matter only where a batch begins or ends
            a, b = bounds[g], bounds[g + 1]
            if keys[a] != key:
                yield from close()
                key, held = keys[a], []
            held.append((sets[a:b], n[a:b], pos[a:b], fps[a:b]))
    yield from close()


def ball_pairs(found: DataFrame) -> DataFrame:
    """Pairs a, b that connect all different sets whose 64-bit fingerprints differ in at most three bits."""
    sets = found.select("set", F.col("fp64").alias("fp")).distinct()
    firsts = sets.groupBy("fp").agg(F.min("set").alias("first"), F.count(F.lit(1)).alias("times"))
    same = sets.join(firsts.filter("times > 1"), "fp").filter("set <> first").select(F.col("first").alias("a"), F.col("set").alias("b"))
    named = firsts.select("fp", "first")
    near = ball_links(firsts).join(named.toDF("a", "left"), "a").join(named.toDF("b", "right"), "b")
    return near.select(F.col("left").alias("a"), F.col("right").alias("b")).union(same)


def candidates(found: DataFrame) -> DataFrame:
    """Pairs a, b of different sets that may be similar: enough of them to connect all that may be."""
    return ball_pairs(found).union(key_pairs(found)).distinct()


def key_pairs(found: DataFrame) -> DataFrame:
    """Pairs a, b of different sets that meet in one of their smallest hashes."""
    sets = found.select("set", "n", "fp", "keys").dropDuplicates(["set"])
    spread = sets.select("set", "n", "fp", F.posexplode("keys").alias("pos", "key")).select("key", "set", "n", "pos", "fp")
    return spread.repartition("key").sortWithinPartitions("key", "n").mapInArrow(_pairs, "a bigint, b bigint")


def shingle_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """set (the digest) and its hashes, a row for each document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                own = [shingle_set(x.as_py() or "") for x in batch.column(0)[start : start + 100]]
                names = np.array([digest(x) for x in own], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], names=["set", "hashes"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "set bigint, hashes array<bigint>")


def tile_forest(names: list[int], sets: list[np.ndarray], left: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with similarity 0.8 or more between the ``left`` sets and the others, or among all if all are left."""
    sizes = np.array([len(x) for x in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = number[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(sets), len(sets)), np.float32)  # whole numbers below 2 ** 24 are exact
    for start in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, (start, start + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        common += part @ part.T
    label, out = np.arange(len(sets)), []
    whole = bool(left.all())
    for i in np.flatnonzero(left).tolist():
        linked = 9 * common[i].astype(np.int64) >= 4 * (sizes[i] + sizes)  # 5 c >= 4 (total - c), a row at a time
        j = np.flatnonzero(linked & (label != label[i]) & (True if whole else ~left))
        if len(j):
            others, at = np.unique(label[j], return_index=True)
            out += [(names[i], names[k]) for k in j[at].tolist()]
            label[np.isin(label, others)] = label[i]
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (root, one, other, block, set, hashes) sorted by the first three in, links out. One tile is held at a time."""
    key, rows, out = None, [], []

    def close() -> None:
        if len(rows) > 1:
            left = np.array([r[0] == key[1] for r in rows])
            out.extend(tile_forest([r[1] for r in rows], [r[2] for r in rows], left))

    def emit() -> pa.RecordBatch:
        pairs = np.array(out, np.int64).reshape(-1, 2)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        heads = list(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
        for i, (root, one, other, block, name) in enumerate(heads):
            if (root, one, other) != key:
                close()
                key, rows = (root, one, other), []
            rows.append((block, name, batch.column(5)[i].values.to_numpy().view(np.uint64)))
        if len(out) > 10_000:
            yield emit()
    close()
    yield emit()


def links(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs a, b of sets with similarity 0.8 or more that connect all such pairs, verified on all shingles; found: the documents' sketches."""
    rooted = star_components(candidates(found)).select(F.col("node").alias("set"), "root")
    rooted = written(rooted.union(rooted.select(F.col("root").alias("set"), "root").distinct()).distinct())
    sizes = rooted.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks"))
    ids = written(found.join(rooted.select("set"), "set", "left_semi").groupBy("set").agg(F.min("doc_id").alias("__id")).select("__id").distinct())
    sets = shingle_sets(docs.join(ids, docs[doc_id].eqNullSafe(ids["__id"]), "left_semi"), doc_id, text).groupBy("set").agg(F.first("hashes").alias("hashes"))
    placed = rooted.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiles = placed.select("root", "block", "set", other).select("root", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("other"), "block", "set")
    dealt = tiles.join(sets, "set").select("root", "one", "other", "block", "set", "hashes")
    key = ["root", "one", "other"]
    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(_verify, "a bigint, b bigint")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each group of near copies the row with the smallest id stays (a repeated id: all its rows)."""
    found = written(sketches(docs, doc_id, text))
    firsts = found.groupBy("set").agg(F.min("doc_id").alias("first_id"))
    stars = star_components(links(docs, found, doc_id, text))
    rooted = firsts.join(stars, firsts["set"] == stars["node"], "left").select("first_id", F.coalesce("root", "set").alias("root"))
    keep = checkpointed(rooted.groupBy("root").agg(F.min("first_id").alias("__id")).select("__id").distinct())
    return docs.join(keep, docs[doc_id].eqNullSafe(keep["__id"]), "left_semi")
