"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint bit is 1 if more than half of the text's 3-word shingles have it set in their XXH64 (seed 42). Two fingerprints
link if at most three bits differ.

Meeting in the middle: the 64 bits fall into ``GROUPS`` blocks. A pair that differs in 1 to 3 bits has a differing bit in some
block; with that block left out, at most two bits differ, and half of that radius is one. So every fingerprint emits, for each
block left out, all variants of the remaining bits within one flip; a linked pair meets in a common variant. (Balls of radius
two over all 64 bits would meet as well, but hold 2081 variants for each fingerprint where these hold 131.) Fingerprints are
shuffled on variants; where they collide, a pair counts only in the one bucket that is canonical for it (first block whose
removal brings it within two bits; smallest common variant), and only after the full distance is verified. A bucket passes on
a spanning forest of its links, never all pairs, so the links' components are kept whole with fewer rows than members.

Defined cases: null and word-less texts have fingerprint zero and link like any other; fewer than three words hash as one
shingle; repeated rows and ids each keep a row; ties go to the smallest id; an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_batches

SEED = 42
RADIUS = 3
#: Bit positions of the blocks, low to high.
GROUPS = (range(0, 21), range(21, 42), range(42, 64))
PAIRWISE = 2048


def shingle_hashes(text: str, size: int = 3) -> np.ndarray:
    """XXH64 of every ``size``-word shingle, repeats included; the whole sequence if it is shorter."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    shifted = [words[i:] for i in range(size)]
    return np.fromiter((digest(s, SEED) for s in map(b" ".join, zip(*shifted, strict=False))), np.uint64, len(words) - size + 1)


def fingerprint(text: str) -> int:
    hashes = shingle_hashes(text)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        block = hashes[start : start + (1 << 16)]
        counts += np.unpackbits(block.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every document."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x or "") for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _kept_masks() -> list[int]:
    return [(1 << 64) - 1 - sum(1 << b for b in group) for group in GROUPS]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _flips(mask: int) -> Column:
    """The masked fingerprint and each single flip of a kept bit."""
    rest = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
    bits = F.array(F.lit(0).cast("bigint"), *(F.shiftleft(F.lit(1).cast("bigint"), b) for b in range(64) if mask >> b & 1))
    return F.transform(bits, lambda bit: rest.bitwiseXOR(bit))


def variants(fps: DataFrame) -> DataFrame:
    """side (the block left out), variant and fp: the remaining bits of every fingerprint and each single flip of them."""
    sides = [F.struct(F.lit(side).alias("side"), _flips(mask).alias("vs")) for side, mask in enumerate(_kept_masks())]
    spread = fps.select("fp", F.inline(F.array(*sides)))
    return spread.select("side", F.explode("vs").alias("variant"), "fp")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def canonical_links(side: int, variant: int, fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links that are canonical for one bucket; fps: distinct unsigned fingerprints."""
    masks = [np.uint64(m) for m in _kept_masks()]
    variant = np.uint64(variant)
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def link(left: np.ndarray, right: np.ndarray) -> None:
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)

    def compare(left: np.ndarray, right: np.ndarray, upper: bool) -> None:
        differ = fps[left][:, None] ^ fps[right][None, :]
        ok = _popcount(differ) <= radius
        if upper:
            ok &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
        i, j = np.nonzero(ok)
        if not len(i):
            return
        diff = differ[i, j]
        for earlier in masks[:side]:
            good = _popcount(diff & earlier) > 2
            i, j, diff = i[good], j[good], diff[good]
        a, b = fps[left[i]] & masks[side], fps[right[j]] & masks[side]
        within = a ^ b
        lowest = within & (~within + np.uint64(1))
        count = _popcount(within)
        middle = np.where(count == 2, np.minimum(a ^ lowest, b ^ lowest), np.minimum(a, b))
        good = (count <= 2) & (middle == variant)
        link(left[i[good]], right[j[good]])

    def blocks(members: np.ndarray) -> None:
        for s in range(0, len(members), PAIRWISE):
            own = members[s : s + PAIRWISE]
            compare(own, own, True)
            for t in range(s + PAIRWISE, len(members), PAIRWISE):
                compare(own, members[t : t + PAIRWISE], False)

    if len(fps) <= PAIRWISE:
        blocks(np.arange(len(fps)))
    else:  # members share nearly all kept bits; linked pairs agree on at least one of four parts of the block left out
        for k in range(4):
            word = fps & np.uint64(sum(1 << b for b in GROUPS[side][k::4]))
            order = np.argsort(word, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(word[order])) + 1):
                if len(part) > 1:
                    blocks(part)
    return [(int(fps[root(i)]), int(fps[i])) for i in range(len(fps)) if root(i) != i]


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by side and variant in; links of each bucket out. One bucket is held at a time, eight bytes a fingerprint."""
    key, held, out = None, [], []

    def close() -> None:
        if len(held) > 1 or held and len(held[0]) > 1:
            out.extend(canonical_links(*key, np.concatenate(held)))

    def emit() -> pa.RecordBatch:
        pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        side, variant, fp = (batch.column(i).to_numpy() for i in range(3))
        variant, fp = variant.view(np.uint64), fp.view(np.uint64)
        bounds = np.concatenate(([0], np.flatnonzero((np.diff(side) != 0) | (variant[1:] != variant[:-1])) + 1, [len(fp)]))
        shared = np.flatnonzero(np.diff(bounds) > 1)
        last = len(bounds) - 2
        for g in sorted({0, last, *shared.tolist()}):  # buckets of one row matter only where a batch begins or ends
            a, b = bounds[g], bounds[g + 1]
            own = (int(side[a]), int(variant[a]))
            if own != key:
                close()
                key, held = own, []
            held.append(fp[a:b])
        if len(out) > 10_000:
            yield emit()
    close()
    yield emit()


def links(fps: DataFrame) -> DataFrame:
    """Links a, b between different fingerprints; together they connect all that are within the radius of each other."""
    key = ["side", "variant"]
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = variants(fps.select("fp").distinct().repartition(tasks, "fp"))  # each row becomes 131
    return spread.repartition(*key).sortWithinPartitions(*key).mapInArrow(_bucket_links, "a bigint, b bigint").distinct()


def star_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node of each component, by alternating large-star and small-star steps until nothing changes.

    Each round is two grouped minima and joins on them, written to reliable storage; no component is gathered in one place.
    """
    state = checkpointed(edges.select("a", "b").filter("a <> b"))
    seen = None
    for _ in range(max_rounds):
        both = state.select("a", "b").union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
        state = checkpointed(small.select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).filter("a <> b").distinct())
        now = tuple(state.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if now == seen:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
    raise RuntimeError("components did not settle")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) of every document."""
    fps = checkpointed(fingerprints(docs, doc_id, text))
    firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    stars = star_components(links(fps))
    rooted = firsts.join(stars, firsts["fp"] == stars["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    per_fp = rooted.join(named, "root").select("fp", "component_id")
    return fps.join(per_fp, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near-duplicates: of each component the row with the smallest id stays (a repeated id: all its rows)."""
    found = components(docs, doc_id, text)
    keep = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(keep, docs[doc_id] == keep["__id"], "left_semi")
