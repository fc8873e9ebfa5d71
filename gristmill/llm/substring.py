"""Substring deduplication: suffix automata of reference shards, documents' passages streamed through for matching statistics.

A window is ``WINDOW`` consecutive words; a word goes if a window over it also starts earlier (smaller id, or the same document
further up). Automata of the whole corpus can't be broadcast: they grow with it, and every document would stream through every
shard. So shards are routed, and a passage meets just the shard that can hold its windows:

1. Routes. The least-hashed ``GRAM``-word gram of every window is its anchor; equal windows have equal anchors, and about one
   word in eight is one. Anchors are grouped by hash; what was met once can't repeat and is left out.
2. Passages. The windows around one place of a repeated anchor form a passage of at most ``2 * WINDOW`` words. Passages travel to
   their anchor's shard; equal passages of a task are combined before, only the earliest travels. Anchors that are met very often
   (``HOT_PLACES``) are split: there every window travels by itself, by its own hash, so that what meets is equal and
   combines as well.
3. Automata. A shard holds whole anchors, about ``SHARD_WORDS`` words. Its suffix automaton keeps for every state the earliest
   window that ends there; all passages stream through it, and where the matching statistic reaches ``WINDOW`` words, a window
   goes if the automaton knows an earlier start.

Texts move once: they are written bucketed by id, and passages and removals are joined to the buckets.

Defined cases: null and empty texts have no words; texts shorter than a window stay whole; texts of any length are read whole; a
null id takes no part in matching; rows that share an id and text don't remove each other, nor do windows at the same place of
different texts under one id; repeated texts under different ids leave the smallest id's; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_chunks, shared_dir, small_batches, written

WINDOW = 20
GRAM = 5
CHUNK_WORDS = 1 << 21
SHARD_WORDS = 1 << 16
#: An anchor is hot from so many places on.
HOT_PLACES = 4096
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A mixed polynomial hash of every ``size`` consecutive values."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * _MULTIPLIER + h[j : n + j]
    out ^= out >> np.uint64(29)
    out *= _MIX
    return out ^ (out >> np.uint64(32))


def sliding_least(g: np.ndarray, size: int) -> np.ndarray:
    """Index of the leftmost least value among every ``size`` consecutive ones, by doubling."""
    arg = np.arange(len(g))
    covered = 1
    while covered < size:
        step = min(covered, size - covered)
        left, right = arg[: len(arg) - step], arg[step:]
        arg = np.where(g[right] < g[left], right, left)
        covered += step
    return arg


def anchors(sizes: list[int], h: np.ndarray) -> tuple[np.ndarray, ...]:
    """For documents laid end to end: anchor hash, document index, first window's start and number of windows of every segment."""
    ends = np.cumsum(sizes)
    starts = ends - np.array(sizes)
    g = gram_hashes(h, GRAM)
    arg = sliding_least(g, WINDOW - GRAM + 1)
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(arg)]
    whole = np.arange(len(arg)) + WINDOW <= ends[doc]
    at = np.flatnonzero(whole)
    if not len(at):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    arg, doc = arg[at], doc[at]
    new = np.flatnonzero(np.concatenate(([True], (arg[1:] != arg[:-1]) | (doc[1:] != doc[:-1]))))
    return g[arg[new]], doc[new], at[new] - starts[doc[new]], np.diff(np.append(new, len(at)))


def _table(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def _slices(batch: pa.RecordBatch, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def _scattered(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Keys that deal rows evenly."""
    return gram_hashes(doc.astype(np.uint64) * _MIX + start.astype(np.uint64), 1).view(np.int64)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """met: how often this chunk holds the anchor, on its first row; 0: a further row, known to repeat, with its anchor in ``hash``."""
    for group in in_chunks(batches, lambda b: b.nbytes // 7 + 1, CHUNK_WORDS):
        ids = np.concatenate([b.column(0).to_numpy() for b in group])
        rows = np.concatenate([b.column(1).to_numpy() for b in group])
        split = [words_of(t) for b in group for t in b.column(2).to_pylist()]
        h, doc, start, n = anchors([len(w) for w in split], np.concatenate([word_hashes(w) for w in split]))
        if not len(h):
            continue
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
        met = np.zeros(len(h), np.int32)
        met[order[first]] = np.diff(np.append(first, len(h)))
        key = h.view(np.int64).copy()
        key[met == 0] = _scattered(ids[doc], start)[met == 0]
        yield from _slices(_table({"key": key, "met": met, "hash": h.view(np.int64), "doc_id": ids[doc], "row": rows[doc], "start": start.astype(np.int32), "n": n.astype(np.int32)}))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by key, regrouped so that no key is split between tables; a key has at most a row for each chunk of words."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut or (held and held[-1].column(0)[-1].as_py() != keys[0]):
            if cut:
                held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _repeated_anchors(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places of repeated anchors; a row with n = 0 names an anchor met more than ``limit`` times."""
        for t in _whole_groups(batches):
            c = {name: t[name].to_numpy() for name in t.column_names}
            new = np.concatenate(([0], np.flatnonzero(c["key"][1:] != c["key"][:-1]) + 1))
            total = np.add.reduceat(c["met"].astype(np.int64), new)
            keep = (c["met"] == 0) | (np.repeat(total, np.diff(np.append(new, len(c["key"])))) > 1)
            yield _table({k: c[k][keep] for k in ("doc_id", "row", "start", "n", "hash")})
            hot = c["hash"][new[total > limit]]
            if len(hot):
                none = np.zeros(len(hot), np.int32)
                yield _table({"doc_id": hot * 0, "row": none, "start": none, "n": none, "hash": hot})

    return run


class _Earliest:
    """Equal passages combined: the earliest place of each is held, windows of later places go."""

    def __init__(self):
        self.held: dict[bytes, list[tuple[int, int, int, int]]] = {}
        self.gone: list[tuple[int, int, int, int]] = []

    def meet(self, passage: bytes, doc: int, row: int, start: int, n: int) -> None:
        own = (doc, row, start, n)
        held = self.held.get(passage)
        if held is None:
            self.held[passage] = [own]
            return
        first = held[0]
        if (doc, start) > (first[0], first[2]):
            self.gone.append(own)
        elif (doc, start) < (first[0], first[2]):
            self.gone += held
            self.held[passage] = [own]
        elif own not in held:  # another text under the same id
            held.append(own)


_PASSAGE = "key bigint, doc_id bigint, row int, start int, n int, passage binary"
_RUN = "doc_id bigint, row int, start int, n int"


def _passage_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "doc_id", "row", "start", "n", "passage"])


def _passages():
    """Documents with their places in, passages out. No passage: a place whose windows all go, settled within the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in in_chunks(batches, lambda b: b.nbytes // 7 + 1, CHUNK_WORDS):
            found, keys = _Earliest(), {}
            for batch in group:
                for i in range(batch.num_rows):
                    doc, own, spots = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(3)[i].values
                    words = words_of(batch.column(2)[i].as_py())
                    for r, s, k, h, split in zip(*(spots.field(k).to_pylist() for k in range(5)), strict=True):
                        if r != own:
                            continue
                        for a, m in [(s, k)] if not split else [(j, 1) for j in range(s, s + k)]:
                            passage = b" ".join(words[a : a + m + WINDOW - 1])
                            found.meet(passage, doc, r, a, m)
                            if passage not in keys:
                                keys[passage] = h if not split else xxhash.xxh3_64_intdigest(passage) - (1 << 63)
            rows = [(keys[p], *place, p) for p, places in found.held.items() for place in places]
            rows += [(hash(place[:3]), *place, None) for place in found.gone]
            for i in range(0, len(rows), 20_000):
                yield _passage_batch(rows[i : i + 20_000])

    return run


class SuffixAutomaton:
    """Suffix automaton over word sequences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, words: list) -> list[int]:
        """Extend by one passage, kept apart from the others; the state reached after each word."""
        nxt, link, length = self.next, self.link, self.length
        last, states = 0, []
        for w in words:
            there = nxt[last].get(w)
            if there is not None:
                last = there if length[there] == length[last] + 1 else self._clone(last, w, there)
                states.append(last)
                continue
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            p = last
            while p >= 0:
                out = nxt[p]
                if w in out:
                    break
                out[w] = new
                p = link[p]
            if p < 0:
                link.append(0)
            else:
                q = out[w]
                link.append(0)
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
            last = new
            states.append(last)
        return states

    def _clone(self, p: int, w, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def stream(self, words: list) -> Iterator[tuple[int, int]]:
        """At each word, the state and the length of the longest passage substring that ends there."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                size = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                size += 1
            else:
                size = 0
            yield state, size

    def matching(self, words: list) -> np.ndarray:
        """The matching statistic at each word."""
        return np.array([size for _, size in self.stream(words)], np.int64)


def earlier_windows(passages: list[list[bytes]], places: list[tuple[int, int]]) -> list[np.ndarray]:
    """Per passage, its windows that some passage holds at an earlier place; ``places``: id and start of each passage."""
    automaton = SuffixAutomaton()
    number = {doc: i for i, doc in enumerate(sorted({doc for doc, _ in places}))}
    codes = [(number[doc] << 32) + start - WINDOW + 1 for doc, start in places]
    first: dict[int, int] = {}
    for words, code in zip(passages, codes, strict=True):
        for end, state in enumerate(automaton.add(words)):
            if end >= WINDOW - 1 and first.get(state, code + end) >= code + end:
                first[state] = code + end
    link, length = automaton.link, automaton.length
    whole = sorted((s for s in range(len(length)) if length[s] >= WINDOW), key=length.__getitem__, reverse=True)
    home = {}
    for s in whole:  # what ends at a state ends at those its suffix links lead to as well
        up = link[s]
        if length[up] >= WINDOW and first.get(up, first[s]) >= first[s]:
            first[up] = first[s]
    for s in reversed(whole):  # the state of the last WINDOW words alone
        home[s] = home.get(link[s], s)
    out = []
    for words, code in zip(passages, codes, strict=True):
        gone = [size >= WINDOW and first[home[state]] < code + end for end, (state, size) in enumerate(automaton.stream(words))]
        out.append(np.array(gone[WINDOW - 1 :], bool))
    return out


def _stretches(mask: np.ndarray) -> list[tuple[int, int]]:
    """Begin and size of the runs of marked places."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return [(a, b - a) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


def _shard_runs(shard: dict[bytes, list[tuple[int, int, int, int]]]) -> list[tuple[int, int, int, int]]:
    """Runs of windows that go: (doc_id, row, start, n)."""
    gone = earlier_windows([p.split(b" ") for p in shard], [(places[0][0], places[0][2]) for places in shard.values()])
    return [(doc, row, start + a, n) for mask, places in zip(gone, shard.values(), strict=True) if mask.any() for a, n in _stretches(mask) for doc, row, start, _ in places]


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key in, runs of windows that go out; at most a shard and one anchor's passages are held."""
    shard: dict[bytes, list[tuple[int, int, int, int]]] = {}
    weight, key, found = 0, None, _Earliest()

    def emit(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "row", "start", "n"])

    for batch in batches:
        for k, doc, row, start, n, passage in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if passage is None:
                found.gone.append((doc, row, start, n))
                continue
            if k != key:
                if len(found.held) > 1:
                    shard |= found.held
                    weight += sum(p[0][3] + WINDOW for p in found.held.values())
                    if weight >= SHARD_WORDS:
                        yield emit(_shard_runs(shard))
                        shard, weight = {}, 0
                key, found.held = k, {}
            found.meet(passage, doc, row, start, n)
        if len(found.gone) > 50_000:
            yield emit(found.gone)
            found.gone = []
    if len(found.held) > 1:
        shard |= found.held
    yield emit(_shard_runs(shard))
    yield emit(found.gone)


def bucketed(docs: DataFrame) -> DataFrame:
    """doc_id, row (0 unless different texts share an id) and text, written as a table bucketed by id."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = docs.repartition(buckets, "doc_id").withColumn("row", (F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))) - 1).cast("int"))
    name = f"substring_{uuid.uuid4().hex}"
    options = {"compression": "zstd", "path": f"{shared_dir(spark)}/{name}"}
    numbered.select("doc_id", "row", "text").write.format("parquet").options(**options).bucketBy(buckets, "doc_id").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalogue's entry; its files lie in the application's folder
    return found


def repeated_runs(base: DataFrame) -> DataFrame:
    """Runs of windows (doc_id, row, start, n windows) that stand at an earlier place as well; base: of ``bucketed``."""
    found = base.select("doc_id", "row", "text").mapInArrow(_anchor_rows, "key bigint, met int, hash bigint, doc_id bigint, row int, start int, n int")
    spots = written(found.repartition("key").sortWithinPartitions("key").mapInArrow(_repeated_anchors(HOT_PLACES), "doc_id bigint, row int, start int, n int, hash bigint"))
    hot = written(spots.filter("n = 0").select("hash").distinct()).withColumn("hot", F.lit(True))  # its files' size decides how it is joined
    flagged = spots.filter("n > 0").join(hot, "hash", "left")
    by_doc = flagged.groupBy("doc_id").agg(F.collect_list(F.struct("row", "start", "n", "hash", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("spots"))
    joined = base.join(by_doc, "doc_id").select("doc_id", "row", "text", "spots")
    routed = joined.mapInArrow(_passages(), _PASSAGE).repartition("key").sortWithinPartitions("key")
    return written(routed.mapInArrow(_decide, _RUN))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, removed, kept = [], [], []
        for own, text, found in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            words = words_of(text)
            total.append(len(words))
            runs = [(r["start"], r["n"]) for r in found or () if r["row"] == own]
            if not runs:
                removed.append(0)
                kept.append(b" ".join(words))
                continue
            change = np.zeros(len(words) + 1, np.int64)
            start, n = np.array(runs).T
            np.add.at(change, start, 1)
            np.add.at(change, start + n + WINDOW - 1, -1)
            gone = np.cumsum(change)[:-1] > 0
            removed.append(int(gone.sum()))
            kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
        columns = [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words joined by single spaces) of every document."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    base = bucketed(slim.filter("doc_id is not null"))
    runs = repeated_runs(base).groupBy("doc_id").agg(F.collect_list(F.struct("row", "start", "n")).alias("runs"))
    known = base.join(runs, "doc_id", "left").select("doc_id", "row", "text", "runs")
    none = slim.filter("doc_id is null").select("doc_id", F.lit(0).alias("row"), "text", F.lit(None).cast("array<struct<row:int,start:int,n:int>>").alias("runs"))
    return known.union(none).mapInArrow(_remove, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
