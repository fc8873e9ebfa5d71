"""Benchmark decontamination: an FM-index over each shard of training documents, searched backwards with the benchmark's phrases.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. A phrase is every window of ``window``
consecutive words of a benchmark item, or the whole item if it is shorter. Each task groups its documents into shards of a
bounded number of words, builds one FM-index over all words of the shard (wavelet matrix over the Burrows-Wheeler transform,
sampled suffix positions; every document is closed by a separator), searches all phrases at once, locates the occurrences and
merges them into removal spans.

Defined cases: null text or a text without words has no hits; a null item text or item id takes no part; repeated items and
repeated documents are each reported; items that share a phrase are all reported where it occurs; an empty benchmark finds
nothing, an empty table gives an empty result; a text of any length is searched whole (one longer than a shard is a shard by
itself); extra columns of either input are not read, and a kept column named like a found one comes back as ``<name>_kept``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_chunks, small_batches

WINDOW = 10
SHARD_WORDS = 1 << 20
BLOCK_BYTES = 16 << 20
SAMPLE = 8

_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")


def _split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class Phrases:
    """The distinct phrases of a block of benchmark items as arrays of word ids (1 up; 0 is the separator)."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            words = [self.ids.setdefault(w, len(self.ids) + 1) for w in _split(text)]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(tuple(words[i : i + window]), set()).add(item_id)
        self.items = [frozenset(v) for v in found.values()]
        self.lengths = np.array([len(k) for k in found], np.int64)
        self.words = np.zeros((len(found), window), np.int64)
        for row, key in enumerate(found):
            self.words[row, : len(key)] = key
        self.shortest = int(self.lengths.min()) if found else 0


class FmIndex:
    """FM-index of a sequence whose entries are 0 (separator) or a symbol below ``alphabet``; it must end with 0."""

    def __init__(self, seq: np.ndarray, alphabet: int, sample: int = SAMPLE):
        n = len(seq)
        order = self._suffix_order(seq)
        before = seq[order - 1]
        self.bwt = before.astype(np.int32)
        counts = np.bincount(seq, minlength=alphabet)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.n = n
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.ranks, self.zeros = [], []
        current = before
        for level in reversed(range(self.levels)):
            bits = (current >> level) & 1
            self.ranks.append(np.concatenate(([0], np.cumsum(bits))).astype(np.int32))
            zeros = n - int(self.ranks[-1][-1])
            self.zeros.append(zeros)
            current = np.concatenate((current[bits == 0], current[bits == 1]))
        self.sampled = (order % sample == 0) | (before == 0)
        self.position = np.where(self.sampled, order, -1).astype(np.int32)

    @staticmethod
    def _suffix_order(seq: np.ndarray) -> np.ndarray:
        """Suffix order by prefix doubling, in each round only of what is still tied; separators are distinct symbols below all words, in text order."""
        n = len(seq)
        ends = np.flatnonzero(seq == 0)
        key = seq + len(ends)
        key[ends] = np.arange(len(ends))
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)  # of each suffix: the first place of those it is tied with
        places, members, keys, step = np.arange(n), order, key[order], 1
        while True:
            new = np.append(True, keys[1:] != keys[:-1])
            rank[members] = places[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
            tied = ~(new & np.append(new[1:], True))
            places, members = places[tied], members[tied]
            if not len(places):
                return order
            keys = rank[members] * n + rank[members + step]  # ties hold no separator, so something stands behind them
            by = np.argsort(keys, kind="stable")
            members, keys = members[by], keys[by]
            order[places] = members
            step *= 2

    def rank(self, symbols: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first ``upto`` entries of the transform, level by level."""
        low = np.zeros_like(upto)
        high = upto.copy()
        for depth, level in enumerate(reversed(range(self.levels))):
            ones, zeros = self.ranks[depth], self.zeros[depth]
            bit = ((symbols >> level) & 1).astype(bool)
            low_ones, high_ones = ones[low].astype(np.int64), ones[high].astype(np.int64)
            low = np.where(bit, zeros + low_ones, low - low_ones)
            high = np.where(bit, zeros + high_ones, high - high_ones)
        return high - low

    def search(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all phrases by backward search; an absent phrase gets an empty range."""
        low = np.zeros(len(lengths), np.int64)
        high = np.full(len(lengths), self.n, np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > step) & (high > low))
            if not len(live):
                break
            symbol = words[live, lengths[live] - 1 - step]
            base = self.first[symbol]
            low[live] = base + self.rank(symbol, low[live])
            high[live] = base + self.rank(symbol, high[live])
        high = np.maximum(low, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk to the previous symbol until a sampled row."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        while True:
            todo = np.flatnonzero(~self.sampled[rows])
            if not len(todo):
                return self.position[rows] + steps
            symbol = self.bwt[rows[todo]]
            rows[todo] = self.first[symbol] + self.rank(symbol, rows[todo])
            steps[todo] += 1


def search_shard(texts: list[str], phrases: Phrases) -> list[tuple[int, int, list[tuple[int, int]], list[str]]]:
    """Per text: words, hit words, merged character spans of the hits, ids of the items found."""
    ids, pieces, starts, sizes, total = dict(phrases.ids), [], [], [], 0
    for text in texts:
        words = _split(text)
        sizes.append(len(words))
        pieces.append(np.fromiter((ids.setdefault(w, len(ids) + 1) for w in words), np.int64, len(words)))
        pieces.append(np.zeros(1, np.int64))
        starts.append(total)
        total += len(words) + 1
    none = [(n, 0, [], []) for n in sizes]
    if not phrases.shortest or not total:
        return none
    whole = np.concatenate(pieces)
    index = FmIndex(whole, len(ids) + 1)
    low, high = index.search(phrases.words, phrases.lengths)
    counts = high - low
    phrase = np.repeat(np.arange(len(counts)), counts)
    if not len(phrase):
        return none
    rows = np.arange(len(phrase)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
    at = index.locate(rows)
    cover = np.zeros(len(whole) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + phrases.lengths[phrase], -1)
    hit = np.cumsum(cover)[:-1] > 0
    doc = np.searchsorted(starts, at, "right") - 1
    pairs = np.unique(np.stack((doc, phrase)), axis=1)
    items: dict[int, set[str]] = {}
    for d, p in pairs.T.tolist():
        items.setdefault(d, set()).update(phrases.items[p])
    out = none
    for d, names in items.items():
        mask = hit[starts[d] : starts[d] + sizes[d]]
        out[d] = (sizes[d], int(mask.sum()), char_spans(texts[d], mask), sorted(names))
    return out


def char_spans(text: str, mask: np.ndarray) -> list[tuple[int, int]]:
    """Code-point spans of maximal runs of marked words."""
    raw = text.encode("utf-8", "surrogatepass")
    bounds = [m.span() for m in _WORD.finditer(raw.translate(_WORD_BYTES))]
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return [(int(chars[bounds[a][0]]), int(chars[bounds[b - 1][1]])) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def count_hit_words(text: str, spans: list[tuple[int, int]]) -> int:
    return sum(len(_split(text[a:b])) for a, b in spans)


_FOUND = pa.schema(
    [("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))]
)
_FOUND_DDL = "n_words bigint, n_hit bigint, spans array<struct<start:int,end:int>>, items array<string>"


def _scanner(shared, text_at: int, first: bool, shard_words: int):
    """Arrow batches in, the same columns and the found ones out; ``first``: no earlier block's findings to merge."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for group in in_chunks(batches, lambda b: b.nbytes // 6 + 1, shard_words):
            texts = [x or "" for b in group for x in b.column(text_at).to_pylist()]
            found = search_shard(texts, phrases)
            at = 0
            for batch in group:
                own, at = found[at : at + batch.num_rows], at + batch.num_rows
                kept = batch
                if not first:
                    own = _merged(own, batch, texts[at - batch.num_rows : at])
                    kept = batch.select([n for n in batch.schema.names if n not in _FOUND.names])
                spans = [[{"start": a, "end": b} for a, b in x[2]] for x in own]
                columns = [pa.array(v, t.type) for v, t in zip(([x[0] for x in own], [x[1] for x in own], spans, [x[3] for x in own]), _FOUND, strict=True)]
                yield pa.RecordBatch.from_arrays([*kept.columns, *columns], names=[*kept.schema.names, *_FOUND.names])

    return scan


def _merged(own, batch, texts):
    spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
    out = []
    for x, text, s, i in zip(own, texts, spans, items, strict=True):
        both = merge_spans([*x[2], *((y["start"], y["end"]) for y in s)])
        out.append((x[0], count_hit_words(text, both), both, sorted({*x[3], *i})))
    return out


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``keep`` columns and the text of every document with its words, hit words, character spans to remove and items found.

    The benchmark is measured first and split by item into blocks of about ``block_bytes``; each block is broadcast by itself
    and the next pass merges its findings, so what one task holds doesn't grow with the benchmark.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")).filter("id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("id")), F.lit(0)).alias("b")).first()["b"]
    blocks = max(1, -(-size // block_bytes))
    names = [*keep, *([text] if text not in keep else [])]
    plain = [f"c{i}" for i in range(len(names))]
    out = docs.select(*names).toDF(*plain)
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast(Phrases([(r["id"], r["text"]) for r in rows], window))
        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.select(*plain).schema)
        out = out.mapInArrow(_scanner(shared, names.index(text), block == 0, shard_words), f"{ddl}, {_FOUND_DDL}")
    return out.toDF(*(f"{n}_kept" if n in _FOUND.names else n for n in names), *_FOUND.names)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents with every benchmark passage cut out of the text; all other columns unchanged.

    A document made of nothing but benchmark passages stays, with what is left of its text.
    """
    names = docs.columns
    renamed = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = f"c{names.index(text)}"
    found = contaminated_spans(renamed, benchmark, renamed.columns, at, window=window)
    gaps = F.transform(
        F.sequence(F.lit(0), F.size("spans")),
        lambda i: F.substring(
            F.col(at),
            F.when(i == 0, F.lit(0)).otherwise(F.try_element_at("spans", i)["end"]) + 1,
            F.coalesce(F.try_element_at("spans", i + 1)["start"], F.length(at)) - F.when(i == 0, F.lit(0)).otherwise(F.try_element_at("spans", i)["end"]),
        ),
    )
    clean = F.when(F.size("spans") > 0, F.array_join(gaps, "")).otherwise(F.col(at))
    return found.withColumn(at, clean).select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))
