"""Phrase collocations: frequent contiguous n-grams by mergeable Misra-Gries summaries, then exact counts and the weakest cut.

1. Words are counted exactly per language; the total gives each language's n and the mass of all n-grams.
2. N-grams of 2 to 4 frequent words (others can't be frequent) are numbered by a 64-bit key. Each task sums its keys and passes
   them on as summaries, one for each hash partition of the keys, whenever it holds ``FLUSH_KEYS``. Summaries of a partition merge:
   counts add up and, beyond the capacity, the largest count that must go is taken off all. What was taken off bounds a count's
   error. The capacity is ``SLACK`` times the mean partition's mass divided by the threshold, ``CAPACITY`` at least. Each unit of
   error costs more than capacity units of mass, so the error stays below the threshold and every frequent n-gram survives,
   whatever the order of merging; should one partition hold over ``SLACK`` times the mean mass, its capacity doubles instead of
   letting the error reach the threshold.
3. A second pass counts the survivors' phrases exactly, by their words. Equal keys of different phrases, or a filter that lets more
   through, change what is counted, never a count.

Tasks test words and n-grams with bit filters of at most ``MOST_BITS`` bits, made by Spark's bitmap aggregates. A filter only spares
work: what passes wrongly is counted and found infrequent. A frequent phrase is one entry of each task's summary, so hot
phrases and languages are combined before they are shuffled.

Defined cases: null and empty texts have no words; a null language is ``und``, joined with rows that say so; rows with equal or null
ids count like any others; texts are read whole; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written

LEAST_COUNT = 30
LONGEST = 4
SHARE_OF_LONGER = 80
SCALE = 2_000_000
TOP = 2000

FLUSH_KEYS = 1 << 21
KEYS_A_ROW = 2048
MASS_A_PART = 1 << 21
MOST_PARTS = 1 << 16
CAPACITY = 1 << 16
SLACK = 4
BITS_A_KEY = 16
MOST_BITS = 1 << 30
BUCKET = 32_768
UNKNOWN = "und"

#: What a byte reads as: A-Z in lower case, piece ends as line ends, tabs as spaces.
_READ = bytes(10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of a batch: their number among the batch's different words, the piece and the language of each.

    ``spelt`` holds the different words; the words of a piece are next to each other.
    """

    def __init__(self, batch: pa.RecordBatch):
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        self.langs = sorted({UNKNOWN if x is None else x for x in langs})
        number = {x: i for i, x in enumerate(self.langs)}
        read = b"\n".join((t or b"").translate(_READ) for t in texts)
        raw = np.frombuffer(read, np.uint8)
        word = (raw != 32) & (raw != 10)
        edge = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.piece = np.searchsorted(np.flatnonzero(raw == 10), starts)
        doc = np.searchsorted(np.cumsum([len(t or b"") + 1 for t in texts]), starts, side="right") if texts else starts
        self.lang = np.array([number[UNKNOWN if x is None else x] for x in langs], np.int64)[doc]
        offsets = np.concatenate(([0], np.cumsum(ends - starts)))
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw[word].tobytes())])
        coded = column.dictionary_encode()
        self.code = coded.indices.to_numpy().astype(np.int64)
        self.spelt: list[bytes] = coded.dictionary.to_pylist()

    def hashes(self) -> np.ndarray:
        """A 64-bit number for each different word."""
        return np.array([xxhash.xxh3_64_intdigest(w) for w in self.spelt], np.uint64)

    def lang_hashes(self) -> np.ndarray:
        return np.array([xxhash.xxh3_64_intdigest(x.encode(), 1) for x in self.langs], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MULTIPLIER
    return x ^ (x >> np.uint64(29))


def word_keys(words: Words) -> np.ndarray:
    """A key for every word of the batch in its language."""
    return _mixed(words.hashes()[words.code] + words.lang_hashes()[words.lang])


def grams(words: Words, keys: np.ndarray, frequent: np.ndarray, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places, keys) of the n-grams of frequent words within pieces, n from 2."""
    at, key = np.flatnonzero(frequent), keys[frequent]
    for n in range(2, longest + 1):
        last = at + n - 1
        own = last < len(keys)
        own[own] = frequent[last[own]] & (words.piece[at[own]] == words.piece[last[own]])
        at = at[own]
        key = _mixed(key[own] * _MULTIPLIER + keys[at + n - 1])
        yield n, at, key


class BitFilter:
    """Two bits for every key; ``has`` is true for every key that was put in."""

    def __init__(self, bits: int, buckets: dict[int, bytes]):
        self.bits, self.table = bits, np.zeros(max(1, bits // 8), np.uint8)
        for number, held in buckets.items():
            first = (number - 1) * BUCKET // 8
            self.table[first : first + BUCKET // 8] = np.frombuffer(held, np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for place in (keys & np.uint64(self.bits - 1), (keys >> np.uint64(33)) & np.uint64(self.bits - 1)):
            found &= (self.table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def bit_filter(keys: DataFrame, count: int, most_bits: int = MOST_BITS) -> BitFilter:
    """A filter of ``keys`` (bigint), about 16 bits a key within ``most_bits``: the bitmaps' size bounds what the driver gets."""
    bits = BUCKET
    while bits < BITS_A_KEY * count and bits < most_bits:
        bits *= 2
    low = F.lit(bits - 1).cast("bigint")
    places = F.array(F.col("key").bitwiseAND(low) + 1, F.shiftrightunsigned("key", 33).bitwiseAND(low) + 1)
    rows = keys.select(F.explode(places).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("held"))
    return BitFilter(bits, {r["bucket"]: bytes(r["held"]) for r in rows.toLocalIterator()})


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Summary:
    """A mergeable Misra-Gries summary: at most ``capacity`` keys, every count short by ``error`` at most."""

    def __init__(self, least: int, capacity: int = CAPACITY):
        self.least, self.capacity, self.error = least, capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def merge(self, keys: np.ndarray, counts: np.ndarray, error: int = 0) -> None:
        self.waiting.append((keys, counts))
        self.held += len(keys)
        self.error += error
        if self.held > self.capacity:
            self.settle()

    def settle(self) -> None:
        """Add up what waits; beyond the capacity take the largest count that must go off all counts.

        Each unit of error has cost more than ``capacity`` units of mass: a capacity over the mass divided by the threshold is never
        exceeded. A smaller one doubles where the error would reach the threshold.
        """
        if self.waiting:
            self.keys, self.counts = _sums(np.concatenate([self.keys, *(k for k, _ in self.waiting)]), np.concatenate([self.counts, *(c for _, c in self.waiting)]))
            self.waiting, self.held = [], 0
        while len(self.keys) > self.capacity:
            off = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            if self.error + off >= self.least:
                self.capacity *= 2
                continue
            self.error += off
            left = self.counts > off
            self.keys, self.counts = self.keys[left], self.counts[left] - off

    def survivors(self) -> np.ndarray:
        """Keys whose count can reach the threshold."""
        self.settle()
        return self.keys[self.counts + self.error >= self.least]


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values))


def _summarised(parts: int, shared, longest: int):
    """Rows (lang, text) in; summaries (part, keys, counts) out."""
    shift = np.uint64(64 - (parts.bit_length() - 1))

    def emitted(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        part = (keys >> shift).astype(np.int64) if parts > 1 else np.zeros(len(keys), np.int64)
        cuts = np.flatnonzero(np.diff(part)) + 1
        ends = np.unique(np.concatenate((cuts, np.arange(KEYS_A_ROW, len(keys), KEYS_A_ROW), [len(keys)])))
        return pa.RecordBatch.from_arrays([pa.array(part[ends - 1]), _lists(keys.view(np.int64), ends), _lists(counts, ends)], names=["part", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        frequent = shared.value
        for batch in batches:
            words = Words(batch)
            own = word_keys(words)
            found = [key for _, _, key in grams(words, own, frequent.has(own), longest)]
            k, c = _sums(np.concatenate(found), np.ones(sum(map(len, found)), np.int64))
            keys.append(k)
            counts.append(c)
            held += len(k)
            if held >= FLUSH_KEYS:
                k, c = _sums(np.concatenate(keys), np.concatenate(counts))
                keys, counts, held = [k], [c], len(k)
                if held >= FLUSH_KEYS // 2:
                    yield emitted(k, c)
                    keys, counts, held = [], [], 0
        if held:
            yield emitted(*_sums(np.concatenate(keys), np.concatenate(counts)))

    return run


def _merged(least: int, capacity: int):
    """Summaries in the order of their partition in; surviving keys out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, summary = None, Summary(least, capacity)
        for batch in batches:
            keys, counts = batch.column("keys"), batch.column("counts")
            for row, own in enumerate(batch.column("part").to_pylist()):
                if own != part:
                    yield _keys(summary.survivors())
                    part, summary = own, Summary(least, capacity)
                summary.merge(keys[row].values.to_numpy().view(np.uint64), counts[row].values.to_numpy())
        yield _keys(summary.survivors())

    return run


def _keys(found: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["key"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = Words(batch)
        width = max(1, len(words.spelt))
        pairs, first, counts = np.unique(words.lang * width + words.code, return_index=True, return_counts=True)
        langs = pa.array(words.langs, pa.string()).take(pa.array(pairs // width))
        spelt = pa.array(words.spelt, pa.binary()).take(pa.array(pairs % width))
        yield pa.RecordBatch.from_arrays([langs, spelt, pa.array(word_keys(words)[first].view(np.int64)), pa.array(counts)], names=["lang", "phrase", "key", "a"])


def _phrase_counts(words_filter, grams_filter, longest: int):
    """Rows (lang, text) in; (lang, phrase, words, a) of the n-grams that pass the filter out, counted within the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, wanted = words_filter.value, grams_filter.value
        for batch in batches:
            words = Words(batch)
            own = word_keys(words)
            for n, at, key in grams(words, own, frequent.has(own), longest):
                hit = wanted.has(key)
                at, key = at[hit], key[hit]
                codes = [words.lang[at], *(words.code[at + i] for i in range(n))]
                order = np.lexsort((*codes[::-1], key))
                new = np.concatenate(([True], key[order][1:] != key[order][:-1]))[: len(at)]
                for c in codes:
                    new[1:] |= c[order][1:] != c[order][:-1]
                first = np.flatnonzero(new)
                counts = np.diff(np.concatenate((first, [len(at)])))
                spelt = [words.spelt[c] for c in np.stack([c[order][first] for c in codes[1:]], 1).ravel().tolist()]
                phrases = [b" ".join(spelt[i : i + n]) for i in range(0, len(spelt), n)]
                langs = pa.array(words.langs, pa.string()).take(pa.array(codes[0][order][first]))
                columns = [langs, pa.array(phrases, pa.binary()), pa.array(np.full(len(first), n, np.int32)), pa.array(counts)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "words", "a"])

    return run


def frequent_phrases(docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, text: str = "text", lang: str = "lang", capacity: int = CAPACITY, mass_a_part: int = MASS_A_PART) -> tuple[DataFrame, DataFrame]:
    """Exact counts of all phrases of 1 to ``longest`` words that stand ``least`` times in a language: lang, phrase, words, a; and lang, n."""
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("binary").alias("text"))
    counted = slim.mapInArrow(_word_counts, "lang string, phrase binary, key bigint, a bigint").groupBy("lang", "phrase").agg(F.first("key").alias("key"), F.sum("a").alias("a"))
    every = written(counted.withColumn("frequent", F.col("a") >= least))
    totals = every.groupBy("lang").agg(F.sum("a").alias("n"))
    words = every.filter("frequent").select("lang", "phrase", F.lit(1).alias("words"), "a", "key")
    mass, known = every.agg(F.coalesce(F.sum("a"), F.lit(0)), F.count_if("frequent")).first()
    parts = 1
    while parts < MOST_PARTS and parts * mass_a_part < mass * (longest - 1):
        parts *= 2
    words_filter = spark.sparkContext.broadcast(bit_filter(words, known))
    summaries = slim.mapInArrow(_summarised(parts, words_filter, longest), "part bigint, keys array<bigint>, counts array<bigint>")
    capacity = max(capacity, -(-SLACK * mass * (longest - 1) // (parts * least)))
    dealt = summaries.repartition(F.col("part")).sortWithinPartitions("part")
    keys = written(dealt.mapInArrow(_merged(least, capacity), "key bigint"))
    grams_filter = spark.sparkContext.broadcast(bit_filter(keys, keys.count()))
    phrases = slim.mapInArrow(_phrase_counts(words_filter, grams_filter, longest), "lang string, phrase binary, words int, a bigint")
    exact = phrases.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.sum("a").alias("a")).filter(F.col("a") >= least)
    return written(words.drop("key").union(exact.select("lang", "phrase", "words", "a")).withColumn("phrase", F.col("phrase").cast("string"))), totals


def _part(first: Column, size: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, size), " ")


def weakest_cuts(counts: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, score of every phrase of two words or more: of its cuts the one with the least score, then the shortest first part."""
    long = counts.filter("words > 1")
    cut = long.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("*", _part(F.lit(1), F.col("k")).alias("first"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    both = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.expr(f"CAST({SCALE} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(19,0)) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    least = both.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return least.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def covered(counts: DataFrame, share: int = SHARE_OF_LONGER) -> DataFrame:
    """lang and phrase of those whose words stand in a longer phrase that has ``share`` per cent of their count or more."""
    size = F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size")
    longer = counts.filter("words > 2").select("*", size).select("*", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("from"))
    most = longer.select("lang", _part(F.col("from"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    exact = lambda n, c: F.expr(f"CAST({n} AS DECIMAL(5,0)) * CAST({c} AS DECIMAL(19,0))")
    return counts.join(most, ["lang", "phrase"]).filter(exact(100, "most") >= exact(share, "a")).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, top: int = TOP, share: int = SHARE_OF_LONGER, **limits: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases that no longer one covers."""
    counts, totals = frequent_phrases(docs, least, longest, **limits)
    scored = weakest_cuts(counts).join(covered(counts, share), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
