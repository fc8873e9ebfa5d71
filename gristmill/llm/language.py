"""Language identification by string kernels: blended-spectrum presence kernels, Nystroem landmarks, ridge one-versus-rest.

A text is lower-cased, everything but letters becomes one space, and its UTF-8 bytes give the n-grams of ``SPECTRUM`` lengths.
For each length the presence kernel of two texts is the number of n-grams that both hold over the geometric mean of how many
each holds; the blended kernel is the mean over lengths. Landmark texts span the Nystroem features, and kernel ridge regression
on them gives one score per language. The kernel is linear in a text's presence vector, so a batch is scored by one product of
its sparse presence rows with the matrix (landmark presences' @ weights), whose rows are the landmarks' own n-grams.

Training is bounded: ``LANDMARKS`` and ``TRAINING`` texts a language in hash order, fewer where many languages share
``MOST_LANDMARKS`` and ``MOST_TRAINING``. The regression's normal equations are summed in the tasks. Every language that is not
null is learnt, every whole text is scored. Rows that share id, language and text are one to learn from.

Defined cases: null texts and texts without a letter are ``und`` with score 0; so is everything if nothing can be learnt (no
rows, no language); ties go to the language first in alphabetical order; repeated rows are scored alike; texts of any length are
read whole; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_chunks, small_batches, written

SPECTRUM = (1, 2, 3)
LANDMARKS, MOST_LANDMARKS = 80, 640
TRAINING, MOST_TRAINING = 1200, 12_000
FIT_TASKS = 16
RIDGE = 1e-2
UNDETERMINED = "und"
BATCH_BYTES = 1 << 19

#: Symbols: 0 for whatever is no letter, 1 to 26 for a to z, then the bytes of other characters.
SYMBOLS = 27 + 128
_SYMBOL = bytes(b - 0x60 if 0x61 <= b <= 0x7A else b - 0x80 + 27 if b >= 0x80 else 0 for b in range(256))
_SPACES = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def has_letter(text: str) -> bool:
    return text.isalpha() or any(map(str.isalpha, text))


def ngrams(text: str) -> list[np.ndarray]:
    """Codes of the different n-grams of each length."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_SPACES).split()) + b" "
    symbols = np.frombuffer(raw.translate(_SYMBOL), np.uint8).astype(np.uint32)
    out = []
    for n in SPECTRUM:
        size = max(0, len(symbols) - n + 1)
        code = symbols[:size].copy()
        for k in range(1, n):
            code = code * np.uint32(SYMBOLS) + symbols[k : size + k]
        code.sort()
        out.append(code[np.append(True, code[1:] != code[:-1])] if size else code)
    return out


class Vocabulary:
    """The n-grams of some texts, numbered."""

    def __init__(self, known: list[np.ndarray]):
        self.known = known
        self.size = sum(map(len, known))
        self._tables: list[np.ndarray] = []

    @classmethod
    def of(cls, texts: list[str]) -> Vocabulary:
        found = [ngrams(t) for t in texts]
        return cls([np.unique(np.concatenate([f[k] for f in found])) for k in range(len(SPECTRUM))])

    def __getstate__(self):
        return {"known": self.known, "size": self.size, "_tables": []}

    def tables(self) -> list[np.ndarray]:
        if not self._tables:
            base = 0
            for n, known in zip(SPECTRUM, self.known, strict=True):
                table = np.full(SYMBOLS**n, -1, np.int32)
                table[known] = np.arange(base, base + len(known))
                base += len(known)
                self._tables.append(table)
        return self._tables

    def presence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse rows whose inner products are the blended kernel: where each row ends, numbers of the known n-grams, values."""
        ends, numbers, values = [], [], []
        total = 0
        for text in texts:
            for table, code in zip(self.tables(), ngrams(text), strict=True):
                own = table[code]
                own = own[own >= 0]
                numbers.append(own)
                values.append(np.full(len(own), 1 / np.sqrt(max(1, len(code)) * len(SPECTRUM))))
                total += len(own)
            ends.append(total)
        return np.array(ends, np.int64), np.concatenate(numbers) if numbers else np.zeros(0, np.int32), np.concatenate(values) if values else np.zeros(0)


def sparse_product(rows: tuple[np.ndarray, np.ndarray, np.ndarray], matrix: np.ndarray) -> np.ndarray:
    """Sparse rows times a dense matrix, a whole batch at once."""
    ends, numbers, values = rows
    starts = np.append(0, ends[:-1])
    out = np.zeros((len(ends), matrix.shape[1]))
    filled = np.flatnonzero(ends > starts)
    if len(filled):
        out[filled] = np.add.reduceat(matrix[numbers] * values[:, None], starts[filled], axis=0)
    return out


class Postings:
    """The landmarks' presences by n-gram: kernels with all landmarks without a matrix of n-grams x landmarks."""

    def __init__(self, landmarks: list[str]):
        self.vocabulary = Vocabulary.of(landmarks)
        ends, numbers, values = self.vocabulary.presence(landmarks)
        self.count = len(landmarks)
        self.owner = np.repeat(np.arange(len(landmarks)), np.diff(np.append(0, ends)))
        order = np.argsort(numbers, kind="stable")
        self.owner, self.values = self.owner[order], values[order]
        self.starts = np.searchsorted(numbers[order], np.arange(self.vocabulary.size + 1))
        self.numbers = numbers[order]

    def kernel(self, texts: list[str]) -> np.ndarray:
        """text x landmark."""
        ends, numbers, values = self.vocabulary.presence(texts)
        out = np.zeros((len(texts), self.count))
        for i, (a, b) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True)):
            own = numbers[a:b]
            size = self.starts[own + 1] - self.starts[own]
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.starts[own], size)
            out[i] = np.bincount(self.owner[at], self.values[at] * np.repeat(values[a:b], size), self.count)
        return out

    def spread(self, weights: np.ndarray) -> np.ndarray:
        """n-gram x language: the landmarks' presences times their weights."""
        out = np.zeros((self.vocabulary.size, weights.shape[1]))
        np.add.at(out, self.numbers, self.values[:, None] * weights[self.owner])
        return out


@dataclass
class Model:
    languages: list[str]
    vocabulary: Vocabulary | None = None
    #: n-gram x language; None without anything learnt.
    matrix: np.ndarray | None = field(default=None, repr=False)

    def scores(self, texts: list[str]) -> np.ndarray:
        return sparse_product(self.vocabulary.presence(texts), self.matrix)


def _sums(shared, roots, languages: list[str], weight: dict[str, float]):
    """One row a task: the normal equations' two sums over its training texts, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        postings, root = shared.value, roots.value
        number = {name: i for i, name in enumerate(languages)}
        left, right = np.zeros((root.shape[1], root.shape[1])), np.zeros((root.shape[1], len(languages)))
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                langs = batch.column(0)[start : start + 100].to_pylist()
                z = postings.kernel([t or "" for t in batch.column(1)[start : start + 100].to_pylist()]) @ root
                w = np.array([weight[g] for g in langs])
                left += (z * w[:, None]).T @ z
                np.add.at(right.T, [number[g] for g in langs], z * w[:, None])
        yield pa.RecordBatch.from_arrays([pa.array([left.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary())], names=["l", "r"])

    return run


def _different(rows: DataFrame) -> DataFrame:
    """lang, doc_id and a hash of the text: once for rows that are the same, so that copies of a row neither crowd a sample nor share its hash order."""
    return rows.select("lang", "doc_id", F.xxhash64("text").alias("__t")).distinct()


def _texts(rows: DataFrame, sample: DataFrame) -> DataFrame:
    """lang, doc_id and text of a bounded sample of ``_different`` rows, each once."""
    found = rows.withColumn("__t", F.xxhash64("text")).join(F.broadcast(sample), ["lang", "doc_id", "__t"])
    return found.groupBy("lang", "doc_id", "__t").agg(F.min("text").alias("text"))


def _per_language(known: DataFrame, counts: DataFrame, each: int, most: int, seed: int) -> DataFrame:
    """At most ``each`` of the ``_different`` rows a language and ``most`` in all, in hash order.

    Rows beyond the share of the hash range in which ``each`` are as good as certain to lie go before the shuffle, so a frequent
    language's rows never meet in one task.
    """
    hashed = known.join(F.broadcast(counts), "lang").withColumn("__h", F.xxhash64("doc_id", "__t", F.lit(seed)))
    share = (each + 10 * each**0.5 + 50) / F.col("count")
    near = hashed.filter((F.col("__h").cast("double") / 2.0**64 + 0.5) < share)
    order = Window.partitionBy("lang").orderBy("__h", "doc_id", "__t")
    ranked = near.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= each)
    return ranked.orderBy("__n", F.xxhash64("lang", F.lit(seed)), "lang").limit(most).select("lang", "doc_id", "__t")


def fit(docs: DataFrame, known: DataFrame | None = None) -> Model:
    """``docs``: doc_id, text and lang of the documents that may be learnt from; ``known`` gives doc_id and lang where these stand apart."""
    spark = docs.sparkSession
    small_batches(spark)
    if known is not None:
        docs = docs.select("doc_id", "text").join(known.select("doc_id", "lang").filter("lang is not null").distinct(), "doc_id")
    rows = docs.select("doc_id", "text", "lang").filter("doc_id is not null and lang is not null")
    known = written(_different(rows))
    counts = known.groupBy("lang").count()  # a row for each language
    count = counts.count()
    if not count:
        return Model([])
    landmarks_each, training_each = (max(1, min(each, most // count)) for each, most in ((LANDMARKS, MOST_LANDMARKS), (TRAINING, MOST_TRAINING)))
    chosen = _texts(rows, _per_language(known, counts, landmarks_each, MOST_LANDMARKS, 5)).select("lang", "doc_id", "text").collect()
    if not chosen:
        return Model([])
    chosen.sort(key=lambda r: (r["lang"], r["doc_id"], r["text"] or ""))
    postings = Postings([r["text"] or "" for r in chosen])
    k_mm = postings.kernel([r["text"] or "" for r in chosen])
    values, vectors = np.linalg.eigh((k_mm + k_mm.T) / 2)
    root = vectors * (1 / np.sqrt(np.maximum(values, 1e-6)))
    picked = _per_language(known, counts, training_each, max(MOST_TRAINING, count), 6)
    drawn = {r["lang"]: r["count"] for r in picked.groupBy("lang").count().collect()}
    languages = sorted(drawn)
    weight = {g: sum(drawn.values()) / len(drawn) / n for g, n in drawn.items()}
    sample = _texts(rows, picked).select("lang", "text").repartition(FIT_TASKS)
    parts = sample.mapInArrow(_sums(spark.sparkContext.broadcast(postings), spark.sparkContext.broadcast(root), languages, weight), "l binary, r binary").collect()
    m = root.shape[1]
    left = sum(np.frombuffer(p["l"]).reshape(m, m) for p in parts) + RIDGE * np.eye(m)
    right = sum(np.frombuffer(p["r"]).reshape(m, len(languages)) for p in parts)
    return Model(languages, postings.vocabulary, postings.spread(root @ np.linalg.solve(left, right)))


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            names, found = [], []
            for texts in in_chunks(batch.column(1).to_pylist(), lambda t: len(t or ""), BATCH_BYTES):
                named = [bool(t) and m.matrix is not None and has_letter(t) for t in texts]
                scores = m.scores([t for t, ok in zip(texts, named, strict=True) if ok]) if any(named) else None
                at = 0
                for ok in named:
                    if not ok:
                        names.append(UNDETERMINED)
                        found.append(0.0)
                        continue
                    best = int(scores[at].argmax())
                    names.append(m.languages[best])
                    found.append(float(min(1, max(0, scores[at, best]))))
                    at += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(found, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
