"""Quality by compression: two zstandard dictionaries, one from good and one from bad labelled text.

A text is cut into blocks of ``BLOCK`` bytes (so that the dictionary, not the text's own past, decides), every block is
compressed with either dictionary and with none, and the differences of the summed sizes, each normalised by its two sizes' sum,
go through a logistic calibration: bad against good, and what either dictionary spares against none (a text that repeats itself
needs neither).

Training is bounded: the dictionaries see whole documents in hash order, ``DICTIONARY_DOCS`` a class or as many as begin within
the first ``DICTIONARY_TEXT`` bytes; the calibration ``CALIBRATION_DOCS`` other labelled documents, whole as well. Scoring covers
every whole text.

Defined cases: null and empty texts are one empty block and get that block's score; where a class has no labelled rows, every
score is the share of label 1 (one half without any labels); an empty table gives an empty result; repeated rows are scored
alike; repeated labels of a document count once each, contradicting ones too; equal texts get equal scores; texts of any length
are read whole; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches
from .samples import hash_sample, texts_of_sample

BLOCK = 1024
LEVEL = 3
DICTIONARY_BYTES = 64 << 10
DICTIONARY_DOCS = 1500
CALIBRATION_DOCS = 6000
DICTIONARY_TEXT = 24 << 20
PIECE = 2048


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]
    mean: list[float]
    scale: list[float]
    prior: float
    _made: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_made": []}

    def compressors(self):
        if not self._made:
            self._made += [compressor(self.good), compressor(self.bad), compressor(b"")]
        return self._made


def compressor(dictionary: bytes):
    import zstandard

    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if data is not None:
        data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


def build_dictionary(pieces: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; the plain end of the text where there is too little to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(pieces)[-size:]


def size_features(text: str, good, bad, none) -> tuple[float, float, float]:
    """(x - y) / (x + y) of the summed compressed sizes: bad and good, none and good, none and bad."""
    raw = text.encode("utf-8", "surrogatepass")
    g = b = n = 0
    for i in range(0, max(1, len(raw)), BLOCK):
        block = raw[i : i + BLOCK]
        g += len(good.compress(block))
        b += len(bad.compress(block))
        n += len(none.compress(block))
    return (b - g) / (b + g), (n - g) / (n + g), (n - b) / (n + b)


def expand(x: np.ndarray) -> np.ndarray:
    return np.column_stack((np.ones(len(x)), x, x * x))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps, halved while they don't lower the loss."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-9

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * v @ penalty @ v)

    best = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > best:
            size /= 2
        if size <= 1e-6:
            break
        w = w + size * step
        best = loss(w)
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def scores(model: Model, features: np.ndarray) -> np.ndarray:
    if not model.weights:
        return np.full(len(features), model.prior)
    z = (np.clip((features - model.mean) / model.scale, -8, 8)) if len(features) else features
    return 1 / (1 + np.exp(-np.clip(expand(z) @ np.array(model.weights), -30, 30)))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The training texts cut into pieces."""
    for batch in batches:
        labels, pieces = [], []
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            cut = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
            labels += [label] * len(cut)
            pieces += cut
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(pieces, pa.binary())], names=["label", "piece"])


def _measure(shared):
    """The first column with the size features of the text in the second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shared.value.compressors()
        for batch in batches:
            found = np.array([size_features(x or "", *made) for x in batch.column(1).to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, i]) for i in range(3))], names=[batch.schema.names[0], "d", "e", "f"])

    return run


def _within(sample: DataFrame, size: int) -> DataFrame:
    """The rows of a bounded sample that begin within the first ``size`` bytes of their class, in hash order."""
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).over(order), F.lit(0))
    return sample.withColumn("__before", before).filter(F.col("__before") < size).select("label", "text")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """``labels``: doc_id and label (1 good, 0 bad), training rows only."""
    spark = docs.sparkSession
    small_batches(spark)
    labels = labels.filter("doc_id is not null and label in (0, 1)").select("doc_id", F.col("label").cast("int")).distinct()
    by_class = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = by_class.get(1, 0) / sum(by_class.values()) if by_class else 0.5
    if len(by_class) < 2:
        return Model(b"", b"", [], [], [], prior)
    chosen = [hash_sample(labels.filter(F.col("label") == c), DICTIONARY_DOCS, 1) for c in (0, 1)]
    taken = chosen[0].unionByName(chosen[1])
    rows = _within(texts_of_sample(docs, taken), DICTIONARY_TEXT).mapInArrow(_pieces, "label int, piece binary").collect()
    pieces = {c: sorted(bytes(r["piece"]) for r in rows if r["label"] == c) for c in (0, 1)}
    if not pieces[0] or not pieces[1]:
        return Model(b"", b"", [], [], [], prior)
    model = Model(build_dictionary(pieces[1]), build_dictionary(pieces[0]), [], [], [], prior)
    others = labels.join(F.broadcast(taken.select("doc_id")), "doc_id", "left_anti")
    calibration = hash_sample(others, CALIBRATION_DOCS, 2)
    if calibration.agg(F.countDistinct("label")).first()[0] < 2:  # few labelled rows: calibrate on those of the dictionaries
        calibration = taken
    slim = texts_of_sample(docs, calibration).select("label", "text")
    measured = slim.mapInArrow(_measure(spark.sparkContext.broadcast(model)), "label int, d double, e double, f double").toPandas().sort_values(["label", "d", "e", "f"])
    x, y = measured[["d", "e", "f"]].to_numpy(float), measured["label"].to_numpy(float)
    model.mean, model.scale = x.mean(0).tolist(), np.maximum(x.std(0), 1e-9).tolist()
    model.weights = fit_logistic(expand(np.clip((x - model.mean) / model.scale, -8, 8)), y).tolist()
    return model


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", out: str = "score") -> DataFrame:
    """doc_id and the score (0 to 1, higher: label 1 likelier) of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    measure = _measure(shared)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in measure(batches):
            features = np.column_stack([batch.column(i).to_numpy() for i in (1, 2, 3)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(shared.value, features))], names=["doc_id", out])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, {out} double")
