"""Toxicity by non-negative positive-unlabelled learning.

Features of a text are the presence of its words and of their first letters (so that inflected forms share evidence), and of pairs
of characters where a script writes no spaces; long words count whole, under a hash. Training uses confirmed toxic documents and unlabelled texts only: a linear numpy classifier minimises the class-prior-corrected risk

    prior * R_positive(+1) + max(0, R_unlabelled(-1) - prior * R_positive(-1))

by full-batch gradient steps; where the bracket is negative the step goes against it, as the non-negative estimator asks.
Its logistic output estimates the chance that a text is toxic. The class prior is the toxic share of the labelled rows, or less
if the strongest features are rarer in the unlabelled texts than that share implies.

Training is bounded: ``POSITIVES`` toxic documents and ``UNLABELLED`` texts in hash order, ``FEATURES`` features kept for how
far their share among the positives exceeds that among the unlabelled, beyond what chance would give (``LEAST_Z``). Scoring covers every whole text.

Defined cases: null and empty texts have no features and get the score of none; without toxic training rows every score is
the prior; an empty table gives an empty result; repeated rows are scored alike, repeated labels of a document count once; equally
good features are taken in alphabetical order; texts of any length are read whole; extra columns are not read, and a kept column
named like the score comes back as ``<name>_kept``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_batches
from .samples import hash_sample, texts_of_sample

POSITIVES = 4000
UNLABELLED = 8000
FEATURES = 512
LEAST_TEXTS = 5
LEAST_RATIO = 2.0
LEAST_Z = 5.0
PRIOR_FEATURES = 20
PREFIXES = (3, 4, 5, 6)
WORDS_KEPT = 500_000
#: Scripts from here on may write no spaces between words.
_UNSPACED = "\u0e00"
_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


@dataclass
class Model:
    features: dict[str, int]
    weights: np.ndarray
    bias: float
    prior: float


def word_features(word: str) -> list[str]:
    """The word without marks at its ends and its first letters, as feature names; where scripts write no spaces, pairs of characters too."""
    word = word.strip(_EDGE)
    if not word:
        return []
    whole = word if len(word) <= 64 else f"{len(word)}:{xxhash.xxh3_128_hexdigest(word.encode('utf-8', 'surrogatepass'))}"
    out = ["=" + whole, *(word[:n] for n in PREFIXES if len(word) >= n)]
    if not word.isascii() and max(word) >= _UNSPACED:
        out += {"~" + word[i : i + 2] for i in range(len(word) - 1)}
    return out


class Reader:
    """Present features of texts; remembers which words have none of the chosen features."""

    def __init__(self, features: dict[str, int]):
        self.features, self.plain, self.found = features, set(), {}

    def present(self, text: str) -> list[int]:
        if len(self.plain) > WORDS_KEPT:
            self.plain.clear()
        out: set[int] = set()
        for word in set(text.lower().split()).difference(self.plain):
            own = self.found.get(word)
            if own is None:
                own = [self.features[f] for f in word_features(word) if f in self.features]
                if not own:
                    self.plain.add(word)
                    continue
                if len(self.found) < WORDS_KEPT:
                    self.found[word] = own
            out.update(own)
        return sorted(out)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each feature, by class, summed over a partition of the sample."""
    counts: tuple[Counter, Counter] = Counter(), Counter()
    for batch in batches:
        for positive, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[positive].update({f for w in set((text or "").lower().split()) for f in word_features(w)})
    names = sorted(counts[0] | counts[1])
    for i in range(0, len(names), 20_000):
        part = names[i : i + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array([c[n] for n in part], pa.int64()) for c in counts)], names=["feature", "unlabelled", "positive"])


def _presence(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            rows = [reader.present(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["positive", "present"])

    return run


def train_nnpu(x: np.ndarray, positive: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear classifier; ``positive`` marks the confirmed rows, the others are unlabelled."""
    x = np.column_stack((x, np.ones(len(x)))).astype(np.float64)
    p, u = x[positive], x[~positive]
    w = np.zeros(x.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    mask = np.append(np.ones(x.shape[1] - 1), 0.0)

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    for t in range(1, rounds + 1):
        zp, zu = p @ w, u @ w
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        pull = -prior * (p.T @ (1 - sigmoid(zp))) / len(p)
        push = (u.T @ sigmoid(zu)) / len(u) - prior * (p.T @ sigmoid(zp)) / len(p)
        grad = pull + push if negative >= 0 else -push
        grad += ridge * mask * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, toxic_ids: DataFrame, labelled: int, unlabelled_ids: DataFrame) -> Model:
    """``toxic_ids``: doc_id of confirmed toxic documents; ``labelled``: labelled rows they are among (gives the class prior)."""
    spark = docs.sparkSession
    small_batches(spark)
    toxic_ids = toxic_ids.filter("doc_id is not null").distinct()
    prior = min(0.9, max(0.005, toxic_ids.count() / max(1, labelled)))
    chosen = hash_sample(toxic_ids, POSITIVES, 3).withColumn("positive", F.lit(1))
    rest = hash_sample(unlabelled_ids.filter("doc_id is not null").distinct(), UNLABELLED, 4).withColumn("positive", F.lit(0))
    sample = checkpointed(texts_of_sample(docs, chosen.unionByName(rest)).select("positive", "text"))
    size = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size.get(1) or not size.get(0):
        return Model({}, np.zeros(0), float(np.log(prior / (1 - prior))), prior)
    share_p, share_u = (F.col("positive") + 0.5) / size[1], (F.col("unlabelled") + 0.5) / size[0]
    pooled = (F.col("positive") + F.col("unlabelled") + 1) / (size[0] + size[1])
    z = (share_p - share_u) / F.sqrt(pooled * (1 - pooled) * (1 / size[0] + 1 / size[1]))
    ranked = (
        sample.mapInArrow(_count, "feature string, unlabelled bigint, positive bigint")
        .groupBy("feature")
        .agg(F.sum("unlabelled").alias("unlabelled"), F.sum("positive").alias("positive"))
        .filter((F.col("positive") >= LEAST_TEXTS) & (share_p >= LEAST_RATIO * share_u) & (z >= LEAST_Z))
        .orderBy((share_p * F.log(share_p / share_u)).desc(), "feature")
        .limit(FEATURES)
    )
    best = ranked.collect()
    features = {r["feature"]: i for i, r in enumerate(best)}
    if best:  # features that only toxic texts hold are in the unlabelled texts in proportion to the class prior
        shares = [(r["unlabelled"] / size[0]) / (r["positive"] / size[1]) for r in best[:PRIOR_FEATURES]]
        prior = min(prior, max(0.005, float(np.median(shares))))
    rows = sample.mapInArrow(_presence(spark.sparkContext.broadcast(features)), "positive int, present array<int>").collect()
    rows.sort(key=lambda r: (r["positive"], r["present"]))
    x = np.zeros((len(rows), len(features)), np.float32)
    for i, row in enumerate(rows):
        x[i, row["present"]] = 1
    weights, bias = train_nnpu(x, np.array([r["positive"] == 1 for r in rows]), prior)
    return Model(features, weights, bias, prior)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, text: str = "text", out: str = "score") -> DataFrame:
    """``keep`` columns (all by default) and the chance of toxicity of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = docs.columns if keep is None else keep
    slim = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(kept)), docs[text].alias("t"))
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        reader = Reader(m.features)
        for batch in batches:
            logits = [m.bias + m.weights[reader.present(x or "")].sum() for x in batch.column(n).to_pylist()]
            found = 1 / (1 + np.exp(-np.clip(np.array(logits, float), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(found, pa.float64())], names=[*batch.schema.names[:n], "s"])

    ddl = [f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(slim.schema.fields[:n])]
    return slim.mapInArrow(run, ", ".join([*ddl, "s double"])).toDF(*(f"{c}_kept" if c == out else c for c in kept), out)


def fit_from_labels(docs: DataFrame, labels: DataFrame, training) -> Model:
    """Train on ``labels(doc_id, toxic)``; ``training`` maps an id column to whether its row may be learnt from."""
    known = labels.filter(training(F.col("doc_id")) & F.col("toxic").isNotNull())
    labelled = known.select("doc_id").distinct().count()
    return fit(docs, known.filter("toxic = 1").select("doc_id"), labelled, docs.select("doc_id").filter(training(F.col("doc_id"))))
