"""Periodic runs of words, by an online sparse diagonal DP.

Cell (i, q) of the DP, on the diagonal of lag q, counts the consecutive words up to i that equal the word q places before. A run of
period q ends where its diagonal ends, with q words less matched than it is long. Dense diagonals cost the square of a text, and so
do all earlier occurrences of a frequent word; only cells that can still become a run are followed:

* Lags are dealt in scales [h, 2h), h = 1, 2, 4, ... A run of four periods matches at least 3q >= 2h words (five for q = 1), so a
  diagonal of that scale is only followed where the gram of 2h words at a place stands there and q places before.
* A gram of at least q words of a run whose smallest period is q occurs again in it at multiples of q only. So of all earlier
  occurrences of a gram the nearest decides, and a place holds at most one active lag of a scale: every gram's nearest earlier
  occurrence extends the active lag's match length or ends it, and an ended diagonal of sufficient length is a run at once.
* Grams of 2h words are pairs of named grams of h words (equal names for equal grams, no hashing), and places whose gram stands
  only once in its document are dropped at every scale. Ordinary text is gone after two or three scales; the most repetitive text
  costs n log n. The smallest period and the greatest extension of what is found follow from the second point.

Documents are whole in their tasks and nothing is shuffled.

Defined cases: null and empty texts have no words, no runs and the empty collapsed text; texts of any length are read whole; rows
with equal or null ids are rows of their own; an empty table stays empty; columns that aren't asked for are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

LEAST_WORDS = 6
LEAST_PERIODS = 4
OUT = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def paired(names: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name the grams at ``at`` whose halves stand ``step`` apart: places of grams that stand twice, in order; names; lags to the gram before (0: none)."""
    at = at[at + step < len(names)]
    at = at[names[at + step] >= 0]
    keys = names[at] * (names.max(initial=0) + 1) + names[at + step]
    order = np.argsort(keys, kind="stable")
    at, keys = at[order], keys[order]
    again = np.concatenate(([False], keys[1:] == keys[:-1]))[: len(at)]
    twice = again | np.concatenate((again[1:], [False]))[: len(at)]
    lag = np.where(again, at - np.concatenate(([0], at[:-1]))[: len(at)], 0)
    name = np.cumsum(~again)
    order = np.argsort(at[twice], kind="stable")
    return at[twice][order], name[twice][order], lag[twice][order]


def ended(places: list[int], lags: list[int]) -> Iterator[tuple[int, int, int]]:
    """The online scan of one scale: (first place, lag, places matched) of every diagonal, as soon as it ends."""
    active = first = last = 0
    for at, lag in zip(places, lags):  # noqa: B905
        if lag != active or at != last + 1:
            if active:
                yield first, active, last - first + 1
            active, first = lag, at
        last = at
    if active:
        yield first, active, last - first + 1


def find_runs(words: np.ndarray, doc: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run. ``words``: one number for each different word of each document, ``doc``: ascending."""
    _, names, counts = np.unique(words, return_inverse=True, return_counts=True)
    names = np.where(counts[names] > 1, names, -1)
    at = np.flatnonzero(names >= 0)
    found, half = [], 1
    while len(at) and LEAST_PERIODS * half <= longest:
        at, name, lag = paired(names, at, half)
        own = (lag >= half) & (lag < 2 * half)
        for first, q, grams in ended(at[own].tolist(), lag[own].tolist()):
            start, length = first - q, grams + 2 * half - 1 + q
            if length >= max(LEAST_WORDS, LEAST_PERIODS * q) and doc[start] == doc[start + length - 1]:
                found.append((start, length, q))
        names = np.full(len(names), -1)
        names[at] = name
        half *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs_of(texts: list[bytes]) -> list[tuple[int, list[tuple[int, int, int]], bytes]]:
    """Of every text its number of words, its runs, and its words joined by one space without those that repeat a run's first period."""
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    doc = np.repeat(np.arange(len(split)), sizes)
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for words in split for w in words), np.int64, int(sizes.sum()))
    runs = find_runs(doc * max(1, len(known)) + codes, doc, int(sizes.max(initial=0)))
    own: list[list[tuple[int, int, int]]] = [[] for _ in split]
    dropped = np.zeros(len(codes), bool)
    for start, length, q in runs:
        d = int(doc[start])
        own[d].append((start - int(starts[d]), length, q))
        dropped[start + q : start + length] = True
    out = []
    for d, words in enumerate(split):
        if own[d]:
            words = [words[i] for i in np.flatnonzero(~dropped[starts[d] : starts[d + 1]]).tolist()]
        out.append((int(sizes[d]), own[d], b" ".join(words)))
    return out


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *kept, text = batch.columns
        found = runs_of([t or b"" for t in text.to_pylist()])
        columns = [
            pa.array([n for n, _, _ in found], pa.int64()),
            pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for _, r, _ in found], pa.list_(RUN)),
            pa.array([c for _, _, c in found], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays([*kept, *columns], names=[*batch.schema.names[:-1], "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, keep: list[str], text: Column | str = "text") -> DataFrame:
    """``keep``, n_words, runs (by start, then period) and collapsed: UTF-8 of the words joined by one space, without the dropped.

    A run is a stretch of words with smallest period q and at least max(6, 4q) words that no neighbour extends; what it has after
    its first q words is dropped.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(*keep, (F.col(text) if isinstance(text, str) else text).cast("binary").alias("__text"))
    ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]]
    return slim.mapInArrow(_find, ", ".join([*ddl, OUT]))


def strongest(runs: str = "runs") -> Column:
    """The run of greatest length by period, compared exactly; ties: smallest start, then period. Null where there is none."""
    order = "b.length * a.period - a.length * b.period, a.start - b.start, a.period - b.period"
    by = " ".join(f"WHEN {x} <> 0 THEN CAST(sign({x}) AS int)" for x in order.split(", "))
    return F.expr(f"try_element_at(array_sort({runs}, (a, b) -> CASE {by} ELSE 0 END), 1)")
