"""Recursive character splitting as a vectorised function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators from coarse to fine.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def _pieces(text: str, separator: str) -> list[str]:
    """Cut before every separator, which stays at the start of the piece behind it."""
    if not separator:
        return list(text)
    head, *tail = text.split(separator)
    return [p for p in [head, *(separator + t for t in tail)] if p]


class _Packer:
    """Collects pieces into chunks of at most ``size`` characters, carrying up to ``overlap`` over."""

    def __init__(self, size: int, overlap: int):
        self.size, self.overlap = size, overlap
        self.chunks: list[str] = []
        self.held: list[str] = []
        self.length = 0

    def emit(self) -> None:
        chunk = "".join(self.held).strip()
        if chunk:
            self.chunks.append(chunk)

    def put(self, piece: str) -> None:
        if self.held and self.length + len(piece) > self.size:
            self.emit()
            while self.length > self.overlap or (self.length + len(piece) > self.size and self.length > 0):
                self.length -= len(self.held.pop(0))
        self.held.append(piece)
        self.length += len(piece)

    def flush(self) -> list[str]:
        if self.held:
            self.emit()
        done, self.chunks, self.held, self.length = self.chunks, [], [], 0
        return done


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    finer = separators[at + 1 :]
    out: list[str] = []
    packer = _Packer(size, overlap)
    for piece in _pieces(text, separators[at]):
        if len(piece) < size:
            packer.put(piece)
            continue
        out += packer.flush()
        out += split_text(piece, size, overlap, finer) if finer else [piece]
    return out + packer.flush()


def recursive_split(text: Column | str, size: Column | int, overlap: Column | int, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """array<string> of chunks; null text gives null."""

    def run(t: pd.Series, s: pd.Series, o: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else split_text(x, int(a), int(b), separators) for x, a, b in zip(t, s, o, strict=True)])

    as_column = lambda c: F.lit(c) if isinstance(c, int) else c
    return F.pandas_udf(run, "array<string>")(text, as_column(size), as_column(overlap))
