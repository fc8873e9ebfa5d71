"""Columns that a caller's model computes: embeddings, rerank scores, judgements. Without a model, lexical scores stand in.

A model is a function over lists; it runs in vectorised batches on the executors and must be importable there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import tokens

EMBED_BATCH, EMBED_CHARS = 12, 8192


def embed_column(text: Column, embed: Callable[[list[str]], list[list[float]]], batch: int = EMBED_BATCH, limit: int = EMBED_CHARS) -> Column:
    """array<float> of every text, ``batch`` texts a call; a text reaches the model up to ``limit`` characters, null gives null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list = [None] * len(texts)
            at = [i for i, t in enumerate(texts) if t is not None]
            for k in range(0, len(at), batch):
                own = at[k : k + batch]
                found = embed([texts.iloc[i] for i in own])
                if len(found) != len(own):
                    raise ValueError(f"{len(found)} vectors for {len(own)} texts")
                for i, v in zip(own, found, strict=True):
                    out[i] = v
            yield pd.Series(out)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")(F.substring(text, 1, limit))


def lexical_score(query: Column, text: Column) -> Column:
    """Share of a query's distinct words that the text holds."""
    asked = F.array_distinct(tokens(query))
    return F.round(F.coalesce(F.size(F.array_intersect(asked, tokens(text))) / F.nullif(F.size(asked), F.lit(0)), F.lit(0.0)), 6)


def rerank(candidates: DataFrame, query: str, text: str, model: Callable[[list[str], list[str]], list[float]] | None = None, out: str = "score") -> DataFrame:
    """Candidates with a rerank score: the model's, or the lexical one."""
    if model is None:
        return candidates.withColumn(out, lexical_score(F.col(query), F.col(text)))

    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(model(q.tolist(), t.tolist()), dtype="float64")

    run.__annotations__ = {"q": pd.Series, "t": pd.Series, "return": pd.Series}
    return candidates.withColumn(out, F.pandas_udf(run, "double")(query, text))


def judged(rows: DataFrame, judge: dict[str, Column]) -> DataFrame:
    """Judge metrics as columns, NaN read as missing."""
    return rows.withColumns({name: F.when(~F.isnan(c.cast("double")), c.cast("double")) for name, c in judge.items()})
