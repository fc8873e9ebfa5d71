"""Approximate nearest neighbours by cosine: inverted lists of coarse centroids, product-quantised residuals, exact reranking.

The index is fitted on a bounded sample in hash order (``FIT_ROWS``, more where many lists need it, up to ``MOST_FIT_ROWS``):
spherical k-means gives the coarse centroids, a list for about ``ROWS_A_LIST`` rows up to ``MANY_LISTS`` and then as many as
the root of the rows; k-means in each of ``PARTS`` slices of the residuals gives the codes. Every row is then indexed. The number of lists to probe is the least
that holds ``PROBE_SHARE`` of the true neighbours among the sample, so it follows how clustered the vectors are; a query probes
further lists while those chosen hold too few rows. Lists are dealt in tiles of a bounded number of rows by a bounded number
of queries, so neither a crowded list nor many queries meet in one task. In a tile every query's asymmetric distance table
scores all codes; the best ``DEPTH`` and whatever lies within twice the quantiser's error of them are reranked on the original
vectors in double precision, and the tile's best k go to the final ranking.

Defined cases: vectors that are null, of another length than most, all zero or hold a null or non-finite component take no
part; ties go to the smaller id; of identical vectors the k + 1 smallest different ids are kept as candidates, which no result can tell
from keeping all; fewer candidates than k give fewer rows; repeated ids count as the query's own row; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed
from .samples import hash_sample

FIT_ROWS, MOST_FIT_ROWS, SAMPLE_A_LIST = 20_000, 100_000, 25
ROWS_A_LIST = 400
MANY_LISTS = 4096
PARTS = 16
CODES = 256
PROBE_SHARE = 0.985
DEPTH = 48
TILE_ROWS = 4096
TILE_QUERIES = 1024


@dataclass
class Index:
    centroids: np.ndarray
    #: part x code x slice width
    codebooks: np.ndarray
    width: int
    probes: int
    #: twice the root mean square error of the asymmetric score
    margin: float

    def padded(self, x: np.ndarray) -> np.ndarray:
        extra = self.codebooks.shape[0] * self.codebooks.shape[2] - x.shape[1]
        return np.pad(x, ((0, 0), (0, extra))) if extra else x

    def assign(self, unit: np.ndarray) -> np.ndarray:
        return nearest_center(unit, self.centroids)

    def encode(self, residual: np.ndarray) -> np.ndarray:
        parts, codes, width = self.codebooks.shape
        r = self.padded(residual).reshape(-1, parts, width)
        out = np.empty((len(r), parts), np.uint8)
        for p in range(parts):
            book = self.codebooks[p]
            out[:, p] = (r[:, p] @ book.T - 0.5 * (book * book).sum(1)).argmax(1)
        return out

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """Inner products of each query's slices with all codewords: query x part x code."""
        parts, _, width = self.codebooks.shape
        q = self.padded(unit).reshape(-1, parts, width)
        return np.einsum("qpw,pcw->qpc", q, self.codebooks)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest_center(x: np.ndarray, centers: np.ndarray, spherical: bool = True) -> np.ndarray:
    """The nearest center of every row, a bounded block of rows at a time."""
    less = 0 if spherical else 0.5 * (centers * centers).sum(1)
    return np.concatenate([(x[i : i + 4096] @ centers.T - less).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def list_count(rows: int) -> int:
    """A list for ``ROWS_A_LIST`` rows up to ``MANY_LISTS``, beyond that the root of the rows: lists and centroids grow alike."""
    return max(1, min(rows // ROWS_A_LIST, max(MANY_LISTS, math.isqrt(rows))))


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, spherical: bool) -> np.ndarray:
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest_center(x, centers, spherical)
        counts = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, d], k) for d in range(x.shape[1])], 1)
        filled = counts > 0
        centers[filled] = sums[filled] / counts[filled, None]
        centers[~filled] = x[rng.choice(len(x), int((~filled).sum()))]
        if spherical:
            centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    return centers


def fit(sample: np.ndarray, rows: int, k: int) -> Index:
    """Index parameters from a sample of the vectors; ``rows``: how many there are in all."""
    rng = np.random.default_rng(7)
    x = unit_rows(sample.astype(np.float64))
    lists = min(len(x), list_count(rows))
    centroids = kmeans(x, lists, 12, rng, True)
    own = nearest_center(x, centroids)
    parts = min(PARTS, x.shape[1])
    index = Index(centroids, np.zeros((parts, 1, -(-x.shape[1] // parts))), x.shape[1], 1, 0.0)
    residual = index.padded(x - centroids[own]).reshape(len(x), parts, -1)
    codes = min(CODES, len(x))
    train = residual[rng.choice(len(x), min(len(x), 10_000), replace=False)]
    index.codebooks = np.stack([kmeans(np.ascontiguousarray(train[:, p]), min(codes, len(train)), 8, rng, False) for p in range(parts)])
    held = rng.choice(len(x), min(len(x), 400), replace=False)
    score = x[held] @ x.T
    score[np.arange(len(held)), held] = -np.inf
    near = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    order = np.argsort(-(x[held] @ centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(lists)[None, :].repeat(len(held), 0), 1)
    if near.size:
        places = np.sort(np.take_along_axis(place, own[near], 1).ravel())
        index.probes = int(places[min(len(places) - 1, int(np.ceil(PROBE_SHARE * len(places))) - 1)]) + 1
    picked = rng.choice(len(x), min(len(x), 1000), replace=False)
    coded = index.encode((x - centroids[own])[picked])
    made = np.concatenate([index.codebooks[p][coded[:, p]] for p in range(parts)], 1)[:, : x.shape[1]]
    error = x[held] @ ((x - centroids[own])[picked] - made).T
    index.margin = 2 * float(np.sqrt((error * error).mean()))
    return index


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and v of the rows that take part; single-precision vectors stay single until they are computed with."""
    single = vectors.schema[embedding].dataType.simpleString() == "array<float>"
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<float>" if single else "array<double>").alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & whole)
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    return rows.join(F.broadcast(usual.select("n")), F.size("v") == F.col("n"), "left_semi")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _indexer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            if batch.num_rows:
                x = unit_rows(_matrix(batch.column(1), index.width))
                own = index.assign(x)
                codes = index.encode(x - index.centroids[own])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1)], names=["vec_id", "list", "codes", "v"]
                )

    return run


def _prober(shared, sizes: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            if batch.num_rows:
                x = unit_rows(_matrix(batch.column(1), index.width))
                order = np.argsort(-(x @ index.centroids.T), axis=1, kind="stable")
                enough = (np.cumsum(sizes[order], 1) > k).argmax(1) + 1
                enough[np.cumsum(sizes[order], 1)[:, -1] <= k] = order.shape[1]
                lists = [o[: max(index.probes, e)].tolist() for o, e in zip(order, enough.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32())), batch.column(1)], names=["query_id", "lists", "q"])

    return run


def search_tile(index: Index, place: int, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, codes: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k best of one tile for each query, by exact cosine, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, codes, vectors = ids[order], codes[order], vectors[order]
    norms = np.sqrt((vectors * vectors).sum(1))
    unit = unit_rows(queries)
    tables = index.tables(unit)
    parts = np.arange(codes.shape[1])[:, None]
    by_part = codes.T
    out = []
    for i, qid in enumerate(query_ids.tolist()):
        rough = tables[i][parts, by_part].sum(0)
        if len(rough) > DEPTH:
            floor = np.partition(rough, len(rough) - DEPTH)[len(rough) - DEPTH] - index.margin
            chosen = np.flatnonzero(rough >= floor)
        else:
            chosen = np.arange(len(rough))
        chosen = chosen[ids[chosen] != qid]
        q = queries[i]
        exact = (vectors[chosen] * q).sum(1) / (norms[chosen] * np.sqrt((q * q).sum()))
        best = np.argsort(-exact, kind="stable")[:k]
        out += [(qid, int(ids[chosen[b]]), float(exact[b])) for b in best]
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest rows found for every row of ``queries``, itself left out."""
    spark = vectors.sparkSession
    different = usable(vectors, vec_id, embedding).distinct()
    copies = Window.partitionBy("v").orderBy("vec_id")  # ranks are limited before the shuffle, so copies of one vector don't meet in one task
    rows = different.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).drop("copy")
    asked = usable(queries, vec_id, embedding).dropDuplicates()
    kind = asked.schema["v"].dataType.simpleString()
    total = usable(vectors, vec_id, embedding).count()
    schema = "query_id bigint, vec_id bigint, score double"
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    fit_rows = min(MOST_FIT_ROWS, max(FIT_ROWS, SAMPLE_A_LIST * list_count(total)))
    sample = hash_sample(usable(vectors, vec_id, embedding).select(F.col("vec_id").alias("doc_id"), "v"), fit_rows, 11).toPandas()
    index = fit(np.unique(np.array(sample["v"].tolist(), np.float64), axis=0), total, k)  # copies would pass for neighbours
    shared = spark.sparkContext.broadcast(index)
    asked = asked.filter(F.size("v") == index.width)
    indexed = checkpointed(rows.mapInArrow(_indexer(shared), f"vec_id bigint, list int, codes binary, v {rows.schema['v'].dataType.simpleString()}"))
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in indexed.groupBy("list").count().collect():  # a row for each centroid
        sizes[r["list"]] = r["count"]
    probes = asked.mapInArrow(_prober(shared, sizes, k), f"query_id bigint, lists array<int>, q {kind}")
    probes = checkpointed(probes)
    asked_lists = probes.select(F.explode("lists").alias("list")).groupBy("list").count()
    blocks = np.maximum(1, -(-sizes // TILE_ROWS))
    by_list = F.broadcast(spark.createDataFrame([(i, int(b)) for i, b in enumerate(blocks)], "list int, blocks int"))
    chunks = by_list.join(F.broadcast(asked_lists), "list", "left").select("list", "blocks", F.greatest(F.lit(1), F.ceil(F.coalesce("count", F.lit(0)) / TILE_QUERIES)).cast("int").alias("chunks"))
    chunks = F.broadcast(checkpointed(chunks))  # a row for each centroid
    left = (
        probes.select("query_id", "q", F.explode("lists").alias("list"))
        .join(chunks, "list")
        .select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int").alias("chunk"), "query_id", "q")
    )
    right = indexed.join(chunks, "list").select(
        "list", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "vec_id", "codes", "v"
    )

    def tile(key, asking: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(own):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        codes = np.frombuffer(b"".join(own["codes"]), np.uint8).reshape(len(own), -1)
        found = search_tile(shared.value, key[0], asking["query_id"].to_numpy(), np.stack(asking["q"].to_list()).astype(np.float64), own["vec_id"].to_numpy(), codes, np.stack(own["v"].to_list()).astype(np.float64), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    keys = ["list", "block", "chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(tile, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
