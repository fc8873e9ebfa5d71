"""Token ids in Parquet files: list columns, controlled row groups and pages, page indexes.

Documents are dealt by ranges of their id and sorted, so the files in name order hold ascending ids. Ids are dictionary
encoded (a 50k vocabulary fits one dictionary page), the other columns delta encoded; the writer adds column and offset
indexes, so a reader that wants some documents or only the lengths touches those pages alone. Files are committed by Spark's
writer: a lost executor or a repeated task leaves no partial file behind.

Defined cases: null text counts as empty (just the end id); an empty table gives an empty file set; rows with equal ids stay,
next to each other; null ids come first; extra columns are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import small_batches

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2000
PIECES_KEPT = 400_000


def write_tokens(docs: DataFrame, path: str, vocabulary: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Encode, append ``end_id`` to each document and write in ascending id order.

    Columns: part (the file's number), doc_id, at (ids before it in its file), n_tokens, ids.
    """
    dealt = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    encoded = bpe.encode(dealt, vocabulary, keep=["doc_id"], append=end_id, running="at", pieces_kept=PIECES_KEPT)
    rows = encoded.select(F.spark_partition_id().alias("part"), "doc_id", "at", F.size("ids").cast("bigint").alias("n_tokens"), "ids")
    options = {
        "compression": "zstd",
        "parquet.compression.codec.zstd.level": "1",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows),
        "parquet.dictionary.page.size": str(1 << 20),
        "parquet.enable.dictionary": "true",
        **{f"parquet.enable.dictionary#{c}": "false" for c in ("part", "doc_id", "at", "n_tokens")},
    }
    rows.write.options(**options).parquet(path)


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """part, doc_id, at, n_tokens: the metadata pages only."""
    return spark.read.parquet(path).select("part", "doc_id", "at", "n_tokens")


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """Ids in all files before each one: as many rows as there are files."""
    sums = read_lengths(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and, if wanted, ids; ``low``/``high`` bound the doc_id read."""
    rows = spark.read.parquet(path)
    if low is not None:
        rows = rows.filter(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.filter(F.col("doc_id") <= high)
    joined = rows.join(F.broadcast(part_starts(spark, path)), "part")
    return joined.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", *(["ids"] if ids else []))


def with_crc32(tokens: DataFrame, ids: str = "ids", out: str = "ids_crc32") -> DataFrame:
    """Replace the ids by the unsigned crc32 of their little-endian 32-bit bytes (null: of no bytes)."""
    small_batches(tokens.sparkSession)
    kept = [c for c in tokens.columns if c != ids]
    slim = tokens.select(*kept, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(kept))
            values, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
            sums = [zlib.crc32(values[ends[i] : ends[i + 1]]) for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(sums, pa.int64())], names=[*kept, out])

    ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[: len(kept)]]
    return slim.mapInArrow(run, ", ".join([*ddl, f"`{out}` bigint"]))
