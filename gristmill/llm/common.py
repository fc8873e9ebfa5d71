"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Texts can be long: keep the Arrow batches that Python workers receive small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the place that driver and executors share, named by ``spark.checkpoint.dir``.

    Steps, token files and pipeline stages lie here under the application's id, so one folder can go when the application ended.
    Where nothing is named, a local session takes a temporary folder; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gristmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/{spark.sparkContext.applicationId}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null reads as empty."""
    return [x or "" for x in column.to_pylist()]


def in_chunks(rows: Iterable, weight, limit: int) -> Iterator[list]:
    """Group consecutive rows until their summed weight reaches ``limit``."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += weight(row)
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage through a Parquet table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
