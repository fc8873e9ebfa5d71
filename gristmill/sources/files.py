"""JSON and text files as tables, and back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files holding an array of objects (or one object), with the name of the file each row comes from."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """Files holding an object of objects, {url: {heading: value}}: file, source, heading and value as a variant.

    A file that is no such object gives no rows.
    """
    whole = spark.read.option("wholetext", True).text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.try_parse_json("value").alias("v"))
    pages = whole.select("file", F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("source", "page"))
    return pages.select("file", "source", F.explode(F.try_variant_get("page", "$", "map<string,variant>")).alias("heading", "value"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Distinct non-blank lines, such as a list of urls."""
    return spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> ''").distinct()


def write_objects(rows: DataFrame, path: str, partitions: int | None = None) -> None:
    """JSON lines in UTF-8; nulls are written, so that every object has all its keys."""
    (rows.coalesce(partitions) if partitions else rows).write.mode("overwrite").option("ignoreNullFields", False).json(path)


CONVERTED = "path string, text string, engine string, error string"


def read_documents(spark: SparkSession, path: str, remote: Callable[[str, bytes], str | None] | None, local: Callable[[str, bytes], str | None], pattern: str = "*") -> DataFrame:
    """path, text, engine (remote, local or null) and error of every file: converted by ``remote``, or by ``local`` where that fails.

    Both get a file's path and bytes; an exception or a blank text is a failure. The first error is kept, also where the fallback
    helped. One plan, row by row: a failing service or file costs no other row.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)

    def attempt(convert, name: str, content: bytes) -> tuple[str | None, str | None]:
        try:
            text = convert(name, content)
        except Exception as e:  # noqa: BLE001 - whatever a service raises is a row's error
            return None, f"{type(e).__name__}: {e}"
        return (text, None) if text and text.strip() else (None, "no text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                error = text = engine = None
                for engine, convert in (("remote", remote), ("local", local)):
                    if convert is None:
                        continue
                    text, why = attempt(convert, name, content)
                    error = error or (why and f"{engine}: {why}")
                    if text is not None:
                        break
                rows.append((name, text, engine if text is not None else None, error))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["path", "text", "engine", "error"])

    return files.select("path", "content").mapInArrow(run, CONVERTED)
