"""Tables cut in hash buckets under one manifest: batches overwrite by id, and only the buckets they touch are rewritten.

Every write goes to a new folder; a commit adds one small manifest file that says which folder holds each bucket of each table. Readers take the
newest manifest, so changes of several tables become visible together or not at all, and a run that is killed before its commit
leaves nothing but folders that no manifest names. A commit may carry a batch number of a source: a batch that a manifest already
knows is not applied again. Two writers that start from the same manifest can't both commit: the second is told to start anew.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import few

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer committed since the manifest was read."""


@dataclass
class Manifest:
    version: int = 0
    #: table -> {"key", "by", "schema", "folders": bucket -> folder below the store}
    tables: dict = field(default_factory=dict)
    #: source -> number of its last applied batch
    batches: dict = field(default_factory=dict)


@dataclass
class Staged:
    """A table's rewritten buckets, not yet visible."""

    table: str
    touched: list[int]
    folders: dict[str, str]


class BucketStore:
    """``buckets`` bounds what the driver sees of a batch: the numbers of the buckets it touches."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def manifest(self) -> Manifest:
        known = sorted(n for n in self._names("_manifests") if n.endswith(".json"))
        if not known:
            return Manifest()
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/_manifests/{known[-1]}").first()[0]
        return Manifest(**json.loads(text))

    def create(self, table: str, schema: StructType, key: list[str], by: list[str] | None = None) -> None:
        """An empty table: ``key`` tells rows apart, ``by`` (the key by default) deals them. A table that exists stays."""
        now = self.manifest()
        if table not in now.tables:
            now.tables[table] = {"key": key, "by": by or key, "schema": schema.jsonValue(), "folders": {}}
            self._publish(now)

    def _publish(self, after: Manifest) -> None:
        after.version += 1
        target = self._path(f"{self.path}/_manifests/{after.version:012d}.json")
        part = self._path(f"{self.path}/_manifests/_{uuid.uuid4().hex}")
        out = self._fs.create(part, False)
        out.write(bytearray(json.dumps(after.__dict__).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(part, target):
            self._fs.delete(part, False)
            raise Conflict(f"manifest {after.version} of {self.path} exists")

    def read(self, table: str, only: list[int] | None = None, at: Manifest | None = None) -> DataFrame:
        """The table, or some of its buckets."""
        own = (at or self.manifest()).tables[table]
        schema = StructType.fromJson(own["schema"])
        folders = [f for b, f in own["folders"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def _numbered(self, rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.withColumn("__bucket", F.pmod(F.xxhash64(*by), F.lit(self.buckets)).cast("int"))

    def read_staged(self, staged: Staged, at: Manifest) -> DataFrame:
        """The rewritten buckets of a table before they are committed."""
        schema = StructType.fromJson(at.tables[staged.table]["schema"])
        folders = [f"{self.path}/{f}" for f in staged.folders.values()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def stage(self, table: str, rows: DataFrame | None = None, gone: DataFrame | None = None, on: list[str] | None = None, at: Manifest | None = None, within: bool = False) -> Staged:
        """Rewrite the buckets of ``rows`` and ``gone``: old rows with the key of a new one, or that match ``gone`` on ``on``, make way for ``rows``.

        ``rows`` has one row a key; ``on`` holds the columns that the table is dealt by, so that ``gone`` finds its buckets. ``within`` says
        that all ``rows`` stand for something in ``gone``: then ``gone`` alone tells what makes way, and ``rows`` are evaluated once.
        Old rows are shuffled only where too many keys make way to be broadcast; else they stay in the files' order.
        """
        at = at or self.manifest()
        own = at.tables[table]
        key, by = own["key"], own["by"]
        if gone is not None and not set(by) <= set(on or []):
            raise ValueError(f"{table} is dealt by {by}: what goes must be named by these columns")
        if within and gone is None:
            raise ValueError("rows within what goes need what goes")
        parts = [self._numbered(x, by).select("__bucket") for x in (None if within else rows, gone) if x is not None]
        touched = sorted(r[0] for r in (parts[0].union(parts[1]) if len(parts) > 1 else parts[0]).distinct().collect())
        columns = StructType.fromJson(own["schema"]).names
        new = None if rows is None else self._numbered(rows.select(*columns), by).repartition("__bucket")
        if any(str(b) in own["folders"] for b in touched):
            left, shuffled = self.read(table, touched, at), False
            for keys, names in ((gone, on), (None if within else rows, key)):
                if keys is not None:
                    keys = keys.select(*names).distinct()
                    light = few(keys)
                    left, shuffled = left.join(F.broadcast(keys) if light else keys, names, "left_anti"), shuffled or not light
            left = self._numbered(left.select(*columns), by)
            left = left.repartition("__bucket") if shuffled else left
            new = left if new is None else left.unionByName(new)
        folder = f"{table}/{at.version + 1:012d}-{uuid.uuid4().hex}"
        if touched and new is not None:
            new.write.partitionBy("__bucket").option("compression", "zstd").parquet(f"{self.path}/{folder}")
        made = {n.removeprefix("__bucket="): f"{folder}/{n}" for n in self._names(folder) if n.startswith("__bucket=")}
        return Staged(table, touched, made)

    def commit(self, *staged: Staged, at: Manifest, source: str | None = None, batch: int | None = None) -> None:
        """Make all of it visible at once."""
        for s in staged:
            folders = at.tables[s.table]["folders"]
            for b in s.touched:
                folders.pop(str(b), None)
            folders.update(s.folders)
        if source is not None:
            at.batches[source] = batch
        self._publish(at)

    def applied(self, at: Manifest, source: str, batch: int) -> bool:
        return at.batches.get(source, -1) >= batch

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Rows overwrite those of the same key."""
        at = self.manifest()
        self.commit(self.stage(table, rows, at=at), at=at)

    def delete(self, gone: DataFrame, tables: dict[str, list[str]]) -> None:
        """Remove from every table the rows that match ``gone`` on its columns, all under one manifest."""
        at = self.manifest()
        self.commit(*(self.stage(t, gone=gone, on=on, at=at) for t, on in tables.items()), at=at)
