"""WARC archives as a Spark data source: records written one gzip member each, read back by byte ranges.

``spark.read.format("warc")`` deals every file in ranges of ``splitBytes``. A task scans its range for the gzip magic, takes a
place for a member if its header decodes and its data begin with a WARC version line, and reads each member that starts inside its
range to the end, beyond the range if need be; what starts before belongs to the range before. So a large file is read by many
tasks, each byte about once, and a lost executor costs its ranges only. The writer names its files after attempts and moves them
to their place when the job commits, so repeated tasks leave nothing behind; it compresses a member anew where the magic stands inside it,
with a filler in the record's header where the checksum and length in the gzip trailer form the magic, so no place within its own
members can be taken for a start.

Files are opened with pyarrow's file systems, so archives lie where these reach: local or mounted folders, HDFS, S3, GCS, ABFS.

Of pages with equal payloads the one with the smallest id is a response, the others are revisits without payload that name its record.

Defined cases: a null payload is empty; rows that share the smallest id of a payload are all responses, null ids come after all
others; a null url writes no target; line ends in urls are percent-encoded; an empty table writes no file and reads as no rows; columns
that aren't asked for are not written. A member that breaks off or whose block doesn't match its length raises an error that names
the file and the place. Of foreign archives, records other than responses and revisits are left out, and a member may hold several records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/"
SPLIT_BYTES = 64 << 20
FILE_BYTES = 1 << 30
READ_BYTES = 1 << 20
PIECE_BYTES = 16 << 10
BATCH_BYTES = 8 << 20
STAGING = "_temporary"
FILLERS = 64
HTTP = "application/http; msgtype=response"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"


def deflated(record: bytes, level: int = 6) -> bytes:
    """One gzip member; its magic stands at its start only.

    Where it stands inside, by chance or in a block stored as it is, the record is flushed within each of its own magics, at other levels too.
    """
    parts = record.split(MAGIC)
    cut = [(MAGIC[1:] if i else b"") + x + (MAGIC[:1] if i < len(parts) - 1 else b"") for i, x in enumerate(parts)]
    for how, pieces in ((level, [record]), *((x, cut) for x in (level, 1, 9, 4, 2, 8, 3, 7, 5))):
        packer = zlib.compressobj(how, zlib.DEFLATED, 31)
        member = b"".join([*(packer.compress(x) + (packer.flush(zlib.Z_SYNC_FLUSH) if len(pieces) > 1 else b"") for x in pieces), packer.flush()])
        if member.find(MAGIC, 1) < 0:
            return member
    raise ValueError("no compression of a record keeps the gzip magic out of it")


def _header(fields: list[tuple[str, str]], version: str = "WARC/1.1") -> bytes:
    return "".join([version, "\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode()


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_of(record_id: str, url: str | None, payload: bytes, refers_to: str | None, date: str, filler: int = 0) -> bytes:
    """A response record, or a revisit of ``refers_to`` that keeps the HTTP header alone. The header tells the whole payload's length.

    ``filler`` puts a field of its own, so many characters long, into the record's header.
    """
    http = _header([("Content-Type", "text/html; charset=UTF-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    block = http if refers_to else http + payload
    fields = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to:
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE)]
    if filler:
        fields.append(("X-Filler", "x" * filler))
    fields += [("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("Content-Type", HTTP), ("Content-Length", str(len(block)))]
    return _header(fields) + block + b"\r\n\r\n"


def member_of(record_id: str, url: str | None, payload: bytes, refers_to: str | None, date: str, level: int = 6) -> bytes:
    """The record's member. A gzip trailer (checksum and length) can hold the magic at every level: then a filler changes both."""
    for filler in range(FILLERS):
        try:
            return deflated(record_of(record_id, url, payload, refers_to, date, filler), level)
        except ValueError:
            if filler == FILLERS - 1:
                raise


def _fields(head: bytes) -> dict[str, str]:
    """The fields of a header, names in lower case; a line that begins with a blank goes on with the field before."""
    lines = re.sub(rb"\r?\n[ \t]+", b" ", head).decode("utf-8", "replace").splitlines()[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def records_in(member: bytes, where: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a member."""
    at = 0
    while at < len(member):
        end = re.compile(rb"\r?\n\r?\n").search(member, at)
        if not member.startswith(VERSION, at) or end is None:
            raise ValueError(f"no WARC header in {where}")
        fields = _fields(member[at : end.start()])
        size = int(fields.get("content-length", "-1"))
        if size < 0 or end.end() + size > len(member):
            raise ValueError(f"a record's block breaks off in {where}")
        yield fields, member[end.end() : end.end() + size]
        at = end.end() + size
        while member[at : at + 1] in (b"\r", b"\n"):
            at += 1


def row_of(fields: dict[str, str], block: bytes) -> tuple | None:
    """A row of ``SCHEMA`` for a response or revisit with an HTTP block or, in a response, any other block as its payload."""
    kind = fields.get("warc-type", "").lower()
    if kind not in ("response", "revisit"):
        return None
    head, http = b"", {}
    if fields.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        cut = re.search(rb"\r?\n\r?\n", block)
        head, block = (block[: cut.end()], block[cut.end() :]) if cut else (block, b"")
        http = _fields(head)
    told = fields.get("warc-payload-digest", "").rpartition(":")[2].upper() or None
    if kind == "revisit":
        size = http.get("content-length", "")
        return (*_ids(fields), kind, (fields.get("warc-refers-to") or "").strip("<>") or None, told, int(size) if size.isdigit() else None, None)
    digest = digest_of(block)
    if told and len(told) == 32 and told != digest:
        raise ValueError(f"payload of {fields.get('warc-record-id')} has digest {digest}, not {told}")
    return (*_ids(fields), kind, None, digest, len(block), block)


def _ids(fields: dict[str, str]) -> tuple[str | None, str | None]:
    return (fields.get("warc-record-id") or "").strip("<>") or None, fields.get("warc-target-uri")


class _Window:
    """Bytes of a file from any place on, a block at a time."""

    def __init__(self, file: pa.NativeFile, block: int = READ_BYTES):
        self.file, self.block = file, block
        self.start, self.held = 0, b""

    def _load(self, at: int) -> int:
        """Where ``at`` is in what is held; a magic's length stands there unless the file ends."""
        if not self.start <= at <= self.start + len(self.held) - len(MAGIC):
            self.file.seek(at)
            self.start, self.held = at, self.file.read(self.block)
        return at - self.start

    def magic(self, at: int, end: int) -> int | None:
        """The first place of the magic in [at, end)."""
        while at < end:
            place = self._load(at)
            found = self.held.find(MAGIC, place)
            if found >= 0:
                return self.start + found if self.start + found < end else None
            if len(self.held) - place < len(MAGIC):
                return None
            at = self.start + len(self.held) - len(MAGIC) + 1
        return None

    def piece(self, at: int) -> memoryview:
        place = self._load(at)
        return memoryview(self.held)[place : place + PIECE_BYTES]


def member_at(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The member that starts at a place, if its gzip header decodes and its data begin as a WARC record, and the place after it."""
    unpacker, place, parts, seen = zlib.decompressobj(31), at, [], b""
    while not unpacker.eof:
        data = window.piece(place)
        if not data:
            if seen == VERSION:
                raise ValueError(f"the member at {at} breaks off")
            return None
        try:
            parts.append(unpacker.decompress(data))
        except zlib.error as e:
            if seen == VERSION:
                raise ValueError(f"the member at {at} is damaged: {e}") from e
            return None
        place += len(data) - len(unpacker.unused_data)
        seen = (seen + parts[-1][: len(VERSION)])[: len(VERSION)]
        if not VERSION.startswith(seen):
            return None
    return (b"".join(parts), place) if seen == VERSION else None


def members(file: pa.NativeFile, start: int, end: int, block: int = READ_BYTES) -> Iterator[tuple[int, bytes]]:
    """(place, data) of every member that starts in [start, end)."""
    window = _Window(file, block)
    at = window.magic(start, end)
    while at is not None:
        member = member_at(window, at)
        if member is not None:
            yield at, member[0]
        at = window.magic(member[1] if member else at + 1, end)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))
        self.names, self.schema = schema.names, pa.schema([(f.name, _ARROW[f.name]) for f in schema.fields])

    def partitions(self):
        own, path = _opened(self.path)
        info = own.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else own.get_file_info(fs.FileSelector(path))
        files = [f for f in files if f.type == fs.FileType.File and f.size and not f.base_name.startswith(("_", "."))]
        return [_Range(f.path, at, min(f.size, at + self.split)) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, self.split)] or [_Range("", 0, 0)]

    def read(self, partition):
        if partition.end == 0:
            return
        own, _ = _opened(self.path)
        rows, held = [], 0
        with own.open_input_file(partition.path) as file:
            for at, data in members(file, partition.start, partition.end):
                for fields, block in records_in(data, f"{partition.path}, member at {at}"):
                    row = row_of(fields, block)
                    if row is not None:
                        rows.append(row)
                        held += len(block)
                if held > BATCH_BYTES or len(rows) >= 10_000:
                    yield self.batch(rows)
                    rows, held = [], 0
        yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        column = dict(zip(_ARROW, zip(*rows, strict=True), strict=True)) if rows else dict.fromkeys(_ARROW, ())
        return pa.RecordBatch.from_arrays([pa.array(column[n], _ARROW[n]) for n in self.names], schema=self.schema)


_ARROW = {"record_id": pa.string(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "payload": pa.binary()}


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.most, self.level = options["path"].rstrip("/"), int(options.get("fileBytes", FILE_BYTES)), int(options.get("level", 6))
        self.date = options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator):
        own, path = _opened(self.path)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for r in batch.to_pylist():
                    if out is None or size >= self.most:
                        if out is not None:
                            out.close()
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        own.create_dir(f"{path}/{STAGING}", recursive=True)
                        out = own.open_output_stream(f"{path}/{STAGING}/{names[-1]}", compression=None)
                        info = b"software: gristmill\r\nformat: WARC File Format 1.1\r\n"
                        size = out.write(deflated(_header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))]) + info + b"\r\n\r\n"))
                    payload = r["payload"] or b""
                    size += out.write(member_of(r["record_id"], r["url"], payload, r["refers_to"], self.date, self.level))
        finally:
            if out is not None:
                out.close()
        return _Written(names)

    def commit(self, messages):
        own, path = _opened(self.path)
        own.create_dir(path, recursive=True)
        for name in (n for m in messages if m for n in m.names):
            own.move(f"{path}/{STAGING}/{name}", f"{path}/{name}")
        if own.get_file_info(f"{path}/{STAGING}").type == fs.FileType.Directory:
            own.delete_dir(f"{path}/{STAGING}")

    def abort(self, messages):
        own, path = _opened(self.path)
        if own.get_file_info(f"{path}/{STAGING}").type == fs.FileType.Directory:
            own.delete_dir(f"{path}/{STAGING}")


class WarcSource(DataSource):
    """Format ``warc``; options: splitBytes to read, fileBytes, level and date to write. Any subset of ``SCHEMA``'s columns can be read."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options, schema)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Spark takes it for."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(own).toString()


def with_revisits(pages: DataFrame, page_id: str = "page_id", payload: str = "html") -> DataFrame:
    """The page's id, url and payload and, where a smaller id has the same payload, that id as refers_to.

    Only payloads that stand more than once are joined back; equal payloads have equal SHA-1 and xxHash sums.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    slim = pages.select(F.col(page_id).alias("page_id"), "url", body.cast("binary").alias("payload"))
    summed = slim.withColumn("sha1", F.sha1("payload")).withColumn("xx", F.xxhash64("payload"))
    keys = pages.select(F.col(page_id).alias("page_id"), F.sha1(body.cast("binary")).alias("sha1"), F.xxhash64(body.cast("binary")).alias("xx"))
    first = keys.groupBy("sha1", "xx").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    joined = summed.join(first, ["sha1", "xx"], "left")
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))
    return joined.select("page_id", "url", "payload", F.when(later, F.col("first")).alias("refers_to"))


PREFIX = "urn:page:"


def write_pages(pages: DataFrame, path: str, page_id: str = "page_id", payload: str = "html", **options: str) -> None:
    """A record per page under ``path``; record ids are ``urn:page:<id>``."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    named = lambda c: F.concat(F.lit(PREFIX), F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = with_revisits(pages, page_id, payload)
    rows = rows.select(named("page_id").alias("record_id"), "url", "payload", F.when(F.col("refers_to").isNotNull(), named("refers_to")).alias("refers_to"))
    rows.write.format("warc").mode("append").options(**options).save(qualified(spark, path))


def read_records(spark: SparkSession, path: str, columns: str = SCHEMA, **options: str) -> DataFrame:
    """The responses and revisits of the archives under ``path``; ``columns``: those of ``SCHEMA`` to read."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").schema(columns).options(**options).load(qualified(spark, path))


def page_of(record_id: str) -> Column:
    """The page's id of a record id that ``write_pages`` wrote; null where it was null."""
    return F.expr(f"try_cast(substr({record_id}, {len(PREFIX) + 1}) AS bigint)")
