import base64
import gzip
import hashlib
import io
import os
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException

from gristmill.llm import query_warc, warc

COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def expected(rows):
    least = {}
    for i, html in rows:
        b = (html or "").encode()
        if i is not None:
            least[b] = min(i, least.get(b, i))
    out = []
    for i, html in rows:
        b = (html or "").encode()
        first = least.get(b)
        other = first is not None and i != first
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if other else "response", first if other else None))
    return sorted(out, key=repr)


def test_query_equals_brute_force(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i * 7 % 503, "<p>%s</p>é" % ("x%d " % rnd.randint(0, 40) * rnd.randint(0, 50))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, None), (1003, "same"), (1003, "same"), (1004, "same"), (None, "same"), (None, "alone"), (1005, "x" * 300_000), (2000, "\r\n\r\nWARC/1.1\r\n")]
    frame = [(i, None if k % 9 == 0 else f"http://h/{k}\r\nX: y", h, "clash", 1) for k, (i, h) in enumerate(rows)]
    spark.createDataFrame(frame, "page_id long, url string, html string, record_type string, payload int").repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in query_warc.query(spark, str(tmp_path)).collect()), key=repr)
    assert got == expected(rows)


def test_round_trip_by_small_ranges(spark, tmp_path):
    """Ranges far smaller than members and files rolled after a few records read every record once."""
    rnd = random.Random(1)
    rows = [(i, f"http://h/é{i}", "".join(rnd.choice("abcdefgh <>\n") for _ in range(rnd.randint(0, 3000)))) for i in range(60)]
    path = f"{tmp_path}/w"
    warc.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path, fileBytes="20000")
    assert len([f for f in os.listdir(path) if f.endswith(".warc.gz")]) > 2 and not os.path.exists(f"{path}/_temporary")
    for split in ("97", "4096", "100000000"):
        got = sorted((warc_row["record_id"], warc_row["url"], warc_row["payload"].decode()) for warc_row in warc.read_records(spark, path, splitBytes=split).collect())
        assert got == sorted((f"urn:page:{i}", u, h) for i, u, h in rows)
    one = sorted(os.listdir(path))[0]
    plain = gzip.decompress(open(f"{path}/{one}", "rb").read())
    assert plain.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and plain.count(b"\r\nWARC-Type: response\r\n") > 0


def test_false_starts_inside_members():
    """Magic bytes within a stored block are no member, nor is a member that holds no record."""
    inner = warc.deflated(b"no record")
    record = warc.record_of("urn:page:1", None, b"\x1f\x8b\x08" * 50 + inner, None, "2020-01-01T00:00:00Z")
    stored = gzip.compress(record, 0)
    file = stored + warc.deflated(warc.record_of("urn:page:2", "u", b"p", None, "2020-01-01T00:00:00Z")) + inner
    assert stored.count(warc.MAGIC) > 50
    for cut in range(1, len(file), 13):
        for block in (16, 1000):
            halves = [list(warc.members(pa.PythonFile(io.BytesIO(file), "r"), a, b, block)) for a, b in ((0, cut), (cut, len(file)))]
            found = [m for half in halves for m in half]
            assert [p for p, _ in found] == [0, len(stored)] and found[0][1] == record


def test_members_never_hold_the_magic():
    rnd = random.Random(7)
    for _ in range(200):
        body = bytes(rnd.randrange(256) for _ in range(200)) + warc.MAGIC * rnd.randint(0, 9)
        member = warc.deflated(body, 0 if rnd.random() < 0.3 else 6)
        assert member.find(warc.MAGIC, 1) < 0 and gzip.decompress(member) == body


def test_trailers_that_form_the_magic(spark, tmp_path):
    """A checksum that ends in 1f before a length of 8b 08: no level helps, and the record is written all the same."""
    date, rows, k = "1970-01-01T00:00:00Z", [], 0
    while len(rows) < 2:
        url = "u%06d" % k
        size = len(warc.record_of("urn:page:%d" % len(rows), url, b"0" * 1000, None, date))
        html = "x%06d" % k + "y" * (1000 - 7 + 0x088B - size)
        record = warc.record_of("urn:page:%d" % len(rows), url, html.encode(), None, date)
        assert len(record) == 0x088B
        if zlib.crc32(record) >> 24 == 0x1F:
            with pytest.raises(ValueError):
                warc.deflated(record)
            rows.append((len(rows), url, html))
        k += 1
    path = f"{tmp_path}/w"
    warc.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    for split in ("50", "100000000"):
        got = sorted((r["record_id"], r["url"], r["payload"].decode()) for r in warc.read_records(spark, path, splitBytes=split).collect())
        assert got == [(f"urn:page:{i}", u, h) for i, u, h in rows]


def test_foreign_archives(spark, tmp_path):
    """Several records in a member, folded header lines, other record types, bare blocks, no digest."""
    text = b"WARC/1.0\r\nWARC-Type: request\r\nContent-Length: 3\r\n\r\nGET\r\n\r\n" + b"WARC/1.0\r\nwarc-type:  Response\r\nWARC-Record-ID: <urn:a>\r\nWARC-Target-URI: http://x/\r\n  y\r\nContent-Type: text/dns\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    os.makedirs(f"{tmp_path}/a")
    for name, data in (("one.warc.gz", gzip.compress(text) + gzip.compress(b"")), ("_SUCCESS", b""), (".x.crc", b"crc")):
        with open(f"{tmp_path}/a/{name}", "wb") as f:
            f.write(data)
    got = warc.read_records(spark, f"{tmp_path}/a").collect()
    assert [(r["record_id"], r["url"], r["record_type"], r["payload_bytes"], bytes(r["payload"])) for r in got] == [("urn:a", "http://x/ y", "response", 4, b"abcd")]


@pytest.mark.parametrize("harm", ["short", "digest"])
def test_damage_is_told(spark, tmp_path, harm):
    record = warc.record_of("urn:page:1", "u", os.urandom(50_000), None, "2020-01-01T00:00:00Z")
    data = warc.deflated(record)[:-3000] if harm == "short" else warc.deflated(record.replace(b"sha1:", b"sha1:A")[:-1].replace(b"sha1:A", b"sha1:", 1)[:-5] + b"....\r\n\r\n")
    with open(f"{tmp_path}/x.warc.gz", "wb") as f:
        f.write(data)
    with pytest.raises(PySparkException):
        warc.read_records(spark, f"{tmp_path}/x.warc.gz").collect()


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert query_warc.query(spark, str(tmp_path)).count() == 0
