import glob
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from gristmill.llm import query_token_files, token_files


def test_files_and_query(spark, tmp_path):
    texts = {i * 7 % 101: f"word{i} " * (i % 30) + "é!" for i in range(101)}
    texts |= {500: None, 501: "", 502: "x" * 30_000, 503: "same", 504: "same"}
    rows = [(i, t, "clash") for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    start = 0
    got = sorted(query_token_files.query(spark, str(tmp_path)).collect())
    assert [r["doc_id"] for r in got] == sorted(texts)
    for r in got:
        ids = np.array([*whole.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_layout_and_selective_reads(spark, tmp_path):
    docs = spark.createDataFrame([(i, "token text number %d" % i) for i in range(4000)], "doc_id long, text string")
    path = f"{tmp_path}/out"
    token_files.write_tokens(docs, path, P.path("byte_bpe_50k.json"), page_rows=500)
    last = -1
    for name in sorted(glob.glob(f"{path}/part-*.parquet")):
        file = pq.ParquetFile(name)
        names = [file.metadata.row_group(0).column(i).path_in_schema for i in range(file.metadata.num_columns)]
        column = lambda n: file.metadata.row_group(0).column(next(i for i, x in enumerate(names) if x.startswith(n)))  # noqa: B023, E731
        assert "DELTA_BINARY_PACKED" in column("doc_id").encodings
        assert any("DICTIONARY" in e for e in column("ids").encodings)
        assert column("doc_id").has_offset_index and column("doc_id").has_column_index
        ids = file.read(["doc_id"])["doc_id"].to_pylist()
        assert ids == sorted(ids) and (not ids or ids[0] > last)
        last = ids[-1] if ids else last
    some = token_files.read_tokens(spark, path, 1000, 1009)
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,1000)" in some._jdf.queryExecution().toString()
    assert [r["doc_id"] for r in some.collect()] == list(range(1000, 1010))
    assert "ids" not in token_files.read_tokens(spark, path, ids=False).columns


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert query_token_files.query(spark, str(tmp_path)).count() == 0


def test_repeated_and_null_ids(spark, tmp_path):
    rows = [(5, "one two"), (None, "first"), (5, "three"), (2, None), (None, "also first")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = query_token_files.query(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got) == [(False, 0), (False, 0), (True, 2), (True, 5), (True, 5)]
    spans = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in got)
    assert [s for s, _, _ in spans] == [sum(n for _, n, _ in spans[:i]) for i in range(5)]
    assert [i for _, _, i in spans] == [None, None, 2, 5, 5]
