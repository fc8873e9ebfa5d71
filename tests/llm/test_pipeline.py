import base64
import random

import public_tokenizers as P
import pytest
import tiktoken

from gristmill.llm import pii

corpus_pipeline = pytest.importorskip("corpus_pipeline")

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    rnd = random.Random(8)
    words = ["w%s%d" % (rnd.choice("abcde"), i) for i in range(500)]
    docs, marks = [], []
    for i in range(300):
        body = [rnd.choice(words) for _ in range(60)]
        bad = i % 6 == 0
        if bad:
            body[10] = body[30] = "nastyword"
        docs.append([i, " ".join(body), "en", "s", 0])
        if i % 2 == 0:
            marks.append((i, 1, int(bad)))
    docs += [[1001, docs[1][1], "en", "s", 0], [1002, docs[2][1] + " " + ITEM.upper() + " tail", "en", "s", 0], [1003, docs[3][1] + " x.y@mail.example.com", "en", "s", 0]]
    docs += [[1004, None, None, None, None], [1005, ITEM, "en", "s", 0]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        seen[name] = (before, {r["doc_id"]: r for r in rows})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
            docs = spark.createDataFrame(rows, docs.schema)
    before, after = seen["toxicity"]
    assert {i for i in before if i not in after} == {i for i, r in before.items() if r["text"] and "nastyword" in r["text"]}
    before, after = seen["simhash_near_dedup"]
    assert 1 in after and 1001 not in after and 1004 in after
    before, after = seen["benchmark_decontamination"]
    assert set(before) == set(after) and after[1005]["text"] == ""
    assert 1002 not in after or "ALPHA" not in after[1002]["text"] and after[1002]["text"].endswith(" tail")
    before, after = seen["pii_redaction"]
    assert all("@" not in (r["text"] or "") for r in after.values())
    before, after = seen["byte_bpe"]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(list(r["ids"]) == other.encode_ordinary(before[i]["text"] or "") and r["round_trip"] for i, r in after.items())


def test_run_equals_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(str, docs.collect()))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, docs, labels=(), items=()):
    for name, rows, schema in (("documents", docs, SCHEMA), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(list(rows), schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_empty_tables(spark, tmp_path):
    out = corpus_pipeline.run(spark, tables(spark, tmp_path, []))
    assert out.count() == 0 and out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"]


def test_repeated_and_null_ids_without_labels_or_items(spark, tmp_path):
    long = "stone river " * 30_000
    rows = [(7, "one two three four five six", "en", "s", 1), (7, "quite another text that stands here", None, None, None), (3, "one two three four five six", "en", "s", 1)]
    rows += [(None, "a text without any id at all", "en", "s", 1), (9, None, "en", "s", 0), (8, "", "en", "s", 0), (5, long, "en", "s", 0), (6, long, "en", "s", 0)]
    out = corpus_pipeline.run(spark, tables(spark, tmp_path, rows)).collect()
    # the copy of 3 under id 7 goes, the other row of id 7 is no copy of anything and its id stays
    assert {r["doc_id"] for r in out} == {3, 5, 7, 8, None} and all(r["round_trip"] for r in out)


def test_redaction_names_overlaps_once():
    assert pii.redact_text("ab 1.2.3.4 z", [(3, 10, 1), (3, 8, 3), (9, 12, 0)]) == "ab [IP]"
