import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from gristmill.llm import bpe, query_bpe

EDGES = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\n x", "x\n\n", "don't we'll", "\x00 \x00a b", "b \x00a", "\x00", "é–日本 👍🏽", "a  b", "a  b",
    "!!!!!! ---- ====", "12345 67 8", "<|endoftext|> x", "a\x1cb \x1c c", "tab\t x", "aaaa aaaaaaa", "  x", "\x85 y", "a \x85y",
]


def fuzz(n, seed=5):
    rnd = random.Random(seed)
    alphabets = ["ab ", "!- ", "aA!1 ", "\n ", "日本語中 ", "0123 ", " \t\n　x", "АаБ я", "😀👍🏽é ", "'st re'll d ", "\x00 a"]
    return ["".join(rnd.choice(rnd.choice(alphabets[:] if rnd.random() < 0.2 else [alphabets[i % len(alphabets)]])) for _ in range(rnd.randint(1, 50))) for i in range(n)]


@pytest.fixture(scope="module")
def multi():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return bpe.Codec(path), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_rank_merging(multi):
    codec, other = multi
    texts = EDGES + fuzz(4000)
    assert [np.frombuffer(r, "<u4").tolist() for r in codec.encode(texts)] == [other.encode_ordinary(t) for t in texts]


def test_equals_whole_text_encoding():
    codec = bpe.Codec(P.path("byte_bpe_50k.json"))
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = EDGES + fuzz(2000, 9)
    assert [np.frombuffer(r, "<u4").tolist() for r in codec.encode(texts)] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_added_tokens_as_the_library_reads_them():
    codec = bpe.Codec(P.path("byte_bpe_50k.json"))
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rnd = random.Random(12)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "\0 <|endoftext|>", "<|endoftext |>", "x<|endoftext|>  y", "<|END|>"]
    for text in fuzz(1500, 11):
        at = rnd.randint(0, len(text))
        texts.append(text[:at] + "<|endoftext|>" * rnd.randint(0, 2) + text[at:])
    assert [np.frombuffer(r, "<u4").tolist() for r in codec.encode(texts)] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert np.frombuffer(codec.encode(["a <|endoftext|> b"])[0], "<u4").tolist() == [64, 220, 50256, 275]


def test_round_trip_and_offsets(multi):
    codec, _ = multi
    decoder = bpe.Decoder(P.path("byte_bpe_multi_50k.tiktoken"))
    for text in EDGES + fuzz(300, 3):
        ids = np.frombuffer(codec.encode([text])[0], "<u4")
        assert decoder.decode_bytes(ids) == text.encode()
        starts, ends = decoder.offsets(ids, text.encode())
        assert all(decoder.bytes_of[i] in text[a:b].encode() for i, a, b in zip(ids.tolist(), starts, ends))
        assert not len(ids) or (starts[0] == 0 and ends[-1] == len(text))


@pytest.mark.parametrize("kept", [0, 7, 100])
def test_small_tables_change_nothing(multi, kept):
    codec = bpe.Codec(P.path("byte_bpe_multi_50k.tiktoken"), kept)
    texts = fuzz(300, 8) + ["One two.\nThree, four!\nfive", "naïve.\nÉté", "a\n\nb", "x.\n", "don't.\nstop", "ab12.cd"]
    for i in range(0, len(texts), 10):
        own = texts[i : i + 10] * 2
        assert [np.frombuffer(r, "<u4").tolist() for r in codec.encode(own)] == [multi[1].encode_ordinary(t) for t in own]


def test_operator_offsets_and_repeated_rows(spark):
    texts = ["é–日本 👍🏽 one", "same text", "same text", "", None]
    docs = spark.createDataFrame([(7, t, "clash") for t in texts], "doc_id long, text string, ids_start string")
    rows = bpe.encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), keep=["doc_id", "text"], offsets=True).collect()
    assert len(rows) == 5
    decoder = bpe.Decoder(P.path("byte_bpe_multi_50k.tiktoken"))
    for r in rows:
        text = r["text"] or ""
        assert decoder.decode_bytes(np.array(r["ids"], "<u4")) == text.encode()
        assert len(r["ids"]) == len(r["ids_start"]) == len(r["ids_end"])
        assert all(decoder.bytes_of[i] in text[a:b].encode() for i, a, b in zip(r["ids"], r["ids_start"], r["ids_end"]))


def test_query_rows(spark, tmp_path, multi):
    texts = [None, *EDGES, "x" * 50_000, "ab " * 20_000]
    spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in query_bpe.query(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        ids = multi[1].encode_ordinary(t or "")
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["chars_covered"] == len(t or "")
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert query_bpe.query(spark, str(tmp_path)).count() == 0


def test_columns_ask_the_table_once_for_each_piece(monkeypatch):
    """Ids gathered by number: 1.2 MB of texts of few words, some with blanks in a row, an end mark or NUL, nulls and slices between."""
    codec = bpe.Codec(P.path("byte_bpe_50k.json"))
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [f"w{i} plain, words. " * 1000 + f"end{i}" for i in range(60)] + [None, "", "two  blanks  x", "em  x", "a <|endoftext|> b", "\0 x", "odd "]
    asked, real = [], codec._ids_of
    monkeypatch.setattr(codec, "_ids_of", lambda pieces: asked.append(len(pieces)) or real(pieces))
    ids, ends = codec.encode_column(pa.array(["left out", *texts])[1:])
    assert sum(asked) < 300
    own = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for t in own for i in t] and ends.tolist() == np.cumsum([len(t) for t in own]).tolist()
    assert bpe.id_lists(ids, ends, 7).to_pylist() == [[*t, 7] for t in own]
