"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text is cut before every single space that a non-space follows: no match of the split pattern reaches across such a cut, so
the pieces between cuts encode independently. Each task keeps a bounded table of the pieces it met lately; the library encodes
only pieces (or their runs of letters and marks) that are new, and a text's ids are the concatenation of its pieces' ids.

Decoding turns each id's characters back into bytes by the reversed table and joins them, so characters that tokens split come
together again.

A vocabulary file's added tokens, such as an end mark, are read as the library reads them by default: where a text holds one, it
becomes that token. A file of ranks has none.

Defined cases: null reads as empty text; an empty text has no tokens; an empty table gives an empty result; a text of any length
is encoded whole; lone surrogates can't occur in Spark strings; repeated rows are encoded alike; of equally ranked merges the
leftmost goes first; columns other than the named ones are passed through or not read.
"""

from __future__ import annotations

import base64
import json
import os
import re
from array import array
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

PIECES_KEPT = 150_000
AT_ONCE = 4096
TEXT_AT_ONCE = 1 << 21
_CUT = re.compile(r" (?=[^\s\x85\xa0\x1c-\x1f])")
#: A space before a blank or the end, as RE2 writes Python's blanks.
_WIDE = r" (?:[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|$)"
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_ID = attrgetter("id")
_RUN = re.compile(rf"[{_LETTERS}]+|[{_MARKS}]+|\n")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 up."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


_SHOWN = dict(enumerate(byte_characters()))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def tokenizer_from_ranks(ranks: dict[bytes, int]):
    """A tokenizers model equal to merging by token rank: every split of a token into two tokens is a merge, ordered by the token's rank."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    name = {k: shown_bytes(k) for k in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        merges += [(name[a], name[b]) for i in range(1, len(token)) if (a := token[:i]) in ranks and (b := token[i:]) in ranks]
    made = Tokenizer(models.BPE(vocab={name[k]: v for k, v in ranks.items()}, merges=merges))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    return made


def token_characters(path: str) -> dict[int, str]:
    """The printable form of every id of a vocabulary file: one character for each byte."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        found = {i: t for t, i in whole["model"]["vocab"].items()}
        return found | {t["id"]: shown_bytes(t["content"].encode()) for t in whole.get("added_tokens", [])}
    return {i: shown_bytes(t) for t, i in load_ranks(path).items()}


def shown_bytes(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_SHOWN)


def token_bytes(path: str) -> list[bytes]:
    """The byte string of every id, by the byte table reversed; empty for ids that the file doesn't use."""
    back = {c: b for b, c in enumerate(byte_characters())}
    tokens = {i: bytes(map(back.__getitem__, t)) for i, t in token_characters(path).items() if all(c in back for c in t)}
    return [tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1)]


class Decoder:
    """One vocabulary's byte strings in one worker process."""

    _loaded: dict[str, Decoder] = {}

    def __init__(self, path: str):
        self.bytes_of = token_bytes(path)
        self.lengths = np.array([len(t) for t in self.bytes_of], np.int64)

    @classmethod
    def load(cls, path: str) -> Decoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of an id sequence; characters that tokens split come together again."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def offsets(self, ids: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each token in code points; a token that begins or ends inside a character covers the whole of it."""
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        leads = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
        inside = np.concatenate(((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80, [False]))
        return leads[starts] - inside[starts], leads[ends]


class Codec:
    """One vocabulary's encoder in one worker process, with its table of pieces.

    The table has two generations of at most ``pieces_kept`` pieces each: a piece that is met moves to the younger one, and when
    that is full the older one, which holds what was not met since the last turn, is let go.
    """

    _loaded: dict[str, Codec] = {}

    def __init__(self, path: str, pieces_kept: int = PIECES_KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path) if path.endswith(".json") else tokenizer_from_ranks(load_ranks(path))
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        #: Texts that hold one of the file's added tokens go to the library whole, which reads them as these tokens.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: The model by itself, where nothing but the byte-level split stands before it.
        plain = self.tokenizer.normalizer is None and "ByteLevel" in str(self.tokenizer.pre_tokenizer) and all(t.special for t in self.tokenizer.get_added_tokens_decoder().values())
        self.tokenize = self.tokenizer.model.tokenize if plain else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pieces_kept = pieces_kept

    @classmethod
    def load(cls, path: str, pieces_kept: int = PIECES_KEPT) -> Codec:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        cls._loaded[path].pieces_kept = pieces_kept
        return cls._loaded[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        ids, ends = self.encode_column(pa.array(texts, pa.string()))
        starts = np.append(0, ends[:-1])
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another and where each text's ids end; null reads as empty."""
        texts = pc.fill_null(texts, "")
        group = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // TEXT_AT_ONCE
        bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        ids, ends, before = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        for a, b in zip(bounds, bounds[1:], strict=False):
            if a < b:
                own, own_ends = self._encode_group(texts[a:b])
                ids.append(own)
                ends.append(own_ends + before)
                before += len(own)
        return np.concatenate(ids), np.concatenate(ends)

    def _encode_group(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Arrow cuts the texts and numbers their distinct pieces; the table is asked once for each of these, the ids are gathered by number.

        A text's first piece has no space before it and is kept under a leading NUL; texts that hold a NUL or an added token bypass the table.
        Texts with a space before another blank are cut by the regular expression.
        """
        apart = np.zeros(len(texts), bool)
        for mark in ("\0", *self.added):
            apart |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        odd = apart | pc.match_substring_regex(texts, _WIDE).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        heads = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        words = lists.flatten()
        numbered = words.dictionary_encode()
        number = numbered.indices.to_numpy().astype(np.int64)
        pieces = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        number[heads] = len(pieces) + np.arange(len(heads))
        pieces += ["\0" + p for p in words.take(pa.array(heads)).to_pylist()]
        raw = self._ids_of(pieces)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        at, size = (np.cumsum(sizes) - sizes)[number], sizes[number]
        ends = np.cumsum(size)
        place = np.repeat(at - ends + size, size)
        place += np.arange(len(place))
        found = np.frombuffer(b"".join(raw), np.int32)[place]
        last = ends[np.append(heads[1:], len(words)) - 1] if len(heads) else ends
        if not odd.any():
            return found, last
        rest = [self._apart(t) if by else self._cut_apart(t) for t, by in zip(texts.filter(pa.array(odd)).to_pylist(), apart[odd].tolist(), strict=True)]
        sizes = np.zeros(len(texts), np.int64)
        sizes[~odd] = np.diff(last, prepend=0)
        sizes[odd] = np.fromiter(map(len, rest), np.int64, len(rest)) // 4
        whole, by_table = np.empty(sizes.sum(), np.int32), np.repeat(~odd, sizes)
        whole[by_table] = found
        whole[~by_table] = np.frombuffer(b"".join(rest), np.int32)
        return whole, np.cumsum(sizes)

    def _cut_apart(self, text: str) -> bytes:
        first, *rest = _CUT.split(text)
        return b"".join(self._ids_of(["\0" + first, *rest]))

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        """The ids of these pieces by the table; what it doesn't hold is encoded."""
        if len(self.young) > self.pieces_kept:
            self.old, self.young = self.young, {}
        young, take = self.young, self.old.pop
        found = list(map(young.get, pieces))
        whole: dict[str, list[int]] = {}
        tokenize, space = self.tokenize, _SHOWN[0x20]
        for at in [i for i, ids in enumerate(found) if ids is None]:
            piece = pieces[at]
            ids = take(piece, None) or young.get(piece)
            if ids is None:
                if tokenize is not None and piece.isalpha() and piece.isascii():
                    ids = array("I", map(_ID, tokenize(space + piece))).tobytes()
                elif tokenize is None or (ids := self._alone(piece)) is None:
                    whole.setdefault(piece, []).append(at)
                    continue
            found[at] = young[piece] = ids
        new = list(whole)
        for i in range(0, len(new), AT_ONCE):
            part = new[i : i + AT_ONCE]
            real = [p[1:] if p[:1] == "\0" else " " + p for p in part]
            for key, e in zip(part, self.tokenizer.encode_batch_fast(real, add_special_tokens=False), strict=True):
                young[key] = ids = array("I", e.ids).tobytes()
                for at in whole[key]:
                    found[at] = ids
        return found

    def _alone(self, piece: str) -> bytes | None:
        """Ids of a piece of plain letters, marks and single line breaks: the model is asked for each run. None for other pieces."""
        lead, bare = ("\0", piece[1:]) if piece[:1] == "\0" else ("", piece)
        word = bare.rstrip(_TAIL)
        if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
            return self._run(lead + word) + (self._run("\0" + bare[len(word) :]) if len(word) < len(bare) else b"")
        runs = _RUN.findall(bare)
        if sum(map(len, runs)) != len(bare) or "\n\n" in bare or bare[-1:] in ("", "\n"):
            return None
        return self._run(lead + runs[0]) + b"".join([self._run("\0" + run) for run in runs[1:]])

    def _run(self, key: str) -> bytes:
        """Ids of one run, kept like a piece."""
        ids = self.young.get(key)
        if ids is None and (ids := self.old.pop(key, None)) is not None:
            self.young[key] = ids
        if ids is None:
            shown = self._shown(key[1:]) if key[0] == "\0" else _SHOWN[0x20] + self._shown(key)
            ids = self.young[key] = array("I", map(_ID, self.tokenize(shown))).tobytes()
        return ids

    @staticmethod
    def _shown(run: str) -> str:
        """The characters that stand for the run's bytes."""
        return run if run.isascii() and run != "\n" else shown_bytes(run.encode())

    def _apart(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = _CUT.split(text)
        parts = [first, *(" " + p for p in rest)]
        return b"".join(np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False))


def id_lists(ids: np.ndarray, ends: np.ndarray, tail: int | None = None) -> pa.Array:
    """Lists of ids that end at ``ends``, each with ``tail`` behind it if given, without a copy into Python integers."""
    if tail is not None:
        own = np.ones(len(ids) + len(ends), bool)
        ends = ends + np.arange(1, len(ends) + 1)
        own[ends - 1] = False
        whole = np.full(len(own), tail, np.int32)
        whole[own] = ids
        ids = whole
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32, copy=False)))


def encode(docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None, ids: str = "ids", append: int | None = None, offsets: bool = False, running: str | None = None, pieces_kept: int = PIECES_KEPT) -> DataFrame:
    """``keep`` columns (all but the text by default) with the token ids of each text; ``append`` adds that id at the end.

    ``offsets`` adds ``<ids>_start`` and ``<ids>_end``, each token's code-point span in the text (not with ``append``).
    ``running`` adds the number of ids in the rows before this one in its partition.
    ``pieces_kept`` bounds each worker's table of pieces: a larger one spares time and takes about 160 bytes a piece.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != text] if keep is None else keep
    extra = [f"{ids}_start", f"{ids}_end"] if offsets else []
    counted = [running] if running else []
    slim = docs.select(*kept, docs[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, before = Codec.load(vocabulary, pieces_kept), 0
        for batch in batches:
            texts = batch.column(len(kept))
            found, ends = codec.encode_column(texts)
            columns = [id_lists(found, ends, append)]
            if offsets:
                starts = np.append(0, ends[:-1]).tolist()
                spans = [Decoder.load(vocabulary).offsets(found[a:b], (t or "").encode()) for a, b, t in zip(starts, ends.tolist(), texts.to_pylist(), strict=True)]
                columns += [id_lists(np.concatenate([s[i] for s in spans]) if spans else found, ends) for i in (0, 1)]
            if running:
                places = before + columns[0].offsets.to_numpy().astype(np.int64)
                columns.append(pa.array(places[:-1]))
                before = int(places[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], names=[*batch.schema.names[: len(kept)], ids, *extra, *counted])

    kept_ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[: len(kept)]]
    return slim.mapInArrow(run, ", ".join([*kept_ddl, *(f"`{c}` array<int>" for c in [ids, *extra]), *(f"`{c}` bigint" for c in counted)]))


def decode(tokens: DataFrame, vocabulary: str, ids: str = "ids", keep: list[str] | None = None, out: str = "decoded") -> DataFrame:
    """``keep`` columns (all by default) with the bytes that the ids stand for; cast them to string for text. Null ids give no bytes."""
    small_batches(tokens.sparkSession)
    kept = tokens.columns if keep is None else keep
    slim = tokens.select(*kept, tokens[ids].alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Decoder.load(vocabulary)
        for batch in batches:
            lists = batch.column(len(kept))
            values = lists.values.to_numpy(zero_copy_only=False)
            ends = lists.offsets.to_numpy()
            valid = lists.is_valid().to_pylist()
            raw = [codec.decode_bytes(values[ends[i] : ends[i + 1]]) if valid[i] else b"" for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(raw, pa.binary())], names=[*batch.schema.names[: len(kept)], out])

    kept_ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[: len(kept)]]
    return slim.mapInArrow(run, ", ".join([*kept_ddl, f"`{out}` binary"]))


def digest_of_ids(ids: str = "ids"):
    """Lower-case hex SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)
