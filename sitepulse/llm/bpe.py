"""Byte-level BPE encoding and decoding with the tokenizers library.

A rank file (base64 token, rank) becomes a BPE model of the library: bytes
are written as printable characters by the usual table (printable Latin-1
characters stand for themselves, the other bytes follow from U+0100), and
every split of a token into two tokens is a merge with the token's rank.
Decoding maps ids to bytes by the reversed table, so a character whose bytes
lie in several tokens comes back whole.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitepulse.llm.pretokens import PORTION, Memo, Splitter, portions
from sitepulse.llm.storage import forget, free_names, worker_cache
from sitepulse.llm.text import slices


def byte_table() -> dict[int, str]:
    """Byte -> printable character."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank.  The file is read on the driver: a vocabulary is a few MB."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """The library's description of the model; ``pattern`` splits texts before the merges.

    Where a token can be put together from several pairs, all pairs are
    merges; ranks order them by the token and then by the longer first part.
    """
    table = byte_table()
    shown = {t: "".join(table[b] for b in t) for t in ranks}
    merges = [
        [shown[t[:i]], shown[t[i:]]]
        for t in sorted(ranks, key=ranks.__getitem__)
        for i in range(len(t) - 1, 0, -1)
        if t[:i] in ranks and t[i:] in ranks
    ]
    model = {
        "type": "BPE",
        "dropout": None,
        "unk_token": None,
        "continuing_subword_prefix": None,
        "end_of_word_suffix": None,
        "fuse_unk": False,
        "byte_fallback": False,
        "ignore_merges": True,
        "vocab": {s: ranks[t] for t, s in shown.items()},
        "merges": merges,
    }
    split = {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    return json.dumps(
        {
            "version": "1.0",
            "truncation": None,
            "padding": None,
            "added_tokens": [],
            "normalizer": None,
            "pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, level]},
            "post_processor": None,
            "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
            "model": model,
        }
    )


def load(description: str):
    """An encoder of texts and the bytes of each id; kept per worker process."""
    cache = worker_cache()
    if cache.get("bpe_key") != hash(description):
        import os

        forget(cache)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        back = {c: b for b, c in byte_table().items()}
        tok = Tokenizer.from_str(description)
        vocab = tok.get_vocab()
        pieces = [b""] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            pieces[i] = bytes(back[c] for c in s)
        cache["bpe"], cache["bpe_key"] = (Encoder(tok, description), pieces), hash(description)
    return cache["bpe"]


def groups(texts: list[str], size: int = PORTION) -> Iterator[list[str]]:
    now, n = [], 0
    for t in texts:
        if now and n + len(t) > size:
            yield now
            now, n = [], 0
        now.append(t)
        n += len(t)
    if now:
        yield now


class Encoder:
    """Ids of texts: split by the pattern, each different pre-token encoded once by the library.

    The library encodes matches of the pattern one by one and a match alone
    is one match again, so ids put together from remembered pre-tokens are
    those of the whole text.
    """

    def __init__(self, tok, description: str):
        self._tok = tok
        self.split = Splitter(json.loads(description)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.memo = Memo(self._encode)

    def _encode(self, words: list[str]) -> list[tuple[int, ...]]:
        return [tuple(e.ids) for e in self._tok.encode_batch_fast(words, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text; texts are taken in groups, which bounds the memory of their pre-tokens."""
        for group in groups(texts):
            split = [list(chain.from_iterable(map(self.split, portions(t)))) for t in group]
            for ids in self.memo.answer(split):
                yield list(chain.from_iterable(ids))


def offsets(pieces: list[bytes], ids: list[int]) -> list[tuple[int, int]]:
    """Code point range (start, end) of each id in the encoded text.

    A token that holds part of a character's bytes covers that whole
    character, so neighbouring tokens that share one overlap.
    """
    out, done = [], 0
    for i in ids:
        heads = sum(b & 0xC0 != 0x80 for b in pieces[i])
        inside = bool(pieces[i]) and pieces[i][0] & 0xC0 == 0x80
        out.append((done - inside, done + heads))
        done += heads
    return out


def decode_ids(pieces: list[bytes], ids: list[int]) -> bytes:
    return b"".join([pieces[i] for i in ids])


class StreamDecoder:
    """Decodes ids that arrive in portions; an unfinished character waits for its other bytes."""

    def __init__(self, pieces: list[bytes]):
        import codecs

        self.pieces, self._utf8 = pieces, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int], last: bool = False) -> str:
        return self._utf8.decode(decode_ids(self.pieces, ids), last)


def _encode(description, with_offsets: bool, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pieces = load(description.value)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            kept = batch.drop_columns([text_col])
            at = 0
            for group in groups(texts, 8 * PORTION):  # a few MB of ids at a time
                ids = list(encoder(group))
                part = kept.slice(at, len(group))
                at += len(group)
                cols = [*part.columns, pa.array(ids, pa.list_(pa.int32()))]
                names = [*part.schema.names, "ids"]
                if with_offsets:
                    spans = [[x for s in offsets(pieces, i) for x in s] for i in ids]
                    cols.append(pa.array(spans, pa.list_(pa.int32())))
                    names.append("offsets")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def encode(
    docs: DataFrame, path: str, pattern: str, text_col: str = "text", with_offsets: bool = False
) -> DataFrame:
    """``docs`` without its text, with ``ids`` (and ``offsets``: start, end, start, end, ... in code points).

    Null and empty texts have no ids.  Any UTF-8 text can be encoded, long
    texts in portions whose joined ids equal those of the whole text.  The
    vocabulary (a few MB, whatever the input) is broadcast.  An input column
    with the name of an added one is replaced.
    """
    spark = docs.sparkSession
    description = spark.sparkContext.broadcast(tokenizer_json(read_ranks(path), pattern))
    names = ["ids"] + ["offsets"] * with_offsets
    others = [c for c in docs.columns if c not in (text_col, *names)]
    text = free_names(docs, "text")["text"]
    rows = docs.select(*others, F.col(text_col).cast("string").alias(text))
    numbers = T.ArrayType(T.IntegerType())
    fields = [f for f in rows.schema.fields if f.name != text]
    added = [T.StructField(c, numbers) for c in names]
    out = T.StructType(fields + added)
    return rows.mapInArrow(_encode(description, with_offsets, text), out)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` with ``decoded`` (binary, the bytes of the column ``ids``); null ids decode to nothing.

    An input column ``decoded`` is replaced.
    """
    encoded = encoded.drop("decoded")
    spark = encoded.sparkSession
    description = spark.sparkContext.broadcast(tokenizer_json(read_ranks(path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pieces = load(description.value)
        for batch in slices(batches):
            ids = batch.column("ids")
            raw = [decode_ids(pieces, ids[i].values.to_pylist() if ids[i].is_valid else []) for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(raw, pa.binary())], [*batch.schema.names, "decoded"]
            )

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def round_trip(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 of every row, and ids if asked for.

    Encodes and decodes in one task, so ids need not be stored in between.  Null and empty texts have no tokens; repeated
    rows each get a row; other columns are not read.
    """
    spark = docs.sparkSession
    description = spark.sparkContext.broadcast(tokenizer_json(read_ranks(path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pieces = load(description.value)
        decimal = [str(i) for i in range(len(pieces))]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
        for batch in slices(batches):
            at = 0
            for group in groups([t or "" for t in batch.column("text").to_pylist()], 8 * PORTION):
                n, coded, decoded, kept = [], [], [], []
                for ids in encoder(group):
                    n.append(len(ids))
                    coded.append(hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(decode_ids(pieces, ids)).hexdigest())
                    if with_ids:
                        kept.append(pa.array(ids, pa.int32()))
                cols = [
                    batch.column("doc_id").slice(at, len(group)),
                    pa.array(n, pa.int64()),
                    pa.array(coded, pa.string()),
                    pa.array(decoded, pa.string()),
                ]
                if with_ids:
                    starts = pa.array([0, *accumulate(n)], pa.int32())
                    cols.append(pa.ListArray.from_arrays(starts, pa.concat_arrays(kept)))
                at += len(group)
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    ids = ", ids array<int>" if with_ids else ""
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{ids}")
