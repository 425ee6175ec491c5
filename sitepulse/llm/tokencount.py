"""Token counts of texts by a two-tier lookup of pre-token lengths.

The library encodes the matches of its pattern (pre-tokens) one by one, so
the tokens of a text are the sum over its pre-tokens.  Tier one is a compact
hash table of the corpus's frequent pre-tokens with their numbers of tokens,
broadcast to all tasks; it has a fixed number of entries.  Tier two is each
worker's own memo: a pre-token outside the table is encoded by the library
once per worker.  No pre-token is ever shuffled; the tables only save work,
so no count depends on what they hold.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitepulse.llm.pretokens import LONGEST, Memo, Splitter, portions
from sitepulse.llm.storage import forget, worker_cache
from sitepulse.llm.text import slices

#: Texts (about) from which the frequent pre-tokens are taken.
SAMPLE = 1000

#: Entries of the broadcast table.
TABLE = 1 << 16

#: Most frequent pre-tokens that one task reports of its sampled texts.
REPORTED = 1 << 9


class LengthTable:
    """Pre-token -> number of tokens, in flat arrays: open addressing over
    CRC-32, slots at most half full, the keys' bytes side by side."""

    def __init__(self, lengths: dict[str, int]):
        keys = [k.encode() for k in lengths]
        self.blob = b"".join(keys)
        self.ends = np.cumsum([0] + [len(k) for k in keys], dtype=np.int64)
        self.lengths = np.fromiter(lengths.values(), np.int32, len(keys))
        self.slots = np.full(1 << max(1, 2 * len(keys)).bit_length(), -1, np.int32)
        for i, key in enumerate(keys):
            at = zlib.crc32(key) & len(self.slots) - 1
            while self.slots[at] >= 0:
                at = at + 1 & len(self.slots) - 1
            self.slots[at] = i

    def get(self, word: str) -> int | None:
        key = word.encode()
        at = zlib.crc32(key) & len(self.slots) - 1
        while (i := self.slots[at]) >= 0:
            if self.blob[self.ends[i] : self.ends[i + 1]] == key:
                return int(self.lengths[i])
            at = at + 1 & len(self.slots) - 1
        return None


class Counts:
    """A tokenizer read from its description (the library's JSON), counting by pre-tokens."""

    def __init__(self, description: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_str(description)
        form = json.loads(description)
        split = form["pre_tokenizer"]["pretokenizers"][0]
        added = form["added_tokens"]
        if form["post_processor"] or any(t[k] for t in added for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("this tokenizer does not count by pre-tokens alone")
        self._split = Splitter(split["pattern"]["Regex"], split["behavior"].lower(), split["invert"])
        self._normalize = self._tok.normalizer.normalize_str if self._tok.normalizer else str
        self._special = [t["content"] for t in added]

    def parts(self, text: str) -> tuple[int, list[str]]:
        """Special strings in a text (one token each, as the library takes them), and the pre-tokens of the rest."""
        rest, n = [text], 0
        for s in self._special if any(s in text for s in self._special) else ():
            cut = [t.split(s) for t in rest]
            n += sum(len(c) - 1 for c in cut)
            rest = list(chain.from_iterable(cut))
        words = []
        for part in chain.from_iterable(map(portions, rest)):
            words += self._split(part.lower() if part.isascii() else self._normalize(part))
        return n, words

    def lengths(self, words: list[str]) -> list[int]:
        return [len(e.ids) for e in self._tok.encode_batch_fast(words, add_special_tokens=False)]


def load(description: str, table: LengthTable | None = None) -> tuple[Counts, Memo]:
    """The tokenizer and the memo behind the table, kept per worker process."""
    cache, key = worker_cache(), (hash(description), table and hash(table.blob))
    if cache.get("count_key") != key:
        forget(cache)
        counts = Counts(description)

        def behind(words: list[str]) -> list[int]:
            found = [table.get(w) if table else None for w in words]
            missed = iter(counts.lengths([w for w, n in zip(words, found) if n is None]))
            return [next(missed) if n is None else n for n in found]

        cache["count"], cache["count_key"] = (counts, Memo(behind)), key
    return cache["count"]


def frequent(texts: DataFrame, description, sample: int, entries: int) -> LengthTable:
    """The table of the most frequent pre-tokens of about ``sample`` random rows.

    Each task with sampled rows reports at most REPORTED pre-tokens, so at
    most ``sample`` * REPORTED short ones reach the driver, whatever the input.
    """
    spark = texts.sparkSession
    rows = texts.count()
    if not rows:
        return LengthTable({})

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, _ = load(description.value)
        seen: Counter[str] = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                seen.update(w for w in counts.parts(text or "")[1] if len(w) <= LONGEST)
                if len(seen) > 64 * REPORTED:
                    seen = Counter(dict(seen.most_common(8 * REPORTED)))
        if seen:
            top = seen.most_common(REPORTED)
            yield pa.RecordBatch.from_pydict({"words": [[w for w, _ in top]], "n": [[n for _, n in top]]})

    picked = texts.sample(min(1.0, sample / rows), seed=1)
    total: Counter[str] = Counter()
    for words, n in picked.mapInArrow(report, "words array<string>, n array<bigint>").collect():
        total.update(dict(zip(words, n)))
    top = [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:entries]]
    return LengthTable(dict(zip(top, Counts(description.value).lengths(top))))


def count_tokens(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 2048,
    sample: int = SAMPLE,
    entries: int = TABLE,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every row.

    ``path`` is a description of the tokenizers library whose pre-tokenizer
    starts with a pattern.  Counts are those of the library on the whole
    text without special tokens around it; special strings inside a text
    count as one token each, the library's default.  Null and empty texts
    have 0 bytes and 0 tokens, repeated rows each get a row, null ids stay
    null, other columns are not read.
    """
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:  # a vocabulary: a few MB
        description = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = spark.sparkContext.broadcast(frequent(rows.select("text"), description, sample, entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, memo = load(description.value, table.value)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            special, split = zip(*map(counts.parts, texts))
            tokens = [n + sum(found) for n, found in zip(special, memo.answer(list(split)))]
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(size, pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
