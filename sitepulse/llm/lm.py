"""Document scores from an n-gram model with deleted interpolation.

    p(w | u) = l2[b] c(u, w) / c(u) + l1[b] c(w) / N + l0[b] / (V + 1)

where b is the bucket of the context's count c(u) (powers of two).  The
weights of a bucket are learned by expectation-maximisation on held-out
counts: part of the training rows is deleted from the counts, and its events
are predicted from the rest.  The final counts are those of all training
rows.

Counts move as packed arrays, not as one row per occurrence:

1. Tasks turn documents into blocks of about BLOCK_TOKENS tokens: sorted
   64-bit hashes of the block's different words, and tokens as indices.
2. A block asks for its different words and word pairs; each ask is one row
   per shard of hashes with the sorted hashes and the block's own counts.
   So a pair that every document holds costs one entry per block.
3. A shard's owner adds the counts up and answers every block in its order.
   Where blocks x shards would be too many rows, the asks climb in steps:
   a step splits the range of hashes by at most 2**FAN_BITS and merges the
   asks of as many blocks into one sorted list, and the answers come down
   the same way.  So a block emits at most 2**FAN_BITS rows a step, and the
   rows grow with the tokens (times the steps, a logarithm), not with their
   square.
4. Blocks meet their answers again, keep the pair count of each token, and
   add up a histogram of quantised held-out events, whose size is bounded
   whatever the input; the weights are fitted on it.
5. Scores are one more pass over the blocks.

Words are told apart by 64-bit hashes; among 10**9 different words the
chance that any two share one is about 3 in 100.  Pairs are told apart by
PAIR_BITS bits, which halves what travels; a pair shares its hash with
another one with a probability of (number of different pairs) / 2**PAIR_BITS,
one in 100,000 at 3 * 10**9 pairs.  That only touches the pair counts of
the model, never the word counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitepulse.llm.storage import Scratch
from sitepulse.llm.text import utf8, words

#: Tokens of a block, about; a text is never cut, so a longer one makes a longer block.
BLOCK_TOKENS = 1 << 20
#: Bits of a pair's hash.
PAIR_BITS = 48
#: Hashes that the owner of a shard receives, about.
SHARD_HASHES = 1 << 20
#: A block's asks go to at most this power of two of ranges in one step.
FAN_BITS = 8
#: Owners, or blocks, whose rows one task takes, about.
UNITS_A_TASK = 2
#: Training rows whose crc32 has this remainder are held out from the counts while the weights are fitted.
DELETED = 3
#: Buckets of context counts: 0, 1, 2-3, 4-7, ...; the last takes all larger ones.
BUCKETS = 44
#: Steps per factor of two in the quantised probabilities of the histogram, and their least exponent.
STEPS, LEAST = 8, -40
ROUNDS = 40
#: Least weight of the uniform distribution.
FLOOR = 1e-6
TRAIN, HELD_BACK, TEST = 0, 1, 2
WORD, PAIR = 1, 2


def _pack(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=kind)


def _pack_sorted(a: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte by byte, so that the empty high bytes vanish."""
    d = np.diff(a, prepend=np.uint64(0))
    return _pack(d.view(np.uint8).reshape(-1, 8).T)


def _unpack_sorted(raw: bytes) -> np.ndarray:
    planes = _unpack(raw, "u1").reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _pack_counts(a: np.ndarray) -> bytes:
    """Counts byte by byte; most are small."""
    return _pack(a.astype("<u8").view(np.uint8).reshape(-1, 8).T)


def _unpack_counts(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(_unpack(raw, "u1").reshape(8, -1).T).view("<u8").ravel()


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


#: The end of a text as a word; no word holds a line break.
END = b"\n"


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = u * np.uint64(0x9E3779B97F4A7C15) + ((w << np.uint64(29)) | (w >> np.uint64(35)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) >> np.uint64(64 - PAIR_BITS)


def _blocks(block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, done = TaskContext.get().partitionId() << 32, 0
        names: dict[bytes, int] = {END: 0}
        ids, parts, sizes, tokens, n = [], [], [], [], 0
        kind = None

        def block() -> pa.RecordBatch:
            hashes = np.array([word_hash(w) for w in names], dtype=np.uint64)
            order = np.argsort(hashes)
            place = np.empty(len(order), dtype=np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            flat = place[np.concatenate(tokens)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([first + done], pa.int64()),
                    pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(kind)),
                    pa.array([_pack(np.array(parts, dtype=np.int8))], pa.binary()),
                    pa.array([_pack(np.array(sizes, dtype=np.int64))], pa.binary()),
                    pa.array([_pack_sorted(hashes[order])], pa.binary()),
                    pa.array([_pack(flat.astype("<u4").view(np.uint8).reshape(-1, 4).T)], pa.binary()),
                    pa.array([int(place[0])], pa.int64()),
                    pa.array([n], pa.int64()),
                ],
                ["block", "ids", "parts", "sizes", "words", "tokens", "end_at", "n"],
            )

        for batch in batches:
            kind = batch.column(0).type
            for i, (part, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
                found = words(utf8(text.as_py()))
                found.append(END)
                tokens.append(np.array([names.setdefault(w, len(names)) for w in found], dtype=np.uint32))
                ids.append(batch.column(0).slice(i, 1)), parts.append(part), sizes.append(len(found))
                n += len(found)
                if n >= block_tokens:
                    yield block()
                    names, ids, parts, sizes, tokens, n = {END: 0}, [], [], [], [], 0
                    done += 1
        if n:
            yield block()

    return run


class Block:
    """A block's arrays: ``words`` sorted hashes, ``tokens`` indices, ``before`` their predecessors, ``part`` per token."""

    def __init__(self, row: dict):
        self.sizes = _unpack(row["sizes"], "i8")
        self.words = _unpack_sorted(row["words"])
        planes = _unpack(row["tokens"], "u1").reshape(4, -1)
        self.tokens = np.ascontiguousarray(planes.T).view("<u4").ravel()
        self.parts = _unpack(row["parts"], "i1")
        # each text ends with END, so END stands before every first word
        self.before = np.concatenate((np.array([row["end_at"]], dtype=np.uint32), self.tokens[:-1]))
        self.part = np.repeat(self.parts, self.sizes)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of the different pairs, and each token's place among them."""
        return np.unique(pair_hash(self.words[self.before], self.words[self.tokens]), return_inverse=True)


BITS = {WORD: 64, PAIR: PAIR_BITS}
ASK = "kind int, grp long, shard long, block long, ids binary, train binary, back binary"


def steps(shard_bits: int, fan_bits: int = FAN_BITS) -> list[int]:
    """Leading bits of a hash that name its range after each step; the last has ``shard_bits``."""
    n = max(1, -(-shard_bits // fan_bits))
    return [shard_bits * (k + 1) // n for k in range(n)]


def group_of(block: int, bits: int) -> int:
    """One of 2**bits groups, the same for every kind and range of a block."""
    return ((block * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 24) & ((1 << bits) - 1)


def _split(kind: int, grp: int, unit: int, ids: np.ndarray, counts: list, at: int, before: int, to: int):
    """Asks of a unit whose range is ``at`` (``before`` leading bits), one row per range of ``to`` bits."""
    left = np.uint64(BITS[kind] - to)
    first, n = at << (to - before), 1 << (to - before)
    edges = np.arange(first + 1, first + n, dtype=np.uint64) << left if n > 1 else np.zeros(0, dtype=np.uint64)
    cuts = [0, *np.searchsorted(ids, edges).tolist(), len(ids)]
    out = [(first + i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
    for lo in range(0, len(out), 64):
        some = out[lo : lo + 64]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([kind] * len(some), pa.int32()),
                pa.array([grp] * len(some), pa.int64()),
                pa.array([s for s, _, _ in some], pa.int64()),
                pa.array([unit] * len(some), pa.int64()),
                pa.array([_pack_sorted(ids[a:b]) for _, a, b in some], pa.binary()),
                *(pa.array([_pack_counts(c[a:b]) for _, a, b in some], pa.binary()) for c in counts),
            ],
            ["kind", "grp", "shard", "block", "ids", "train", "back"],
        )


def _asks(to: int, shard_bits: int):
    """The asks of the blocks, by ranges of ``to`` bits and groups of the other ``shard_bits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                block = Block(row)
                hashes, place = block.pairs()
                grp = group_of(row["block"], shard_bits - to)
                for kind, ids, at in ((WORD, block.words, block.tokens), (PAIR, hashes, place)):
                    own = [np.bincount(at[block.part == p], minlength=len(ids)) for p in (TRAIN, HELD_BACK)]
                    yield from _split(kind, grp, row["block"], ids, own, 0, 0, to)

    return run


def _climb(before: int, to: int, shard_bits: int):
    """The asks of merged units, by ranges of ``to`` instead of ``before`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                own = [_unpack_counts(row["train"]), _unpack_counts(row["back"])]
                unit = row["grp"] << before | row["shard"]
                grp = row["grp"] & ((1 << (shard_bits - to)) - 1)
                yield from _split(row["kind"], grp, unit, _unpack_sorted(row["ids"]), own, row["shard"], before, to)

    return run


def _summed(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Each ask's places in the sorted different hashes of all asks, these hashes, and their counts."""
    ids = [_unpack_sorted(x.as_py()) for x in table["ids"]]
    names, place = np.unique(np.concatenate(ids), return_inverse=True)
    sums = []
    for column in ("train", "back"):
        own = np.concatenate([_unpack_counts(x.as_py()) for x in table[column]])
        # whole numbers up to 2**53 are exact in the weights
        sums.append(np.bincount(place, weights=own, minlength=len(names)).astype("<u8"))
    cuts = np.cumsum([len(x) for x in ids])[:-1]
    return np.split(place, cuts), names, sums


MERGED = ASK + ", place binary"


def _merge(table: pa.Table) -> pa.Table:
    """One row of the unit's hashes and counts (no ``place``), and a row per ask with its places among them."""
    places, names, (train, back) = _summed(table)
    n = len(places)
    return pa.table(
        {
            "kind": pa.array([table["kind"][0].as_py()] * (n + 1), pa.int32()),
            "grp": pa.array([table["grp"][0].as_py()] * (n + 1), pa.int64()),
            "shard": pa.array([table["shard"][0].as_py()] * (n + 1), pa.int64()),
            "block": pa.array([None, *table["block"].to_pylist()], pa.int64()),
            "ids": pa.array([_pack_sorted(names)] + [None] * n, pa.binary()),
            "train": pa.array([_pack_counts(train)] + [None] * n, pa.binary()),
            "back": pa.array([_pack_counts(back)] + [None] * n, pa.binary()),
            "place": pa.array([None] + [_pack_sorted(x.astype(np.uint64)) for x in places], pa.binary()),
        }
    )


REPLY = "kind int, shard long, block long, train binary, back binary"


def _descend(before: int):
    """A merged unit's replies, taken apart for the asks that it was merged from."""

    def run(table: pa.Table) -> pa.Table:
        finer, children = [], []
        for i in range(table.num_rows):
            if table["place"][i].is_valid:
                children.append(i)
            else:
                finer.append((table["finer"][i].as_py(), i))
        total = [
            np.concatenate([_unpack_counts(table[c][i].as_py()) for _, i in sorted(finer)]) for c in ("train", "back")
        ]
        places = [_unpack_sorted(table["place"][i].as_py()) for i in children]
        n, unit = len(children), table["unit"][0].as_py()
        return pa.table(
            {
                "kind": pa.array([table["kind"][0].as_py()] * n, pa.int32()),
                "shard": pa.array([unit & ((1 << before) - 1)] * n, pa.int64()),
                "block": pa.array([table["block"][i].as_py() for i in children], pa.int64()),
                "train": pa.array([_pack_counts(total[0][p]) for p in places], pa.binary()),
                "back": pa.array([_pack_counts(total[1][p]) for p in places], pa.binary()),
            }
        )

    return run


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


ANSWER = "kind int, shard long, block long, train binary, back binary, types long, tokens long, kept long"


def _answer(table: pa.Table) -> pa.Table:
    """Adds up one shard; the row of block -1 holds the numbers of different and of all tokens."""
    places, _, (train, back) = _summed(table)
    out = []
    for b, place in zip(table["block"].to_pylist(), places):
        out.append((b, _pack_counts(train[place]), _pack_counts(back[place]), 0, 0, 0))
    out.append((-1, None, None, int((train + back > 0).sum()), int((train + back).sum()), int(train.sum())))
    kind, shard = table["kind"][0].as_py(), table["shard"][0].as_py()
    n = len(out)
    return pa.table(
        {
            "kind": pa.array([kind] * n, pa.int32()),
            "shard": pa.array([shard] * n, pa.int64()),
            "block": pa.array([x[0] for x in out], pa.int64()),
            "train": pa.array([x[1] for x in out], pa.binary()),
            "back": pa.array([x[2] for x in out], pa.binary()),
            "types": pa.array([x[3] for x in out], pa.int64()),
            "tokens": pa.array([x[4] for x in out], pa.int64()),
            "kept": pa.array([x[5] for x in out], pa.int64()),
        }
    )


def bucket(counts: np.ndarray) -> np.ndarray:
    """0 for no count, then 1 + log2, at most BUCKETS - 1."""
    out = np.zeros(len(counts), dtype=np.int64)
    some = counts > 0
    out[some] = np.minimum(np.log2(counts[some]).astype(np.int64) + 1, BUCKETS - 1)
    return out


_LEVELS = -LEAST * STEPS + 2


def _level(p: np.ndarray) -> np.ndarray:
    """Quantised probability: 0 for none, else from 1 up."""
    out = np.zeros(len(p), dtype=np.int64)
    some = p > 0
    out[some] = np.clip(np.round(np.log2(p[some]) * STEPS).astype(np.int64) - LEAST * STEPS, 0, _LEVELS - 2) + 1
    return out


def _value(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, 2.0 ** ((level - 1) / STEPS + LEAST), 0.0)


def _ratio(a: np.ndarray, b) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.asarray(b) > 0)


def _gather(kept: int):
    """Block rows with the answers to them: total counts per word and per token's pair, histogram of held-out events."""

    def run(table: pa.Table) -> pa.Table:
        answers: dict[int, list] = {WORD: [], PAIR: []}
        row = None
        for i in range(table.num_rows):
            kind = table["kind"][i].as_py()
            if kind == 0:
                row = {n: table[n][i].as_py() for n in ("block", "parts", "sizes", "words", "tokens", "end_at")}
                ids = table["ids"].slice(i, 1)
            else:
                answers[kind].append((table["shard"][i].as_py(), i))
        block = Block(row)
        _, place = block.pairs()

        def joined(kind: int, column: str) -> np.ndarray:
            return np.concatenate([_unpack_counts(table[column][i].as_py()) for _, i in sorted(answers[kind])])

        back = block.part == HELD_BACK
        word, pair = joined(WORD, "train"), joined(PAIR, "train")
        cu, cw, cuw = word[block.before[back]], word[block.tokens[back]], pair[place[back]]
        cell = (bucket(cu) * _LEVELS + _level(_ratio(cuw, cu))) * _LEVELS + _level(cw / max(1, kept))
        cells, events = np.unique(cell, return_counts=True)
        word, pair = word + joined(WORD, "back"), pair + joined(PAIR, "back")
        return pa.table(
            {
                "block": pa.array([row["block"]], pa.int64()),
                "ids": ids,
                "parts": pa.array([row["parts"]], pa.binary()),
                "sizes": pa.array([row["sizes"]], pa.binary()),
                "tokens": pa.array([row["tokens"]], pa.binary()),
                "end_at": pa.array([row["end_at"]], pa.int64()),
                "word_total": pa.array([_pack_counts(word)], pa.binary()),
                "pair_total": pa.array([_pack_counts(pair[place])], pa.binary()),
                "cells": pa.array([cells], pa.list_(pa.int64())),
                "events": pa.array([events], pa.list_(pa.int64())),
            }
        )

    return run


def fit_weights(cells: np.ndarray, events: np.ndarray, types: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (BUCKETS x 3: pair, word, uniform) that make the held-out events likeliest.

    A bucket without events gets the weights of all buckets together; for
    a context without counts the pair has no weight.
    """
    b, rest = cells // _LEVELS**2, cells % _LEVELS**2
    p = np.stack([_value(rest // _LEVELS), _value(rest % _LEVELS), np.full(len(cells), 1 / (types + 1))], axis=1)

    def em(rows: np.ndarray) -> np.ndarray:
        weights = np.array([0.5, 0.4, 0.1]) if p[rows, 0].any() else np.array([0.0, 0.8, 0.2])
        for _ in range(rounds):
            share = p[rows] * weights
            share *= (events[rows] / share.sum(axis=1))[:, None]
            weights = share.sum(axis=0) / share.sum()
        return weights

    everything = em(np.ones(len(b), dtype=bool)) if len(b) else np.array([0.0, 0.0, 1.0])
    out = np.tile(everything, (BUCKETS, 1))
    for k in np.unique(b):
        out[k] = em(b == k)
    out[0, 0] = 0
    out[:, 2] = np.maximum(out[:, 2], FLOOR)
    return out / out.sum(axis=1, keepdims=True)


def _scores(weights: np.ndarray, tokens: int, types: int, id_kind: pa.DataType):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("parts", "sizes", "tokens", "end_at")}
                sizes, parts = _unpack(row["sizes"], "i8"), _unpack(row["parts"], "i1")
                at = np.ascontiguousarray(_unpack(row["tokens"], "u1").reshape(4, -1).T).view("<u4").ravel()
                totals = _unpack_counts(batch.column("word_total")[i].as_py()).astype(np.float64)
                cuw = _unpack_counts(batch.column("pair_total")[i].as_py()).astype(np.float64)
                before = np.concatenate((np.array([row["end_at"]], dtype=np.uint32), at[:-1]))
                cu, cw = totals[before], totals[at]
                lam = weights[bucket(cu)]
                p = lam[:, 0] * _ratio(cuw, cu) + lam[:, 1] * (cw / max(1, tokens)) + lam[:, 2] / (types + 1)
                base = np.log10((cw + 1) / (tokens + types + 1))
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("ids").slice(i, 1).flatten().cast(id_kind),
                        pa.array(parts == TEST),
                        pa.array(sizes),
                        pa.array(np.add.reduceat((cw > 0).astype(np.int64), starts)),
                        pa.array(np.full(len(sizes), tokens, dtype=np.int64)),
                        pa.array(np.add.reduceat(base, starts)),
                        pa.array(np.add.reduceat(np.log10(p), starts)),
                    ],
                    names,
                )

    return run


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 7,
    held_out: int = 2,
    deleted: int = DELETED,
    block_tokens: int = BLOCK_TOKENS,
    shard_hashes: int = SHARD_HASHES,
    fan_bits: int = FAN_BITS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Learns from rows whose crc32(id as text) mod ``folds`` is not
    ``held_out``; a null id counts as the text ''.  Scores are log10
    probabilities of the lower-cased (A-Z) words and one end per text;
    ``base_score`` is that of add-one unigrams.  Null and empty texts are one
    end.  Rows repeated with one id each count and each get a row.  Without
    training rows a token costs nothing.  Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(folds))
    part = F.when(fold == held_out, TEST).when(fold == deleted, HELD_BACK).otherwise(TRAIN)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), part.alias("part"), F.col(text_col).cast("string").alias("text")
    )
    id_type = rows.schema["doc_id"].dataType.simpleString()
    blocks = scratch.table(
        rows.mapInArrow(
            _blocks(block_tokens),
            f"block long, ids array<{id_type}>, parts binary, sizes binary, words binary, tokens binary, end_at long, n long",
        ),
        "blocks",
    )
    size, pieces = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shard_bits = max(0, int(np.ceil(np.log2(max(1, size) / shard_hashes))))

    def tasks(units: int) -> int:
        return max(1, -(-units // UNITS_A_TASK))

    def owners(asks: DataFrame) -> DataFrame:
        # 2**shard_bits units of each kind, of words and of pairs, in every step
        return asks.repartition(tasks(2 << shard_bits), "kind", "grp", "shard").groupBy("kind", "grp", "shard")

    climb = steps(shard_bits, fan_bits)
    asks, merged = blocks.mapInArrow(_asks(climb[0], shard_bits), ASK), []
    for k, (before, to) in enumerate(zip(climb, climb[1:])):
        merged.append(scratch.table(owners(asks).applyInArrow(_merge, MERGED), f"merged{k}"))
        units = merged[-1].filter("place is null").drop("block", "place")
        asks = units.mapInArrow(_climb(before, to, shard_bits), ASK)
    answers = scratch.table(owners(asks).applyInArrow(_answer, ANSWER), "answers")
    sums = answers.filter((F.col("block") == -1) & (F.col("kind") == WORD))
    types, tokens, kept = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("types", "tokens", "kept")]).first()

    replies = answers.filter("block >= 0").drop("types", "tokens", "kept")
    for k in reversed(range(len(merged))):
        before = climb[k]
        unit = F.shiftleft("grp", before).bitwiseOR(F.col("shard"))
        asked = merged[k].filter("place is not null").select("kind", unit.alias("unit"), "block", "place")
        found = replies.select("kind", F.col("block").alias("unit"), F.col("shard").alias("finer"), "train", "back")
        met = asked.unionByName(found, allowMissingColumns=True).repartition(tasks(2 << shard_bits), "kind", "unit")
        replies = scratch.table(met.groupBy("kind", "unit").applyInArrow(_descend(before), REPLY), f"replies{k}")
    both = blocks.drop("n").withColumn("kind", F.lit(0)).unionByName(replies, allowMissingColumns=True)
    gathered = scratch.table(
        both.repartition(tasks(pieces), "block").groupBy("block").applyInArrow(
            _gather(int(kept)),
            f"block long, ids array<{id_type}>, parts binary, sizes binary, tokens binary, end_at long, "
            "word_total binary, pair_total binary, cells array<long>, events array<long>",
        ),
        "gathered",
    )
    # the histogram has at most BUCKETS * _LEVELS**2 cells, whatever the input
    cell = gathered.select(F.explode(F.arrays_zip("cells", "events")).alias("x")).select("x.cells", "x.events")
    found = cell.groupBy("cells").agg(F.sum("events").alias("events")).orderBy("cells").toArrow()
    weights = fit_weights(found["cells"].to_numpy(), found["events"].to_numpy().astype(np.float64), int(types))

    arrow_id = gathered.limit(0).select("ids").toArrow().schema.field("ids").type.value_type
    out = (
        f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double"
    )
    return gathered.mapInArrow(_scores(weights, int(tokens), int(types), arrow_id), out)
