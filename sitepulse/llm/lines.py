"""Line deduplication by probing sharded minimal perfect hashes.

1. Every document emits its distinct line keys as 128-bit hashes; their
   document counts are summed map-side first, so a line that a third of the
   documents share costs one row per map task.
2. The distinct hashes are split into shards by their leading bits.  Each
   shard gets a minimal perfect hash (levels of bit arrays; a key rests at
   the first level where nothing else falls on its bit) that indexes two
   arrays: a 64-bit fingerprint and the document count.
3. Documents probe the arrays: (hash, document, line number) goes to the
   shard's owner, which answers with the lines to drop.  No line text and no
   count table takes part in a join.

There are as many shards as keys and (document, key) pairs ask for, so the
probes spread with the documents.  A key of at least HOT_DOCS documents and
more than 1/4096 of all pairs would still make its shard hot.  At most 4096
such keys can exist, whatever the input; they are handed to all tasks and
answered on the spot.  All other keys are decided by the perfect hash.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitepulse.llm.storage import Scratch
from sitepulse.llm.text import slices, utf8

SPACE = b" \t\n\r\x0b\x0c"
MIN_DOCS = 10
KEYS_PER_SHARD = 1 << 18
PAIRS_PER_SHARD = 1 << 19
HOT_SHARE, HOT_DOCS = 4096, 4096
LEVELS = 24
GAMMA = 2.0


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def hash_keys(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of the keys as two unsigned halves."""
    import xxhash

    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k) for k in keys), dtype=">u8").reshape(-1, 2)
    return both[:, 0].astype(np.uint64), both[:, 1].astype(np.uint64)


def _mix(k: np.ndarray, level: int) -> np.ndarray:
    x = k ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys onto 0..n-1."""

    def __init__(self, keys: np.ndarray):
        self.n, self.levels, left, base = len(keys), [], keys, 0
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, int(len(left) * GAMMA))
            at = _mix(left, level) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            self.levels.append((alone, np.cumsum(alone) - 1 + base))
            base += int(alone.sum())
            left = left[~alone[at.astype(np.int64)]]
        self.rest, self.base = np.sort(left), base

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys; for a key outside the set any slot, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            if not len(todo):
                return out
            at = (_mix(keys[todo], level) % np.uint64(len(alone))).astype(np.int64)
            hit = alone[at]
            out[todo[hit]] = rank[at[hit]]
            todo = todo[~hit]
        if len(todo) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            hit = self.rest[at] == keys[todo]
            out[todo[hit]] = at[hit] + self.base
        return out

    def dump(self, **arrays: np.ndarray) -> bytes:
        buf = io.BytesIO()
        levels = {f"bits{i}": np.packbits(alone) for i, (alone, _) in enumerate(self.levels)}
        sizes = np.array([len(alone) for alone, _ in self.levels], dtype=np.int64)
        np.savez(buf, sizes=sizes, rest=self.rest, base=self.base, n=self.n, **levels, **arrays)
        return buf.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> tuple[PerfectHash, dict]:
        z = dict(np.load(io.BytesIO(blob)))
        self, base = cls.__new__(cls), 0
        self.levels = []
        for i, size in enumerate(z.pop("sizes")):
            alone = np.unpackbits(z.pop(f"bits{i}"))[: int(size)].astype(bool)
            self.levels.append((alone, np.cumsum(alone) - 1 + base))
            base += int(alone.sum())
        self.n, self.rest, self.base = int(z.pop("n")), z.pop("rest"), int(z.pop("base"))
        return self, z


def _doc_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, f, n): distinct line keys, counted once per document, summed per batch."""
    for batch in batches:
        counts: dict[bytes, int] = {}
        for text in batch.column(0):
            for key in {line_key(x) for x in utf8(text.as_py()).split(b"\n")}:
                if key:
                    counts[key] = counts.get(key, 0) + 1
        k, f = hash_keys(list(counts))
        yield pa.RecordBatch.from_arrays(
            [pa.array(k.view(np.int64)), pa.array(f.view(np.int64)), pa.array(list(counts.values()), pa.int64())],
            ["k", "f", "n"],
        )


def line_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(k, f, docs): in how many rows of ``docs`` each non-empty line key occurs."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(_doc_keys, "k long, f long, n long")
    return counted.groupBy("k", "f").agg(F.sum("n").alias("docs"))


def _build(table: pa.Table) -> pa.Table:
    k = table["k"].to_numpy().view(np.uint64)
    f, n = table["f"].to_numpy(), table["docs"].to_numpy()
    order = np.argsort(k, kind="stable")
    k, f, n = k[order], f[order], n[order]
    first = np.ones(len(k), dtype=bool)
    first[1:] = k[1:] != k[:-1]
    mph = PerfectHash(k[first])
    slot = mph.index(k[first])
    fingers, counts = np.zeros(mph.n, dtype=np.int64), np.zeros(mph.n, dtype=np.int64)
    fingers[slot], counts[slot] = f[first], n[first]
    # keys equal in the first 64 bits and different in the second
    blob = mph.dump(fingers=fingers, counts=counts, twin_k=k[~first], twin_f=f[~first], twin_n=n[~first])
    return pa.table({"shard": table["shard"].slice(0, 1), "blob": pa.array([blob], pa.binary())})


def build_index(counts: DataFrame, shard_bits: int) -> DataFrame:
    """One row (shard, blob) per shard of 64-bit hashes that holds keys."""
    shard = F.shiftrightunsigned("k", 64 - shard_bits) if shard_bits else F.lit(0).cast("long")
    return counts.withColumn("shard", shard).groupBy("shard").applyInArrow(_build, "shard long, blob binary")


def _emit(hot: dict[int, int], min_docs: int, shard_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_k = np.array(sorted(hot), dtype=np.int64)
        for batch in slices(batches):
            keys, doc, num = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for j, line in enumerate(utf8(text).split(b"\n")):
                    if key := line_key(line):
                        keys.append(key), doc.append(i), num.append(j)
            if not keys:
                continue
            k, f = hash_keys(keys)
            signed = k.view(np.int64)
            shard = (k >> np.uint64(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(k), np.int64)
            at = np.minimum(np.searchsorted(hot_k, signed), max(0, len(hot_k) - 1))
            known = hot_k[at] == signed if len(hot_k) else np.zeros(len(k), bool)
            shard[known] = -1  # answered: every hot key is over the limit
            doc = np.array(doc)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shard),
                    batch.column(0).take(pa.array(doc)),
                    batch.column(1).take(pa.array(doc)),
                    pa.array(num, pa.int32()),
                    pa.array(signed),
                    pa.array(f.view(np.int64)),
                ],
                ["shard", "doc_id", "t", "line", "k", "f"],
            )

    return run


def _probe(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mph, arrays = None, None, {}
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
            for lo, hi in zip(cuts, cuts[1:]):
                part = batch.slice(lo, hi - lo)
                if part.num_rows and (blob := part.column("blob")[0].as_py()) is not None:
                    now, (mph, arrays) = shards[lo], PerfectHash.load(blob)
                    part = part.slice(1)
                if not part.num_rows:
                    continue
                if shards[lo] != now:
                    raise ValueError(f"probes reached shard {shards[lo]} before its arrays")
                k = part.column("k").to_numpy().view(np.uint64)
                f = part.column("f").to_numpy()
                slot = mph.index(k)
                drop = (slot >= 0) & (arrays["fingers"][slot] == f) & (arrays["counts"][slot] >= min_docs)
                for a, b, n in zip(arrays["twin_k"], arrays["twin_f"], arrays["twin_n"]):
                    drop |= (k == a) & (f == b) & (n >= min_docs)
                yield part.select(["doc_id", "t", "line"]).filter(pa.array(drop))

    return run


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        n, gone, kept = [], [], []
        for text, drops in zip(batch.column("text").to_pylist(), batch.column("drops").to_pylist()):
            lines, out = ("" if text is None else text).split("\n"), set(drops or ())
            n.append(len(lines)), gone.append(len(out))
            kept.append("\n".join(x for j, x in enumerate(lines) if j not in out) if out else "\n".join(lines))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
            ["doc_id", "n_lines", "n_dropped", "kept_text"],
        )


def drop_common_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    keys_per_shard: int = KEYS_PER_SHARD,
    pairs_per_shard: int = PAIRS_PER_SHARD,
    hot_docs: int = HOT_DOCS,
) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for every row of ``docs``.

    A line is dropped where its key (stripped of ASCII space at both ends,
    A-Z lower-cased, not empty) occurs in at least ``min_docs`` rows of
    ``docs``.  A null or empty text is one empty line and stays as it is.
    Every row is a document: rows repeated with the same id, or id and text,
    count as two and get a row each.  Other columns of ``docs`` are not read; an empty input
    gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = scratch.table(line_counts(rows), "counts")
    total, keys = counts.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.count(F.lit(1))).first()
    wanted = max(keys / keys_per_shard, total / pairs_per_shard, 1)
    shard_bits = int(np.ceil(np.log2(wanted)))
    index = scratch.table(build_index(counts, shard_bits), "index")
    # at most HOT_SHARE keys can hold that share of all pairs each
    hot_from = max(min_docs, hot_docs, int(total) // HOT_SHARE + 1)
    hot = counts.groupBy("k").agg(F.min("docs").alias("least"), F.count(F.lit(1)).alias("twins"))
    hot = {r[0]: r[1] for r in hot.filter((F.col("least") >= hot_from) & (F.col("twins") == 1)).collect()}

    ids = rows.select("doc_id", F.xxhash64("text").alias("t"), "text")
    probes = scratch.table(
        ids.mapInArrow(
            _emit(hot, min_docs, shard_bits),
            _schema(rows, "shard long, doc_id {id}, t long, line int, k long, f long"),
        ),
        "probes",
    )
    answered = probes.filter("shard < 0").select("doc_id", "t", "line")
    asked = probes.filter("shard >= 0").withColumn("blob", F.lit(None).cast("binary"))
    id_type = rows.schema["doc_id"].dataType
    arrays = index.select(
        "shard",
        F.lit(None).cast(id_type).alias("doc_id"),
        F.lit(None).cast("long").alias("t"),
        F.lit(-1).alias("line"),
        F.lit(None).cast("long").alias("k"),
        F.lit(None).cast("long").alias("f"),
        "blob",
    )
    owned = asked.unionByName(arrays).repartition("shard").sortWithinPartitions("shard", "line")
    found = owned.mapInArrow(_probe(min_docs), _schema(rows, "doc_id {id}, t long, line int"))
    drops = (
        answered.unionByName(found)
        .groupBy(F.col("doc_id").alias("__id"), F.col("t").alias("__t"))
        .agg(F.collect_set("line").alias("drops"))
    )
    joined = ids.join(drops, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("t") == F.col("__t")), "left")
    return joined.select("doc_id", "text", "drops").mapInArrow(
        _rebuild, _schema(rows, "doc_id {id}, n_lines long, n_dropped long, kept_text string")
    )


def _schema(rows: DataFrame, ddl: str) -> str:
    return ddl.replace("{id}", rows.schema["doc_id"].dataType.simpleString())
