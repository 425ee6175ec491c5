"""SimHash near-duplicates with pivot distance tables.

Each distinct 64-bit fingerprint stores its Hamming distances to PIVOTS
reference fingerprints.  For two fingerprints the largest difference of a
coordinate is a lower bound of their distance (triangle inequality), so a
pair whose tables differ by more than ``max_bits`` anywhere is discarded;
the survivors are verified bit by bit.

Pairs are only looked at where they can lie within ``max_bits``: the 64 bits
form max_bits + 2 blocks, a close pair agrees on at least two of them, and
every two blocks make a key.  A key shared by more than ``GROUP`` distinct
fingerprints does not emit its pairs: there each member goes to itself and
to its one-bit neighbours, and is paired with the smallest member met at
each.  Members that meet are at most two bits apart, and any two within two
bits meet, so no link is lost and the work grows with the members only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitepulse.llm.components import components
from sitepulse.llm.storage import Scratch, free_names
from sitepulse.llm.text import slices, utf8, words

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: Reference fingerprints; eight distances share a long.
PIVOTS = 16
#: Distinct fingerprints of one key up to which pairs are formed directly.
GROUP = 64
_PART = 1 << 16


def _pivot(i: int) -> int:
    """The i-th reference fingerprint, as a signed 64-bit number."""
    x = (0x9E3779B97F4A7C15 * (i + 1)) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    x ^= x >> 31
    return x - 2**64 if x >= 2**63 else x


def shingle_hashes(found: list[bytes], size: int, seed: int) -> list[int]:
    """XXH64 of every run of ``size`` words joined by a space; of all words where there are fewer."""
    import xxhash

    if not found:
        return []
    h, joined = xxhash.xxh64_intdigest, b" ".join(found)
    if len(found) <= size:
        return [h(joined, seed)]
    starts, ends, at = [], [], 0
    for w in found:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    return [h(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :])]


def fingerprint(text, size: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash: a bit is set if it is set in over half the hashes."""
    hashes = shingle_hashes(words(utf8(text)), size, seed)
    if not hashes:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), _PART):
        part = np.array(hashes[lo : lo + _PART], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED
) -> DataFrame:
    """doc_id, t (a hash of the text) and fp (the fingerprint's bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [fingerprint(t, shingle, seed) for t in batch.column("text").to_pylist()]
            signed = np.array(fps, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("t"), pa.array(signed)], ["doc_id", "t", "fp"]
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("t"), "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, t long, fp long")


def pivot_table(fp: Column) -> list[Column]:
    """Distances of ``fp`` to all pivots, eight to a long (t0, t1, ...)."""
    out = []
    for lo in range(0, PIVOTS, 8):
        packed = None
        for j in range(8):
            d = F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(_pivot(lo + j)))).cast("long"), 8 * j)
            packed = d if packed is None else packed.bitwiseOR(d)
        out.append(packed.alias(f"t{lo // 8}"))
    return out


def _apart(a: str, b: str) -> Column:
    """Largest difference of a coordinate of the two pivot tables."""

    def at(side: str, i: int) -> Column:
        return F.shiftrightunsigned(F.col(f"{side}.t{i // 8}"), 8 * (i % 8)).bitwiseAND(F.lit(255))

    return F.greatest(*[F.abs(at(a, i) - at(b, i)) for i in range(PIVOTS)])


def _keys(fp: Column, max_bits: int) -> Column:
    """One key per pair of blocks: (number of the pair, the bits of both blocks)."""
    n = max_bits + 2
    edges = [round(64 * i / n) for i in range(n + 1)]
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    keys = []
    for i, (x, y) in enumerate(combinations(masks, 2)):
        mask = x | y
        signed = mask - 2**64 if mask >= 2**63 else mask
        keys.append(F.struct(F.lit(i).alias("i"), fp.bitwiseAND(F.lit(signed)).alias("bits")))
    return F.explode(F.array(*keys))


def links(nodes: DataFrame, scratch: Scratch, max_bits: int = MAX_BITS, group: int = GROUP) -> DataFrame:
    """(u, v): pairs of distinct fingerprints within ``max_bits`` that connect all that are linked.

    ``nodes`` has one row per distinct fingerprint, column fp.
    """
    if not 1 <= max_bits <= 2:
        raise ValueError("the meeting points of crowded keys are exact for one or two bits")
    table = nodes.select("fp", *pivot_table(F.col("fp")))
    tables = [f"t{i}" for i in range(PIVOTS // 8)]
    keyed = table.select("fp", *tables, _keys(F.col("fp"), max_bits).alias("k")).select("fp", *tables, "k.i", "k.bits")
    sizes = keyed.groupBy("i", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    crowd = scratch.table(keyed.join(sizes, ["i", "bits"]), "crowd")

    few = crowd.filter(F.col("n") <= group)
    a, b = few.alias("a"), few.alias("b")
    pairs = a.join(
        b,
        (F.col("a.i") == F.col("b.i"))
        & (F.col("a.bits") == F.col("b.bits"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (_apart("a", "b") <= max_bits),
    )

    members = crowd.filter(F.col("n") > group).select("fp", *tables).distinct()
    flips = F.expr("transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i))")
    met = members.select("fp", *tables, F.explode(F.concat(F.array("fp"), flips)).alias("z"))
    first = met.groupBy("z").agg(F.min("fp").alias("fp"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = first.select("z", "fp", *pivot_table(F.col("fp")))
    a, b = first.alias("a"), met.alias("b")
    meets = a.join(
        b, (F.col("a.z") == F.col("b.z")) & (F.col("a.fp") < F.col("b.fp")) & (_apart("a", "b") <= max_bits)
    )

    verified = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits
    out = [x.filter(verified).select(F.col("b.fp").alias("u"), F.col("a.fp").alias("v")) for x in (pairs, meets)]
    return out[0].unionByName(out[1])


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    seed: int = SEED,
    group: int = GROUP,
) -> DataFrame:
    """doc_id, t, fp, root, component_id for every row of ``docs``.

    Documents link when their fingerprints differ in at most ``max_bits``
    bits; component_id is the smallest id reachable, the own one included, and
    root the smallest fingerprint; t is a hash of the row's text.
    Texts without words (null, empty, only spaces) have fingerprint zero,
    which links like any other.  Null ids take part but are never the
    smallest; a component of null ids has a null component_id.  Repeated rows
    each get a row.  Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.table(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    nodes = scratch.table(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    stars = components(links(nodes, scratch, max_bits, group), scratch)
    # stars hold only fingerprints with a link to another one
    linked = stars.select(F.col("u").alias("fp"), F.col("v").alias("root"))
    linked = linked.unionByName(stars.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
    known = nodes.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = known.select("fp", "root").join(least, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").select("doc_id", "t", "fp", "root", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; all columns kept.

    Rows repeated with that id and text become one; of rows with that id and
    different texts, and of components without any id, one row stays too.
    """
    found = near_groups(docs, id_col, text_col, **kw)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("s")
    names = free_names(docs, "t", "id", "stay")
    t, kept_id, stays = names["t"], names["id"], names["stay"]
    stay = found.groupBy("root").agg(first).select(F.col("s.doc_id").alias(kept_id), F.col("s.t").alias(stays))
    marked = docs.withColumn(t, F.xxhash64(F.col(text_col).cast("string")))
    kept = marked.join(stay, F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(t) == F.col(stays)), "left_semi")
    return kept.dropDuplicates([id_col, t]).select(*docs.columns)
