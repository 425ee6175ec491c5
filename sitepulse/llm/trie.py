"""Prefix trie of conversations by whole-sequence collapse.

Conversations are rebuilt (the first turns come from their group's first
conversation), and identical ones collapse into one weighted sequence with
the list of its members.  Only distinct sequences go on: a sequence that is a
proper prefix of another is no leaf (anti-join), and the nodes of the trie
are the sequences' prefixes with their weights added up.

A prefix is known by its depth and two 64-bit hashes, each the xor over its
turns of hashes of (turn, place), so it can be put together from parts: the
turns of one conversation may lie in many range partitions, and no window
covers more than the part in one of them.  The parts' totals are carried
over by a small table that holds only conversations with several parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitepulse.llm.storage import Scratch

#: Conversations whose ids share the quotient by GROUP start alike.
GROUP = 20

#: Turns taken over at most (a conversation's number is its id's CRC-32 modulo SHARED + 1).
SHARED = 3

#: Members of one packed row of an end list.
PACKED = 1 << 14

ORDER = ["turn", "role", "digest"]
KEY = ["depth", "x", "y"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """c, turn, role, digest of the text, a and b (hashes of role and text), w (words)."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"),
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.select(
        "c",
        "turn",
        "role",
        F.md5("text").alias("digest"),
        F.xxhash64("role", "text").alias("a"),
        F.xxhash64(F.lit("second"), "role", "text").alias("b"),
        F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("w"),
    )


def placed(a: str, b: str, place) -> tuple:
    """The turn's hashes at a place of the sequence."""
    return F.xxhash64(a, place), F.xxhash64(b, place, F.lit("second"))


def taken_over(turns: DataFrame) -> DataFrame:
    """c, h, heads of every conversation: the at most SHARED first turns that it takes over, in order.

    The pick of the first turns is a group limit, which cuts each map task's rows.
    """
    first = Window.partitionBy("c").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    base = turns.where(F.col("c") % GROUP == 0)
    heads = (
        base.withColumn("p", F.row_number().over(first))
        .where(F.col("p") <= SHARED)
        .groupBy(F.col("c").alias("base"))
        .agg(F.array_sort(F.collect_list(F.struct("p", "a", "b", "w"))).alias("heads"))
    )
    convs = turns.select("c").distinct().select(
        "c",
        (F.col("c") - F.col("c") % GROUP).alias("base"),
        (F.crc32(F.col("c").cast("string")) % (SHARED + 1)).cast("int").alias("h"),
    )
    heads_of = F.coalesce(F.slice("heads", F.lit(1), F.col("h")), F.expr("array()").cast("array<struct<p:int,a:long,b:long,w:long>>"))
    return convs.join(heads, "base", "left").select("c", "h", heads_of.alias("heads"))


def carried(parts: DataFrame, totals: dict) -> DataFrame:
    """c, pid and, per column, the total over the conversation's earlier parts; only of conversations with several parts."""
    earlier = Window.partitionBy("c").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = {n: (F.bit_xor(n) if how == "xor" else F.sum(n)).over(earlier) for n, how in totals.items()}
    return parts.withColumns({f"before_{n}": s for n, s in sums.items()}).where("before_n IS NOT NULL").drop(*totals)


def rebuilt_turns(scratch: Scratch, turns: DataFrame, heads: DataFrame) -> DataFrame:
    """Own turns that stay: c, pid, depth, f, g (placed hashes), w and the part's running x, y, words."""
    rows = turns.join(heads.select("c", "h", F.size("heads").alias("nb")), "c")
    ranged = rows.repartitionByRange("c", *ORDER).withColumn("pid", F.spark_partition_id())
    parts = scratch.table(ranged, "turns")
    before = carried(parts.groupBy("c", "pid").agg(F.count(F.lit(1)).alias("n")), {"n": "sum"})
    within = Window.partitionBy("c", "pid").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    running = within.rowsBetween(Window.unboundedPreceding, 0)
    place = F.row_number().over(within) + F.coalesce("before_n", F.lit(0))
    numbered = parts.join(before, ["c", "pid"], "left").withColumn("p", place).where("p > h")
    numbered = numbered.withColumn("depth", F.col("p") - F.col("h") + F.col("nb"))
    f, g = placed("a", "b", F.col("depth"))
    hashed = numbered.withColumns({"f": f, "g": g})
    return scratch.table(
        hashed.select(
            "c",
            "pid",
            "depth",
            "f",
            "g",
            "w",
            F.bit_xor("f").over(running).alias("x"),
            F.bit_xor("g").over(running).alias("y"),
            F.sum("w").over(running).alias("words"),
        ),
        "rebuilt",
    )


def head_turns(heads: DataFrame) -> DataFrame:
    """The taken-over turns of every conversation as c, depth, f, g, w, x, y, words."""
    f, g = placed("t.a", "t.b", F.col("t.p").cast("long"))
    one = heads.select("c", F.explode("heads").alias("t")).select(
        "c", F.col("t.p").cast("long").alias("depth"), f.alias("f"), g.alias("g"), F.col("t.w").alias("w")
    )
    running = Window.partitionBy("c").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    sums = {"x": F.bit_xor("f"), "y": F.bit_xor("g"), "words": F.sum("w")}
    return one.select("*", *[s.over(running).alias(n) for n, s in sums.items()])


def pack_ends(members: DataFrame) -> DataFrame:
    """depth, x, y, ends_sha256: SHA-256 of the member ids in ascending order, comma-joined.

    A sequence may have a large share of all conversations, and the hash of
    one text cannot be split.  So range partitions first pack its ids into
    texts of PACKED ids; one pass over those texts makes the hash, holding
    one text at a time.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, out = None, [], []

        def done():
            out.append((*now, ids[0], ",".join(map(str, ids))))

        for batch in batches:
            for *key, c in zip(*[col.to_pylist() for col in batch.columns]):
                if ids and (key != now or len(ids) == PACKED):
                    done()
                    ids = []
                now = key
                ids.append(c)
            if len(out) >= 64:
                yield _rows(out, [*KEY, "first", "text"])
                out = []
        if ids:
            done()
        if out:
            yield _rows(out, [*KEY, "first", "text"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, out = None, None, []
        for batch in batches:
            for *key, _, text in zip(*[col.to_pylist() for col in batch.columns]):
                if key != now:
                    if sha:
                        out.append((*now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            if out:
                yield _rows(out, [*KEY, "ends_sha256"])
                out = []
        if sha:
            yield _rows([(*now, sha.hexdigest())], [*KEY, "ends_sha256"])

    rows = members.select(*KEY, "c").repartitionByRange(*KEY, "c").sortWithinPartitions(*KEY, "c")
    packed = rows.mapInArrow(pack, "depth long, x long, y long, first long, text string")
    dealt = packed.repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return dealt.mapInArrow(digest, "depth long, x long, y long, ends_sha256 string")


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string() if n in ("text", "ends_sha256") else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def collapse(heads: DataFrame, own: DataFrame, taken: DataFrame) -> DataFrame:
    """Every conversation as c, depth, x, y, total: its rebuilt length, hashes and words."""
    parts = own.select("c", "f", "g", "w").unionByName(taken.select("c", "f", "g", "w"))
    sums = parts.groupBy("c").agg(
        F.count(F.lit(1)).alias("depth"), F.bit_xor("f").alias("x"), F.bit_xor("g").alias("y"), F.sum("w").alias("total")
    )
    zero = {n: F.coalesce(n, F.lit(0).cast("long")) for n in ("depth", "x", "y", "total")}
    return heads.select("c").join(sums, "c", "left").withColumns(zero)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the
    root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.  Turns
    are ordered by turn (null first); equal turns by role and then by the MD5
    of the text, so the result does not depend on the rows' order, and
    repeated rows are repeated turns.  Null role or text counts as empty.
    Rows with a null conv_id belong to no conversation.  An empty table has
    no nodes.  Other columns are not read.  Two prefixes are one node if
    their lengths and two 64-bit hashes are equal.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    turns = turns_of(conversations)
    heads = scratch.table(taken_over(turns), "heads")
    own = rebuilt_turns(scratch, turns, heads)
    taken = head_turns(heads)

    members = scratch.table(collapse(heads, own, taken), "members")
    sequences = scratch.table(
        members.groupBy(*KEY, "total").agg(F.count(F.lit(1)).alias("weight"), F.min("c").alias("c")), "sequences"
    )
    n = sequences.select("c", F.col("depth").alias("length"))

    # running values of own turns: the taken-over turns and the conversation's earlier parts come before
    totals = own.groupBy("c", "pid").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("f").alias("f"), F.bit_xor("g").alias("g"), F.sum("w").alias("w")
    )
    before = carried(totals, {"n": "sum", "f": "xor", "g": "xor", "w": "sum"})
    head_sum = taken.groupBy("c").agg(F.bit_xor("f").alias("hf"), F.bit_xor("g").alias("hg"), F.sum("w").alias("hw"))
    kept = own.join(n, "c").join(before, ["c", "pid"], "left").join(head_sum, "c", "left")
    none = F.lit(0).cast("long")
    whole = kept.select(
        "c",
        "length",
        F.col("depth").cast("long").alias("depth"),
        "f",
        "g",
        "w",
        *[
            F.col(v).bitwiseXOR(F.coalesce(f"before_{s}", none)).bitwiseXOR(F.coalesce(f"h{s}", none)).alias(v)
            for v, s in (("x", "f"), ("y", "g"))
        ],
        (F.col("words") + F.coalesce("before_w", none) + F.coalesce("hw", none)).alias("words"),
    )
    zeros = [none.alias(v) for v in ("depth", "f", "g", "w", "x", "y", "words")]
    prefixes = scratch.table(
        whole.unionByName(taken.join(n, "c").select(*whole.columns)).unionByName(n.select("c", "length", *zeros)),
        "prefixes",
    )

    inner = prefixes.where("depth < length").select(*KEY).distinct()
    leaves = sequences.join(inner, KEY, "left_anti").select("c", F.lit(1).cast("long").alias("leaf"))
    marked = sequences.join(leaves, "c", "left").select("c", "weight", "total", F.coalesce("leaf", none).alias("leaf"))
    weighted = prefixes.withColumn("start", F.col("words") - F.col("w")).join(marked, "c")

    nodes = scratch.table(
        weighted.groupBy(*KEY).agg(
            F.min("c").alias("conv_id"),
            F.sum("weight").alias("n_convs"),
            F.sum("leaf").alias("n_leaves"),
            F.sum(F.col("weight") * (F.col("total") - F.col("start"))).alias("spoken"),
            F.min("start").alias("start"),
            F.min(F.col("x").bitwiseXOR(F.col("f"))).alias("px"),
            F.min(F.col("y").bitwiseXOR(F.col("g"))).alias("py"),
        ),
        "nodes",
    )
    # A node belongs to the sequence of its smallest member; those of one sequence
    # are the end of its path.  So each node's words are counted once in a subtree.
    owned = nodes.groupBy(F.col("conv_id").alias("c")).agg(F.min("start").alias("from"))
    once = (
        weighted.join(owned, "c", "left")
        .groupBy(*KEY)
        .agg(F.sum(F.col("total") - F.greatest("start", F.coalesce("from", "total"))).alias("once"))
    )
    inner_nodes = nodes.where("depth > 0")
    children = inner_nodes.groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")
    ).agg(F.count(F.lit(1)).alias("n_children"))
    ends = pack_ends(members)
    full = scratch.table(
        nodes.join(once, KEY).join(children, KEY, "left").join(ends, KEY, "left"), "full"
    )
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    return full.join(parents, ["depth", "px", "py"], "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", none).alias("n_children"),
        "n_leaves",
        (F.col("spoken") - F.col("once")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
