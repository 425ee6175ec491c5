"""Exact deduplication through an extendible-hash index on shared files.

Every text is addressed by the leading bits of its 64-bit hash.  The index
starts as one bucket; the directory doubles as long as a bucket holds more
than ``bucket_keys`` distinct hashes, and only overfull buckets split.  A
bucket therefore owns a contiguous range of hash values.  Its pages (hash,
number of rows) lie in shared files, and neighbouring buckets of about equal
rows make an owner.

Rows are routed by the directory to the owner of their bucket.  The owner
task sorts its key range; texts with one hash form a chain, which it resolves
by comparing their bytes.  The pages tell which chains are hot (at most
HOT_SHARE can hold that share of all rows): their texts are reduced map-side
to one head per text before any exchange, and their rows never travel.

Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitepulse.llm.storage import Scratch, free_names

#: Distinct hashes a bucket holds before it splits.
BUCKET_KEYS = 1024
#: Largest directory depth: 2**16 entries bound what is broadcast; a bucket at
#: this depth does not split any more and just holds a longer page.
MAX_DEPTH = 16
#: A chain is hot if it holds more than 1 / HOT_SHARE of all rows, and at least HOT_ROWS.
HOT_SHARE, HOT_ROWS = 4096, 512
#: Owners for each task: their rows even out.  Bytes of text (about) of one task.
OWNERS, TASK_BYTES = 32, 64 << 20
#: Heads of hot texts are broadcast up to this size; larger ones are joined by their hash.
BROADCAST_BYTES = 32 << 20


def address(h: Column, depth: int) -> Column:
    """The leading ``depth`` bits of a 64-bit hash as a number from 0."""
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, bucket_keys: int = BUCKET_KEYS, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Buckets of an extendible-hash directory over ``keys`` (column ``h``).

    Returns (bucket, depth, lo, hi, keys): ``lo <= address < hi`` in
    addresses of ``max_depth`` bits.  All doublings are derived from one
    histogram of at most 2**max_depth cells: the prefix of length d is a
    bucket exactly when the prefix of length d-1 was overfull and it is not
    overfull itself (or cannot split further).
    """
    cells = keys.groupBy(address(F.col("h"), max_depth).alias("a")).agg(F.count(F.lit(1)).alias("keys"))
    prefixes = (
        cells.select(F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth"), "a", "keys")
        .select("depth", F.expr(f"shiftright(a, {max_depth} - depth)").alias("prefix"), "keys")
        .groupBy("depth", "prefix")
        .agg(F.sum("keys").alias("keys"))
    )
    overfull = prefixes.filter((F.col("keys") > bucket_keys) & (F.col("depth") < max_depth))
    halves = overfull.select(
        (F.col("depth") + 1).alias("depth"),
        F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"),
    )
    leaf = (F.col("keys") <= bucket_keys) | (F.col("depth") == max_depth)
    root = prefixes.filter((F.col("depth") == 0) & leaf)
    leaves = prefixes.filter(leaf).join(halves, ["depth", "prefix"]).select("depth", "prefix", "keys")
    width = F.expr(f"shiftleft(1L, {max_depth} - depth)")
    return root.unionByName(leaves).select(
        (F.col("prefix") * width).alias("bucket"),
        "depth",
        (F.col("prefix") * width).alias("lo"),
        ((F.col("prefix") + 1) * width).alias("hi"),
        "keys",
    )


class Index:
    """The index of one table of texts, written to the shared folder: ``directory`` and ``pages``."""

    def __init__(self, rows: DataFrame, h: str, text: str, bucket_keys: int, max_depth: int):
        spark = rows.sparkSession
        self.scratch, self.h, self.text, self.max_depth = Scratch(spark, "exact"), h, text, max_depth
        table = self.scratch.table
        size = F.sum(F.octet_length(text)).alias("bytes")
        keys = table(rows.groupBy(F.col(h).alias("h")).agg(F.count(F.lit(1)).alias("n"), size), "keys")
        buckets = table(directory(keys, bucket_keys, max_depth), "directory")
        entries = buckets.select(F.explode(F.sequence("lo", F.col("hi") - 1)).alias("a"), "bucket")
        # the directory has at most 2**max_depth entries, which bounds this broadcast
        self.pages = table(
            keys.withColumn("a", address(F.col("h"), max_depth))
            .join(F.broadcast(entries), "a")
            .select("bucket", "h", "n")
            .repartitionByRange("bucket", "h")
            .sortWithinPartitions("bucket", "h"),
            "pages",
        )
        total, size = keys.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        self.tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size) // TASK_BYTES)
        owners = OWNERS * self.tasks
        # a directory of full depth has no more ranges to give: owners then share a bucket by the hash's next bits
        self.more_bits = max(0, (owners >> max_depth).bit_length())
        held = self.pages.groupBy("bucket").agg(F.sum("n").alias("n"))
        before = F.sum("n").over(Window.orderBy("bucket")) - F.col("n")  # at most 2**max_depth rows
        owner = F.call_function("div", before * owners, F.lit(max(1, int(total))))
        self.directory = table(entries.join(held.select("bucket", owner.alias("owner")), "bucket"), "owners")
        limit = max(HOT_ROWS, int(total) // HOT_SHARE)
        self.hot = self.pages.where(F.col("n") > limit).select("h")  # fewer than HOT_SHARE rows

    def route(self, rows: DataFrame, names: dict[str, str]) -> DataFrame:
        """``rows`` with the bucket and owner of their hash, and whether its chain is hot."""
        h, address_, bucket, owner, hot = (names[n] for n in ("h", "a", "bucket", "owner", "hot"))
        entries = self.directory.select(F.col("a").alias(address_), F.col("bucket").alias(bucket), F.col("owner").alias(owner))
        listed = self.hot.select(F.col("h").alias(h), F.lit(True).alias(hot))
        addressed = rows.withColumn(address_, address(F.col(h), self.max_depth))
        found = addressed.join(F.broadcast(entries), address_).join(F.broadcast(listed), h, "left").drop(address_)
        if self.more_bits:
            more = F.shiftrightunsigned(h, 64 - self.max_depth - self.more_bits).bitwiseAND((1 << self.more_bits) - 1)
            found = found.withColumn(owner, F.shiftleft(owner, self.more_bits) + more)
        return found

    def heads(self, hot_rows: DataFrame, doc_id: str) -> DataFrame:
        """hh, head, keep_id, group_size of every text of the hot chains, reduced map-side."""
        found = hot_rows.groupBy(F.col(self.h).alias("hh"), F.col(self.text).alias("head")).agg(
            F.max(doc_id).alias("keep_id"), F.count(F.lit(1)).alias("group_size")
        )
        heads = self.scratch.table(found, f"heads-{doc_id}")
        size = heads.agg(F.coalesce(F.sum(F.octet_length("head")), F.lit(0))).first()[0]
        return F.broadcast(heads) if size <= BROADCAST_BYTES else heads


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_keys: int = BUCKET_KEYS,
    max_depth: int = MAX_DEPTH,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, bucket.

    Texts are equal when byte-identical; a null text counts as the empty
    text, so null and empty rows form one group.  The largest id of a group
    stays.  A null id never wins over a number; a group of null ids only has
    a null keep_id and keeps its rows.  Rows repeated with the same id share
    their decision and all count in group_size.  Other columns of ``docs``
    are not read.  An empty input gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    index = Index(rows, "h", "text", bucket_keys, max_depth)
    routed = index.route(rows, {n: n for n in ("h", "a", "bucket", "owner", "hot")})

    # the owner's task compares the bytes of a chain's texts: it sorts them
    chain = Window.partitionBy("owner", "h", "text")
    cold = routed.where("hot IS NULL").repartition(index.tasks, "owner").select(
        "doc_id",
        F.max("doc_id").over(chain).alias("keep_id"),
        F.count(F.lit(1)).over(chain).alias("group_size"),
        "text",
        "bucket",
    )
    hot = routed.where("hot")
    heads = index.heads(hot, "doc_id")
    warm = hot.join(heads, (F.col("h") == F.col("hh")) & (F.col("text") == F.col("head"))).select(*cold.columns)
    return cold.unionByName(warm).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.sha2("text", 256).alias("text_sha256"),
        "bucket",
    )


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_keys: int = BUCKET_KEYS,
    max_depth: int = MAX_DEPTH,
) -> DataFrame:
    """``docs`` without exact copies, all columns kept, one row per text: that with the largest id.

    Rows repeated with one id and one text become a single row; of rows
    without an id, one per text stays if no row of the text has an id.  Each
    row travels once, to the owner of its bucket; of hot texts only the rows
    that may stay do.
    """
    names = free_names(docs, "h", "whole", "a", "bucket", "owner", "hot", "place")
    h, whole, owner, hot, place = (names[n] for n in ("h", "whole", "owner", "hot", "place"))
    rows = docs.withColumn(whole, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = rows.withColumn(h, F.xxhash64(whole))
    index = Index(rows.select(h, whole), h, whole, bucket_keys, max_depth)
    routed = index.route(rows, names)
    cold = routed.where(F.col(hot).isNull())
    chained = routed.where(F.col(hot))
    heads = index.heads(chained.select(h, whole, F.col(id_col).alias("id")), "id")
    heads = heads.select("hh", "head", F.col("keep_id").alias("id"))
    top = chained.alias("r").join(
        heads.alias("k"),
        (F.col(f"r.{h}") == F.col("k.hh")) & (F.col(f"r.{whole}") == F.col("k.head")) & F.col(f"r.{id_col}").eqNullSafe(F.col("k.id")),
        "left_semi",
    )
    first = top.dropDuplicates([h, whole])  # a partial aggregate: one row a text and task travels
    chain = Window.partitionBy(owner, h, whole).orderBy(F.desc_nulls_last(id_col))
    return (
        cold.unionByName(first)
        .repartition(index.tasks, owner)
        .withColumn(place, F.row_number().over(chain))
        .where(F.col(place) == 1)
        .select(*docs.columns)
    )
