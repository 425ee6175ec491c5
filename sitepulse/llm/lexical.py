"""Ranked lexical search: summed accumulators of the short lists join a
document-at-a-time walk over the long ones.

The queries are read in blocks of bounded size.  For each block the
documents are read once and leave an inverted index of the queries' terms,
one row per some thousand documents of one task; no text is shuffled.  The
counts N, L and df are sums over those rows, so they cover all documents.
Then every index row is searched for every query of the block:

- TAAT: the query's short lists are added into accumulators, which are
  summed and put in document order.
- DAAT: the accumulators are one more iterator, bounded by their largest
  sum, beside the long lists, each bounded by its largest contribution.
  Documents are taken in windows.  Iterators whose bounds together stay
  below the query's k-th score so far name no candidates; the candidates of
  the others are probed in them, largest bound first, and dropped as soon as
  the bounds left cannot lift them to that score.

Each task keeps only its k best documents per query, so what is shuffled is
queries x k rows a task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitepulse.llm.storage import Scratch
from sitepulse.llm.text import alnum_words, slices, utf8

#: Terms of the queries that are searched at a time, counted query by query.
BLOCK_TERMS = 1 << 19

#: Documents and postings (about) of one index row.
ROW_DOCS, ROW_POSTINGS = 1 << 14, 1 << 22

#: A list is short if it holds less than 1 in SHORT of the row's documents.
SHORT = 16

#: Documents between two looks at the k-th score.
WINDOW = 1 << 11

INDEX = (
    "docs bigint, words bigint, ids array<bigint>, lens binary,"
    " terms array<int>, df array<int>, doc binary, tf binary"
)


# ------------------------------------------------------------------ queries


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """no, item_id, terms, counts of each row that has a term; ``no`` tells repeated rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [Counter(alnum_words(utf8(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("item_id"),
                    pa.array([list(c) for c in found], pa.list_(pa.binary())),
                    pa.array([list(c.values()) for c in found], pa.list_(pa.int64())),
                ],
                ["item_id", "terms", "counts"],
            )

    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()
    terms = rows.mapInArrow(run, f"item_id {kind}, terms array<binary>, counts array<bigint>")
    return terms.where(F.size("terms") > 0).withColumn("no", F.monotonically_increasing_id())


# -------------------------------------------------------------------- index


def pack(part: list[tuple], docs: int, words: int) -> pa.RecordBatch:
    """One index row of (ids, lens, doc, term, tf) pieces: lists by term, documents in order within each."""
    ids, lens, doc, term, tf = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*part))
    used, doc = np.unique(doc, return_inverse=True)
    order = np.lexsort((doc, term))
    terms, df = np.unique(term, return_counts=True)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([docs], pa.int64()),
            pa.array([words], pa.int64()),
            pa.array([ids[used].tolist()], pa.list_(pa.int64())),
            pa.array([lens[used].astype(np.int64).tobytes()], pa.binary()),
            pa.array([terms.tolist()], pa.list_(pa.int32())),
            pa.array([df.tolist()], pa.list_(pa.int32())),
            pa.array([doc[order].astype(np.int32).tobytes()], pa.binary()),
            pa.array([tf[order].astype(np.int32).tobytes()], pa.binary()),
        ],
        [f.split()[0] for f in INDEX.split(", ")],
    )


class _Vocabulary(dict):
    def __missing__(self, word):
        return -1


def build_index(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """Index rows of the vocabulary's terms; docs and words count all documents with a term of any kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Vocabulary((w, i) for i, w in enumerate(vocabulary.value))
        part, docs, words, held, postings = [], 0, 0, 0, 0
        for batch in slices(batches):
            split = [alnum_words(utf8(t)) for t in batch.column("text").to_pylist()]
            lens = np.array([len(ws) for ws in split], np.int64)
            terms = np.fromiter((number[w] for ws in split for w in ws), np.int64, int(lens.sum()))
            at = np.repeat(np.arange(len(split)), lens)[terms >= 0]
            pairs, tf = np.unique(at << 32 | terms[terms >= 0], return_counts=True)
            ids = np.array(batch.column("doc_id").to_pylist(), object)
            part.append((ids, lens, (pairs >> 32) + held, pairs & 0xFFFFFFFF, tf))
            docs, words = docs + int((lens > 0).sum()), words + int(lens.sum())
            held, postings = held + len(split), postings + len(pairs)
            if held >= ROW_DOCS or postings >= ROW_POSTINGS:
                yield pack(part, docs, words)
                part, docs, words, held, postings = [], 0, 0, 0, 0
        if docs:
            yield pack(part, docs, words)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, INDEX)


class Lists:
    """The lists of some index rows, laid behind one another, with each posting's contribution."""

    def __init__(self, rows: list[dict], n_docs: int, n_words: int):
        lens = np.concatenate([np.frombuffer(r["lens"], np.int64) for r in rows])
        self.ids = [i for r in rows for i in r["ids"]]
        starts = np.cumsum([0] + [len(r["ids"]) for r in rows])
        term = np.concatenate([np.repeat(np.array(r["terms"], np.int64), np.array(r["df"], np.int64)) for r in rows])
        doc = np.concatenate([np.frombuffer(r["doc"], np.int32).astype(np.int64) + s for r, s in zip(rows, starts)])
        tf = np.concatenate([np.frombuffer(r["tf"], np.int32) for r in rows]).astype(np.int64)
        order = np.argsort(term, kind="stable")
        self.doc, tf = doc[order], tf[order]
        self.terms, at = np.unique(term[order], return_index=True)
        self.ends = np.append(at, len(term))
        m = 75 + 25 * lens * n_docs // max(1, n_words)
        self.gain = 1_000_000_000 * tf // (1000 * tf + 12 * m[self.doc])
        self.most = np.maximum.reduceat(self.gain, at) if len(at) else self.gain

    def of(self, terms: np.ndarray, weights: np.ndarray) -> list[tuple]:
        """(bound, docs, contributions) of the query's terms that occur, shortest list first."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        out = []
        for i, w in zip(at.tolist(), np.where(self.terms[at] == terms, weights, 0).tolist() if len(self.terms) else ()):
            if w:
                cut = slice(self.ends[i], self.ends[i + 1])
                out.append((w * int(self.most[i]), self.doc[cut], w * self.gain[cut]))
        return sorted(out, key=lambda x: len(x[1]))


# ------------------------------------------------------------------- search


class Best:
    """The k highest scores so far; equal scores by ascending id, null last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def least(self) -> int:
        """A score below this cannot be among the k."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, docs: np.ndarray, ids: list) -> None:
        if len(scores) > self.k:
            bar = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, docs = scores[scores >= bar], docs[scores >= bar]
        self.rows += [(s, ids[d]) for s, d in zip(scores.tolist(), docs.tolist())]
        self.rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        del self.rows[self.k :]


def accumulate(short: list[tuple], n_docs: int) -> tuple | None:
    """TAAT: the short lists' sums as one list with its largest sum as bound."""
    sums = np.zeros(n_docs, np.int64)
    for _, docs, gains in short:
        sums[docs] += gains
    docs = np.flatnonzero(sums)
    return (int(sums[docs].max()), docs, sums[docs]) if len(docs) else None


def search(lists: Lists, terms: np.ndarray, weights: np.ndarray, best: Best, window: int = WINDOW) -> None:
    """Adds to ``best`` what these lists hold for one query."""
    found = lists.of(terms, weights)
    n_docs = len(lists.ids)
    n_short = sum(len(docs) * SHORT < n_docs for _, docs, _ in found)
    summed = accumulate(found[:n_short], n_docs)
    walk = sorted([x for x in [summed, *found[n_short:]] if x], key=lambda x: x[0])
    edges = np.arange(0, n_docs + window, window)
    cuts = [np.searchsorted(docs, edges) for _, docs, _ in walk]
    below = np.cumsum([0] + [bound for bound, _, _ in walk])  # below[i]: bounds of the first i together
    for j in range(len(edges) - 1):
        least = best.least
        passive = int(np.searchsorted(below[1:], least))  # the first so many together stay below it
        if passive == len(walk):
            break
        sums = np.zeros(window, np.int64)
        for (_, docs, gains), cut in zip(walk[passive:], cuts[passive:]):
            part = slice(cut[j], cut[j + 1])
            sums[docs[part] - edges[j]] += gains[part]
        docs = np.flatnonzero(sums)
        sums, docs = sums[docs], docs + edges[j]
        for i in range(passive - 1, -1, -1):
            keep = sums + below[i + 1] >= least
            sums, docs = sums[keep], docs[keep]
            if not len(docs):
                break
            _, other, gains = walk[i]
            part = slice(cuts[i][j], cuts[i][j + 1])
            at = np.searchsorted(other[part], docs)
            hit = at < part.stop - part.start
            hit[hit] = other[part][at[hit]] == docs[hit]
            sums[hit] += gains[part][at[hit]]
        keep = sums >= least
        if keep.any():
            best.add(sums[keep], docs[keep], lists.ids)


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _search_block(scratch: Scratch, name: str, docs: DataFrame, items: list, id_col: str, text_col: str, k: int):
    """no, doc_id, score: each task's k best documents of each of the ``items``."""
    spark = docs.sparkSession
    words = sorted({w for _, terms, _ in items for w in terms})
    number = {w: i for i, w in enumerate(words)}
    vocabulary = spark.sparkContext.broadcast(words)
    index = scratch.table(build_index(docs, vocabulary, id_col, text_col), f"index-{name}")
    total = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    n_docs, n_words = int(total[0]), int(total[1])
    held = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df"))
    weight = np.zeros(len(words), np.int64)
    for i, df in held.collect():  # one number per term of the block
        weight[i] = term_weight(n_docs, int(df))
    queries = []
    for no, terms, counts in items:
        at = np.array([number[t] for t in terms], np.int64)
        queries.append((no, at, weight[at] * np.array(counts, np.int64)))
    shared = spark.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in shared.value]

        def look(rows):
            lists = Lists(rows, n_docs, n_words)
            for (_, at, weights), b in zip(shared.value, best):
                search(lists, at, weights, b)

        rows = []
        for batch in batches:
            for i in range(batch.num_rows):
                rows += batch.slice(i, 1).to_pylist()
                if sum(len(r["ids"]) for r in rows) >= ROW_DOCS or sum(len(r["doc"]) for r in rows) >= 4 * ROW_POSTINGS:
                    look(rows)
                    rows = []
        if rows:
            look(rows)
        out = [(no, d, s) for (no, _, _), b in zip(shared.value, best) for s, d in b.rows]
        for lo in range(0, len(out), 1 << 16):
            cols = list(zip(*out[lo : lo + (1 << 16)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["no", "doc_id", "score"])

    return index.select("ids", "lens", "terms", "df", "doc", "tf").mapInArrow(
        run, "no bigint, doc_id bigint, score bigint"
    )


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` highest-scoring documents of each item, scores above 0.

    Null and empty texts have no terms; such documents count nowhere and
    such items have no rows.  Every row of ``docs`` is a document of its own
    and every row of ``items`` a query of its own, repeated ids included.
    Equal scores are ranked by ascending doc_id, null last.  Other columns
    are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    queries = scratch.table(query_terms(items, item_col, item_text), "queries")
    size = queries.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_terms))
    found = None
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("no"), F.lit(blocks)) == b).select("no", "terms", "counts")
        rows = [(no, [bytes(t) for t in terms], counts) for no, terms, counts in block.collect()]
        part = _search_block(scratch, str(b), docs, rows, id_col, text_col, k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(queries.select("no", "item_id"), "no").select("item_id", "rank", "doc_id", "score")
