"""Benchmark decontamination with a generalised suffix automaton.

The benchmark's normalised items are cut into pieces, equal pieces are kept
once with the ids of their items beside them, and bounded blocks of pieces
become one automaton each, built on the executors.  One automaton at a time
is handed to the tasks.  Documents are streamed through it: after each
word the automaton holds the longest suffix that occurs in some item.  A
match of at least ``window`` words covers windows; its words form a span.
Items shorter than the window match as a whole only.
"""

from __future__ import annotations

import itertools
import pickle
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitepulse.llm.storage import Scratch, free_names
from sitepulse.llm.text import ALNUM, alnum_words, slices, utf8

WINDOW = 10
#: Words of items in one automaton.  It bounds what a task holds and what is
#: broadcast (about 100 bytes a word); a larger benchmark is cut into blocks.
BLOCK_WORDS = 200_000
#: Longer items are cut into pieces that overlap by a window less one word,
#: which keeps every window.
PIECE_WORDS = 4096


class SuffixAutomaton:
    """All substrings of a set of word sequences."""

    def __init__(self, window: int):
        self.window, self.vocab = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        self.items: list[set] = [set()]
        self.whole: list[list] = [[]]

    def _state(self, length: int, link: int, following: dict, items=()) -> int:
        self.next.append(following), self.link.append(link), self.length.append(length)
        self.items.append(set(items)), self.whole.append([])
        return len(self.length) - 1

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            if self.length[q] == self.length[last] + 1:
                return q
            return self._clone(last, w, q)
        cur = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), self.items[q])
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        self.link[q] = c
        return c

    def build(self, sequences: list[tuple[object, list[bytes], bool]]) -> SuffixAutomaton:
        """sequences: (item, words, whether the words are a whole item).  Item None has spans, but is not listed."""
        coded = [(i, [self.vocab.setdefault(w, len(self.vocab)) for w in ws], whole) for i, ws, whole in sequences]
        for _, ws, _ in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        for item, ws, whole in coded:  # a state occurs in an item if a prefix of the item leads into its subtree
            s = 0
            for w in ws:
                s = p = self.next[s][w]
                while p > 0 and item not in self.items[p]:
                    self.items[p].add(item)
                    p = self.link[p]
            if whole and 0 < len(ws) < self.window:
                self.whole[s].append((len(ws), item))
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        self.anchor = [-1] * len(self.length)  # the state of the match's last `window` words
        for s in order:
            self.whole[s] = self.whole[s] + self.whole[self.link[s]]
            if self.length[s] >= self.window:
                self.anchor[s] = s if self.length[self.link[s]] < self.window else self.anchor[self.link[s]]
        keep = {a for a in self.anchor if a >= 0}
        self.items = [frozenset(x) if s in keep else None for s, x in enumerate(self.items)]
        self.least = min([self.window, *(len(ws) for _, ws, whole in coded if whole and ws)])
        return self

    def spans(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans of words (start, end) covered by occurring windows, merged where they touch or overlap; the items."""
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in found), dtype=np.int64, count=len(found))
        known = np.concatenate(([0], (ids >= 0).astype(np.int8), [0]))
        edge = np.diff(known)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        out: list[tuple[int, int]] = []
        items: set = set()
        for lo, hi in zip(starts.tolist(), ends.tolist()):
            if hi - lo >= self.least:
                self._run(ids[lo:hi].tolist(), lo, out, items)
        items.discard(None)
        return out, items

    def _run(self, ids: list[int], base: int, out: list, items: set) -> None:
        following, link, length = self.next, self.link, self.length
        s = n = 0
        for i, w in enumerate(ids):
            while s and w not in following[s]:
                s = link[s]
                n = length[s]
            if w in following[s]:
                s, n = following[s][w], n + 1
            hit = 0
            if n >= self.window:
                # n can be below the state's own length, never below its link's
                items |= self.items[self.anchor[s]]
                hit = n
            for k, item in self.whole[s]:
                if k <= n:
                    items.add(item)
                    hit = max(hit, k)
            if hit:
                lo, hi = base + i + 1 - hit, base + i + 1
                while out and lo <= out[-1][1]:
                    lo = min(lo, out.pop()[0])
                out.append((lo, hi))


def _build(window: int):
    def run(table: pa.Table) -> pa.Table:
        rows = enumerate(zip(table["piece"].to_pylist(), table["whole"].to_pylist()))
        sam = SuffixAutomaton(window).build([(i, p.encode().split(b" "), w) for i, (p, w) in rows])
        blob = pickle.dumps((sam.__dict__, table["ids"].to_pylist()))
        return pa.table({"block": table["block"].slice(0, 1), "blob": pa.array([blob], pa.binary())})

    return run


def _pieces(window: int, piece_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            item, piece, whole, n = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ws = alnum_words(utf8(text))
                for lo in range(0, max(1, len(ws) - window + 1) if ws else 0, piece_words):
                    part = ws[lo : lo + piece_words + window - 1]
                    item.append(i), piece.append(b" ".join(part).decode()), n.append(len(part))
                    whole.append(len(part) == len(ws))
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.string()), pa.array(piece, pa.string()), pa.array(whole, pa.bool_()), pa.array(n, pa.int64())],
                ["item", "piece", "whole", "n"],
            )

    return run


def automata(
    benchmark: DataFrame,
    scratch: Scratch,
    item_col: str = "item_id",
    text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    piece_words: int = PIECE_WORDS,
) -> tuple[list[int], Iterator[bytes]]:
    """The blocks' numbers, and one pickled automaton after the other, for at most about ``block_words`` words each."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    cut = items.mapInArrow(_pieces(window, piece_words), "item string, piece string, whole boolean, n long")
    pieces = scratch.table(
        cut.groupBy("piece", "whole").agg(F.max("n").alias("n"), F.collect_set("item").alias("ids")), "pieces"
    )
    total = pieces.agg(F.coalesce(F.sum(F.col("n") + F.size("ids")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_words))
    scratch.table(
        pieces.withColumn("block", F.pmod(F.xxhash64("piece"), F.lit(blocks)))
        .groupBy("block")
        .applyInArrow(_build(window), "block long, blob binary"),
        "automata",
    )
    return _again(scratch, None)


def _again(scratch: Scratch, names: list[int] | None) -> tuple[list[int], Iterator[bytes]]:
    """The written automata; one bounded automaton at a time passes the driver on its way to the tasks."""
    built = scratch.spark.read.parquet(f"{scratch.path}/automata")
    if names is None:
        names = [r[0] for r in built.select("block").orderBy("block").collect()]
    return names, (bytes(built.filter(F.col("block") == b).first()["blob"]) for b in names)


def _load(blob: bytes) -> tuple[SuffixAutomaton, list[list[str]]]:
    """The automaton and the item ids of each piece."""
    sam = SuffixAutomaton.__new__(SuffixAutomaton)
    state, ids = pickle.loads(blob)
    sam.__dict__.update(state)
    return sam, ids


def _scan(blob, key: str, only_hits: bool):
    """key, n_words, spans, items of the rows (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sam, ids = _load(blob.value)
        for batch in slices(batches):
            n, spans, items = [], [], []
            for text in batch.column("text").to_pylist():
                ws = alnum_words(utf8(text))
                s, pieces = sam.spans(ws)
                n.append(len(ws))
                spans.append([x for pair in s for x in pair])
                items.append(sorted({i for p in pieces for i in ids[p]}))
            out = pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    pa.array(n, pa.int64()),
                    pa.array(spans, pa.list_(pa.int32())),
                    pa.array(items, pa.list_(pa.string())),
                ],
                [key, "n_words", "spans", "items"],
            )
            yield out.filter(pa.array([bool(x) for x in spans], pa.bool_())) if only_hits else out

    return run


def merged(flat: list[int]) -> list[list[int]]:
    """Spans (start, end, start, end, ...) in order, joined where they touch or overlap."""
    out: list[list[int]] = []
    for lo, hi in sorted(zip(flat[::2], flat[1::2])):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def _hits(rows: DataFrame, blobs: Iterator[bytes], scratch: Scratch, name: str) -> DataFrame:
    """r, spans (in any order), items of the rows (r, text) that an automaton hits.

    Each block is one pass whose hits are written; its automaton is let go before the next.
    """
    spark = rows.sparkSession
    found = spark.createDataFrame([], "r long, n_words long, spans array<int>, items array<string>")
    ddl = "r long, n_words long, spans array<int>, items array<string>"
    for i, blob in enumerate(blobs):
        shared = spark.sparkContext.broadcast(blob)
        hit = scratch.table(rows.select("r", "text").mapInArrow(_scan(shared, "r", True), ddl), f"{name}-{i}")
        shared.unpersist()
        found = found.unionByName(hit)
    return found.groupBy("r").agg(
        F.flatten(F.collect_list("spans")).alias("spans"),  # one entry per block that hits the row
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        spans = [[x for pair in merged(s or []) for x in pair] for s in batch.column("spans").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(alnum_words(utf8(t))) for t in batch.column("text").to_pylist()], pa.int64()),
                pa.array(spans, pa.list_(pa.int32())),
                pa.array([i or [] for i in batch.column("items").to_pylist()], pa.list_(pa.string())),
            ],
            ["doc_id", "n_words", "spans", "items"],
        )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """doc_id, n_words, n_hit, spans, items for every row of ``docs``.

    ``spans`` are word ranges (start, end, start, end, ...) covered by
    occurring windows, ``items`` the sorted ids of items with such a window,
    ``n_hit`` the words in spans.  Null and empty texts have no words and no
    hits; items whose text is null or empty match nothing; equal items all
    count.  An item without an id has spans, but is not in ``items``.  Rows
    repeated with one id and text get equal answers.  Other columns are not
    read.  An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontam")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, n_words long, spans array<int>, items array<string>"
    names, blobs = automata(benchmark, scratch, item_col, item_text_col, window, block_words)
    if len(names) == 1:
        found = rows.mapInArrow(_scan(spark.sparkContext.broadcast(next(blobs)), "doc_id", False), ddl)
    elif not names:
        none = {"spans": F.lit(None).cast("array<int>"), "items": F.lit(None).cast("array<string>")}
        found = rows.withColumns(none).mapInArrow(_finish, ddl)
    else:
        numbered = scratch.table(rows.withColumn("r", F.monotonically_increasing_id()), "rows")
        found = numbered.join(_hits(numbered, blobs, scratch, "hits"), "r", "left").mapInArrow(_finish, ddl)
    hit = F.expr("aggregate(transform(spans, (x, i) -> if(i % 2 = 1, x, -x)), 0L, (a, x) -> a + x)")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), "spans", "items")


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text: str, spans: list[int]) -> str:
    """``text`` without its word ranges ``spans``; a cut leaves one line break."""
    raw = utf8(text)
    at = [m.span() for m in _WORD.finditer(raw.translate(ALNUM))]
    out, last = [], 0
    for lo, hi in zip(spans[::2], spans[1::2]):
        out.append(raw[last : at[lo][0]])
        last = at[hi - 1][1]
    out.append(raw[last:])
    return b"\n".join(out).decode("utf-8", "surrogatepass")


class _Cut:
    """What becomes of one text: spans are cut until none is too long, or it goes for too many covered words."""

    def __init__(self, max_span: int, max_coverage: float):
        self.max_span, self.max_coverage = max_span, max_coverage

    def step(self, text: str, total: int, gone: int, spans: list) -> tuple[str, int, bool]:
        """The text after one round, the covered words so far, and whether another round is needed."""
        long = [s for s in spans if s[1] - s[0] > self.max_span]
        gone += sum(b - a for a, b in spans)
        if gone > self.max_coverage * total or not long:
            return text, gone, False
        return cut(text, [x for pair in long for x in pair]), gone, True

    def keeps(self, total: int, gone: int) -> bool:
        return not total or gone <= self.max_coverage * total


def _clean(blob, text_col: str, rule: _Cut):
    """All rounds at once, for a benchmark of one automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sam, _ = _load(blob.value)
        for batch in slices(batches):
            at = batch.schema.get_field_index(text_col)
            keep, texts = [], []
            for text in batch.column(at).to_pylist():
                total, gone, again = len(alnum_words(utf8(text))), 0, bool(text)
                while again and text:  # a cut may bring words together that form a window
                    text, gone, again = rule.step(text, total, gone, sam.spans(alnum_words(utf8(text)))[0])
                keep.append(rule.keeps(total, gone))
                texts.append(text)
            yield batch.set_column(at, text_col, pa.array(texts, pa.string())).filter(pa.array(keep, pa.bool_()))

    return run


def _round(rule: _Cut):
    """One round for rows whose spans were found by several automata."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for r, text, total, gone, spans in zip(*[c.to_pylist() for c in batch.columns]):
                if total is None:
                    total = len(alnum_words(utf8(text)))
                text, gone, again = rule.step(text, total, gone, merged(spans))
                out.append((r, text, total, gone, again and bool(text), rule.keeps(total, gone)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
            cols = zip(*out) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)], ["r", "text", "total", "gone", "again", "keep"]
            )

    return run


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_span: int = 0,
    max_coverage: float = 0.0,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` without benchmark passages, all columns kept.

    A document whose covered words exceed ``max_coverage`` of its words is
    removed; in the others every span of more than ``max_span`` words is cut
    out, again until none is left.  With the default limits every document
    that holds a window goes and clean documents stay untouched.  Null and
    empty texts stay.  The limits hold for the whole benchmark: spans of all
    blocks are merged before they are tested, round by round for the rows
    that were cut.
    """
    spark = docs.sparkSession
    scratch, rule = Scratch(spark, "decontam"), _Cut(max_span, max_coverage)
    names, blobs = automata(benchmark, scratch, item_col, item_text_col, window, block_words)
    rows = docs.withColumn(text_col, F.col(text_col).cast("string"))
    if not names:
        return rows
    if len(names) == 1:
        return rows.mapInArrow(_clean(spark.sparkContext.broadcast(next(blobs)), text_col, rule), rows.schema)
    number = free_names(docs, "r")["r"]
    rows = scratch.table(rows.withColumn(number, F.monotonically_increasing_id()), "rows")
    active = rows.select(
        F.col(number).alias("r"), F.col(text_col).alias("text"), F.lit(None).cast("long").alias("total"), F.lit(0).cast("long").alias("gone")
    )
    ended = []
    for i in itertools.count():
        found = _hits(active, blobs, scratch, f"round-{i}").select("r", "spans")
        ddl = "r long, text string, total long, gone long, again boolean, keep boolean"
        stepped = scratch.table(active.join(found, "r").mapInArrow(_round(rule), ddl), f"stepped-{i}")
        if i:  # rows that no automaton hits any more are done as they are
            rest = active.join(found, "r", "left_anti").withColumn("keep", F.lit(True))
            ended.append(scratch.table(rest.select("r", "text", "keep"), f"ended-{i}"))
        ended.append(stepped.where("NOT again").select("r", "text", "keep"))
        active = stepped.where("again").select("r", "text", "total", "gone")
        if active.isEmpty():
            break
        names, blobs = _again(scratch, names)
    changed = reduce(DataFrame.unionByName, ended).select("r", F.col("text").alias("changed"), "keep")
    names = free_names(docs, "r", "changed", "keep")
    changed = changed.toDF(names["r"], names["changed"], names["keep"])
    joined = rows.join(changed, names["r"], "left").where(F.coalesce(F.col(names["keep"]), F.lit(True)))
    text = F.when(F.col(names["keep"]).isNotNull(), F.col(names["changed"])).otherwise(F.col(text_col))
    return joined.withColumn(text_col, text).select(*docs.columns)
