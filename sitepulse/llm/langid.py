"""Language identification by segmentation-marginalised unigram models.

The pieces are a fixed public vocabulary of byte strings.  Every language
has a probability per piece; the probability of a word (with the space
before it) is the sum over all its segmentations into pieces, computed by
the forward algorithm, and a text's is the product over its words.  The
probabilities are fitted by expectation-maximisation (forward-backward) on
word counts of a bounded sample of labelled documents.  Short words go
through the recursion together; long ones (unspaced scripts write whole
paragraphs as one word) in logarithms and in portions, each of which takes
over as many positions from the one before as the longest piece has bytes.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitepulse.llm.storage import forget, worker_cache
from sitepulse.llm.text import alnum_words, slices, utf8

#: Labelled documents the model is fitted on, at most: an equal share of each
#: language, those with the smallest id hash.
SAMPLE = 4000
#: Languages that are learned, at most (the most frequent ones of the labelled rows).
MAX_LANGS = 64
#: Different words per language that the fit goes through (the most frequent of the sample).
FIT_WORDS = 20_000
ROUNDS = 4
#: Counts that every piece gets in every language; more for single bytes.
SMOOTH, SMOOTH_BYTE = 0.01, 0.5
#: Bytes of a word (with its space) up to which plain probabilities are used: 50,000 pieces cannot underflow there.
SHORT = 32
#: Longer words than this are not fitted on (they are scored whole like all others).
FIT_BYTES = 1 << 16
#: Positions of a long word in one portion, and position x word pairs in memory.
PORTION, CELLS = 1 << 11, 1 << 17
#: Words whose scores a Python worker remembers.
MEMORY = 200_000


def read_pieces(path: str) -> list[bytes]:
    """The byte strings of a rank file (a few MB, read on the driver); all single bytes are added."""
    with open(path, "rb") as f:
        return with_bytes([base64.b64decode(line.split()[0]) for line in f if line.strip()])


def with_bytes(pieces: list[bytes]) -> list[bytes]:
    """The pieces and all single bytes, so that every word has a segmentation."""
    known = set(pieces)
    return pieces + [bytes([b]) for b in range(256) if bytes([b]) not in known]


def lettered(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def together(words: list[bytes], cells: int, most: int) -> Iterator[list[int]]:
    """Places of the words in groups of like length: at most ``most`` words and about ``cells`` positions each."""
    group: list[int] = []
    for i in sorted(range(len(words)), key=lambda i: len(words[i])):
        if group and (len(group) == most or (len(group) + 1) * len(words[i]) > cells):
            yield group
            group = []
        group.append(i)
    if group:
        yield group


class Trie:
    """The pieces as a tree of bytes: node and next byte -> node, found by binary search in sorted keys."""

    def __init__(self, pieces: list[bytes]):
        nodes = {b"": 0}
        for p in pieces:
            for i in range(1, len(p) + 1):
                nodes.setdefault(p[:i], len(nodes))
        keys = np.array([nodes[q[:-1]] << 8 | q[-1] for q in nodes if q] or [-1], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], (order + 1).astype(np.int64)
        self.longest = max(map(len, pieces), default=0)
        self.piece = np.full(len(nodes), -1, dtype=np.int64)
        self.piece[[nodes[p] for p in pieces]] = np.arange(len(pieces))


class Lattice:
    """All ways to cut words into pieces: arcs (word, start, end, piece), sorted by end and word."""

    def __init__(self, words: list[bytes], trie: Trie):
        self.size = np.array([len(w) for w in words], dtype=np.int64)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        first = np.concatenate(([0], np.cumsum(self.size)))
        # all starts of all words walk down the tree together
        word = np.repeat(np.arange(len(words)), self.size)
        at = np.arange(len(flat))
        start, node, found = at - first[word], np.zeros(len(flat), dtype=np.int64), []
        while len(at):
            key = node << 8 | flat[at]
            i = np.minimum(np.searchsorted(trie.keys, key), len(trie.keys) - 1)
            on = trie.keys[i] == key
            word, start, at, node = word[on], start[on], at[on] + 1, trie.child[i[on]]
            piece = trie.piece[node]
            arc = piece >= 0
            found.append((word[arc], start[arc], at[arc] - first[word[arc]], piece[arc]))
            on = at < first[word + 1]
            word, start, at, node = word[on], start[on], at[on], node[on]
        word, start, end, piece = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 4
        order = np.argsort(end * (len(words) + 1) + word)
        self.word, self.start, self.end, self.piece = word[order], start[order], end[order], piece[order]
        self.longest = int(self.size.max(initial=0))
        self.cuts = np.searchsorted(self.end, np.arange(self.longest + 2))

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """alpha[word, position, language]; ``prob`` is pieces x languages."""
        alpha = np.zeros((len(self.size), self.longest + 1, prob.shape[1]))
        alpha[:, 0] = 1
        for e in range(1, self.longest + 1):
            arcs = slice(self.cuts[e], self.cuts[e + 1])
            w = self.word[arcs]
            x = alpha[w, self.start[arcs]] * prob[self.piece[arcs]]
            if len(w):  # arcs of one end are sorted by word
                first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
                alpha[w[first], e] = np.add.reduceat(x, first, axis=0)
        return alpha

    def log_forward(self, log: np.ndarray, alpha: np.ndarray, done: int = 0) -> np.ndarray:
        """``forward`` in logarithms; positions up to ``done`` are given in ``alpha``."""
        for e in range(done + 1, self.longest + 1):
            arcs = slice(self.cuts[e], self.cuts[e + 1])
            w = self.word[arcs]
            if len(w):
                x = alpha[w, self.start[arcs]] + log[self.piece[arcs]]
                first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
                alpha[w[first], e] = np.logaddexp.reduceat(x, first, axis=0)
        return alpha

    def log_expected(self, log: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """``expected`` in logarithms, for words too long for plain probabilities."""
        alpha = np.full((len(self.size), self.longest + 1, log.shape[1]), -np.inf)
        alpha[:, 0] = 0
        self.log_forward(log, alpha)
        rows = np.arange(len(self.size))
        total = alpha[rows, self.size]
        beta = np.full_like(alpha, -np.inf)
        beta[rows, self.size] = 0
        out = np.zeros_like(log)
        for e in range(self.longest, 0, -1):
            arcs = slice(self.cuts[e], self.cuts[e + 1])
            w, s, p = self.word[arcs], self.start[arcs], self.piece[arcs]
            back = beta[w, e] + log[p]
            np.add.at(out, p, np.exp(alpha[w, s] + back - total[w]) * counts[w])
            beta[w, s] = np.logaddexp(beta[w, s], back)  # one arc per word and start has this end
        return out

    def log_prob(self, prob: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language, all segmentations summed."""
        alpha = self.forward(prob)
        return np.log(alpha[np.arange(len(self.size)), self.size])

    def expected(self, prob: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of every piece per language, words weighted by ``counts`` (words x languages)."""
        alpha = self.forward(prob)
        beta = np.zeros_like(alpha)
        rows = np.arange(len(self.size))
        total = alpha[rows, self.size]
        beta[rows, self.size] = counts / total
        out = np.zeros_like(prob)
        for e in range(self.longest, 0, -1):
            arcs = slice(self.cuts[e], self.cuts[e + 1])
            w, s, p = self.word[arcs], self.start[arcs], self.piece[arcs]
            back = beta[w, e] * prob[p]
            for k in range(prob.shape[1]):
                out[:, k] += np.bincount(p, weights=alpha[w, s, k] * back[:, k], minlength=len(prob))
                np.add.at(beta[:, :, k], (w, s), back[:, k])
        return out


def long_log_prob(words: list[bytes], trie: Trie, log: np.ndarray, portion: int = PORTION) -> np.ndarray:
    """Log probabilities of whole long words, all segmentations summed.

    A portion's lattice starts ``longest`` positions early: no piece that
    ends in the portion starts before.  So memory follows the portion.
    """
    size = np.array([len(w) for w in words])
    out = np.zeros((len(words), log.shape[1]))
    back = trie.longest
    carried = None
    whole = int(size.max(initial=0))
    for base in range(0, whole, portion):
        lo, width = max(0, base - back), min(portion, whole - base)
        lattice = Lattice([w[lo : base + width] for w in words], trie)
        alpha = np.full((len(words), base - lo + width + 1, log.shape[1]), -np.inf)
        if carried is None:
            alpha[:, 0] = 0
        else:
            alpha[:, : base - lo + 1] = carried
        lattice.log_forward(log, alpha, base - lo)
        ends = (size > base) & (size <= base + width)
        out[ends] = alpha[ends, size[ends] - lo]
        keep = min(back, base + width)
        carried = alpha[:, base - lo + width - keep :]
    return out


class Model:
    """Piece probabilities of the languages."""

    def __init__(self, langs: list[str], pieces: list[bytes], prob: np.ndarray):
        self.langs, self.pieces, self.prob = langs, pieces, prob
        self.log = np.log(prob)
        self.trie = Trie(pieces)
        self.memory: dict[bytes, int] = {}  # word -> row of known
        self.known = np.zeros((1024, len(langs)))
        self.again: set[bytes] = set()  # words met again since the memory was last full

    def learn_words(self, words: set[bytes]) -> None:
        """Scores words not yet in memory.  A full memory forgets the words met only once, or else all."""
        met = words & self.memory.keys()
        self.again |= met
        if len(self.memory) + len(words) - len(met) > MEMORY:
            keep = list(self.again) if len(self.again) + len(words) <= MEMORY else []
            self.known[: len(keep)] = self.known[[self.memory[w] for w in keep]]
            self.memory, self.again = {w: i for i, w in enumerate(keep)}, set()
        fresh = [w for w in words if w not in self.memory]
        base = len(self.memory)
        if base + len(fresh) > len(self.known):
            room = np.zeros((2 * (base + len(fresh)), len(self.langs)))
            room[:base] = self.known[:base]
            self.known = room
        short = [i for i, w in enumerate(fresh) if len(w) < SHORT]
        for lo in range(0, len(short), 4096):
            part = short[lo : lo + 4096]
            lattice = Lattice([b" " + fresh[i] for i in part], self.trie)
            self.known[base + np.array(part)] = lattice.log_prob(self.prob)
        long = [i for i, w in enumerate(fresh) if len(w) >= SHORT]
        for group in together([fresh[i][:PORTION] for i in long], CELLS, 4096):
            part = [long[i] for i in group]
            self.known[base + np.array(part)] = long_log_prob([b" " + fresh[i] for i in part], self.trie, self.log)
        self.memory.update((w, base + i) for i, w in enumerate(fresh))

    def predict(self, texts: list) -> list[tuple[str, float]]:
        """(language, posterior under equal priors) of each text; ('und', 0) without a letter."""
        found = [alnum_words(utf8(t)) if lettered(t) else None for t in texts]
        out, lo = [], 0
        while lo < len(found):  # portions whose different words fit the memory
            hi, words = lo, set()
            while hi < len(found) and (hi == lo or len(words) < MEMORY // 4):
                words.update(found[hi] or ())
                hi += 1
            self.learn_words(words)
            for ws in found[lo:hi]:
                if not ws or not self.langs:
                    out.append(("und", 0.0))
                    continue
                total = self.known[np.fromiter(map(self.memory.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
                best = int(total.argmax())
                out.append((self.langs[best], float(1 / np.exp(total - total[best]).sum())))
            lo = hi
        return out


def fit(counts: list[tuple[str, bytes, int]], pieces: list[bytes], rounds: int = ROUNDS, words: int = FIT_WORDS) -> Model:
    """Fits piece probabilities on (language, word, count) rows; single bytes that are no pieces are added."""
    pieces = with_bytes(pieces)
    langs = sorted({a for a, _, _ in counts})
    if not langs:
        return Model([], pieces, np.zeros((len(pieces), 0)))
    column = {a: i for i, a in enumerate(langs)}
    top: dict[str, list] = {a: [] for a in langs}
    for a, w, n in sorted(counts, key=lambda x: (-x[2], x[1], x[0])):
        if len(top[a]) < words:
            top[a].append((w, n))
    table: dict[bytes, np.ndarray] = {}
    for a, rows in top.items():
        for w, n in rows:
            if len(w) < FIT_BYTES:
                table.setdefault(b" " + w, np.zeros(len(langs)))[column[a]] += n
    trie = Trie(pieces)
    found = sorted(table, key=len)
    weight = np.array([table[w] for w in found]).reshape(-1, len(langs))
    n_short = sum(len(w) <= SHORT for w in found)
    base = np.where(np.array([len(p) == 1 for p in pieces])[:, None], SMOOTH_BYTE, SMOOTH)
    prob = np.ones((len(pieces), len(langs))) / len(pieces)
    cuts = [*range(0, n_short, 8192), n_short]
    short = [(Lattice(found[i:j], trie), weight[i:j]) for i, j in zip(cuts, cuts[1:])]
    groups = [np.array(g) + n_short for g in together(found[n_short:], CELLS, 4096)]
    for _ in range(rounds):
        used = sum((lat.expected(prob, n) for lat, n in short), np.zeros_like(prob)) + base
        for g in groups:
            used += Lattice([found[i] for i in g], trie).log_expected(np.log(prob), weight[g])
        prob = used / used.sum(axis=0)
    return Model(langs, pieces, prob)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[tuple, int] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            for w in alnum_words(utf8(text.as_py())):
                counts[lang, w] = counts.get((lang, w), 0) + 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([a for a, _ in counts], pa.string()),
                pa.array([w for _, w in counts], pa.binary()),
                pa.array(list(counts.values()), pa.int64()),
            ],
            ["lang", "word", "n"],
        )


def train(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 5,
    sample: int = SAMPLE,
    fit_words: int = FIT_WORDS,
    max_langs: int = MAX_LANGS,
) -> Model:
    """Fits on rows with a letter and a language whose crc32(id as text) mod ``folds`` is not 0.

    At most ``sample`` rows, an equal share for each of the at most
    ``max_langs`` most frequent languages, and of their words the
    ``fit_words`` most frequent of each language reach the driver; repeated
    rows with one id and text count once.
    """
    known = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), folds))
    known = known.where(F.col("text").rlike("\\p{L}"))
    kinds = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs)
    langs = [r["lang"] for r in kinds.collect()]
    if not langs:
        return fit([], read_pieces(path))
    slim = known.where(F.col("lang").isin(langs)).select("lang", "doc_id", F.xxhash64("text").alias("t"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "t")
    chosen = slim.withColumn("place", F.row_number().over(first)).where(F.col("place") <= max(1, sample // len(langs)))
    chosen = chosen.select("lang", F.col("doc_id").alias("__id"), F.col("t").alias("__t")).distinct()
    # at most `sample` rows are broadcast
    here = (F.col("d.doc_id") == F.col("__id")) & (F.xxhash64("d.text") == F.col("__t")) & (F.col("d.lang") == F.col("c.lang"))
    picked = known.alias("d").join(F.broadcast(chosen).alias("c"), here, "left_semi").dropDuplicates(["doc_id", "text", "lang"])
    counted = picked.select("lang", "text").mapInArrow(_word_counts, "lang string, word binary, n long")
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    summed = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found = summed.withColumn("place", F.row_number().over(top)).where(F.col("place") <= fit_words).toArrow()
    counts = list(zip(*(found[c].to_pylist() for c in ("lang", "word", "n"))))
    return fit(counts, read_pieces(path), words=fit_words)


def held_out(doc_id: Column, folds: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == 0, F.lit(False))


def _on_worker(model: Model):
    """A function that gives the model on the executors; a worker builds it once and keeps its memory of words."""
    shared, token = (model.langs, model.pieces, model.prob), uuid.uuid4().hex

    def get(value) -> Model:
        cache = worker_cache()
        if cache.get("langid_token") != token:
            forget(cache)
            cache["langid"], cache["langid_token"] = Model(*value), token
        return cache["langid"]

    return shared, get


def identify(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 5,
    **kw,
) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``.

    Learns as ``train``; a null id is never learned from and not held out.
    Only the text decides a prediction.  Null texts, texts without a letter,
    and all texts where there is nothing to learn from are 'und' with score
    0.  Repeated rows each get a row; other columns are not read.
    """
    model = train(docs, path, id_col, text_col, lang_col, folds, **kw)
    value, on_worker = _on_worker(model)
    shared = docs.sparkSession.sparkContext.broadcast(value)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        held_out(F.col(id_col), folds).alias("held_out"),
        F.col(text_col).cast("string").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = on_worker(shared.value)
        for batch in slices(batches):
            found = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array([a for a, _ in found], pa.string()),
                    pa.array([s for _, s in found], pa.float64()),
                ],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(
    docs: DataFrame, path: str, text_col: str = "text", least_score: float = 0.0, wanted: set[str] | None = None, **kw
) -> DataFrame:
    """``docs`` whose texts have a letter, and a language of at least ``least_score`` and among ``wanted`` if given.

    Where there is nothing to learn from, every text with a letter stays; to
    ask for a score or for languages is an error then.  All columns stay as
    they are; one pass over the texts, no exchange.
    """
    model = train(docs, path, text_col=text_col, **kw)
    if not model.langs and (least_score > 0 or wanted is not None):
        raise ValueError("least_score and wanted need rows with a language to learn from")
    value, on_worker = _on_worker(model)
    shared = docs.sparkSession.sparkContext.broadcast(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = on_worker(shared.value)
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            found = zip(texts, model.predict(texts))
            keep = [lettered(t) and s >= least_score and (wanted is None or a in wanted) for t, (a, s) in found]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
