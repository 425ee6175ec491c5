"""Toxicity scores from a factorization machine over hashed terms.

    score = sigmoid(w0 + sum_i w_i + sum_{i<j} <v_i, v_j>)

over the distinct hashed terms of a text, so two terms that are harmless
apart can be toxic together.  The model is fitted on a bounded sample of
labelled rows and is a few MB whatever the input; scoring is one pass over
the texts without an exchange.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitepulse.llm.text import alnum_words, slices, utf8

#: Hashed terms.
BUCKETS = 1 << 20
#: Besides whole words, their first so many bytes are terms (stems of inflected words).
STEMS = (4, 5)
#: Dimension of the factors.
FACTORS = 4
#: Labelled rows the model is fitted on, at most (of each class those with the
#: smallest id hash; the smaller class gets up to half of the places).
SAMPLE = 16_000
EPOCHS = 8
BATCH = 200
#: Few rows are gone through more often, until so many batches are done.
LEAST_STEPS = 600
RATE = 0.1
#: Penalties of linear weights and factors.
DECAY_W = 2e-3
DECAY_V = 0.1
#: Rows of one class, whichever, that must hold a term before it gets weights: at
#: least this many, and at least this share (rarer terms only retell single texts).
LEAST_ROWS = 4
LEAST_SHARE = 1 / 400
#: Rows of either class that the calibration needs.
LEAST_CALIBRATION = 20


def terms(text) -> np.ndarray:
    """Sorted distinct hashed terms of a text."""
    found = set(alnum_words(utf8(text)))
    hashed = {zlib.crc32(w) & (BUCKETS - 1) for w in found}
    for n in STEMS:
        hashed |= {zlib.crc32(w, n) & (BUCKETS - 1) for w in {w[:n] for w in found if len(w) > n}}
    return np.array(sorted(hashed), dtype=np.int32)


class Machine:
    """Factorization machine; ``w`` (BUCKETS), ``v`` (BUCKETS x FACTORS), ``w0``.

    A score is the sigmoid of ``scale * margin + shift``.
    """

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray, scale: float = 1.0, shift: float = 0.0):
        self.w0, self.w, self.v, self.scale, self.shift = w0, w, v, scale, shift

    def margins(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores before the sigmoid; row r holds the terms flat[starts[r]:starts[r+1]]."""
        n = len(starts) - 1
        row = np.repeat(np.arange(n), np.diff(starts))
        live = self.w[flat] != 0
        row, flat = row[live], flat[live]
        out = self.w0 + np.bincount(row, weights=self.w[flat], minlength=n)
        for f in range(self.v.shape[1]):
            x = self.v[flat, f]
            s = np.bincount(row, weights=x, minlength=n)
            out += 0.5 * (s * s - np.bincount(row, weights=x * x, minlength=n))
        return out

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        starts = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
        flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margins(flat, starts) + self.shift, -30, 30)))

    def calibrate(self, rows: list[np.ndarray], y: np.ndarray, stand: tuple[float, float] = (1.0, 1.0)) -> Machine:
        """Fits scale and shift on rows that the weights have not seen (Platt's method, Newton steps).

        ``stand``: the labelled rows that a row of class 0, 1 stands for.
        Where the rows do not suffice, only the shift between the classes' shares is corrected.
        """
        self.shift = float(np.log(stand[1] / stand[0]))
        if min(y.sum(), len(y) - y.sum()) < LEAST_CALIBRATION:
            return self
        each = np.where(y == 1, stand[1], stand[0])
        pos, neg = each[y == 1].sum(), each[y != 1].sum()
        target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
        starts = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
        x = np.stack([self.margins(np.concatenate(rows), starts), np.ones(len(y))], axis=1)
        a = np.array([1.0, self.shift])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
            h = (x * (each * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
            a -= np.clip(np.linalg.solve(h, x.T @ (each * (p - target)) + 1e-3 * (a - [1, self.shift])), -1, 1)
        self.scale, self.shift = float(max(a[0], 1e-3)), float(a[1])
        return self


def fit(
    flat: np.ndarray,
    starts: np.ndarray,
    y: np.ndarray,
    epochs: int = EPOCHS,
    factors: int = FACTORS,
    seed: int = 7,
    least_rows: int = LEAST_ROWS,
    least_share: float = LEAST_SHARE,
) -> Machine:
    """Fits by mini-batch AdaGrad on the log loss.  Without both classes the score is the smoothed class share.

    Terms get weights that ``least_rows`` rows and a share of ``least_share`` of the rows of one class hold.
    """
    n = len(y)
    share = (y.sum() + 1) / (n + 2)
    w0 = float(np.log(share / (1 - share)))
    w, v = np.zeros(BUCKETS), np.zeros((BUCKETS, factors))
    row = np.repeat(np.arange(n), np.diff(starts))
    seen = np.zeros(BUCKETS, dtype=bool)
    for of in (y == 1, y != 1):
        seen |= np.bincount(flat[of[row]], minlength=BUCKETS) >= max(least_rows, least_share * of.sum())
    if not seen.any() or y.min() == y.max():
        return Machine(w0, w, v)
    row, flat = row[seen[flat]], flat[seen[flat]]
    names, flat = np.unique(flat, return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n))))
    rng = np.random.default_rng(seed)
    wl, vl = np.zeros(len(names)), rng.normal(0, 0.01, (len(names), factors))
    gw, gv, g0 = np.full(len(names), 1e-6), np.full(vl.shape, 1e-6), 1e-6
    for _ in range(max(epochs, -(-LEAST_STEPS * BATCH // n))):
        shuffled = rng.permutation(n)
        for lo in range(0, n, BATCH):
            rows = shuffled[lo : lo + BATCH]
            size = starts[rows + 1] - starts[rows]
            at = np.repeat(starts[rows] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            i, r = flat[at], np.repeat(np.arange(len(rows)), size)
            x = vl[i]
            s = np.stack([np.bincount(r, weights=x[:, f], minlength=len(rows)) for f in range(factors)], axis=1)
            q = np.stack([np.bincount(r, weights=x[:, f] ** 2, minlength=len(rows)) for f in range(factors)], axis=1)
            z = w0 + np.bincount(r, weights=wl[i], minlength=len(rows)) + 0.5 * (s * s - q).sum(axis=1)
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            used, where = np.unique(i, return_inverse=True)
            dw = np.bincount(where, weights=d[r]) + DECAY_W * wl[used]
            pair = d[r][:, None] * (s[r] - x)
            dv = np.stack([np.bincount(where, weights=pair[:, f]) for f in range(factors)], axis=1) + DECAY_V * vl[used]
            gw[used] += dw**2
            gv[used] += dv**2
            g0 += d.sum() ** 2
            wl[used] -= RATE * dw / np.sqrt(gw[used])
            vl[used] -= RATE * 0.3 * dv / np.sqrt(gv[used])
            w0 -= RATE * float(d.sum()) / np.sqrt(g0)
    w[names], v[names] = wl, vl
    return Machine(float(w0), w, v)


def fit_calibrated(rows: list[np.ndarray], y: np.ndarray, stand: tuple[float, float] = (1.0, 1.0), **kw) -> Machine:
    """Fits on four fifths of the rows and calibrates on the rest, if that is enough for it; ``stand`` as there."""
    part = np.arange(len(y)) % 5 == 4
    if min(y[part].sum(), (1 - y[part]).sum()) < LEAST_CALIBRATION:
        part[:] = False
    seen = [r for r, p in zip(rows, part) if not p]
    starts = np.concatenate(([0], np.cumsum([len(r) for r in seen]))).astype(np.int64)
    flat = np.concatenate(seen) if seen else np.zeros(0, dtype=np.int32)
    return fit(flat, starts, y[~part], **kw).calibrate([r for r, p in zip(rows, part) if p], y[part], stand)


def places(negative: int, positive: int, sample: int) -> tuple[int, int]:
    """Rows of each class in a sample: all if they fit, else the smaller class up to half, the other the rest."""
    n = min(positive, max(sample // 2, sample - negative))
    return min(negative, sample - n), n


def labelled_terms(
    rows: DataFrame, labels: DataFrame, sample: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[float, float]]:
    """(terms, starts, labels) of at most ``sample`` labelled rows, and how many a row of class 0, 1 stands for."""
    known = labels.groupBy(F.col("doc_id").alias("__id")).agg(F.max("y").alias("y"))
    toxic = F.col("y") == 1
    total = known.agg(F.count_if(~toxic), F.count_if(toxic)).first()
    taken = places(*total, sample)
    stand = tuple(float(a / b) if b else 1.0 for a, b in zip(total, taken))
    first = [known.filter(of).orderBy(F.xxhash64("__id"), "__id").limit(n) for of, n in zip((~toxic, toxic), taken)]
    chosen = first[0].unionByName(first[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [terms(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(found, pa.list_(pa.int32()))], ["y", "terms"])

    # at most `sample` rows of two numbers are broadcast; the texts stay where they are
    picked = rows.join(F.broadcast(chosen), rows["doc_id"] == F.col("__id"))
    # of rows with one id one is learned from, so the bound holds for rows as it does for ids
    picked = picked.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = picked.select("y", "text").mapInArrow(run, "y int, terms array<int>").toArrow()
    y = got["y"].to_numpy().astype(np.float64)
    cells = got["terms"].combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    cells = pa.concat_arrays(cells.chunks) if isinstance(cells, pa.ChunkedArray) else cells
    flat = cells.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum([len(x) for x in cells]))).astype(np.int64)
    return flat, starts, y, stand


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = 5,
    sample: int = SAMPLE,
    least_rows: int = LEAST_ROWS,
    least_share: float = LEAST_SHARE,
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Labels are learned only from rows whose crc32(id as text) mod ``folds``
    is not 0, and at most ``sample`` of them: where there are more, the rarer
    class keeps its rows up to half of them, and scores are corrected for
    the classes' shares among all labels.  Only the text decides a score;
    a null or empty text gets that of a text without terms.  Null labels
    are ignored, the larger of contradicting ones counts, rows without a
    label are scored like all others.  Without labels every score is 0.5.
    A null id is never learned from; it is not held out.  Of rows with one
    id that with the smallest text hash is learned from.  ``least_rows`` and
    ``least_share`` as for ``fit``.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == 0, F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held)
    flat, starts, y, stand = labelled_terms(rows, known, sample)
    # sorted, so that the fit does not depend on the order of arrival
    sample_rows = sorted((y[i], flat[starts[i] : starts[i + 1]].tobytes()) for i in range(len(y)))
    y = np.array([a for a, _ in sample_rows])
    none = Machine(0.0, np.zeros(BUCKETS), np.zeros((BUCKETS, FACTORS)))
    model = fit_calibrated([np.frombuffer(b, dtype=flat.dtype) for _, b in sample_rows], y, stand, least_rows=least_rows, least_share=least_share) if len(y) else none
    shared = spark.sparkContext.broadcast(
        (model.w0, model.w.astype(np.float32), model.v.astype(np.float32), model.scale, model.shift)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(*shared.value)
        for batch in slices(batches):
            score = machine.scores([terms(t) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", held.alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int"
    )
