"""Document quality by a linear-chain conditional random field over lines.

Each line of a text is good or bad. The chain's features are those of the line itself and of its two neighbours (shares of kinds of
characters, repeated words and lines, lengths), and the pair of states of adjacent lines. Forward and backward passes give each line's
probability of being good; their mean, weighted by the lines' lengths, becomes the document's score by a logistic curve.

Training takes at most SAMPLE labelled documents of each class with at most MAX_LINES lines; a document's label stands for its lines. Without
documents of both classes every score is 0.5. An empty or null text is one empty line. Rows are scored one by one, repeated ones too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siemloom.llm.training import labelled_sample
from siemloom.llm.words import U, Words, mix, pieces, small_batches

SAMPLE, MAX_LINES = 2000, 300
STEPS, RATE, DECAY = 120, 0.08, 1e-3

_KINDS = np.zeros((6, 256), bool)  # upper, lower or other letters, digits, usual marks, other symbols, white space
_KINDS[0, 65:91] = _KINDS[1, 97:123] = _KINDS[1, 128:] = _KINDS[2, 48:58] = True
_KINDS[3, [ord(c) for c in ".,;:'\"-?()"]] = True
_KINDS[5, [32, 9, 10, 11, 12, 13]] = True
_KINDS[4] = ~_KINDS.any(0)
FEATURES = 14


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x FEATURES), lines of each text, bytes of each line. A text has one line more than line breaks."""
    breaks = data == 10
    per_text = np.r_[0, np.cumsum(breaks)][offsets]
    counts = np.diff(per_text) + 1
    place = np.sort(np.r_[offsets[:-1], np.flatnonzero(breaks) + 1], kind="stable")  # lines' first bytes
    stop = np.r_[place[1:], len(data)]
    length = stop - place
    text = np.repeat(np.arange(len(counts)), counts)
    totals = [np.r_[0, np.cumsum(k[data], dtype=np.int64)] for k in _KINDS]
    shares = [(t[stop] - t[place]) / np.maximum(length, 1) for t in totals]
    words = Words(data, offsets)
    h = words.hashes
    line = np.searchsorted(place, words.starts, "right") - 1
    n = np.bincount(line, minlength=len(place))
    first = np.r_[0, np.cumsum(n)]
    again = np.r_[False, (h[1:] == h[:-1]) & (line[1:] == line[:-1])] if len(h) else np.zeros(0, bool)
    repeated = np.bincount(line, again, len(place))
    distinct = np.unique(mix(h ^ mix(line.astype(U) + U(1))), return_index=True)[1]
    kinds = np.bincount(line[distinct], minlength=len(place))
    inside = np.arange(len(h)) - first[line]
    sums = np.r_[np.zeros(1, U), np.cumsum(mix(h + inside.astype(U) * U(0x9E3779B97F4A7C15)))]
    whole = sums[first[1:]] - sums[first[:-1]]  # hash of the line's words
    key = mix(whole ^ mix(text.astype(U) + U(3)))
    same = np.unique(key, return_index=True, return_inverse=True)
    copied = (same[1][same[2]] != np.arange(len(key))) & (n > 0)
    size = np.log1p(length) / 5
    some = np.maximum(n, 1)
    ends = stop - 1 - (np.r_[breaks, False][stop - 1] if len(data) else 0)
    last = data[np.clip(ends, 0, max(0, len(data) - 1))] if len(data) else np.zeros(len(place), np.uint8)
    x = np.stack([*shares[:5], repeated / some, 1 - kinds / some, copied, size, n == 0, np.log1p(n) / 4,
                  (length - n) / some / 10, (last == ord(".")) & (length > 0), np.ones(len(place))], 1)
    return x.astype(np.float32), counts, length


def with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    first = np.cumsum(counts) - counts
    before, after = np.roll(x, 1, 0), np.roll(x, -1, 0)
    before[first] = 0
    after[np.cumsum(counts) - 1] = 0
    return np.concatenate([x, before, after], 1)


def marginals(scores: np.ndarray, counts: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of state 1 at each line, and the expected pairs of states (2 x 2) of all chains.

    scores: score of state 1 over state 0 by line; move: scores of (state, next state). Chains advance side by side, longest first.
    """
    order = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[order]
    lengths = counts[order]
    weight = np.exp(move - move.max())
    potential = np.stack([np.ones_like(scores), np.exp(np.clip(scores, -30, 30))], 1)
    forward, backward = np.zeros_like(potential), np.ones_like(potential)
    most = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(most), "left")  # chains longer than t
    for t in range(most):
        at = first[:alive[t]] + t
        p = potential[at] if t == 0 else (forward[at - 1] @ weight) * potential[at]
        forward[at] = p / p.sum(1, keepdims=True)
    for t in range(most - 2, -1, -1):
        at = first[:alive[t + 1]] + t
        p = (potential[at + 1] * backward[at + 1]) @ weight.T
        backward[at] = p / p.sum(1, keepdims=True)
    both = forward * backward
    both /= both.sum(1, keepdims=True)
    inner = np.ones(len(scores), bool)
    inner[np.cumsum(counts) - 1] = False
    at = np.flatnonzero(inner)
    pairs = forward[at][:, :, None] * weight[None] * (potential[at + 1] * backward[at + 1])[:, None, :]
    pairs /= pairs.sum((1, 2), keepdims=True)
    return both[:, 1], pairs.sum(0)


class Model:
    def __init__(self, w: np.ndarray, move: np.ndarray, curve: tuple[float, float]) -> None:
        self.w, self.move, self.curve = w, move, curve

    def document(self, x: np.ndarray, counts: np.ndarray, length: np.ndarray) -> np.ndarray:
        good, _ = marginals(with_neighbours(x, counts) @ self.w, counts, self.move)
        text = np.repeat(np.arange(len(counts)), counts)
        weight = length + 1.0
        return np.bincount(text, good * weight, len(counts)) / np.bincount(text, weight, len(counts))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        mean = np.clip(self.document(*line_features(data, offsets)), 1e-4, 1 - 1e-4)
        a, b = self.curve
        return 1 / (1 + np.exp(-(a * np.log(mean / (1 - mean)) + b)))


def fit(x: np.ndarray, counts: np.ndarray, length: np.ndarray, y: np.ndarray) -> Model | None:
    """Gradient ascent (Adam) of the conditional likelihood, classes weighted alike."""
    if len(np.unique(y)) < 2:
        return None
    full = with_neighbours(x, counts).astype(np.float64)
    text = np.repeat(np.arange(len(counts)), counts)
    truth = y[text].astype(np.float64)
    inner = text[:-1] == text[1:] if len(text) else np.zeros(0, bool)
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (truth[:-1][inner].astype(int), truth[1:][inner].astype(int)), 1)
    weight = np.sqrt(length + 1.0)
    weight /= np.bincount(text, weight, len(counts))[text]  # each document counts alike
    weight *= np.where(truth > 0, 1 / max(1, (y == 1).sum()), 1 / max(1, (y == 0).sum()))
    p = np.zeros(full.shape[1] + 4)
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, STEPS + 1):
        w, move = p[:-4], p[-4:].reshape(2, 2)
        good, expected = marginals(full @ w, counts, move)
        grad = np.r_[full.T @ ((truth - good) * weight), ((pairs - expected) / max(1, inner.sum())).ravel()] - DECAY * p
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        p = p + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = Model(p[:-4].astype(np.float32), p[-4:].reshape(2, 2), (1.0, 0.0))
    mean = np.clip(model.document(x, counts, length), 1e-4, 1 - 1e-4)
    z, a, b = np.log(mean / (1 - mean)), 1.0, 0.0
    for _ in range(500):  # the curve: logistic regression on one number, classes weighted alike
        e = (y - 1 / (1 + np.exp(-(a * z + b)))) / np.where(y == 1, (y == 1).sum(), (y == 0).sum())
        a, b = a + 0.3 * ((e * z).sum() - 0.002 * (a - 1)), b + 0.3 * (e.sum() - 0.002 * b)
    model.curve = float(a), float(b)
    return model


def train(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality") -> Model | None:
    small_batches(docs.sparkSession)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for first, after, data, offsets in pieces(batch.column("text")):
                x, counts, length = line_features(data, offsets)
                cut = np.r_[0, np.cumsum(counts)]
                out += [(batch.column("doc_id")[first + i].as_py(), batch.column("y")[first + i].as_py(), x[cut[i]:cut[i + 1]].tobytes(), length[cut[i]:cut[i + 1]].astype(np.int64).tobytes())
                        for i in range(after - first) if counts[i] <= MAX_LINES]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["doc_id", "y", "x", "length"])

    sample = labelled_sample(docs, labels, label, held_out, SAMPLE).withColumn("y", F.col("y").cast("int"))
    rows = sorted(sample.mapInArrow(features, "doc_id long, y int, x binary, length binary").collect())
    if not rows:
        return None
    x = [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in rows]
    return fit(np.concatenate(x), np.array([len(a) for a in x]), np.concatenate([np.frombuffer(r.length, np.int64) for r in rows]), np.array([r.y for r in rows]))


def with_score(docs: DataFrame, model: Model | None, column: str = "quality_score", least: float | None = None) -> DataFrame:
    """The documents, all columns, and their score; only those with `least` or more if it is given (then without the score)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(data, offsets) if model else np.full(len(offsets) - 1, 0.5) for _, _, data, offsets in pieces(batch.column(batch.schema.get_field_index("text")))]
            score = np.concatenate(found) if found else np.zeros(0)
            if least is not None:
                yield batch.filter(pa.array(score >= least))
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, column])

    if least is not None:
        return docs.mapInArrow(run, docs.schema)
    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(column, DoubleType())]))
