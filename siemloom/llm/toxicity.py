"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as two vectors: that of the word itself, if it is one of the vocabulary, and the mean of those of its character trigrams. Over windows
of WINDOW words, one starting at every word, two gated recurrent layers run in both directions; attention weighs their states into one
vector, which becomes the window's score. All windows of a text are scored; the highest one is the text's, turned into a probability by a logistic
curve. A text of fewer words is one shorter window, an empty or null one has the lowest evidence.

Training takes at most SAMPLE labelled documents of each class of at most MAX_WORDS words each. Words of the vocabulary are those of at least MIN_DOCS of them. As only documents are
labelled, each round trains on the windows that score highest so far: one of a toxic document, several of a clean one. Without documents of both classes
every score is 0.25.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siemloom.llm.training import labelled_sample
from siemloom.llm.words import NON_ALNUM, U, Words, mix, pieces, small_batches, text_bytes

SAMPLE, MAX_WORDS, MIN_DOCS, MOST_VOCABULARY = 1000, 2000, 3, 20_000
WINDOW = 16
WORD, CHARS, HIDDEN, BUCKETS = 6, 6, 6, 4096
ROUNDS, PASSES, RATE = 3, 5, 0.02
_NEUTRAL = 0.25


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def trigrams(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character trigrams of chosen words (with one mark at both ends), and how many each has."""
    a, n = words.starts[chosen], (words.ends - words.starts)[chosen]
    first = np.cumsum(n) - n
    at = np.repeat(a - first, n) + np.arange(n.sum())
    own = np.repeat(np.arange(len(a)), n)
    inner = at - a[own]
    data = words.data.astype(U)
    left = np.where(inner > 0, data[at - 1], U(1))
    right = np.where(inner < n[own] - 1, data[np.minimum(at + 1, len(data) - 1)], U(2))
    key = mix(left << U(16) | data[at] << U(8) | right)
    return (key >> U(64 - 12)).astype(np.int64), n


class Windows:
    """Chosen windows by themselves: their words, and of the distinct ones the number in the vocabulary and the trigrams."""

    place: np.ndarray
    size: np.ndarray
    number: np.ndarray
    sizes: np.ndarray
    buckets: np.ndarray


class Texts:
    """Distinct words of a run of texts and the windows over them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray) -> None:
        words = Words(data, offsets, NON_ALNUM, lower=True)
        self.hashes, where, self.word = np.unique(words.hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(vocabulary, self.hashes), max(0, len(vocabulary) - 1))
        known = vocabulary[at] == self.hashes if len(vocabulary) else np.zeros(len(at), bool)
        self.number = np.where(known, at + 1, 0)
        self.buckets, self.sizes = trigrams(words, where) if len(where) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        # a window at every word; the last one ends with the text
        steps = np.maximum(1, words.counts - WINDOW + 1) * (words.counts > 0)
        self.doc = np.repeat(np.arange(len(words.counts)), steps)
        self.begin = words.first[:-1][self.doc] + np.arange(len(self.doc)) - np.repeat(np.cumsum(steps) - steps, steps)
        self.size = np.minimum(WINDOW, words.counts[self.doc])
        self.texts = len(words.counts)

    def place(self, some: np.ndarray) -> np.ndarray:
        """Words of some windows; a shorter one's last word fills it up."""
        return self.word[self.begin[some][:, None] + np.minimum(np.arange(WINDOW), self.size[some][:, None] - 1)]

    def part(self, some: np.ndarray) -> Windows:
        """Some of the windows, with only their words."""
        new = Windows()
        words, place = np.unique(self.place(some), return_inverse=True)
        new.place, new.size = place.reshape(len(some), WINDOW), self.size[some]
        new.number, new.sizes = self.number[words], self.sizes[words]
        first = (np.cumsum(self.sizes) - self.sizes)[words]
        inner = np.arange(new.sizes.sum()) - np.repeat(np.cumsum(new.sizes) - new.sizes, new.sizes)
        new.buckets = self.buckets[np.repeat(first, new.sizes) + inner]
        return new


class Network:
    def __init__(self, vocabulary: np.ndarray, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        normal = lambda *s, by: (r.standard_normal(s) * by).astype(np.float32)
        inputs = WORD + CHARS
        self.vocabulary, self.curve = vocabulary, (1.0, 0.0)
        self.p = {
            "word": normal(len(vocabulary) + 1, WORD, by=0.1), "chars": normal(BUCKETS, CHARS, by=0.1),
            "wx": normal(2, inputs, 3 * HIDDEN, by=inputs**-0.5), "wh": normal(2, HIDDEN, 3 * HIDDEN, by=HIDDEN**-0.5),
            "b": np.zeros((2, 3 * HIDDEN), np.float32), "wa": normal(2 * HIDDEN, by=0.3), "wo": normal(2 * HIDDEN, by=0.3),
            "bo": np.zeros(1, np.float32)}

    def inputs(self, t: Texts | Windows) -> np.ndarray:
        """Vector of every distinct word."""
        p = self.p
        if not len(t.number):
            return np.zeros((0, WORD + CHARS), np.float32)
        chars = np.add.reduceat(p["chars"][t.buckets], np.cumsum(t.sizes) - t.sizes) / np.maximum(t.sizes, 1)[:, None]
        return np.concatenate([p["word"][t.number], chars], 1).astype(np.float32)

    def run(self, gates: np.ndarray, place: np.ndarray, size: np.ndarray, keep: bool = False):
        """Scores of windows. gates: of every distinct word, for both directions."""
        p, n = self.p, len(place)
        states, kept = np.zeros((WINDOW, n, 2 * HIDDEN), np.float32), []
        for d in (0, 1):
            h, wh = np.zeros((n, HIDDEN), np.float32), p["wh"][d]
            for step in range(WINDOW):
                t = step if d == 0 else WINDOW - 1 - step
                on = (t < size)[:, None]
                g = gates[d][place[:, t]]
                zr = 1 / (1 + np.exp(-(g[:, :2 * HIDDEN] + h @ wh[:, :2 * HIDDEN])))
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(g[:, 2 * HIDDEN:] + (r * h) @ wh[:, 2 * HIDDEN:])
                new = np.where(on, h + z * (c - h), h)
                if keep:
                    kept.append((d, t, on, h, z, r, c))
                h = new
                states[t, :, d * HIDDEN:(d + 1) * HIDDEN] = h
        e = states @ p["wa"]
        e = np.where(np.arange(WINDOW)[:, None] < size, e, -30)
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tn,tnh->nh", a, states)
        out = pooled @ p["wo"] + p["bo"][0]
        return (out, (states, a, pooled, kept)) if keep else out

    def gates(self, x: np.ndarray) -> np.ndarray:
        return np.stack([x @ self.p["wx"][d] + self.p["b"][d] for d in (0, 1)])

    def windows(self, t: Texts, at_once: int = 8192) -> np.ndarray:
        """Scores of all windows. Full ones that start at neighbouring words are run together: at each step they read neighbouring words."""
        g, out = self.gates(self.inputs(t)), np.zeros(len(t.begin), np.float32)
        short = np.flatnonzero(t.size < WINDOW)
        for a in range(0, len(short), at_once):
            some = short[a:a + at_once]
            out[some] = self.run(g, t.place(some), t.size[some])
        full = np.flatnonzero(t.size == WINDOW)
        cuts = np.searchsorted(t.begin[full], np.arange(0, len(t.word) + at_once, at_once))
        with np.errstate(over="ignore"):
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    begin = t.begin[full[a:b]]
                    out[full[a:b]] = self._neighbours(g, t.word[begin[0]:begin[-1] + WINDOW])[begin - begin[0]]
        return out

    def _neighbours(self, gates: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Scores of the windows that start at each word, but for the last WINDOW - 1.

        Features lie in rows, so that a step is a shifted slice. Signs and factors are in the weights: 1 / (1 + exp(u)) is the gates' curve and,
        doubled less 1, the candidate's. What attention and output read of a state comes with the next step's product.
        """
        p, n, two = self.p, len(word) - WINDOW + 1, 2 * HIDDEN
        e, v = np.zeros((WINDOW, n), np.float32), np.zeros((WINDOW, n), np.float32)
        factor = np.repeat(np.array([-1, -2], np.float32), (two, HIDDEN))[:, None]
        for d in (0, 1):
            own = slice(d * HIDDEN, (d + 1) * HIDDEN)
            read = np.stack([p["wa"][own], p["wo"][own]])
            wh = p["wh"][d].T * factor
            first, wc = np.concatenate([wh[:two], read]), wh[two:]
            g = gates[d][word].T * factor
            h, last = None, 0
            for step in range(WINDOW):
                at = step if d == 0 else WINDOW - 1 - step
                if h is None:
                    zr, c = g[:two, at:at + n].copy(), g[two:, at:at + n].copy()
                else:
                    found = first @ h
                    e[last] += found[two]
                    v[last] += found[two + 1]
                    zr = found[:two]
                    zr += g[:two, at:at + n]
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                if h is not None:
                    c = wc @ (zr[HIDDEN:] * h)
                    c += g[two:, at:at + n]
                np.exp(c, out=c)
                c += 1
                np.divide(2, c, out=c)
                c -= 1
                if h is None:
                    h = c * zr[:HIDDEN]
                else:
                    c -= h
                    c *= zr[:HIDDEN]
                    h += c
                last = at
            found = read @ h
            e[last] += found[0]
            v[last] += found[1]
        e -= e.max(0)
        np.exp(e, out=e)
        return (e * v).sum(0) / e.sum(0) + p["bo"][0]

    def gradients(self, t: Windows, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, x = self.p, self.inputs(t)
        place, size = t.place, t.size
        out, (states, a, pooled, kept) = self.run(self.gates(x), place, size, keep=True)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        do = ((_sigmoid(out) - y) * weight).astype(np.float32)
        g["wo"], g["bo"] = pooled.T @ do, np.array([do.sum()], np.float32)
        dp = do[:, None] * p["wo"]
        da = np.einsum("nh,tnh->tn", dp, states)
        de = a * (da - (a * da).sum(0))
        ds = a[:, :, None] * dp + de[:, :, None] * p["wa"]
        g["wa"] = np.einsum("tn,tnh->h", de, states)
        dx = np.zeros_like(x)
        dh = {d: np.zeros((len(place), HIDDEN), np.float32) for d in (0, 1)}
        for d, at, on, h, z, r, c in reversed(kept):
            wh = p["wh"][d]
            top = dh[d] + ds[at, :, d * HIDDEN:(d + 1) * HIDDEN]
            new = np.where(on, top, 0)
            dz, dc = new * (c - h) * z * (1 - z), new * z * (1 - c * c)
            drh = dc @ wh[:, 2 * HIDDEN:].T
            dr = drh * h * r * (1 - r)
            dg = np.concatenate([dz, dr, dc], 1)
            g["wh"][d][:, :2 * HIDDEN] += h.T @ dg[:, :2 * HIDDEN]
            g["wh"][d][:, 2 * HIDDEN:] += (r * h).T @ dc
            g["b"][d] += dg.sum(0)
            word = place[:, at]
            g["wx"][d] += x[word].T @ dg
            np.add.at(dx, word, dg @ p["wx"][d].T)
            dh[d] = np.where(on, new * (1 - z) + drh * r + dg[:, :2 * HIDDEN] @ wh[:, :2 * HIDDEN].T, top)
        np.add.at(g["word"], t.number, dx[:, :WORD])
        np.add.at(g["chars"], t.buckets, np.repeat(dx[:, WORD:] / np.maximum(t.sizes, 1)[:, None], t.sizes, axis=0))
        return g

    def text_scores(self, t: Texts) -> np.ndarray:
        best = np.full(t.texts, -12, np.float32)
        np.maximum.at(best, t.doc, self.windows(t))
        return best

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return _sigmoid(a * self.text_scores(Texts(data, offsets, self.vocabulary)) + b).astype(np.float64)


def fit(texts: list[str], y: np.ndarray) -> Network | None:
    if len(np.unique(y)) < 2:
        return None
    data, offsets = text_bytes(pa.array(texts))
    words = Words(data, offsets, NON_ALNUM, lower=True)
    # in how many documents of either class a word stands
    doc_word = np.unique(np.stack([words.doc.astype(U), words.hashes], 1), axis=0)
    vocabulary, number = np.unique(doc_word[:, 1], return_inverse=True)
    toxic = y[doc_word[:, 0].astype(np.int64)] == 1
    n1, n0 = np.bincount(number, toxic), np.bincount(number, ~toxic)
    frequent = np.argsort(-(n0 + n1), kind="stable")[:MOST_VOCABULARY]
    kept = np.sort(frequent[(n0 + n1)[frequent] >= MIN_DOCS])
    vocabulary, n1, n0 = vocabulary[kept], n1[kept], n0[kept]
    net = Network(vocabulary)
    # A word's first component starts as its share of the evidence, so that the first choice of windows isn't blind.
    odds = np.log((n1 + 0.5) / ((y == 1).sum() + 1)) - np.log((n0 + 0.5) / ((y == 0).sum() + 1))
    net.p["word"][1:, 0] = odds.astype(np.float32) * (n1 + n0) / (n1 + n0 + 4)
    t = Texts(data, offsets, vocabulary)
    m, v, step, r = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0, np.random.default_rng(3)
    for turn in range(ROUNDS):
        if turn:
            scores = net.windows(t)
        else:
            odds = net.p["word"][t.number, 0][t.word]
            scores = np.full(len(t.begin), -np.inf, np.float32)
            for step in range(WINDOW):
                np.maximum(scores, odds[t.begin + np.minimum(step, t.size - 1)], out=scores)
        order = np.lexsort((-scores, t.doc))
        own = t.doc[order]
        rank = np.arange(len(order)) - np.searchsorted(own, own)
        chosen = order[rank < np.where(y[own] == 1, 1, 2)]
        chosen = np.r_[chosen, r.choice(np.flatnonzero(y[t.doc] == 0), min(1000, int((y[t.doc] == 0).sum())), replace=False)]
        truth = y[t.doc[chosen]]
        weight = np.where(truth == 1, 0.5 / max(1, (truth == 1).sum()), 0.5 / max(1, (truth == 0).sum()))
        for _ in range(PASSES):
            for part in np.array_split(r.permutation(len(chosen)), max(1, len(chosen) // 400)):
                step += 1
                g = net.gradients(t.part(chosen[part]), truth[part], weight[part] * len(chosen) / max(1, len(part)))
                for k, x in net.p.items():
                    m[k] += 0.1 * (g[k] - m[k])
                    v[k] += 0.01 * (g[k] * g[k] - v[k])
                    x -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6) + 1e-5 * x
    z, a, b = net.text_scores(t).astype(np.float64), 1.0, 0.0
    for _ in range(500):
        e = (y - _sigmoid(a * z + b)) / np.where(y == 1, (y == 1).sum(), (y == 0).sum())
        a, b = a + 0.1 * ((e * z).sum() - 0.01 * (a - 1)), b + 0.1 * e.sum()
    net.curve = float(a), float(b)
    return net


def train(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "toxic") -> Network | None:
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, held_out, SAMPLE)
    rows = sorted(sample.where(F.size(F.split("text", r"\s+")) <= MAX_WORDS).collect())
    return fit([r.text for r in rows], np.array([r.y for r in rows])) if rows else None


def with_score(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id and score of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            net = shared.value
            found = [net.score(data, offsets) if net else np.full(len(offsets) - 1, _NEUTRAL) for _, _, data, offsets in pieces(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(found) if found else np.zeros(0))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
