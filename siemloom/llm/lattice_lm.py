"""Probability of texts under a vocabulary of subwords, over all segmentations, beside a smoothed unigram model of words.

Words are runs of bytes other than ASCII white space, with A-Z lower-cased; a text is its words and one end.

`score`: a word is drawn as a whole, by its share of the learned tokens, or, with the probability NEW, spelled in pieces by the lattice. NEW is the share of
learned tokens that are words seen once, which is how often a token is a new word; the end of a text is a token likewise.

The lattice: the vocabulary is one that exists (a SentencePiece model). Its scores weight the pieces at first: a unigram model's are log
probabilities as they are, a BPE model's are ranks, weighted as 1 / (1 + rank). Expectation maximisation then learns the weights from the distinct words of all
texts to learn from, whatever their length, each word once, as new words are like rare ones: a round is a pass over the table of counts, each task of which sums what it
expects of each piece. Every byte is a piece of its own too, so that each text has a segmentation.
Pieces share 1 - BYTES - END of the probability, all bytes alike BYTES, the end of a text END. A word is read with the vocabulary's space mark in front; as no piece
that is taken has the mark behind its first place, no piece reaches over words, and a text's segmentations are those of its words, one by one. The forward recursion
sums over all pieces that end at each byte, so a word's probability is that of all its segmentations, and the text's is the product.

`base_score`: counts of words in the texts to learn from, over all of them. One pass cuts the texts into blocks of at most BLOCK_WORDS words (a longer text alone),
with the block's distinct words once each, and writes them to the shared folder in buckets by id, so that the ids of blocks hold for what follows. Counts are summed by word;
words meet their counts as rows of word and block, and go back to the blocks, which stay where they were written. A word in all texts is one row a block there; Spark splits such
a join's hot key. What is gathered grows with the words of the corpus, and no task holds more than a block's words or its share of the counts.

Null texts are empty: no word, one end. Rows without an id don't teach and have a null held_out. Repeated rows count each. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siemloom.llm.components import TASKS
from siemloom.llm.words import small_batches
from siemloom.sources.files import bucketed, written

BLOCK_WORDS = 1 << 20
BYTES, END = 0.01, 0.01
MARK = "▁"
_MARK = MARK.encode()
#: Words are read so many bytes at a time; those of more than TOGETHER bytes apart, sorted by size, and each alone where no more than FEW make up the bytes.
MANY_BYTES, TOGETHER, FEW = 1 << 17, 64, 4
#: Bytes of text for which a task is kept where the table's partitions are small.
TASK_BYTES = 4 << 20
_LN = math.log(10)
#: Rounds in which the pieces' weights are learned, and characters of a text that teach them: all.
ROUNDS, SAMPLE_CHARS = 4, None

Vocabulary = tuple[dict[bytes, float], float, float]


def vocabulary(path: str) -> Vocabulary:
    """log10 probability of each piece, as bytes; of any byte; of the end."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) and model.get_score(i) > -1e6 and MARK not in piece[1:]:
            scores[piece.encode()] = model.get_score(i)
    ranked = all(s <= 0 and s == int(s) for s in scores.values())
    weights = {p: 1 / (1 - s) if ranked else math.exp(s) for p, s in scores.items()}
    share = (1 - BYTES - END) / math.fsum(weights.values())
    return {p: math.log10(w * share) for p, w in weights.items()}, math.log10(BYTES / 256), math.log10(END)


class Lattice:
    """The forward and backward recursion over words' segmentations, many words at a time."""

    def __init__(self, model: Vocabulary) -> None:
        pieces = model[0]
        nodes = sorted({p[:k] for p in pieces for k in range(1, len(p) + 1)}, key=lambda p: (len(p), p))
        self.number = number = {b"": 0} | {p: i + 1 for i, p in enumerate(nodes)}
        #: Node of the trie by the node before and a byte: by table from the root; from there on at the place base[node] + byte, if its owner is the node. 256 ends a word.
        self.first = np.zeros(257, np.int32)
        for p in nodes[:256]:
            if len(p) == 1:
                self.first[p[0]] = number[p]
        deep = np.array([(number[p[:-1]], p[-1], number[p]) for p in nodes if len(p) > 1], np.int32).reshape(-1, 3)
        self.base, self.owner, self.child = _placed(deep, len(number))
        self.weigh(model)

    def weigh(self, model: Vocabulary) -> None:
        """Other weights of the same pieces."""
        self.pieces, self.byte, self.end = model
        self.scores = np.full(len(self.base), np.nan)
        for p, v in self.pieces.items():
            self.scores[self.number[p]] = v
        self._lists: tuple[list, ...] | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("number", "pieces")} | {"_lists": None}

    def words(self, words: list[bytes] | pa.Array) -> np.ndarray:
        """log10 of the summed probability of all segmentations of each word."""
        raw, begin, sizes = _spans(words)
        out = np.empty(len(sizes))
        for some, together in _runs(sizes):
            if together:
                out[some] = self._run(raw, begin[some], sizes[some], _MARK)
            else:
                out[some] = [self._long(_MARK + raw[begin[i]:begin[i] + sizes[i]].tobytes()) for i in some]
        return out

    def expected(self, words: list[bytes] | pa.Array) -> np.ndarray:
        """How often each node's piece is expected in the words, each once."""
        raw, begin, sizes = _spans(words)
        out = np.zeros(len(self.scores))
        for some, together in _runs(sizes):
            if together:
                out += self._run(raw, begin[some], sizes[some], _MARK, np.ones(len(some)))
            else:
                for i in some:
                    self._long(_MARK + raw[begin[i]:begin[i] + sizes[i]].tobytes(), out)
        return out

    def _forward(self, texts: list[bytes], times: np.ndarray | None = None) -> np.ndarray:
        """log10 of the texts' probabilities; with `times` of the texts, how often each node's piece is expected in them instead."""
        return self._run(*_spans(texts), b"", times)

    def _run(self, raw: np.ndarray, begin: np.ndarray, sizes: np.ndarray, lead: bytes, times: np.ndarray | None = None) -> np.ndarray:
        """As _forward, of the texts at some places of the bytes, each with `lead` in front."""
        order = np.argsort(-sizes, kind="stable")
        begin, sizes = begin[order] - len(lead), sizes[order] + len(lead)
        # Place by place, the longest text first: a place's texts are the first ones of the place before.
        most = int(sizes[0]) if len(sizes) else 0
        have = len(sizes) - np.r_[0, np.cumsum(np.bincount(sizes, minlength=most + 1))[:-1]]
        start = np.r_[0, np.cumsum(have)]
        after = np.arange(start[-1]) + np.repeat(have, have)
        ends = start[sizes] + np.arange(len(sizes))
        data = np.full(start[-1], 256, np.int32)
        begins, haves = start.tolist(), [*have.tolist(), 0]
        for j in range(most):
            data[begins[j]:begins[j] + haves[j + 1]] = raw[begin[:haves[j + 1]] + j] if j >= len(lead) else lead[j]
        # Products of probabilities, which a short text keeps far from zero; sums of their logarithms for longer ones.
        short = most <= TOGETHER + len(_MARK)
        nothing, one = (0.0, 1.0) if short else (-np.inf, 0.0)
        put, join = (np.add, np.multiply) if short else (np.logaddexp, np.add)
        value = np.nan_to_num(np.power(10.0, self.scores) if short else self.scores * _LN, nan=nothing)
        byte = 10.0 ** self.byte if short else self.byte * _LN

        # Pieces by length: from a place, to a place, value, node. Of one byte, a piece or the byte itself, at all places.
        letter = self.first[data]
        single = put(value[letter], byte)
        edges = []
        at = np.flatnonzero(letter)
        node, to = letter[at], after[at]
        while True:
            place = self.base[node] + data[to]
            go = np.flatnonzero(self.owner[place] == node)
            if not len(go):
                break
            at, node, to = at[go], self.child[place[go]], after[to[go]]
            v = value[node]
            whole = np.flatnonzero(v != nothing)
            if len(whole):
                x = at[whole]
                edges.append((x, to[whole], v[whole], node[whole], np.searchsorted(x, start).tolist()))

        total = np.full(start[-1], nothing)
        total[:len(sizes)] = one
        for j in range(most):
            a, b, n = begins[j], begins[j + 1], haves[j + 1]
            total[b:b + n] = put(total[b:b + n], join(total[a:a + n], single[a:a + n]))
            for x, y, v, _, cut in edges:
                c, d = cut[j], cut[j + 1]
                if c < d:  # no text twice
                    y = y[c:d]
                    total[y] = put(total[y], join(total[x[c:d]], v[c:d]))
        whole = total[ends]
        if times is None:
            out = np.empty(len(sizes))
            out[order] = np.log10(whole) if short else whole / _LN
            return out
        rest = np.full(start[-1], nothing)
        rest[ends] = times[order] / whole if short else np.log(times[order]) - whole
        for j in reversed(range(most)):
            a, b, n = begins[j], begins[j + 1], haves[j + 1]
            rest[a:a + n] = put(rest[a:a + n], join(rest[b:b + n], single[a:a + n]))
            for x, y, v, _, cut in edges:
                c, d = cut[j], cut[j + 1]
                if c < d:
                    x = x[c:d]
                    rest[x] = put(rest[x], join(rest[y[c:d]], v[c:d]))
        x = np.flatnonzero(letter)
        out = np.zeros(len(self.scores))
        for x, y, v, node, _ in [(x, after[x], value[letter[x]], letter[x], None), *edges]:  # without the byte's share
            share = join(join(total[x], v), rest[y])
            out += np.bincount(node, share if short else np.exp(share), len(out))
        return out

    def _long(self, text: bytes, expected: np.ndarray | None = None) -> float:
        """log10 of one text's probability; what is expected of each node's piece is added to `expected`."""
        terms: list[list[float] | None] = [[] for _ in range(len(text) + 1)]
        total = [0.0] * (len(text) + 1)
        for i in range(len(text)):
            if i:
                total[i], terms[i] = _total(terms[i]), None
            for j, score, _ in self._edges(text, i):
                terms[j].append(total[i] + score)
        whole = _total(terms[-1])
        if expected is not None:
            rest = [0.0] * (len(text) + 1)
            for i in reversed(range(len(text))):
                edges = self._edges(text, i)
                rest[i] = _total([score + rest[j] for j, score, _ in edges])
                for j, score, node in edges[1:]:
                    expected[node] += 10 ** (total[i] + score + rest[j] - whole)
        return whole

    def _edges(self, text: bytes, i: int) -> list[tuple[int, float, int]]:
        """What may stand at a place: the byte, then the pieces; where each ends, its log10 probability, its node."""
        if self._lists is None:
            self._lists = tuple(x.tolist() for x in (self.first, self.base, self.owner, self.child, self.scores))
        first, base, owner, child, scores = self._lists
        edges, node, j = [(i + 1, self.byte, 0)], first[text[i]], i + 1
        while node:
            score = scores[node]
            if score == score:
                edges.append((j, score, node))
            if j == len(text):
                break
            place = base[node] + text[j]
            node, j = child[place] if owner[place] == node else 0, j + 1
        return edges


def _placed(deep: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base by node, owner and child by place, of rows of node, byte and node after it: a node's rows stand at its base + byte, no two at one place."""
    deep = deep[np.lexsort((deep[:, 1], deep[:, 0]))]
    cuts = np.flatnonzero(np.r_[True, deep[1:, 0] != deep[:-1, 0]]) if len(deep) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[cuts, len(deep)])
    base, at = np.zeros(nodes, np.int32), np.zeros(len(deep), np.int64)
    free, low = np.ones(1024 * (len(cuts) + 4), bool), 256
    for k in np.argsort(-sizes, kind="stable")[:(sizes > 1).sum()]:
        letters = deep[cuts[k]:cuts[k] + sizes[k], 1]
        while True:
            some = np.flatnonzero(free[low:low + 1024]) + low
            for x in letters[1:] - letters[0]:
                some = some[free[some + x]]
            if len(some):
                break
            low += 512  # what is left free there is for nodes of one row
        at[cuts[k]:cuts[k] + sizes[k]] = some[0] + letters - letters[0]
        free[at[cuts[k]:cuts[k] + sizes[k]]] = False
    alone = cuts[sizes == 1]
    at[alone] = np.flatnonzero(free[256:])[:len(alone)] + 256
    base[deep[:, 0]] = at - deep[:, 1]
    size = int(at.max(initial=0)) + 513
    owner, child = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    owner[at], child[at] = deep[:, 0], deep[:, 2]
    return base, owner, child


def _spans(words: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' bytes, where each begins, their sizes."""
    if isinstance(words, list):
        words = pa.array(words, pa.large_binary())
    words = words.cast(pa.large_binary())
    _, at, data = words.buffers()
    at = np.frombuffer(at, np.int64)[words.offset:words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at[:-1], np.diff(at)


def _runs(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
    """Places of the words that are read at a time, and whether together or one by one."""
    long = np.flatnonzero(sizes > TOGETHER)
    for words in (np.flatnonzero(sizes <= TOGETHER), long[np.argsort(sizes[long], kind="stable")]):
        run = np.cumsum(sizes[words] + len(_MARK)) // MANY_BYTES
        for some in np.split(words, np.flatnonzero(run[1:] != run[:-1]) + 1) if len(words) else []:
            yield some, len(some) > FEW or sizes[some[0]] <= TOGETHER


def reweighted(model: Vocabulary, lattice: Lattice, expected: np.ndarray) -> Vocabulary:
    """The vocabulary with the pieces' shares of what is expected of them. A piece keeps a hundredth of an occurrence."""
    pieces, byte, end = model
    weights = {p: float(expected[lattice.number[p]]) + 0.01 for p in pieces}
    share = (1 - BYTES - END) / math.fsum(weights.values())
    return {p: math.log10(w * share) for p, w in weights.items()}, byte, end


def fitted(model: Vocabulary, kinds: set[bytes], rounds: int = ROUNDS) -> Vocabulary:
    """The vocabulary with the weights that expectation maximisation finds for the words, each once."""
    words = sorted(kinds)
    lattice = Lattice(model)
    for _ in range(rounds if words else 0):
        model = reweighted(model, lattice, lattice.expected(words))
        lattice.weigh(model)
    return model


def learned(words: DataFrame, model: Vocabulary, rounds: int = ROUNDS) -> Lattice:
    """As `fitted`, of a table's rows `word`; each round's sums of each piece come to the driver, a row a piece."""
    lattice = Lattice(model)
    for _ in range(rounds):
        def run(batches: Iterator[pa.RecordBatch], lattice: Lattice = lattice) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(lattice.scores))
            for batch in batches:
                total += lattice.expected(batch.column("word"))
            node = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int32)), pa.array(total[node])], ["node", "expected"])

        rows = words.select("word").mapInArrow(run, "node int, expected double").groupBy("node").agg(F.sum("expected").alias("expected")).toArrow()
        expected = np.zeros(len(lattice.scores))
        expected[rows["node"].to_numpy()] = rows["expected"].to_numpy()
        model = reweighted(model, lattice, expected)
        lattice.weigh(model)
    return lattice


def _total(logs: list[float]) -> float:
    most = max(logs)
    return most + math.log10(math.fsum(10.0 ** (x - most) for x in logs))


_LISTS = {"doc_ids": pa.int64(), "teaches": pa.int8(), "n_tokens": pa.int64(), "ends": pa.int32(), "places": pa.int32(), "times": pa.int32(),
          "words": pa.binary(), "trained": pa.int64()}
_BLOCKS = ("block long, doc_ids array<long>, teaches array<byte>, n_tokens array<long>, ends array<int>, places array<int>, "
           "times array<int>, words array<binary>, trained array<long>")


class _Block:
    """Documents' distinct words as places in the block's list of words."""

    def __init__(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids, self.teaches, self.counts = [], [], []
        self.places: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, teaches: int | None, words: list[bytes]) -> None:
        number = self.number
        self.ids.append(doc_id)
        self.teaches.append(teaches)
        self.counts.append(len(words))
        self.places.append(np.array([number[w] for w in words], np.int64))
        self.size += len(words) + 1

    def batch(self, block: int) -> pa.RecordBatch:
        n, kinds, counts = len(self.ids), len(self.number), np.array(self.counts)
        place, doc = np.concatenate(self.places), np.repeat(np.arange(n), counts)
        trained = np.bincount(place[np.array([t == 1 for t in self.teaches])[doc]], minlength=kinds)
        pair, times = np.unique(doc * max(1, kinds) + place, return_counts=True)
        doc, place = pair // max(1, kinds), pair % max(1, kinds)
        words = list(self.number)
        lists = [self.ids, self.teaches, counts + 1, np.searchsorted(doc, np.arange(n), "right"), place, times, words, trained]
        return pa.RecordBatch.from_arrays([pa.array([block]), *(
            pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, t)) for v, t in zip(lists, _LISTS.values(), strict=True))], ["block", *_LISTS])


def _gathered(docs: DataFrame) -> DataFrame:
    """The rows, small partitions put together: a task writes a block at least, so many of few texts would be as many blocks and files."""
    size = docs.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return docs.coalesce(max(TASKS * docs.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES))


def _blocks(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        number = TaskContext.get().partitionId() << 32  # of the task's first block
        for batch in batches:
            for doc_id, teaches, text in zip(*(batch.column(c) for c in ("doc_id", "teaches", "text")), strict=True):
                words = (text.as_py() or "").encode().lower().split()
                if block.size and block.size + len(words) >= BLOCK_WORDS:
                    yield block.batch(number)
                    block, number = _Block(), number + 1
                block.add(doc_id.as_py(), teaches.as_py(), words)
        if block.size:
            yield block.batch(number)

    return docs.mapInArrow(run, _BLOCKS)


def score(docs: DataFrame, model: Vocabulary, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known (tokens that the learned texts hold), train_tokens, base_score and score (log10)."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~held_out).cast("byte").alias("teaches"), F.col("text").cast("string").alias("text"))
    blocks = bucketed(_blocks(_gathered(docs)), "lm-blocks", "block")
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("words", "trained")).alias("place", "w")).select("block", "place", F.col("w.words").alias("word"), "w.trained")
    counts = pairs.where("trained > 0").groupBy("word").agg(F.sum("trained").alias("c"))
    counts = written(counts, "lm-counts")
    words, distinct, once = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("c"), F.count_if(F.col("c") == 1)).first()
    ends = blocks.select(F.coalesce(F.sum(F.size(F.filter("teaches", lambda t: t == 1))), F.lit(0))).first()[0]
    total, kinds = words + ends, distinct + (ends > 0)
    small_batches(spark, 1 << 13)
    lattice = learned(counts, model, ROUNDS if distinct else 0)
    small_batches(spark, 500)
    # A long word goes by its digest; no text holds the byte in front of it.
    digest = F.when(F.length("word") <= 32, F.col("word")).otherwise(F.concat(F.lit(b"\xff"), F.unhex(F.sha2("word", 256))))
    pairs, counts = (x.withColumn("word", digest) for x in (pairs, counts))
    known = pairs.join(counts, "word").groupBy("block").agg(
        F.collect_list(F.struct("place", "c")).alias("known"))
    rows = blocks.select("block", "doc_ids", "teaches", "n_tokens", "ends", "places", "times", "words").join(known, "block", "left")

    new = (once + 1) / (total + 2)
    end = math.log10((1 - new) * ends / max(1, total) + new * 10 ** lattice.end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm = math.log10(total + 0.5 * (kinds + 1))
        for batch in batches:
            for i in range(batch.num_rows):
                part = {c: batch.column(c)[i].values for c in ("doc_ids", "teaches", "n_tokens")}
                ends_at, places, times = (batch.column(c)[i].values.to_numpy() for c in ("ends", "places", "times"))
                logs = lattice.words(batch.column("words")[i].values)
                count = np.zeros(len(logs), np.int64)
                have = batch.column("known")[i].values
                if have is not None:
                    count[have.field("place").to_numpy()] = have.field("c").to_numpy()
                n = len(ends_at)
                doc = np.repeat(np.arange(n), np.diff(np.r_[0, ends_at]))
                base = np.bincount(doc, times * (np.log10(count + 0.5) - norm)[places], n) + math.log10(ends + 0.5) - norm
                known_tokens = np.bincount(doc, times * (count[places] > 0), n).astype(np.int64) + (ends > 0)
                seen = np.log((1 - new) * count / max(1, total), out=np.full(len(count), -np.inf), where=count > 0)
                each = np.logaddexp(seen, logs * _LN + math.log(new)) / _LN
                scores = np.bincount(doc, times * each[places], n) + end
                teaches = part["teaches"].to_numpy(zero_copy_only=False).astype(float)
                yield pa.RecordBatch.from_arrays([
                    part["doc_ids"], pa.array(teaches == 0, mask=np.isnan(teaches)), part["n_tokens"], pa.array(known_tokens),
                    pa.array(np.full(n, total, np.int64)), pa.array(base), pa.array(scores)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
