"""Benchmark decontamination by spaced-seed hashing.

A mask marks the words of a window that count; the others may be anything. For each mask, the hash of the counting words at every place of the
benchmark texts is looked up at every place of the training texts. A hit fixes an alignment of an item with a text; on it all runs of words are
found, a word that equals its partner counting 1 and one that differs costing COST: a run is longest among those of which no head and no tail sums to
less than 0. It is an overlap if enough of its words are equal: at least LEAST, or all of a shorter item's.

No overlap lacks a hit: the part of a run up to its LEAST-th equal word is one of 3,876 patterns (no head of it is below 0), and in each of them one
of the masks fits on equal words. A shorter item is equal as a whole and holds the mask without gaps, or is found by its exact words.

Texts and items that repeat themselves hit each other at very many pairs of places, but on few alignments: places of one hash at equal steps are
taken together, and two such sequences of the same step give their alignments at once. What steps differently is expanded in bounded parts.

The benchmark is taken in blocks of at most BLOCK_WORDS words; each block is sent to all tasks and every text meets every block, so the benchmark
may have any size. Words are runs of digits, letters and bytes outside ASCII, in lower case. Null and empty texts on either side match nothing.
Rows are judged one by one: repeated rows give repeated results; the filter keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siemloom.llm.words import NON_ALNUM, U, Words, grams, mix, pieces, small_batches

#: 1: the word counts. Chosen greedily among all masks of six such words until every pattern that LEAST and COST allow holds one.
MASKS = ("111111", "111001101", "110110101", "11101011", "1101100101", "1110101001", "110011011")
LEAST, COST = 13, 2
#: Pairs of words compared at once.
CELLS = 1 << 20
BLOCK_WORDS = 100_000
#: Bits of the table that is asked before the sorted hashes are.
SIEVE = 20


def _prepare(column: pa.Array) -> Iterator[tuple[int, Words]]:
    for first, _, data, offsets in pieces(column):
        yield first, Words(data, offsets, NON_ALNUM, lower=True)


def seeds(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask the places where it fits in a text, and the hashes there."""
    single = grams(words.hashes, 1)
    for mask in MASKS:
        out = np.zeros(words.n, U)
        for j, c in enumerate(mask):
            if c == "1" and j < words.n:
                out[:words.n - j] += single[j:] * U((2 * j + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        at = np.flatnonzero(words.left >= len(mask))
        yield at, mix(out[at] ^ U(hash_of_mask(mask)))


def hash_of_mask(mask: str) -> int:
    return int(mask, 2) * 2 + 1 << 20


def runs(equal: np.ndarray) -> list[tuple[int, int]]:
    """First word and word after the last of all runs of an alignment."""
    edges = np.flatnonzero(np.diff(np.r_[False, equal, False].astype(np.int8))).reshape(-1, 2).tolist()
    found: list[tuple[int, int, int, int]] = []  # first, after, sum before, sum with it
    total, last = 0, 0
    for a, b in edges:
        total -= COST * (a - last)
        new, total, last = (a, b, total, total + b - a), total + b - a, b
        j = len(found) - 1
        while j >= 0:
            if found[j][2] > new[2]:
                j -= 1
            elif found[j][3] > new[3]:
                break
            else:  # from the j-th on all are one run, which may join earlier ones
                new = (found[j][0], new[1], found[j][2], new[3])
                del found[j:]
                j = len(found) - 1
        found.append(new)
    return [(a, b) for a, b, *_ in found]


def progressions(same: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts places into runs of equal steps: index of each run's first place, its step (0: a single place), its places.

    same: whether a place is of the same group as the one before it (False for the first).
    """
    gap = np.diff(at, prepend=at[:1])
    new = ~same
    new[2:] |= same[1:-1] & (gap[2:] != gap[1:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(at)])
    return first, np.where(count > 1, gap[np.minimum(first + 1, len(at) - 1)] if len(at) else 0, 0), count


def _expand(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For n copies of each row: the row of each copy and the copy's number within it."""
    own = np.repeat(np.arange(len(n)), n)
    return own, np.arange(len(own)) - (np.cumsum(n) - n)[own]


def _parts(n: np.ndarray) -> Iterator[slice]:
    """Slices of rows whose n add up to about CELLS."""
    if len(n):
        ends = np.cumsum(n)
        cuts = np.unique(np.searchsorted(ends, np.arange(CELLS, ends[-1] + CELLS, CELLS), "left") + 1)
        for a, b in zip(np.r_[0, cuts[:-1]].tolist(), cuts.tolist(), strict=True):
            yield slice(a, b)


class Index:
    """Of a block of benchmark items."""

    def __init__(self, ids: np.ndarray, texts: list[str]) -> None:
        # a text of fewer words than a mask is found by its exact words
        (_, self.words), = _whole(texts)
        self.ids, parts = ids, []
        for at, hashes in seeds(self.words):
            parts.append((hashes, at))
        for n in range(1, min(map(len, MASKS))):
            at = np.flatnonzero((self.words.counts[self.words.doc] == n) & (self.words.left == n))
            parts.append((self.words.grams(n)[at], at))
        hashes, places = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.lexsort((places, hashes))
        hashes, places = hashes[order], places[order]
        item = self.words.doc[places]
        same = np.r_[False, (hashes[1:] == hashes[:-1]) & (item[1:] == item[:-1])][:len(places)]
        first, self.step, self.count = progressions(same, places)
        self.hashes, self.places, self.item = hashes[first], places[first], item[first]
        self.sieve = np.zeros(1 << SIEVE, bool)
        self.sieve[(self.hashes >> U(64 - SIEVE)).astype(np.int64)] = True
        self.short = [n for n in range(1, min(map(len, MASKS))) if (self.words.counts == n).any()]

    def _alignments(self, words: Words, at: np.ndarray, hashes: np.ndarray) -> Iterator[np.ndarray]:
        """The alignments that hits give, as numbers of text, item and shift in one; they may come several times."""
        some = np.flatnonzero(self.sieve[(hashes >> U(64 - SIEVE)).astype(np.int64)])
        some = some[np.searchsorted(self.hashes, hashes[some], "left") < np.searchsorted(self.hashes, hashes[some], "right")]
        some = some[np.argsort(hashes[some], kind="stable")]
        at, hashes, doc = at[some], hashes[some], words.doc[at[some]]
        same = np.r_[False, (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])][:len(at)]
        first, step, count = progressions(same, at)
        at, hashes, doc = at[first], hashes[first], doc[first]
        a = np.searchsorted(self.hashes, hashes, "left")
        n = np.searchsorted(self.hashes, hashes, "right") - a
        for part in _parts(n):
            own, k = _expand(n[part])
            own, other = own + part.start, (a[part])[own] + k
            # a sequence of another step meets the text's place by place
            uneven = (step[own] != self.step[other]) & (count[own] > 1) & (self.count[other] > 1)
            copy, k = _expand(np.where(uneven, self.count[other], 1))
            own, other, uneven = own[copy], other[copy], uneven[copy]
            place = self.places[other] + k * self.step[other]
            behind = np.where(uneven, 1, self.count[other])
            low = at[own] - place - self.step[other] * (behind - 1)
            by = np.where(uneven, step[own], np.maximum(step[own], self.step[other]))
            total = count[own] + behind - 1
            key = self._key(words, doc[own], self.item[other], low)
            for inner in _parts(total):
                row, k = _expand(total[inner])
                yield np.unique(key[inner][row] + k * by[inner][row])

    def _key(self, words: Words, doc: np.ndarray, item: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (doc * len(self.ids) + item) * (words.n + self.words.n + 1) + shift + self.words.n

    def overlaps(self, words: Words) -> list[tuple[int, int, int, int, int]]:
        """Text's row, item, first word, word after the last, equal words of every overlap; once where several alignments give the same."""
        if not words.n or not len(self.hashes):
            return []
        wanted = list(seeds(words))
        for n in self.short:
            at = np.flatnonzero(words.left >= n)
            wanted.append((at, words.grams(n)[at]))
        found, held = [np.zeros(0, np.int64)], 0
        for at, hashes in wanted:
            for part in self._alignments(words, at, hashes):
                found.append(part)
                held += len(part)
                if held > 4 * CELLS:
                    found, held = [np.unique(np.concatenate(found))], 0
        key = np.unique(np.concatenate(found))
        if not len(key):
            return []
        pair, shift = np.divmod(key, words.n + self.words.n + 1)
        doc, item = np.divmod(pair, len(self.ids))
        # where the item's first word would stand
        begin = shift - self.words.n + self.words.first[item]
        first, size = self.words.first[item], self.words.counts[item]
        lo, hi = np.maximum(begin, words.first[doc]), np.minimum(begin + size, words.first[doc + 1])
        shift, need, out = first - begin, np.minimum(LEAST, size), []
        ends = np.cumsum(hi - lo)
        cuts = np.searchsorted(ends, np.arange(CELLS, ends[-1] + CELLS, CELLS), "right")
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(ends)], strict=True):
            if a == b:
                continue
            n = (hi - lo)[a:b]
            at = np.cumsum(n) - n
            place = np.repeat(lo[a:b] - at, n) + np.arange(n.sum())
            equal = words.hashes[place] == self.words.hashes[place + np.repeat(shift[a:b], n)]
            same = np.add.reduceat(equal.astype(np.int64), at)
            for k in np.flatnonzero(same >= need[a:b]).tolist():
                own, i = equal[at[k]:at[k] + n[k]], a + k
                base = int(lo[i] - words.first[doc[i]])
                for start, stop in runs(own):
                    inside = int(own[start:stop].sum())
                    if inside >= need[i]:
                        out.append((int(doc[i]), int(self.ids[item[i]]), base + start, base + stop, inside))
        return list(dict.fromkeys(out))


def _whole(texts: list[str]) -> list[tuple[int, Words]]:
    data = "".join(texts).encode()
    offsets = np.r_[0, np.cumsum([len(t.encode()) for t in texts])].astype(np.int64)
    return [(0, Words(np.frombuffer(data, np.uint8), offsets, NON_ALNUM, lower=True))]


def _blocks(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark comes to the driver a block at a time."""
    ids, texts, size = [], [], 0
    for row in benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1].split()) + 1
        if size >= BLOCK_WORDS:
            yield Index(np.array(ids, np.int64), texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Index(np.array(ids, np.int64), texts)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start and stop (words of the document), n_equal of every overlap."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = "doc_id long, item_id long, start long, stop long, n_equal long"
    out = spark.createDataFrame([], schema)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for index in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, found = batch.column("doc_id"), []
                for first, words in _prepare(batch.column("text")):
                    found += [(ids[first + d].as_py(), *rest) for d, *rest in shared.value.overlaps(words)]
                columns = list(zip(*found, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "start", "stop", "n_equal"])

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def without_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, that have no overlap with the benchmark."""
    spark = docs.sparkSession
    small_batches(spark)
    for index in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for first, words in _prepare(batch.column(batch.schema.get_field_index("text"))):
                    for d, *_ in shared.value.overlaps(words):
                        keep[first + d] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
