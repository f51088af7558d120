"""Removal of word passages that occur earlier, by sparse suffix arrays.

Steps 1, 2 and 4 are those of `repeats`: whole copies, minimisers that stand twice, removal. Between them:

- only the suffixes at such minimisers are kept: a row for each place, with the `window` words from it on and the window - gram words before it, as 64-bit
  hashes of words, and the windows (by how far they reach to the left of the place) whose minimiser it is,
- places meet by their gram. There suffixes are sorted by their words, and neighbours compared: the lengths of their common prefixes cut the array into
  stretches that agree for so many words to the right,
- matches are extended to the left: a window that reaches r words to the left has its equals among the places of a stretch that agrees for window - r words
  and whose r words before are the same. All but the first of them, in the order of documents and starts, are repeated. Every match of `window` words and
  more, cut to windows, is found so; the spans removed are the union of its windows.

The same is done within each batch of documents first, and only windows that are first in their batch go on. Grams with more than their share of all places
(known from counts by hash bins over all documents) would come to one task with all that stands around them; their windows go one by one instead, under
the hash of the whole window. Which grams these are depends on the gram and the counts alone, so equal windows always take the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siemloom.llm.repeats import _compare, _groups, _joined, candidate_texts, remove_repeats, with_ids
from siemloom.llm.words import U, Words, by_bucket, minimisers, mix, pieces, window_minima

#: Bins of the counts of grams; a gram's group has at most LEAST + 1 / BINS of all places.
BINS, LEAST = 4096, 4096
PLACE, KNOWN, WINDOW = 0, 1, 2

_KIND = {"bucket": pa.int64(), "kind": pa.int32(), **dict.fromkeys(("words", "bits", "keys", "docs", "tags", "starts"), pa.binary())}
_ENTRIES = "bucket long, kind int, words binary, bits binary, keys binary, docs binary, tags binary, starts binary"


def _heavy(docs: DataFrame, window: int, gram: int) -> np.ndarray:
    """Bins with a gram that stands too often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column("text")):
                words = Words(data, offsets)
                total += np.bincount((words.grams(gram)[minimisers(words, gram, window)] % U(BINS)).astype(np.int64), minlength=BINS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    out = np.zeros(BINS, np.int64)
    for slot, n in docs.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n")).collect():
        out[slot] = n
    return out > 2 * out.sum() / BINS + LEAST


class Places:
    """Suffixes at places: surroundings (rows of hashes of words, `back` before the place), the windows of each as bits by their reach, and where it stands."""

    def __init__(self, window: int, gram: int) -> None:
        self.window, self.back = window, window - gram

    def of(self, words: Words, at: np.ndarray, minima: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the first minimisers of the windows at `at`, their surroundings and bits."""
        g, reach, left = words.grams(gram), np.zeros(len(at), np.int64), np.ones(len(at), bool)
        for step in range(self.back + 1):
            hit = left & (g[np.minimum(at + step, len(g) - 1)] == minima[at])
            reach[hit] = step
            left &= ~hit
        place, number = np.unique(at + reach, return_inverse=True)
        bits = np.zeros(len(place), U)
        np.bitwise_or.at(bits, number, U(1) << reach.astype(U))
        around = place[:, None] + np.arange(-self.back, self.window)
        doc = words.doc[place]
        inside = (around >= words.first[doc][:, None]) & (around < words.first[doc + 1][:, None])
        return place, np.where(inside, words.hashes[np.clip(around, 0, words.n - 1)], U(0)), bits

    def repeated(self, around: np.ndarray, bits: np.ndarray, doc: np.ndarray, tag: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits of the windows that stand earlier, and of those that are the same place again."""
        again, same = np.zeros(len(bits), U), np.zeros(len(bits), U)
        if not len(bits):
            return again, same
        right = np.ascontiguousarray(around[:, self.back:])
        order = np.argsort(right.view(f"V{right.shape[1] * 8}").ravel(), kind="stable")  # the sparse suffix array
        agree = np.r_[0, np.cumprod(right[order[1:]] == right[order[:-1]], axis=1, dtype=np.int8).sum(1)]  # common prefixes of neighbours
        stretch, before = np.zeros(len(bits), np.int64), np.zeros(len(bits), U)
        for reach in range(self.back + 1):
            if reach:
                before = mix(before * U(3) + around[:, self.back - reach])
            rows = np.flatnonzero(bits >> U(reach) & U(1))
            if not len(rows):
                continue
            stretch[order] = np.cumsum(agree < self.window - reach)
            key = np.stack([stretch[rows].astype(U), before[rows]], 1)
            at, later, double = _compare(key, doc[rows], tag[rows], start[rows])
            again[rows[at[later]]] |= U(1) << U(reach)
            same[rows[at[double & ~later]]] |= U(1) << U(reach)
        return again, same

    def windows(self, bits: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and start of each window of the bits."""
        rows, reach = np.nonzero(bits[:, None] >> np.arange(self.back + 1, dtype=U) & U(1))
        return rows, (start[rows] - reach).astype(np.int32)


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_KIND)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KIND.values(), strict=True)], list(_KIND))


def repeated_windows(docs: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """As in `repeats`: the documents with their tag, and doc_id, tag and start of every repeated window; start -1: the whole document."""
    docs = with_ids(docs)
    groups = _groups(docs)
    heavy = _heavy(docs, window, gram)
    texts, candidates, gone = candidate_texts(docs, window, gram, groups)
    places = Places(window, gram)
    wide = places.back + window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy()
            wanted = np.unique(batch.column("hashes").flatten().to_numpy().view(U))
            some = [(np.zeros((0, wide), U), np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
            often = [(np.zeros((0, 2), U), *some[0][3:])]
            for first, _, data, offsets in pieces(batch.column("text")):
                words = Words(data, offsets)
                minima = window_minima(words, gram, window)
                at = np.flatnonzero(words.left >= window)
                if not len(at):
                    continue
                at = at[wanted[np.minimum(np.searchsorted(wanted, minima[at]), len(wanted) - 1)] == minima[at]]
                hot = heavy[(minima[at] % U(BINS)).astype(np.int64)]
                where = lambda x: (ids[first + words.doc[x]], tags[first + words.doc[x]], (x - words.first[words.doc[x]]).astype(np.int32))  # noqa: E731, B023
                alone = at[hot]
                often.append((np.stack([words.grams(window)[alone], minima[alone]], 1), *where(alone)))
                if not hot.all():
                    place, around, bits = places.of(words, at[~hot], minima, gram)
                    some.append((around, bits, words.grams(gram)[place], *where(place)))
            around, bits, hashes, doc, tag, start = (np.concatenate(x) for x in zip(*some, strict=True))
            again, same = places.repeated(around, bits, doc, tag, start)
            rows, at = places.windows(again, start)
            known = [(doc[rows], tag[rows], at)]
            left = np.flatnonzero(bits & ~again & ~same)
            out = [(b, PLACE, w, x, b"", *place) for b, w, x, *place in by_bucket(
                (hashes[left] % U(groups)).astype(np.int64), around[left], (bits & ~again & ~same)[left], doc[left], tag[left], start[left])]
            key, doc, tag, start = (np.concatenate(x) for x in zip(*often, strict=True))
            order, later, double = _compare(key, doc, tag, start)
            rest, rows = np.sort(order[~later & ~double]), order[later & ~double]
            out += [(b, WINDOW, b"", b"", k, *place) for b, k, *place in by_bucket((key[rest, 0] % U(groups)).astype(np.int64), key[rest], doc[rest], tag[rest], start[rest])]
            doc, tag, start = (np.concatenate(x) for x in zip(*known, (doc[rows], tag[rows], start[rows]), strict=True))
            yield _entries(out + [(b, KNOWN, b"", b"", b"", *place) for b, *place in by_bucket(doc % groups, doc, tag, start)])

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        where = lambda part: tuple(_joined(part, c, t) for c, t in (("docs", np.int64), ("tags", np.int64), ("starts", np.int32)))
        part = rows[rows.kind == PLACE]
        doc, tag, start = where(part)
        bits = _joined(part, "bits", U)
        again, _ = places.repeated(_joined(part, "words", U).reshape(-1, wide), bits, doc, tag, start)
        at, starts = places.windows(again, start)
        found.append((doc[at], tag[at], starts))
        found.append(where(rows[rows.kind == KNOWN]))
        part = rows[rows.kind == WINDOW]
        doc, tag, start = where(part)
        order, later, _ = _compare(_joined(part, "keys", U).reshape(-1, 2), doc, tag, start)
        found.append((doc[order[later]], tag[order[later]], start[order[later]]))
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("doc_id", "tag", "start"), zip(*found, strict=True), strict=True)})

    found = candidates.mapInArrow(run, _ENTRIES).groupBy("bucket").applyInPandas(meet, "doc_id long, tag long, start int")
    return texts, found.unionByName(gone.withColumn("start", F.lit(-1)))


def suffix_arrays(docs: DataFrame, window: int = 50) -> DataFrame:
    """As `repeats.remove_repeats`, by sparse suffix arrays. A window has at most 64 words more than its gram."""
    return remove_repeats(docs, window, max(1, window // 3), repeated_windows)
